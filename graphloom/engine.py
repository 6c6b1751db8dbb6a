"""The engine's front: queries over a source, and updates of a store of quads."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.builtins import Function
from graphloom.functions.values import Val, as_term, text_of, written
from graphloom.operators.describe import describe
from graphloom.plans import algebra as A
from graphloom.plans.compiler import Compiler, Context
from graphloom.plans.parameters import Parameterized
from graphloom.plans.parser import parse_query
from graphloom.plans.solutions import Solutions, ref


@dataclass(frozen=True)
class Result:
    """form SELECT: solutions; ASK: answer; CONSTRUCT and DESCRIBE: triples (s, p, o as terms)."""

    form: str
    solutions: Solutions | None = None
    answer: bool | None = None
    triples: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        """A plain column for each variable: native where the type is known, the text of IRIs and tagged literals, else N-Triples."""
        s = self.solutions

        def plain(v: Val) -> Any:
            return text_of(v) if v.kind in ("iri", "lang") else written(v.col) if v.kind == "term" else v.col

        return s.df.select(*(plain(s.val(n)).alias(n) for n in s.vars))

    @property
    def terms(self) -> DataFrame:
        """A term column for each variable."""
        s = self.solutions
        return s.df.select(*(as_term(s.val(n)).col.alias(n) for n in s.vars))


class QueryTimeout(TimeoutError):
    """A query took longer than it may."""


@dataclass
class Engine:
    """source: quads or a mapped graph. functions: custom functions by IRI. properties: property functions by IRI. aliases:
    namespaces that mean one of the built-in ones. service: answers SERVICE patterns. timeout: seconds that `rows` may take (None:
    any); partial: then it gives the rows it has instead of an error."""

    spark: SparkSession
    source: Any
    prefixes: dict[str, str] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    properties: dict[str, Callable[..., Solutions]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    service: Callable[[str, Any], Solutions] | None = None
    describer: str = "cbd"
    timeout: float | None = None
    partial: bool = False

    def compiler(self, source: Any = None) -> Compiler:
        return Compiler(self.spark, source or self.source, self.functions, self.properties, self.service)

    def parse(self, text: str) -> A.Query:
        return parse_query(text, prefixes=self.prefixes, aliases=self.aliases)

    def query(self, text: str | A.Query | Parameterized) -> Result:
        q = text if isinstance(text, A.Query) else self.parse(str(text))
        c = self.compiler(self.source.dataset(q.default_graphs, q.named_graphs))
        if q.form == "SELECT":
            return Result("SELECT", c.select(q, Context()))
        if q.form == "ASK":
            return Result("ASK", answer=c.ask(q))
        if q.form == "CONSTRUCT":
            return Result("CONSTRUCT", triples=c.construct(q))
        return Result("DESCRIBE", triples=describe(c, q, self.describer))

    def select(self, text: str) -> DataFrame:
        return self.query(text).df

    def rows(self, text: str | A.Query) -> list[Row]:
        """A small result's rows, within the engine's timeout; rounds of paths count, too. Partitions arrive one after the other."""
        sc, tag, over, out = self.spark.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event(), []

        def stop() -> None:
            over.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout, stop) if self.timeout is not None else None
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            if timer:
                timer.start()
            df = self.query(text).df
            if not self.partial:
                out = df.collect()
            else:
                for row in df.toLocalIterator():
                    if over.is_set():
                        break
                    out.append(row)
        except Exception:
            if not over.is_set():
                raise
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)
            sc.setInterruptOnCancel(False)
        if over.is_set() and not self.partial:
            raise QueryTimeout(f"no result within {self.timeout} seconds")
        return out

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a SELECT, CONSTRUCT or DESCRIBE, or of an ASK's pattern; nothing runs but the rounds of paths and descriptions."""
        q = self.parse(text)
        result = Result("SELECT", self.compiler(self.source.dataset(q.default_graphs, q.named_graphs)).pattern(q.pattern, Context())) if q.form == "ASK" else self.query(q)
        df = result.triples if result.triples is not None else result.solutions.df
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def ask(self, text: str) -> bool:
        return bool(self.query(text).answer)

    def ask_frame(self, text: str) -> DataFrame:
        """The answer as a row, made by the plan itself."""
        q = self.parse(text)
        s = self.compiler().pattern(q.pattern, Context())
        return s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
