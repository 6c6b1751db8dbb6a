"""A store of quads that updates change: each command makes a new table, written to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine, Result
from graphloom.plans import algebra as A
from graphloom.plans.compiler import Context
from graphloom.plans.parameters import Parameterized
from graphloom.plans.parser import parse_update
from graphloom.sources.files import read_files, read_text
from graphloom.sources.quads import SCHEMA, QuadSource
from graphloom.staging import kept


class UpdateProblem(ValueError):
    pass


@dataclass
class Store:
    spark: SparkSession
    source: QuadSource
    prefixes: dict[str, str] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)  # graphs made empty
    version: int = 0

    @classmethod
    def of_text(cls, spark: SparkSession, text: str, how: str = "turtle", prefixes: dict[str, str] | None = None) -> Store:
        return cls(spark, read_text(spark, text, how), dict(prefixes or {}))

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(spark, QuadSource.empty(spark))

    def engine(self, source: QuadSource | None = None, **options: Any) -> Engine:
        return Engine(self.spark, source or self.source, self.prefixes, **options)

    def query(self, text: str) -> Result:
        return self.engine().query(text)

    def replace(self, quads: DataFrame) -> None:
        self.source = replace(self.source, quads=kept(quads.distinct(), "quads"))
        self.version += 1

    def insert(self, quads: DataFrame) -> None:
        self.replace(self.source.quads.unionAll(quads.select("s", "p", "o", "g")))

    def delete(self, quads: DataFrame) -> None:
        """Removes quads; a null graph is the default graph."""
        gone = quads.select(*(F.col(c).alias(f"d{c}") for c in "spog")).distinct()
        q = self.source.quads
        self.replace(q.join(gone, (q["s"] == gone["ds"]) & (q["p"] == gone["dp"]) & (q["o"] == gone["do"]) & q["g"].eqNullSafe(gone["dg"]), "left_anti"))

    def update(self, text: str | Parameterized) -> None:
        """Commands one after the other; each sees what those before it did."""
        for c in parse_update(str(text), prefixes=self.prefixes):
            try:
                self.run(c)
            except Exception:
                if not c.options.get("silent"):
                    raise

    def explain(self, text: str, mode: str = "formatted") -> list[str]:
        """The plan of each command's pattern, or the command itself where it has none; nothing is changed."""
        out = []
        for c in parse_update(text, prefixes=self.prefixes):
            if c.kind == "MODIFY":
                source = self.source.dataset(c.options["using"], c.options["named"])
                df = self.engine(source).compiler(source).pattern(c.options["pattern"], Context()).df
                out.append(f"{c.kind}\n" + df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode))
            else:
                out.append(c.kind)
        return out

    def graph_names(self) -> set[str]:
        return {r["g"] for r in self.source.quads.select("g").distinct().filter("g is not null").collect()} | self.known

    def run(self, c: A.Command) -> None:
        o = c.options
        if c.kind in ("INSERT DATA", "DELETE DATA"):
            rows = self.instances(None, o["quads"], None)
            (self.insert if c.kind == "INSERT DATA" else self.delete)(rows)
        elif c.kind == "MODIFY":
            self.modify(o)
        elif c.kind == "LOAD":
            found = read_files(self.spark, o["source"].removeprefix("file://")).quads
            if o["into"]:
                found = found.withColumn("g", F.lit(o["into"]))
            self.insert(found)
        elif c.kind in ("CLEAR", "DROP"):
            self.clear(o["target"], drop=c.kind == "DROP")
        elif c.kind == "CREATE":
            if o["target"] in self.graph_names():
                raise UpdateProblem(f"graph {o['target']} exists")
            self.known.add(o["target"])
        elif c.kind in ("ADD", "COPY", "MOVE"):
            self.transfer(c.kind, o["source"], o["target"])

    def rows_of(self, target: str) -> Any:
        g = F.col("g")
        return {"DEFAULT": g.isNull(), "NAMED": g.isNotNull(), "ALL": F.lit(True)}.get(target, F.coalesce(g == target, F.lit(False)))

    def clear(self, target: str, drop: bool = False) -> None:
        if target not in ("DEFAULT", "NAMED", "ALL") and target not in self.graph_names():
            raise UpdateProblem(f"no graph {target}")
        self.replace(self.source.quads.filter(~self.rows_of(target)))
        if drop:
            self.known -= self.known if target in ("NAMED", "ALL") else {target}
        elif target not in ("DEFAULT", "NAMED", "ALL"):
            self.known.add(target)

    def transfer(self, kind: str, source: str, target: str) -> None:
        if source == target:
            return
        if source != "DEFAULT" and source not in self.graph_names():
            raise UpdateProblem(f"no graph {source}")
        q = self.source.quads
        to = F.lit(None if target == "DEFAULT" else target).cast("string")
        moved = q.filter(self.rows_of(source)).withColumn("g", to)
        stay = q if kind == "ADD" else q.filter(~self.rows_of(target))
        if kind == "MOVE":
            stay = stay.filter(~self.rows_of(source))
            self.known.discard(source)
        self.replace(stay.unionAll(moved))

    def instances(self, solutions: Any, template: list, with_: str | None) -> DataFrame:
        compiler = self.engine().compiler()
        rows = compiler.instances(solutions if solutions is not None else compiler.identity(), [(g if g is not None else A.Iri(with_) if with_ else None, t) for g, t in template])
        return rows.select("s", F.col("p.lex").alias("p"), "o", F.col("g.lex").alias("g")) if template else self.spark.createDataFrame([], SCHEMA)

    def modify(self, o: dict) -> None:
        """Both templates are filled from the same solutions, taken before anything changes; deletions come first."""
        source = self.source.dataset(o["using"], o["named"])
        if o["with"] and not o["using"] and not o["named"]:
            source = replace(self.source, default=(o["with"],))
        s = self.engine(source).compiler(source).pattern(o["pattern"], Context())
        s = replace(s, df=kept(s.df, "solutions")) if s.vars else s
        gone, new = (self.instances(s, o[x], o["with"]) for x in ("delete", "insert"))
        gone, new = kept(gone, "deleted"), kept(new, "inserted")
        if o["delete"]:
            self.delete(gone)
        if o["insert"]:
            self.insert(new)
