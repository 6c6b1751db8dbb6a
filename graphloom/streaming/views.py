"""Streams of lines of N-Triples or N-Quads into a store, and views that follow it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.engine import Result
from graphloom.functions.values import BLANK, IRI, LITERAL
from graphloom.sources.files import by_line, from_texts
from graphloom.store import Store


def stream_into(store: Store, folder: str, checkpoint: str, after: Callable[[Store], None] | None = None) -> StreamingQuery:
    """Adds every new file of a folder to the store, a batch at a time; inserting a batch twice changes nothing, as graphs are sets."""
    lines = store.spark.readStream.schema("value string").text(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def take(batch: DataFrame, _: int) -> None:
        store.insert(from_texts(by_line(batch)))
        if after:
            after(store)

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class View:
    """A query's result, kept until the store changes."""

    store: Store
    text: str
    version: int = -1
    held: Any = field(default=None)

    def df(self) -> DataFrame:
        if self.version != self.store.version:
            self.held, self.version = self.store.query(self.text).df, self.store.version
        return self.held


@dataclass
class Handlers:
    """A chain of handlers that rows of quads pass: filters, a limit, counts; the batch form of push handlers."""

    df: DataFrame

    def only(self, condition: Any) -> Handlers:
        return Handlers(self.df.filter(condition))

    def graph(self, iri: str | None) -> Handlers:
        return Handlers(self.df.withColumn("g", F.lit(iri).cast("string")))

    def paged(self, limit: int | None = None, offset: int = 0) -> Handlers:
        out = self.df.orderBy("g", "s", "p", "o").offset(offset)
        return Handlers(out if limit is None else out.limit(limit))

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def by_predicate(self) -> DataFrame:
        return self.df.groupBy("p").agg(F.count(F.lit(1)).alias("n"))

    def without_duplicates(self) -> Handlers:
        return Handlers(self.df.distinct())

    def iris(self) -> DataFrame:
        """(value) every IRI among subjects, predicates and objects."""
        found = self.df.select(F.explode(F.array(F.when(F.col("s.kind") == IRI, F.col("s.lex")), F.col("p"), F.when(F.col("o.kind") == IRI, F.col("o.lex")))).alias("value"))
        return found.filter("value is not null").distinct()

    def texts(self) -> DataFrame:
        """(value) the text of every literal."""
        return self.df.filter(F.col("o.kind") == LITERAL).select(F.col("o.lex").alias("value")).distinct()

    def own_blank_nodes(self, scope: str) -> Handlers:
        """Labels of blank nodes begin with scope, so that those of two sources differ."""

        def own(name: str) -> Column:
            t = F.col(name)
            return F.when(t["kind"] == BLANK, t.withField("lex", F.concat(F.lit(scope), t["lex"]))).otherwise(t)

        return Handlers(self.df.withColumn("s", own("s")).withColumn("o", own("o")))

    def to_all(self, *handlers: Callable[[Handlers], Any]) -> list[Any]:
        """Every handler gets the same rows; what they return."""
        return [h(self) for h in handlers]

    def into(self, store: Store) -> None:
        store.insert(self.df)


def merged_results(*results: Result) -> DataFrame:
    """The solutions of several queries as one table of terms; a variable that one of them lacks is unbound there."""
    out = results[0].terms
    for r in results[1:]:
        out = out.unionByName(r.terms, allowMissingColumns=True)
    return out
