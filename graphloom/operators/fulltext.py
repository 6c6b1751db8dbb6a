"""Full-text search over literals: a table of words, and a property function (?subject or literal <text:query> "words")."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import LITERAL
from graphloom.plans import algebra as A
from graphloom.plans.solutions import Info, Solutions, column
from graphloom.sources.quads import QuadSource

QUERY = "urn:graphloom:text#query"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


@dataclass(frozen=True)
class TextIndex:
    """postings(word, doc, n): how often a word occurs in a document; docs(doc, length)."""

    postings: DataFrame
    docs: DataFrame

    @staticmethod
    def of(rows: DataFrame, doc: str, text: str) -> TextIndex:
        each = rows.select(F.col(doc).alias("doc"), words_of(F.col(text)).alias("w"))
        return TextIndex(each.select("doc", F.explode("w").alias("word")).groupBy("word", "doc").agg(F.count(F.lit(1)).alias("n")), each.select("doc", F.size("w").alias("length")))

    def search(self, query: str, every: bool = True) -> DataFrame:
        """(doc, score) of the documents that hold every word (or any), scored by BM25."""
        words = sorted({w for w in _words(query)})
        hits = self.postings.filter(F.col("word").isin(words))
        stats = self.docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row for each word asked for
        found = hits.join(F.broadcast(df), "word").join(self.docs, "doc").crossJoin(F.broadcast(stats))  # one row
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("n") * 2.2 / (F.col("n") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
        out = found.groupBy("doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("k"))
        return out.filter(F.col("k") >= (len(words) if every else 1)).select("doc", "score")


def _words(query: str) -> list[str]:
    import re

    return re.findall(r"\w+", query.lower())


def text_property(source: QuadSource) -> dict[str, Any]:
    """A property function: subjects whose literals hold every word of a constant string."""

    def run(compiler: Any, t: A.Triple, c: Any) -> Solutions:
        rows = source.in_graph(c.graph).filter(F.col("o.kind") == LITERAL).select("s", F.col("o.lex").alias("text"))
        ok = F.lit(True)
        have = words_of(F.col("text"))
        for w in sorted(set(_words(t.o.value))):
            ok = ok & F.array_contains(have, w)
        found = rows.filter(ok).select(F.col("s").alias(column(t.s.name))).distinct()
        return Solutions(found, {t.s.name: Info("term")})

    return {QUERY: run}


def contains_words(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every word, without an index: one scan."""
    ok = F.lit(True)
    for w in sorted(set(_words(query))):
        ok = ok & F.array_contains(words_of(F.col(text)), w)
    return rows.filter(ok)
