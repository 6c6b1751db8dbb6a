"""Mixing sources to target weights: exponential keys (Efraimidis and Spirakis) scaled by document quality.

Each source gets a budget of words. Whole epochs come first: a budget of 2.4 times the source's size takes every
document twice and then a sample worth 0.4. The sample is the start of the source in the order of the keys -ln(u) / quality.
The place where a budget ends is found from sums by key range, in two levels, so that no task ever sorts a whole source; the
decision about a document then is a comparison with its source's cut. No Python runs on the executors.

Defined results: a null text counts as empty (size 0); sources order by code point, null last, and a null source is a source;
documents of no words never count towards a budget, and follow their source's cut; a source of no words takes nothing; rows
that agree in id and text share one key, hence one decision; an empty table gives an empty mix; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, prefix_sums, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Key ranges: steps in an octave of the key's value, and finer steps in each of those.
STEPS, FINER = 64, 1024


@dataclass(frozen=True)
class Mix:
    """rules: a row for each source (__sk, source_size, target, __epochs, cuts). rows: the narrow table of all documents with their keys."""

    rows: DataFrame
    rules: DataFrame
    sources: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column) -> Column:
    """Weight of a document: very short texts are drawn less readily."""
    return F.least(F.lit(1.0), F.lit(0.25) + size / F.lit(400.0))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with __sk (source as a key without nulls), __size, __key, __tie and __range, the key's range."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))
    out = docs.withColumns({"__sk": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("~null")), "__size": word_count(F.col(text_col)), "__tie": F.md5(name)})
    u = (F.conv(F.substring("__tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = out.withColumn("__key", -F.log(u) / quality(F.col("__size")))
    return out.withColumn("__range", F.floor(F.log2(F.col("__key")) * float(STEPS * FINER)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes(__sk, source_size) with target: all words shared out by weight, no source above most times its size.

    With sources ordered by the level at which they fill up, a source is full exactly if filling all sources up to its level
    takes no more words than there are; that replaces sharing the excess again and again.
    """
    ranked = prefix_sums(sizes, [F.col("__sk")], {"__rank": F.lit(1)}, "mix-rank")
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("__cap", (F.col("source_size") * most).cast("double")).withColumn("__level", F.col("__cap") / F.col("__w"))
    filled = staged(prefix_sums(ranked, [F.col("__level"), F.col("__sk")], {"__caps": F.col("__cap"), "__ws": F.col("__w")}, "mix-level"), "mix-filled")
    all_ = filled.agg(F.sum("source_size"), F.sum("__w")).first()
    words, weight = float(all_[0] or 0), float(all_[1] or 0)
    full = F.col("__caps") + F.col("__cap") + F.col("__level") * (F.lit(weight) - F.col("__ws") - F.col("__w")) <= F.lit(words)
    filled = filled.withColumn("__full", full)
    done = filled.filter("__full").agg(F.sum("__cap"), F.sum("__w")).first()
    left, share = words - float(done[0] or 0), weight - float(done[1] or 0)
    return filled.select("__sk", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__w") * F.lit(left / share if share else 0.0)).alias("target"))


def ends(sums: DataFrame, rules: DataFrame, at: str) -> DataFrame:
    """The range in which each source's remaining budget __left ends, and what is left for that range."""
    run = Window.partitionBy("__sk").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("__sum", F.sum("__words").over(run)).withColumn("__before", F.col("__sum") - F.col("__words"))
    found = run.join(rules.select("__sk", "__left"), "__sk").filter((F.col("__before") <= F.col("__left")) & (F.col("__left") < F.col("__sum")))
    return found.groupBy("__sk").agg(F.min_by(at, "__before").alias(at), F.min(F.col("__left") - F.col("__before")).alias("__left"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> Mix:
    names = ["__sk", "__size", "__key", "__tie", "__range"]
    rows = keyed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).alias("__source")), "__id", "__text", "__source", seed)
    rows = staged(rows.select("__id", *names, F.floor(F.col("__range") / FINER).cast("long").alias("__coarse")), "mix-rows")
    coarse = staged(rows.groupBy("__sk", "__coarse").agg(F.sum("__size").alias("__words")), "mix-coarse")
    rules = targets(coarse.groupBy("__sk").agg(F.sum("__words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rules = rules.withColumn("__epochs", epochs).withColumn("__left", F.col("target") - F.col("__epochs") * F.col("source_size"))
    rules = staged(rules, "mix-rules")
    sources = rules.count()
    near = join_counted(rows, ends(coarse, rules, "__coarse"), ["__sk", "__coarse"], "inner", sources)
    near = staged(near, "mix-near")  # what lies in the coarse ranges where the budgets end
    fine = ends(near.groupBy("__sk", "__range").agg(F.sum("__size").alias("__words")), near.groupBy("__sk").agg(F.first("__left").alias("__left")), "__range")
    last = join_counted(near.drop("__left"), fine, ["__sk", "__range"], "inner", sources)
    before = Window.partitionBy("__sk").orderBy("__key", "__tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("__sum", F.sum("__size").over(before))
    within = F.when(F.col("__sum") <= F.col("__left"), F.struct("__key", "__tie"))
    last = last.groupBy("__sk").agg(F.first("__range").alias("__cut"), F.max(within).alias("__at"), (F.first("__left") - F.coalesce(F.max(F.when(F.col("__sum") <= F.col("__left"), F.col("__sum"))), F.lit(0))).alias("__gap"))
    cuts = staged(rules.drop("__left").join(last, "__sk", "left"), "mix-cuts")
    # what the prefix leaves of a budget is under one document: the later document that comes nearest to it fills it
    out = join_counted(rows, cuts, "__sk", "inner", sources, 128).filter((F.col("__size") > 0) & ~into())
    off = F.abs(F.col("__size") - F.col("__gap"))
    fill = out.filter(off < F.col("__gap")).groupBy("__sk").agg(F.min_by("__tie", F.struct(off, "__key", "__tie")).alias("__fill"))
    return Mix(rows, staged(cuts.drop("__gap").join(fill, "__sk", "left"), "mix-fill"), sources)


def into() -> Column:
    """Whether a keyed row lies before its source's cut."""
    own = F.struct("__key", "__tie")
    return F.coalesce((F.col("__range") < F.col("__cut")) | ((F.col("__range") == F.col("__cut")) & (own <= F.col("__at"))), F.lit(False))


def copies() -> Column:
    """How often a keyed row joined with its source's rule is taken."""
    return F.col("__epochs") + (into() | F.coalesce(F.col("__tie") == F.col("__fill"), F.lit(False))).cast("long")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: id, size, source_size, target, copies and taken, the words that the mix takes from it."""
    mix = plan(docs, **options)
    out = join_counted(mix.rows, mix.rules, "__sk", "inner", mix.sources, 128).withColumn("copies", copies())
    return out.select(F.col("__id").alias(options.get("id_col", "doc_id")), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as the mix takes it. Texts aren't shuffled; a source's rule decides on each row."""
    mix = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    rows = keyed(docs, id_col, text_col, source_col, seed)
    rows = join_counted(rows, mix.rules.drop("source_size", "target"), "__sk", "inner", mix.sources, 128)
    rows = rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
