"""Line dedup by deletion neighbourhoods: a line goes if an earlier line is within one edit of it.

Two lines within one edit agree outside one of a few parts that both are cut into alike, at the length m of the shorter one. So a
line's keys are hashes of all of it but one part; lines that share a key can differ in that part alone, and under the key they
emit the variants of that part within the edit bound as hashed keys: itself, and itself without each of its characters. Equal
variants meet: parts that agree without the same character differ by a substitution, a part that equals another's variant by an
insertion. A key gives each member the earliest other one by a minimum, so that no pairs of a group are ever listed; the edit
distance of a line and what it found is then verified, and the earliest stays. Variants cost a part's length squared, of which a
line has a sixteenth, from LONG characters on a 256th.

Lines that share no half with any other distinct line are left out first, which loses nothing. Only DataFrame functions are used.

Defined results: lines are compared without white space at their ends; blank lines stay and count as no line; a line of any length
counts (fuzzy_from: below it lines are only compared whole); the order is by id (null first), then the text's hash, then place, so
equal rows share their places and stay or go alike; a null text stays null; an empty table gives no rows; columns n_lines and
n_removed are replaced, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, prefix_sums, staged

FUZZY_FROM = 0
#: Parts of lines below and from LONG characters on.
PARTS, MANY_PARTS, LONG = 16, 256, 4096


def place() -> Column:
    return F.struct("__id", "__tie", "__pos")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit("\t\n\x0b\x0c\r "))


def cut(m: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Where part i of a length m begins and ends."""
    return F.floor(m * i / parts).cast("int"), F.floor(m * (i + 1) / parts).cast("int")


def but_one(line: Column, n: Column, less: int, parts: Column) -> Column:
    """Structs (less, i, key): hashes of the line without its part i, for a partner of the same length or longer (less 0) or shorter (1)."""
    m = n - less

    def of(i: Column) -> Column:
        a, z = cut(m, i, parts)
        return F.struct(F.lit(less).cast("byte").alias("less"), i.cast("short").alias("i"), F.xxhash64(i, m, F.substring(line, F.lit(1), a), F.substring(line, n - (m - z) + 1, m - z)).alias("key"))

    return F.transform(F.sequence(F.lit(0), parts - 1), of)


def parts_of(n: Column, less: Column | int) -> Column:
    return F.when(n - less < LONG, PARTS).otherwise(MANY_PARTS)


def halves(line: Column, n: Column) -> Column:
    return F.transform(F.concat(but_one(line, n, 0, F.lit(2)), but_one(line, n, 1, F.lit(2))), lambda x: x["key"])


def distinct_lines(rows: DataFrame, fuzzy_from: int) -> tuple[DataFrame, DataFrame]:
    """All lines (__id, __tie, __pos, __hash), and the distinct ones (__hash, first, n, halves)."""
    lines = rows.select("__id", "__tie", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line")).withColumn("__line", trimmed(F.col("__line"))).filter("__line <> ''")
    n = F.length("__line")
    lines = lines.select("__id", "__tie", "__pos", F.unhex(F.md5("__line")).alias("__hash"), F.when(n >= fuzzy_from, halves(F.col("__line"), n)).alias("__halves"))
    lines = staged(lines, "line-all")
    distinct = lines.groupBy("__hash").agg(F.min(place()).alias("__first"), F.count(F.lit(1)).alias("__n"), F.first("__halves").alias("__halves"))
    return lines, staged(distinct, "line-distinct")


def sharing(each: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of a written table whose key another row has, too. Both sides of the join are plain shuffles, whose hot keys are split."""
    shared = staged(each.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), name)
    return each.join(shared.hint("shuffle_merge"), key, "left_semi")


def hopeful(distinct: DataFrame) -> DataFrame:
    """(__hash, __first) of the distinct lines that share a half with another one."""
    rows = distinct.withColumn("__line_id", F.xxhash64("__hash"))
    each = staged(rows.filter("__halves is not null").select("__line_id", F.explode(F.array_distinct("__halves")).alias("__key")), "line-halves")
    found = sharing(each, "__key", "line-shared-halves").select("__line_id").distinct()
    return staged(rows.join(found.hint("shuffle_merge"), "__line_id", "left_semi").select("__hash", "__first"), "line-hopeful")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(__hash, __first) with the lines' texts, read again from where they first occur."""
    by_row = wanted.groupBy(F.col("__first.__id").alias("__id"), F.col("__first.__tie").alias("__tie")).agg(F.collect_list(F.struct("__first.__pos", "__hash")).alias("__at"))
    by_row = staged(by_row.select(F.coalesce(F.col("__id").cast("string"), F.lit("~")).alias("__key"), "__tie", "__at"), "line-wanted")
    own = rows.withColumn("__key", F.coalesce(F.col("__id").cast("string"), F.lit("~")))
    got = join_counted(own, by_row, ["__key", "__tie"], "inner", by_row.count(), 256)
    got = got.select("__id", "__tie", F.split("__text", "\n").alias("__lines"), F.explode("__at").alias("__one"))
    line = trimmed(F.element_at("__lines", F.col("__one.__pos") + 1))
    return got.select(F.col("__one.__hash").alias("__hash"), F.struct("__id", "__tie", F.col("__one.__pos").alias("__pos")).alias("__first"), line.alias("__line")).dropDuplicates(["__hash"])


def earlier_near(texts: DataFrame) -> DataFrame:
    """(__hash) of the lines that have an earlier distinct line within one edit."""
    n, line = F.length("__line"), F.col("__line")
    texts = staged(prefix_sums(texts, [F.col("__first"), F.col("__hash")], {"__line_id": F.lit(1)}, "line-numbers"), "line-numbered")  # by first place
    keys = F.concat(*(but_one(line, n, less, parts_of(n, less)) for less in (0, 1)))
    each = staged(texts.select("__line_id", F.inline(keys)), "line-parts")
    close = sharing(each, "key", "line-shared-parts")
    close = close.join(texts.select("__line_id", "__line").hint("shuffle_merge"), "__line_id")
    m = n - F.col("less")
    a, z = cut(m, F.col("i"), parts_of(n, F.col("less")))
    close = staged(close.select("__line_id", "key", "less", "i", F.substring(line, a + 1, n - (m - z) - a).alias("__part")), "line-close")
    size = F.length("__part")
    variants = close.filter(size > 0).select("__line_id", "key", "less", "i", "__part", F.explode(F.sequence(F.lit(1), size)).alias("p"))
    without = F.concat(F.substring("__part", F.lit(1), F.col("p") - 1), F.substring("__part", F.col("p") + 1, size))
    # kind 0: without the character at a place, for a partner of the same length; 1: without some character, for a shorter one; 2: the
    # part itself, for a longer one
    variants = variants.select("__line_id", F.col("less").alias("kind"), "i", F.xxhash64("key", without, F.when(F.col("less") == 0, F.col("p")).otherwise(0)).alias("key"))
    whole = close.filter("less = 0").select("__line_id", F.lit(2).cast("byte").alias("kind"), "i", F.xxhash64("key", "__part", F.lit(0)).alias("key"))
    emitted = staged(variants.unionAll(whole), "line-variants")
    met = emitted.groupBy("key").agg(F.min(F.when(F.col("kind") < 2, F.col("__line_id"))).alias("cut"), F.min(F.when(F.col("kind") == 2, F.col("__line_id"))).alias("full"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    partner = F.when(F.col("kind") == 1, F.col("full")).otherwise(F.col("cut"))
    found = emitted.join(staged(met.drop("n"), "line-met").hint("shuffle_merge"), "key").withColumn("__near", partner).filter(F.col("__near") < F.col("__line_id"))
    found = found.groupBy("__line_id").agg(F.min(F.struct("__near", "kind", "i")).alias("f")).select("__line_id", "f.*")
    found = found.join(texts.select("__line_id", "__hash", "__line").hint("shuffle_merge"), "__line_id")
    found = found.join(texts.select(F.col("__line_id").alias("__near"), F.col("__line").alias("__earlier")).hint("shuffle_merge"), "__near")
    # both lines in three: what must be equal at both ends, and the part between, whose distance counts
    m = n - (F.col("kind") == 1).cast("int")
    a, z = cut(m, F.col("i"), F.when(m < LONG, PARTS).otherwise(MANY_PARTS))
    found = found.withColumns({"__a": a, "__z": m - z})
    own, other = ((F.substring(x, F.lit(1), F.col("__a")), F.substring(x, F.col("__a") + 1, F.length(x) - F.col("__z") - F.col("__a")), F.substring(x, F.length(x) - F.col("__z") + 1, F.col("__z"))) for x in (line, F.col("__earlier")))
    return found.filter((own[0] == other[0]) & (own[2] == other[2]) & (F.levenshtein(own[1], other[1], 1) >= 0)).select("__hash")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fuzzy_from: int = FUZZY_FROM) -> DataFrame:
    """docs without the lines that an earlier line is near to, with n_lines (not blank) before and n_removed."""
    tie = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), tie.alias("__tie"), F.col(text_col).alias("__text"))
    lines, distinct = distinct_lines(rows, fuzzy_from)
    near = staged(earlier_near(staged(texts_of(rows, hopeful(distinct)), "line-texts")), "line-near").withColumn("__gone", F.lit(True))
    rules = distinct.select("__hash", "__first", "__n").join(near.hint("shuffle_merge"), "__hash", "left").filter("__n > 1 or __gone").select("__hash", "__first", "__gone")
    gone = lines.select("__id", "__tie", "__pos", "__hash").join(staged(rules, "line-rules").hint("shuffle_merge"), "__hash").filter(F.col("__gone") | (place() > F.col("__first")))
    gone = gone.groupBy(F.coalesce(F.col("__id").cast("string"), F.lit("~")).alias("__key"), "__tie").agg(F.sort_array(F.collect_set("__pos")).alias("__at"))
    gone = staged(gone, "line-gone")
    out = docs.withColumns({"__key": F.coalesce(F.col(id_col).cast("string"), F.lit("~")), "__tie": tie})
    out = join_counted(out, gone, ["__key", "__tie"], "left", gone.count(), 128)
    all_ = F.split(F.col(text_col), "\n")
    edge = F.concat(F.array(F.lit(-1)), F.col("__at"), F.array(F.size(all_)))
    parts = F.transform(F.sequence(F.lit(0), F.size("__edge") - 2), lambda i: F.slice(F.col("__all"), F.get("__edge", i) + 2, F.get("__edge", i + 1) - F.get("__edge", i) - 1))
    out = out.withColumns({"__all": all_, "__edge": edge})
    text = F.when(F.col("__at").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(parts), "\n"))
    blank = F.size(F.filter("__all", lambda x: F.length(trimmed(x)) == 0))
    extra = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__all") - blank), "n_removed": F.coalesce(F.size("__at"), F.lit(0))}
    kept = [c for c in docs.columns if c not in extra]
    return out.select(*((text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in kept), *(v.cast("int").alias(k) for k, v in extra.items()))
