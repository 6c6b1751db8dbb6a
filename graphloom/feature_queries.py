"""Queries for single functions, shape constraints and ways of describing, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import fulltext, inference, shacl
from graphloom.plans.algebra import XSD
from graphloom.plans.parameters import Parameterized
from graphloom.sources import files, results
from graphloom.sources.mapped import tables_in
from graphloom.sources.quads import QuadSource
from graphloom.staging import shared_dir
from graphloom.store import Store
from graphloom.streaming.views import Handlers, merged_results

#: name: (tables, SPARQL, DuckDB SQL)
PAIRS: dict[str, tuple[str, str, str]] = {}


def rounded(name: str, table: str, key: str, variables: dict[str, str], given: dict[str, tuple[str, str]]) -> None:
    """Numbers by function, to six digits. given: of each result its expression in both languages."""
    prefix = f"?x {table}:{key} ?k ; " + " ; ".join(f"{table}:{c} ?{v}" for v, c in variables.items())
    sparql = "SELECT ?k " + " ".join(f"(ROUND({e} * 1000000) AS ?{n})" for n, (e, _) in given.items()) + f" {{ {prefix} }}"
    sql = f"SELECT {key} AS k, " + ", ".join(f"floor(({e}) * 1000000 + 0.5) AS {n}" for n, (_, e) in given.items()) + f" FROM {table}"
    PAIRS[name] = (table, sparql, sql)


def valued(name: str, table: str, key: str, variables: dict[str, str], given: dict[str, tuple[str, str]], where: str = "") -> None:
    prefix = f"?x {table}:{key} ?k ; " + " ; ".join(f"{table}:{c} ?{v}" for v, c in variables.items())
    sparql = "SELECT ?k " + " ".join(f"({e} AS ?{n})" for n, (e, _) in given.items()) + f" {{ {prefix} {where} }}"
    PAIRS[name] = (table, sparql, f"SELECT {key} AS k, " + ", ".join(f"{e} AS {n}" for n, (_, e) in given.items()) + f" FROM {table}")


SIZE, PRICE = {"s": "p_size"}, {"s": "p_size", "p": "p_retailprice"}
rounded("fn_trig_others", "part", "p_partkey", SIZE, {"a": ("ext:tan(?s)", "tan(p_size)"), "b": ("ext:sec(?s)", "1 / cos(p_size)"), "c": ("ext:cosec(?s)", "1 / sin(p_size)"), "d": ("ext:cotan(?s)", "1 / tan(p_size)")})
rounded("fn_trig_inverse", "part", "p_partkey", SIZE, {"a": ("ext:sin-1(?s / 100)", "asin(p_size / 100)"), "b": ("ext:cos-1(?s / 100)", "acos(p_size / 100)"), "c": ("ext:tan-1(?s)", "atan(p_size)"), "d": ("ext:sec-1(?s)", "acos(1 / p_size)"), "e": ("ext:cosec-1(?s)", "asin(1 / p_size)"), "f": ("ext:cotan-1(?s)", "atan(1 / p_size)")})
rounded("fn_degrees", "part", "p_partkey", SIZE, {"a": ("ext:radians-to-degrees(?s)", "degrees(p_size)")})
rounded("fn_logarithms", "part", "p_partkey", PRICE, {"a": ("ext:ln(?p)", "ln(p_retailprice)"), "b": ("ext:log(?p)", "log10(p_retailprice)"), "c": ("ext:log(?p, 2)", "ln(p_retailprice) / ln(2)"), "d": ("ext:e(?s / 10)", "exp(p_size / 10)")})
rounded("fn_powers", "part", "p_partkey", SIZE, {"a": ("ext:pow(?s, 2)", "power(p_size, 2)"), "b": ("ext:root(?s, 3)", "power(p_size, 1.0 / 3)"), "c": ("ext:ten(?s / 10)", "power(10.0::DOUBLE, p_size::DOUBLE / 10)"), "d": ("ext:reciprocal(?s)", "1.0::DOUBLE / p_size"), "e": ("ext:sqrt(?s)", "sqrt(p_size)")})
rounded("fn_distances", "part", "p_partkey", PRICE, {"a": ("ext:pythagoras(?s, ?p)", "sqrt(p_size * p_size + p_retailprice * p_retailprice)"), "b": ("ext:cartesian(?s, ?p, 0, 1)", "sqrt(p_size * p_size + (p_retailprice - 1) * (p_retailprice - 1))")})
rounded("fn_constants", "region", "r_regionkey", {"n": "r_name"}, {"a": ("afn:pi()", "pi()"), "b": ("afn:e()", "exp(1.0)"), "c": ("ext:pi()", "pi()")})
valued("fn_random_range", "part", "p_partkey", SIZE, {"a": ("IF(ext:rnd() >= 0 && ext:rnd() < 1, 1, 0)", "1::BIGINT"), "b": ("IF(RAND() >= 0 && RAND() < 1, 1, 0)", "1::BIGINT"), "c": ("IF(ext:rnd(5, 7) >= 5, 1, 0)", "1::BIGINT")})
valued("fn_min_max", "part", "p_partkey", SIZE, {"a": ("afn:min(?s, 10)", "CAST(least(p_size, 10) AS BIGINT)"), "b": ("afn:max(?s, 20)", "CAST(greatest(p_size, 20) AS BIGINT)")})
valued("fn_date_parts_xpath", "events", "event_id", {"t": "ts"}, {"a": ("fn:year-from-dateTime(?t)", "year(ts)"), "b": ("fn:month-from-dateTime(?t)", "month(ts)"), "c": ("fn:day-from-dateTime(?t)", "day(ts)"), "d": ("fn:hours-from-dateTime(?t)", "hour(ts)"), "e": ("fn:minutes-from-dateTime(?t)", "minute(ts)"), "f": ("xsd:integer(fn:seconds-from-dateTime(?t))", "CAST(second(ts) AS BIGINT)")})
rounded("fn_seconds", "events", "event_id", {"t": "ts"}, {"a": ("xsd:double(SECONDS(?t))", "CAST(microsecond(ts) AS DOUBLE) / 1000000")})
valued("fn_now", "region", "r_regionkey", {"n": "r_name"}, {"a": ("NOW() = NOW()", "true"), "b": ("NOW() > '2020-01-01T00:00:00Z'^^xsd:dateTime", "true"), "c": ("afn:now() >= NOW()", "true")})
valued("fn_timezone", "events", "event_id", {"t": "ts"}, {"a": ("STR(TIMEZONE(?t))", "'PT0S'"), "b": ("STR(fn:timezone-from-dateTime(?t))", "'PT0S'")})
valued("fn_string_xpath", "part", "p_partkey", {"n": "p_name", "b": "p_brand"}, {"a": ("fn:string-length(?n)", "length(p_name)"), "c": ("fn:upper-case(?n)", "upper(p_name)"), "d": ("fn:lower-case(?n)", "lower(p_name)"), "e": ("fn:contains(?n, '00')", "contains(p_name, '00')"), "f": ("fn:starts-with(?n, 'P')", "starts_with(p_name, 'P')"), "g": ("fn:ends-with(?n, '1')", "ends_with(p_name, '1')"), "h": ("fn:substring(?n, 2, 3)", "substring(p_name, 2, 3)"), "i": ("fn:substring-before(?b, '#')", "CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END"), "j": ("fn:substring-after(?b, '#')", "CASE WHEN contains(p_brand, '#') THEN substring(p_brand, position('#' IN p_brand) + 1) ELSE '' END")})
valued("fn_string_xpath_more", "part", "p_partkey", {"n": "p_name", "b": "p_brand"}, {"a": ("fn:concat(?n, '|', ?b)", "p_name || '|' || p_brand"), "c": ("fn:replace(?n, '[0-9]', 'x')", "regexp_replace(p_name, '[0-9]', 'x', 'g')"), "d": ("fn:matches(?n, '1$')", "regexp_matches(p_name, '1$')"), "e": ("fn:encode-for-uri(?b)", "replace(p_brand, '#', '%23')"), "f": ("fn:escape-html-uri(CONCAT(?n, 'é'))", "p_name || '%C3%A9'"), "g": ("fn:normalize-space(CONCAT('  ', ?n, '   x '))", "trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' x'"), "h": ("fn:normalize-unicode('é')", "'é'"), "i": ("fn:compare(?n, ?b)", "CASE WHEN p_name < p_brand THEN -1 WHEN p_name > p_brand THEN 1 ELSE 0 END"), "l": ("afn:strjoin('+', ?n, ?b)", "p_name || '+' || p_brand"), "m": ("afn:substr(?n, 1, 3)", "substring(p_name, 2, 2)")})
valued("fn_numeric_xpath", "lineitem", "l_orderkey", {"q": "l_extendedprice", "l": "l_linenumber"}, {"a": ("fn:abs(0 - ?q)", "l_extendedprice"), "b": ("fn:ceiling(?q)", "ceil(l_extendedprice)"), "c": ("fn:floor(?q)", "floor(l_extendedprice)"), "d": ("fn:round(?q)", "floor(l_extendedprice + 0.5)"), "e": ("fn:round-half-to-even(?l / 2.0e0)", "round_even(l_linenumber / 2, 0)")})
valued("fn_hash_more", "part", "p_partkey", {"n": "p_name"}, {"a": ("ext:md5hash(?n)", "md5(p_name)"), "b": ("ext:sha256hash(?n)", "sha256(p_name)"), "c": ("afn:sha1sum(?n)", "sha1(p_name)"), "d": ("STRLEN(SHA384(?n))", "96"), "e": ("STRLEN(SHA512(?n))", "128"), "f": ("SHA384(?n) = SHA384(CONCAT(?n, ''))", "true"), "g": ("SHA512('abc')", "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'"), "h": ("SHA384('abc')", "'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7'")})
valued("fn_casts_more", "part", "p_partkey", {"s": "p_size", "p": "p_retailprice"}, {"a": ("xsd:double(xsd:decimal(?s))", "CAST(p_size AS DOUBLE)"), "b": ("xsd:double(xsd:float(?s))", "CAST(p_size AS DOUBLE)"), "c": ("YEAR(xsd:dateTime('2021-03-04T05:06:07Z'))", "2021::BIGINT"), "d": ("fn:boolean(?s - ?s)", "false"), "e": ("xsd:boolean('true')", "true"), "f": ("STR(xsd:string(?s))", "CAST(p_size AS VARCHAR)"), "g": ("xsd:integer('17') + ?s", "CAST(p_size + 17 AS BIGINT)"), "h": ("STR(DATATYPE(xsd:decimal(?s)))", f"'{XSD}decimal'"), "i": ("STR(DATATYPE(xsd:float(?p)))", f"'{XSD}float'")})
valued("fn_terms", "part", "p_partkey", {"n": "p_name", "s": "p_size"}, {"a": ("isURI(?x)", "true"), "b": ("isURI(?n)", "false"), "c": ("STR(DATATYPE(STRDT(?n, xsd:token)))", f"'{XSD}token'"), "d": ("STR(STRDT(?n, xsd:token))", "p_name"), "e": ("isBlank(BNODE())", "true"), "f": ("isBlank(BNODE(?n))", "true"), "g": ("isIRI(UUID())", "true"), "h": ("STRLEN(STRUUID())", "36"), "i": ("STRSTARTS(STR(UUID()), 'urn:uuid:')", "true"), "j": ("LANG(STRLANG(?n, 'en'))", "'en'"), "l": ("sameTerm(BNODE(), BNODE())", "false")})
valued("fn_quoted_parts", "part", "p_partkey", {"n": "p_name"}, {"a": ("isTRIPLE(TRIPLE(?x, <urn:says>, ?n))", "true"), "b": ("STR(SUBJECT(TRIPLE(?x, <urn:says>, ?n)))", "'urn:row:part/' || p_partkey"), "c": ("STR(PREDICATE(TRIPLE(?x, <urn:says>, ?n)))", "'urn:says'"), "d": ("STR(OBJECT(TRIPLE(?x, <urn:says>, ?n)))", "p_name"), "e": ("isTRIPLE(?n)", "false")})
valued("fn_date_moves", "orders", "o_orderkey", {"t": "o_orderdate"}, {"a": ("?t + 'P2DT3H'^^xsd:dayTimeDuration", "o_orderdate + INTERVAL 51 HOUR"), "b": ("?t - 'PT90M'^^xsd:dayTimeDuration", "o_orderdate - INTERVAL 90 MINUTE"), "c": ("'P1D'^^xsd:dayTimeDuration + 'PT1H'^^xsd:dayTimeDuration = 'PT25H'^^xsd:dayTimeDuration", "true"), "d": ("'P1D'^^xsd:dayTimeDuration - 'PT1H'^^xsd:dayTimeDuration = 'PT23H'^^xsd:dayTimeDuration", "true")})
valued("decimals_are_exact", "part", "p_partkey", {"s": "p_size"}, {"a": ("STR(1.00000000019 + 0.0)", "'1.00000000019'"), "b": ("STR(1234567890123456789.5 * 2)", "'2469135780246913579'"), "c": ("STR(0.000000000001 * 1.5)", "'0.0000000000015'"), "d": ("STR(1 / 8)", "'0.125'"), "e": ("STR(9007199254740993 / 1)", "'9007199254740993'"), "f": ("STR(10.0 / 4.0)", "'2.5'"), "g": ("STR(?s + 0.25)", "CAST(p_size AS VARCHAR) || '.25'")})
PAIRS["decimal_sums"] = ("part", "SELECT ?b (STR(SUM(?d)) AS ?sum) (STR(MAX(?d)) AS ?most) { ?x part:p_brand ?b ; part:p_size ?s BIND(?s + 0.00000000011 AS ?d) } GROUP BY ?b", "SELECT p_brand AS b, rtrim(CAST(sum(p_size + 0.00000000011::DECIMAL(18, 11)) AS VARCHAR), '0') AS sum, CAST(max(p_size) AS VARCHAR) || '.00000000011' AS most FROM part GROUP BY 1")

#: Queries that take more than one SPARQL text, and their SQL.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHAPE_PREFIXES = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix p: <urn:col:part#> . @prefix n: <urn:col:nation#> . @prefix nr: <urn:ref:nation#> . @prefix d: <urn:col:documents#> . "


def shapes(name: str, tables: str, body: str, counts: dict[str, str]) -> None:
    """Failures by constraint component. counts: of each the SQL that counts them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = shacl.validate(tables_in(spark, folder, tables.split()).quads(), SHAPE_PREFIXES + body)
        return found.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name] = run
    SQL[name] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS component, ({q}) AS n" for c, q in counts.items()) + ") WHERE n > 0"


PART = "<urn:S> a sh:NodeShape ; sh:targetClass <urn:table:part> ; "
shapes(
    "shacl_ranges",
    "part",
    PART + "sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ; sh:minExclusive 10 ] ; sh:property [ sh:path p:p_retailprice ; sh:maxExclusive 1000 ] .",
    {"MaxInclusive": "SELECT count(*) FROM part WHERE p_size > 40", "MinExclusive": "SELECT count(*) FROM part WHERE p_size <= 10", "MaxExclusive": "SELECT count(*) FROM part WHERE p_retailprice >= 1000"},
)
shapes(
    "shacl_strings",
    "part",
    PART + 'sh:property [ sh:path p:p_name ; sh:minLength 9 ; sh:pattern "1$" ] ; sh:property [ sh:path p:p_brand ; sh:hasValue "Brand#11" ; sh:maxLength 7 ] .',
    {"MinLength": "SELECT count(*) FROM part WHERE length(p_name) < 9", "Pattern": "SELECT count(*) FROM part WHERE NOT regexp_matches(p_name, '1$')", "HasValue": "SELECT count(*) FROM part WHERE p_brand <> 'Brand#11'", "MaxLength": "SELECT count(*) FROM part WHERE length(p_brand) > 7"},
)
shapes(
    "shacl_counts_and_types",
    "part",
    PART + "sh:property [ sh:path p:p_name ; sh:maxCount 0 ] ; sh:property [ sh:path p:p_none ; sh:minCount 1 ] ; sh:property [ sh:path p:p_size ; sh:datatype xsd:string ] ; sh:property [ sh:path p:p_brand ; sh:nodeKind sh:IRI ] .",
    {c: "SELECT count(*) FROM part" for c in ("MaxCount", "MinCount", "Datatype", "NodeKind")},
)
shapes(
    "shacl_pairs",
    "part",
    PART + "sh:property [ sh:path p:p_retailprice ; sh:lessThan p:p_size ] ; sh:property [ sh:path p:p_size ; sh:lessThanOrEquals p:p_partkey ] ; sh:property [ sh:path p:p_name ; sh:equals p:p_brand ] ; sh:property [ sh:path p:p_type ; sh:disjoint p:p_type ] .",
    {"LessThan": "SELECT count(*) FROM part WHERE NOT p_retailprice < p_size", "LessThanOrEquals": "SELECT count(*) FROM part WHERE NOT p_size <= p_partkey", "Equals": "SELECT 2 * count(*) FROM part WHERE p_name <> p_brand", "Disjoint": "SELECT count(*) FROM part"},
)
shapes(
    "shacl_logic",
    "part",
    PART + "sh:and ( [ sh:property [ sh:path p:p_size ; sh:minInclusive 10 ] ] [ sh:property [ sh:path p:p_size ; sh:maxInclusive 20 ] ] ) ; sh:or ( [ sh:property [ sh:path p:p_size ; sh:maxInclusive 5 ] ] [ sh:property [ sh:path p:p_size ; sh:minInclusive 45 ] ] ) ; sh:not [ sh:property [ sh:path p:p_size ; sh:minInclusive 30 ] ] ; sh:xone ( [ sh:property [ sh:path p:p_size ; sh:maxInclusive 25 ] ] [ sh:property [ sh:path p:p_size ; sh:minInclusive 20 ] ] ) .",
    {"And": "SELECT count(*) FROM part WHERE NOT p_size BETWEEN 10 AND 20", "Or": "SELECT count(*) FROM part WHERE p_size > 5 AND p_size < 45", "Not": "SELECT count(*) FROM part WHERE p_size >= 30", "Xone": "SELECT count(*) FROM part WHERE p_size BETWEEN 20 AND 25"},
)
shapes(
    "shacl_class_and_node",
    "nation region",
    "<urn:S> a sh:NodeShape ; sh:targetClass <urn:table:nation> ; sh:property [ sh:path nr:n_regionkey ; sh:class <urn:table:nation> ; sh:node <urn:T> ] . <urn:T> a sh:NodeShape ; sh:property [ sh:path <urn:col:region#r_name> ; sh:hasValue 'ASIA' ] .",
    {"Class": "SELECT count(*) FROM nation", "Node": "SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"},
)
shapes(
    "shacl_closed",
    "region",
    "<urn:S> a sh:NodeShape ; sh:targetClass <urn:table:region> ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path <urn:col:region#r_name> ] .",
    {"Closed": "SELECT count(*) FROM region"},
)


def by_subject(name: str, way: str, sql: str) -> None:
    """Triples of a description, counted by subject."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = Engine(spark, tables_in(spark, folder, ["region", "nation"]), {"n": "urn:col:nation#", "nr": "urn:ref:nation#"}, describer=way)
        return e.query("DESCRIBE ?r WHERE { ?n nr:n_regionkey ?r . ?n n:n_nationkey 3 }").triples.groupBy(F.col("s.lex").alias("s")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], SQL[name] = run, sql


REGION_3 = "(SELECT n_regionkey FROM nation WHERE n_nationkey = 3)"
LEAVING = f"SELECT 'urn:row:region/' || r_regionkey AS s, 3::BIGINT AS n FROM region WHERE r_regionkey = {REGION_3}"
COMING = f"SELECT 'urn:row:nation/' || n_nationkey AS s, 1::BIGINT AS n FROM nation WHERE n_regionkey = {REGION_3}"
for _way in ("subject", "labelled", "cbd"):
    by_subject(f"describe_{_way}", _way, LEAVING)
for _way in ("simple", "symmetric", "minimal-spanning"):
    by_subject(f"describe_{_way}".replace("-", "_"), _way, f"{LEAVING} UNION ALL {COMING}")
by_subject("describe_object", "object", COMING)

BLANKS = """@prefix l: <http://www.w3.org/2000/01/rdf-schema#> . @prefix e: <urn:e:> .
e:a e:p _:x ; e:q e:b ; l:label "a" . _:x l:label "x" ; e:p _:y ; e:r 1 . _:y l:label "y" . e:b l:label "b" ; e:p _:x . e:c e:p e:a ."""


def describe_blank_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """How many triples each way gives where blank nodes are reached."""
    out = None
    for way in ("subject", "object", "simple", "cbd", "symmetric", "labelled", "minimal-spanning"):
        t = Engine(spark, files.read_text(spark, BLANKS), {}, describer=way).query("DESCRIBE <urn:e:a>").triples
        row = t.agg(F.lit(way).alias("way"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionAll(row)
    return out


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def fulltext_index_match(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all words, by the index."""
    return fulltext.TextIndex.of(_notes(spark, folder), "doc_id", "text").search("the and was").select(F.col("doc").alias("doc_id"))


def fulltext_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of documents that hold any of the words."""
    found = fulltext.TextIndex.of(_notes(spark, folder), "doc_id", "text").search("the was la", every=False)
    return found.select(F.col("doc").alias("doc_id"), F.round(F.col("score") * 1000).cast("long").alias("score"))


def fulltext_property(spark: SparkSession, folder: str) -> DataFrame:
    source = tables_in(spark, folder, ["nation"]).quads()
    e = Engine(spark, source, {"n": "urn:col:nation#"}, properties=fulltext.text_property(source))
    return e.select(f'SELECT (STR(?v) AS ?k) {{ ?x <{fulltext.QUERY}> "nation_3" ; n:n_nationkey ?v }}')


SKOS_TREE = "http://www.w3.org/2004/02/skos/core#"


def skos_transitive(spark: SparkSession, folder: str) -> DataFrame:
    """Nations in a region, regions in the world: what is narrower, and how deep."""
    q = tables_in(spark, folder, ["nation"]).quads().quads.filter(F.col("p") == "urn:ref:nation#n_regionkey")
    top = files.read_text(spark, "<urn:none> <urn:none> <urn:world> .").quads.select("o").limit(1)
    tree = q.select("s", F.lit(SKOS_TREE + "broader").alias("p"), "o", "g")
    tree = tree.unionAll(q.select(F.col("o").alias("s"), "g").distinct().crossJoin(F.broadcast(top)).select("s", F.lit(SKOS_TREE + "broader").alias("p"), "o", "g"))
    got = inference.skos(QuadSource(tree)).quads
    return got.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def rules_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    """A chain of customers, far longer than any fixed number of rounds would reach in steps of one."""
    text = " ".join(f"<urn:c:{i}> <urn:next> <urn:c:{i + 1}> ." for i in range(40))
    got = inference.rules(files.read_text(spark, text), "{ ?a <urn:next> ?b } => { ?a <urn:after> ?b } . { ?a <urn:after> ?b . ?b <urn:after> ?c } => { ?a <urn:after> ?c }")
    return got.quads.filter("p = 'urn:after'").agg(F.count(F.lit(1)).alias("n"))


def round_trip(name: str, how: str, rows: str) -> None:
    """What a writer wrote, read again: rows by predicate."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        text = files.write_text(tables_in(spark, folder, ["region", "nation"]).quads().quads, how)
        return files.read_text(spark, text, how).quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("values"))

    QUERIES[name], SQL[name] = run, rows


BY_PREDICATE = " UNION ALL ".join(
    f"SELECT '{p}' AS p, count(*) AS n, count(DISTINCT {v}) AS values FROM {t}"
    for p, v, t in (
        ("urn:col:nation#n_nationkey", "n_nationkey", "nation"),
        ("urn:col:nation#n_name", "n_name", "nation"),
        ("urn:col:nation#n_regionkey", "n_regionkey", "nation"),
        ("urn:ref:nation#n_regionkey", "n_regionkey", "nation"),
        ("urn:col:region#r_regionkey", "r_regionkey", "region"),
        ("urn:col:region#r_name", "r_name", "region"),
    )
)
TYPES = " UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 2"
for _how in ("turtle", "ntriples", "rdfxml", "rdfjson", "jsonld", "trix", "trig", "nquads"):
    round_trip(f"written_{_how}", _how, BY_PREDICATE + TYPES)


def _updated(spark: SparkSession, folder: str, *commands: str) -> Store:
    store = Store(spark, tables_in(spark, folder, ["nation"]).quads(), {"n": "urn:col:nation#"})
    for c in commands:
        store.update(c)
    return store


def update_data_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE, INSERT DATA, DELETE DATA, DROP and CLEAR, and what is left by graph."""
    store = _updated(
        spark,
        folder,
        "CREATE GRAPH <urn:g:a>",
        "INSERT DATA { GRAPH <urn:g:a> { <urn:x> <urn:p> 1, 2, 3 } GRAPH <urn:g:b> { <urn:x> <urn:p> 4 } GRAPH <urn:g:c> { <urn:x> <urn:p> 5 } }",
        "DELETE DATA { GRAPH <urn:g:a> { <urn:x> <urn:p> 2 } }",
        "DROP GRAPH <urn:g:b>; CLEAR GRAPH <urn:g:c>; DROP SILENT GRAPH <urn:g:none>",
        "DELETE WHERE { ?s n:n_name ?o }",
    )
    return store.source.quads.groupBy(F.coalesce("g", F.lit("default")).alias("g")).agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {f.__name__: f for f in (describe_blank_nodes, fulltext_index_match, fulltext_bm25, fulltext_property, skos_transitive, rules_unbounded, update_data_and_drop)}
WORDS = "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL"
SQL |= {
    "describe_blank_nodes": "SELECT * FROM (VALUES ('subject', 3::BIGINT), ('object', 1), ('simple', 4), ('cbd', 7), ('symmetric', 8), ('labelled', 4), ('minimal-spanning', 9)) v(way, n)",
    "fulltext_index_match": f"SELECT doc_id FROM ({WORDS}) WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'was')",
    "fulltext_bm25": f"WITH d AS ({WORDS}), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), q AS (SELECT doc_id, len(w) AS length, unnest(['the', 'was', 'la']) AS word, w FROM d), h AS (SELECT doc_id, length, word, len(list_filter(w, lambda x: x = word)) AS n FROM q), f AS (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM h WHERE n > 0) SELECT doc_id, CAST(round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) * 1000) AS BIGINT) AS score FROM f, s GROUP BY doc_id",
    "fulltext_property": "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation WHERE lower(n_name) = 'nation_3'",
    "skos_transitive": f"SELECT '{SKOS_TREE}' || p AS p, n FROM (SELECT count(*) + count(DISTINCT n_regionkey) AS one, 2 * count(*) + count(DISTINCT n_regionkey) AS far FROM nation), LATERAL (VALUES ('broader', one), ('narrower', one), ('broaderTransitive', far), ('narrowerTransitive', far)) v(p, n)",
    "rules_unbounded": "SELECT 820::BIGINT AS n",
    "update_data_and_drop": "SELECT 'default' AS g, 4 * count(*) AS n FROM nation UNION ALL SELECT 'urn:g:a', 2",
}


# files and results


def result_round_trip(how: str) -> None:
    """A result written and read again, with an unbound variable and what CSV and TSV must quote."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = Engine(spark, tables_in(spark, folder, ["nation"]), {"n": "urn:col:nation#"})
        text = files.write_result(e.query('SELECT ?name ?k ?odd { ?x n:n_name ?name ; n:n_nationkey ?k OPTIONAL { ?x n:n_nationkey 3 BIND("a,\\"b\\"" AS ?odd) } }'), how)
        got = results.read_result(spark, text, how)
        return got.select(F.col("name.lex").alias("name"), F.col("k.lex").alias("k"), F.col("odd.lex").alias("odd"))

    QUERIES[f"result_{how}"] = run
    SQL[f"result_{how}"] = "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS k, CASE WHEN n_nationkey = 3 THEN 'a,\"b\"' END AS odd FROM nation"


for _how in ("json", "xml", "csv", "tsv"):
    result_round_trip(_how)


def result_as_graph(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark, tables_in(spark, folder, ["region"]), {"r": "urn:col:region#"})
    got = files.read_text(spark, results.as_graph(e.query("SELECT ?n ?k { ?x r:r_name ?n ; r:r_regionkey ?k }"))).quads
    return got.groupBy(F.regexp_extract("p", "#(.*)$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def documents_round_trip(name: str, how: str, compressed: bool, graph: str | None = None) -> None:
    """A graph written as several documents and read again: rows by predicate, and the graphs' names."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        quads = tables_in(spark, folder, ["customer"]).quads().quads.withColumn("g", F.lit(graph).cast("string"))
        path = f"{shared_dir(spark)}/graph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        files.write_documents(quads, path, how, compressed=compressed, parts=4)
        got = files.read_files(spark, path, how).quads
        return got.filter(F.col("p").startswith("urn:col:")).groupBy("p", F.coalesce("g", F.lit("none")).alias("g")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name] = run
    SQL[name] = " UNION ALL ".join(f"SELECT 'urn:col:customer#{c}' AS p, '{graph or 'none'}' AS g, count(*) AS n FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


for _how in ("turtle", "ntriples", "rdfxml", "rdfjson", "jsonld"):
    documents_round_trip(f"documents_gz_{_how}", _how, True)
for _how in ("nquads", "trig", "trix", "csv", "tsv"):
    documents_round_trip(f"documents_gz_{_how}", _how, True, "urn:g:customers")
documents_round_trip("documents_turtle", "turtle", False)


# queries with parameters, order of patterns, limits of time


def parameterized(spark: SparkSession, folder: str) -> DataFrame:
    q = Parameterized('SELECT ?n { ?x nation:n_name ?n ; nation:n_nationkey ?k FILTER(?k >= @least && ?n != @name && "@least" != "") }', {"least": 20})
    return Engine(spark, tables_in(spark, folder, ["nation"]), {"nation": "urn:col:nation#"}).select(str(q.set(name='x" || true || "')))


def ordered_patterns(name: str, order: str) -> None:
    """The order in which patterns are joined changes no result."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = tables_in(spark, folder, ["nation", "supplier"]).quads()
        source = source.weighted() if order == "weighted" else replace(source, order=order)
        e = Engine(spark, source, {"n": "urn:col:nation#", "s": "urn:col:supplier#", "sr": "urn:ref:supplier#"})
        return e.select("SELECT (STR(?n) AS ?name) (COUNT(*) AS ?c) { ?y s:s_name ?z . ?y sr:s_nationkey ?x . ?x n:n_name ?n } GROUP BY ?n")

    QUERIES[name], SQL[name] = run, "SELECT n_name AS name, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


for _order in ("written", "weighted", "fixed"):
    ordered_patterns(f"order_{_order}", _order)


def timed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows within a limit of time."""
    e = Engine(spark, tables_in(spark, folder, ["region"]), {"r": "urn:col:region#"}, timeout=600)
    return spark.createDataFrame(e.rows("SELECT ?n ?k { ?x r:r_name ?n ; r:r_regionkey ?k }"), "n string, k long")


# handlers


def handlers_iris(spark: SparkSession, folder: str) -> DataFrame:
    return Handlers(tables_in(spark, folder, ["region"]).quads().quads).iris().select(F.when(F.col("value").startswith("urn:row:"), "row").otherwise(F.col("value")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def handlers_texts(spark: SparkSession, folder: str) -> DataFrame:
    return Handlers(tables_in(spark, folder, ["region"]).quads().quads).texts()


def handlers_several(spark: SparkSession, folder: str) -> DataFrame:
    """Two handlers of one stream of rows, and a store that takes them."""
    store = Store.empty(spark)
    a, b, _ = Handlers(tables_in(spark, folder, ["region"]).quads().quads).to_all(Handlers.count, lambda h: h.only(F.col("o.kind") == 2).count(), lambda h: h.into(store))
    return a.select(F.lit("all").alias("what"), "n").unionAll(b.select(F.lit("literals"), "n")).unionAll(Handlers(store.source.quads).count().select(F.lit("stored"), "n"))


def handlers_blank_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Two documents with one label: two nodes, once each has a scope of its own."""
    q = files.read_text(spark, "_:a <urn:p> _:b .").quads
    both = Handlers(q).own_blank_nodes("one").df.unionAll(Handlers(q).own_blank_nodes("two").df)
    return both.agg(F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def handlers_merged_results(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark, tables_in(spark, folder, ["region"]), {"r": "urn:col:region#"})
    got = merged_results(e.query("SELECT ?n { ?x r:r_name ?n }"), e.query("SELECT ?n ?k { ?x r:r_name ?n ; r:r_regionkey ?k FILTER(?k > 1) }"))
    return got.select(F.col("n.lex").alias("n"), F.col("k.lex").alias("k"))


# shapes in SPARQL

DECLARED = '<urn:P> sh:declare [ sh:prefix "p" ; sh:namespace "urn:col:part#"^^xsd:anyURI ] . '
shapes(
    "shacl_sparql",
    "part",
    DECLARED + PART + 'sh:sparql [ a sh:SPARQLConstraint ; sh:prefixes <urn:P> ; sh:select "SELECT $this ?value { $this p:p_size ?value FILTER(?value > 40) }" ] ; sh:sparql [ sh:prefixes <urn:P> ; sh:select "SELECT $this { FILTER NOT EXISTS { $this p:p_brand \\"Brand#11\\" } }" ] .',
    {"SPARQL": "SELECT count(*) FILTER (p_size > 40) + count(*) FILTER (p_brand <> 'Brand#11') FROM part"},
)
COMPONENTS = (
    '<urn:c:MostConstraintComponent> a sh:ConstraintComponent ; sh:parameter [ sh:path <urn:par:most> ] , [ sh:path <urn:par:unused> ; sh:optional true ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:ask "ASK { FILTER(?value <= ?most) }" ] . '
    '<urn:c:LeastConstraintComponent> a sh:ConstraintComponent ; sh:parameter [ sh:path <urn:par:least> ] ; sh:propertyValidator [ a sh:SPARQLSelectValidator ; sh:select "SELECT $this ?value { $this $PATH ?value FILTER(?value < ?least) }" ] . '
)


def shacl_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components that are defined by an ASK and by a SELECT."""
    found = shacl.validate(tables_in(spark, folder, ["part"]).quads(), SHAPE_PREFIXES + COMPONENTS + PART + "sh:property [ sh:path p:p_size ; <urn:par:most> 30 ; <urn:par:least> 5 ] .")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


QUERIES |= {f.__name__: f for f in (result_as_graph, parameterized, timed_rows, handlers_iris, handlers_texts, handlers_several, handlers_blank_nodes, handlers_merged_results, shacl_components)}
SQL |= {
    "result_as_graph": "SELECT * FROM (SELECT 'type' AS p, 1::BIGINT AS n UNION ALL SELECT 'resultVariable', 2 UNION ALL SELECT 'solution', count(*) FROM region UNION ALL SELECT 'binding', 2 * count(*) FROM region UNION ALL SELECT 'variable', 2 * count(*) FROM region UNION ALL SELECT 'value', 2 * count(*) FROM region)",
    "parameterized": "SELECT n_name AS n FROM nation WHERE n_nationkey >= 20",
    "timed_rows": "SELECT r_name AS n, CAST(r_regionkey AS BIGINT) AS k FROM region",
    "handlers_iris": "SELECT 'row' AS kind, count(*) AS n FROM region UNION ALL SELECT x, 1 FROM (VALUES ('urn:table:region'), ('urn:col:region#r_regionkey'), ('urn:col:region#r_name'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) v(x)",
    "handlers_texts": "SELECT r_name AS value FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR) FROM region",
    "handlers_several": "SELECT 'all' AS what, 3 * count(*) AS n FROM region UNION ALL SELECT 'literals', 2 * count(*) FROM region UNION ALL SELECT 'stored', 3 * count(*) FROM region",
    "handlers_blank_nodes": "SELECT 2::BIGINT AS subjects, 2::BIGINT AS objects",
    "handlers_merged_results": "SELECT r_name AS n, NULL::VARCHAR AS k FROM region UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey > 1",
    "shacl_components": "SELECT 'urn:c:MostConstraintComponent' AS component, count(*) AS n, count(DISTINCT p_size) AS values FROM part WHERE p_size > 30 UNION ALL SELECT 'urn:c:LeastConstraintComponent', count(*), count(DISTINCT p_size) FROM part WHERE p_size < 5",
}


def describe_named_graph(spark: SparkSession, folder: str) -> DataFrame:
    """What two graphs hold, described by their names."""
    tables = [tables_in(spark, folder, [t]).quads().quads.withColumn("g", F.lit(f"urn:g:{t}")) for t in ("region", "nation", "supplier")]
    e = Engine(spark, QuadSource(tables[0].unionAll(tables[1]).unionAll(tables[2])), {}, describer="named-graph")
    t = e.query("DESCRIBE <urn:g:region> <urn:g:nation> <urn:g:none>").triples
    return t.groupBy(F.regexp_extract("s.lex", "^urn:row:(.*)/", 1).alias("t")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["describe_named_graph"] = describe_named_graph
SQL["describe_named_graph"] = "SELECT 'region' AS t, 3 * count(*) AS n FROM region UNION ALL SELECT 'nation', 5 * count(*) FROM nation"
