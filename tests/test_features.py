"""Result documents, parameters, plans and limits of time."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine, QueryTimeout
from graphloom.operators import shacl
from graphloom.plans import algebra as A
from graphloom.plans.parameters import Parameterized
from graphloom.sources import files, results
from graphloom.sources.quads import QuadSource
from graphloom.store import Store

ODD = '@prefix : <urn:x#> . :a :p "x\\\\ny\\"q\\n\\t z"@en , 3, 1.5, true, _:b ; :q "é,<&>", "" . _:b :p :a .'


@pytest.fixture(scope="module")
def odd(spark):
    return files.read_text(spark, ODD)


def cells(df):
    return sorted((tuple(t and (t.kind, t.lex, t.dt, t.lang) for t in r) for r in df.collect()), key=str)


def test_escapes_are_read_as_one(odd):
    assert {r.o.lex for r in odd.quads.filter(F.col("o.lang") == "en").collect()} == {'x\\ny"q\n\t z'}


@pytest.mark.parametrize("how", ["json", "xml", "tsv"])
def test_results_come_back_as_they_were(spark, odd, how):
    e = Engine(spark, odd, {"": "urn:x#"})
    result = e.query("SELECT ?s ?o ?z { ?s :p|:q ?o OPTIONAL { ?o :p ?z } }")
    assert cells(results.read_result(spark, files.write_result(result, how), how)) == cells(result.terms)
    none = e.query("SELECT ?s { ?s :nothing ?o }")
    got = results.read_result(spark, files.write_result(none, how), how)
    assert got.columns == ["s"] and got.isEmpty()
    if how != "tsv":
        assert results.read_result(spark, files.write_result(e.query("ASK { :a :p 3 }"), how), how) is True


def test_csv_results_and_unknown_formats(spark):
    got = results.read_result(spark, 'a,b\r\nurn:x#1,"x, ""y"""\r\n_:n,\r\n', "csv").collect()
    assert [(r.a.kind, r.a.lex, r.b and r.b.lex) for r in got] == [(0, "urn:x#1", 'x, "y"'), (1, "n", None)]
    with pytest.raises(ValueError):
        results.read_result(spark, "", "yaml")


def test_documents_hold_all_rows_and_name_blank_nodes(spark, odd, tmp_path):
    for how in ("turtle", "rdfxml"):
        files.write_documents(odd.quads, str(tmp_path / how), how, compressed=True, parts=3)
        got = files.read_files(spark, str(tmp_path / how), how).quads
        assert got.count() == odd.quads.count()
        assert got.filter(F.col("s.lex").startswith("urn:genid:")).count() == 1
    files.write_documents(odd.quads.limit(0), str(tmp_path / "none"), "turtle")
    assert not [p for p in (tmp_path / "none").iterdir() if p.stat().st_size and p.name.endswith("txt")]


def test_parameters_can_only_be_terms():
    q = Parameterized('SELECT * { ?s <urn:@p> @o ; ?q "@o"@en # @o\n }')
    assert q.names() == ["o"]
    assert str(q.set(o='a" } DROP ALL #')) == 'SELECT * { ?s <urn:@p> "a\\" } DROP ALL #" ; ?q "@o"@en # @o\n }'
    assert str(Parameterized("@a @b @c").set(a=A.Iri("urn:x"), b=A.Literal("x", lang="en"), c=True)) == '<urn:x> "x"@en true'
    assert str(Parameterized("@a").set(a=float("inf"))) == '"INF"^^<http://www.w3.org/2001/XMLSchema#double>'
    for wrong in (A.Iri("urn:x> <urn:y"), A.Literal("x", lang='en "'), A.Literal("x", "urn:a> b")):
        with pytest.raises(ValueError):
            str(Parameterized("@a").set(a=wrong))
    with pytest.raises(ValueError):
        str(q)


def test_plans_are_explained_and_nothing_changes(spark, odd):
    e = Engine(spark, odd, {"": "urn:x#"})
    assert "Physical Plan" in e.explain("SELECT ?o { :a :p ?o }") and "Physical Plan" in e.explain("ASK { :a :p ?o }", "simple")
    store = Store(spark, odd, {"": "urn:x#"})
    plans = store.explain("DELETE { ?s :p ?o } WHERE { ?s :p ?o } ; CLEAR ALL")
    assert plans[0].startswith("MODIFY") and plans[1] == "CLEAR" and store.version == 0


def test_a_query_ends_in_time(spark, odd):
    @F.udf("string")
    def slow(x):
        time.sleep(30)
        return x

    late = Engine(spark, type(odd)(odd.quads.withColumn("p", slow("p"))), {"": "urn:x#"}, timeout=3)
    began = time.time()
    with pytest.raises(QueryTimeout):
        late.rows("SELECT ?s ?p { ?s ?p ?o }")
    late.partial = True
    assert late.rows("SELECT ?s ?p { ?s ?p ?o }") == []
    assert time.time() - began < 60


def test_weights_order_patterns(odd):
    weighted = odd.weighted()
    assert dict(weighted.weights)["urn:x#p"] == 6
    a, b = (A.Triple(A.Var("s"), A.Iri(f"urn:x#{p}"), A.Var("o")) for p in "pq")
    assert weighted.ranked([a, b]) == [b, a] and odd.ranked([a, b]) == [a, b]


@pytest.mark.parametrize("how", ["turtle", "ntriples", "rdfxml", "rdfjson", "jsonld", "nquads", "trig", "trix", "csv", "tsv"])
def test_large_graphs_become_several_documents(spark, tmp_path, how):
    """However few parts are asked for, no document has over MOST_ROWS rows, a subject that has more rows among them."""
    n = files.MOST_ROWS + 5_000
    terms = [(0, F.concat(F.lit("urn:s:"), F.when(F.col("id") < n, -1).otherwise(F.floor(F.col("id") / 3)))), (2, F.concat(F.col("id"), F.lit(' "é"\n<&>')))]
    s, o = (F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), F.lit("http://www.w3.org/2001/XMLSchema#string" if kind else None).alias("dt"), F.lit(None).cast("string").alias("lang")) for kind, lex in terms)
    quads = spark.range(n + 9_000).select(s.alias("s"), F.lit("urn:x#p").alias("p"), o.alias("o"), F.lit("urn:g" if how in ("nquads", "trig", "trix", "csv", "tsv") else None).cast("string").alias("g"))
    files.write_documents(quads, str(tmp_path), how, compressed=how == "trig", parts=1)
    got = files.read_files(spark, str(tmp_path), how).quads
    assert got.count() == quads.count() and got.select("s.lex", "p", F.col("o.lex").alias("o"), "g").exceptAll(quads.select("s.lex", "p", F.col("o.lex").alias("o"), "g")).isEmpty()
    lines = [len(gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes()) for p in tmp_path.glob("part-*")]
    assert len(lines) > 1 and max(lines) < 0.8 * sum(lines)


def test_rows_are_cut_between_subjects_or_within_a_large_one():
    def rows(subject, n, ow="<urn:o>"):
        return [files.Written(files.Term(0, subject, None, None), "urn:p", files.Term(0, "urn:o", None, None), None, f"<{subject}>", ow) for _ in range(n)]

    most = files.MOST_ROWS
    one = rows("urn:a", most // 2 + 1) + rows("urn:b", 2 * most + 1) + rows("urn:c", 2)
    cut = list(files.cut(iter(one)))
    assert [len(x) for x in cut] == [most // 2 + 1, most, most, 3] and [r for x in cut for r in x] == one
    long = rows("urn:a", 3, "x" * files.MOST_CHARS)
    assert [len(x) for x in files.cut(iter(long))] == [1, 1, 1]


def test_equal_values_are_compared_in_many_tasks(spark):
    """Pairs (focus, value) of one side only, both ways, and no task has most of them."""
    term = lambda kind, lex: F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), F.lit("http://www.w3.org/2001/XMLSchema#string" if kind else None).alias("dt"), F.lit(None).cast("string").alias("lang"))
    n = 8000
    given = {"urn:x#p": F.col("id"), "urn:x#q": F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-F.col("id"))}  # every fourth agrees
    quads = None
    for p, value in given.items():
        part = spark.range(n).select(term(0, F.concat(F.lit("urn:s:"), F.col("id"))).alias("s"), F.lit(p).alias("p"), term(2, value.cast("string")).alias("o"), F.lit(None).cast("string").alias("g"))
        quads = part if quads is None else quads.unionAll(part)
    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <urn:x#> . <urn:S> sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:equals :q ] ."
    found = shacl.validate(QuadSource(quads.unionAll(quads.limit(10))), shapes)
    by = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in by) == n * 3 // 4 * 2 and max(r["count"] for r in by) < 0.4 * n * 3 // 4 * 2
    got = {(r.focus.lex, r.value.lex) for r in found.collect()}
    assert got == {(f"urn:s:{i}", str(x)) for i in range(n) if i % 4 for x in (i, -i)}
