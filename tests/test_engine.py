"""The graph engine over small graphs given as text."""

import json

import pytest

from graphloom.engine import Engine
from graphloom.operators import canon, fulltext, inference, shacl
from graphloom.plans.builder import ask, select
from graphloom.plans.parser import SyntaxProblem, parse_query
from graphloom.sources.files import by_line, lines_of, read_files, read_text, write_lines, write_result, write_text
from graphloom.store import Store, UpdateProblem
from graphloom.streaming.views import Handlers, View, stream_into

PEOPLE = """@prefix : <urn:x#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:ann a :Person ; :name "Ann"@en, "Anna" ; :age 41 ; :knows :bob, :cid .
:bob a :Person ; :name "Bob" ; :age 17.5 ; :knows :cid .
:cid a :Robot ; :name "Cid" ; :knows :ann ; :made "2020-02-03T04:05:06+02:00"^^<http://www.w3.org/2001/XMLSchema#dateTime> .
:Robot rdfs:subClassOf :Agent . :Person rdfs:subClassOf :Agent . :knows rdfs:domain :Agent ; rdfs:subPropertyOf :met .
[] :name "Nobody" ; :list (1 2 3) .
"""
PX = {"": "urn:x#", "xsd": "http://www.w3.org/2001/XMLSchema#", "ext": "urn:graphloom:ext#"}


@pytest.fixture(scope="module")
def people(spark):
    return read_text(spark, PEOPLE)


def rows(engine, text):
    return sorted(tuple(r) for r in engine.select(text).collect())


@pytest.fixture(scope="module")
def e(spark, people):
    return Engine(spark, people, PX)


def test_patterns_and_literals(e):
    assert rows(e, "SELECT ?x { ?x :age 41 }") == [("<urn:x#ann>",)]
    assert rows(e, 'SELECT ?x { ?x :name "Ann" }') == []
    assert rows(e, 'SELECT ?x { ?x :name "Ann"@en }') == [("<urn:x#ann>",)]
    assert rows(e, "SELECT (COUNT(*) AS ?n) { ?s ?p ?o }") == [(26,)]
    assert rows(e, "SELECT ?i { ?l :list/(<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>*/<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>) ?v BIND(xsd:integer(?v) AS ?i) }") == [(1,), (2,), (3,)]


def test_value_comparison_is_by_type(e):
    assert rows(e, "SELECT ?x { ?x :age ?a FILTER(?a > 17) }") == [("<urn:x#ann>",), ("<urn:x#bob>",)]
    assert rows(e, 'SELECT ?x { ?x :name ?a FILTER(?a > "B" && isIRI(?x)) }') == [("<urn:x#bob>",), ("<urn:x#cid>",)]
    assert rows(e, "SELECT ?b { VALUES ?b { true } FILTER(1 = 1.0 && !(1 = 2) && sameTerm(1, 1) && !sameTerm(1, 1.0)) }") == [(True,)]
    assert rows(e, "SELECT ?x { ?x :age ?a FILTER(?a + :nothing > 1) }") == []


def test_optional_minus_exists_agree(e):
    a = rows(e, "SELECT ?x { ?x :knows ?y MINUS { ?x :age ?a } }")
    b = rows(e, "SELECT ?x { ?x :knows ?y FILTER NOT EXISTS { ?x :age ?a } }")
    c = rows(e, "SELECT ?x { ?x :knows ?y OPTIONAL { ?x :age ?a } FILTER(!BOUND(?a)) }")
    assert a == b == c == [("<urn:x#cid>",)]
    assert rows(e, "SELECT ?x ?a { ?x :knows :cid OPTIONAL { ?x :age ?a FILTER(?a > 20) } }") == sorted([("<urn:x#ann>", '"41"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<urn:x#bob>", None)], key=str)


def test_join_on_variables_that_may_be_unbound(e):
    got = rows(e, "SELECT ?n ?k { { ?x :name ?n OPTIONAL { ?x :knows ?k } } { ?k a :Robot } }")
    assert ('"Bob"', "<urn:x#cid>") in got and ('"Nobody"', "<urn:x#cid>") in got and ('"Cid"', "<urn:x#ann>") not in got


def test_paths(e):
    assert rows(e, "SELECT ?y { :ann :knows+ ?y }") == [("<urn:x#ann>",), ("<urn:x#bob>",), ("<urn:x#cid>",)]
    assert rows(e, "SELECT ?y { :bob :knows? ?y }") == [("<urn:x#bob>",), ("<urn:x#cid>",)]
    assert rows(e, "SELECT ?y { ?y ^:knows :bob }") == [("<urn:x#cid>",)]
    assert rows(e, "SELECT ?y { :ann :knows{2} ?y }") == [("<urn:x#ann>",), ("<urn:x#cid>",)]
    assert rows(e, "SELECT (COUNT(*) AS ?n) { ?a :knows* ?b }")[0][0] >= 9
    assert rows(e, "SELECT ?y { :ann !(:name|:age|^:knows) ?y }") != []
    assert e.ask("ASK { :ann :knows+ :ann }") and not e.ask("ASK { :bob :age+ :ann }")


def test_aggregates_and_errors(e):
    assert rows(e, "SELECT (SUM(?a) AS ?s) { ?x :age ?a }") == [('"58.5"^^<http://www.w3.org/2001/XMLSchema#decimal>',)]
    assert rows(e, "SELECT (SUM(?n) AS ?s) { ?x :name ?n }") == [(None,)]
    assert rows(e, "SELECT (COUNT(?z) AS ?c) (SUM(?z) AS ?s) { ?x :none ?z }") == [(0, '"0"^^<http://www.w3.org/2001/XMLSchema#integer>')]
    assert rows(e, "SELECT ?x (COUNT(*) AS ?c) { ?x :none ?z } GROUP BY ?x") == []
    assert rows(e, 'SELECT ?t (GROUP_CONCAT(?n; SEPARATOR=",") AS ?g) { ?x a ?t ; :name ?n FILTER(LANG(?n) = "") } GROUP BY ?t') == [("<urn:x#Person>", "Anna,Bob"), ("<urn:x#Robot>", "Cid")]
    with pytest.raises(ValueError):
        e.select("SELECT ?x (COUNT(*) AS ?c) { ?x :name ?n } GROUP BY ?n")


def test_functions_on_terms(e):
    q = 'SELECT (YEAR(?d) AS ?y) (HOURS(?d) AS ?h) (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?w) (DATATYPE(?d) AS ?t) { ?x :made ?d }'
    assert rows(e, q) == [(2020, 4, "+02:00", "PT2H", "http://www.w3.org/2001/XMLSchema#dateTime")]
    q = 'SELECT (UCASE(?n) AS ?a) (STRLEN(?n) AS ?b) (LANG(?n) AS ?c) (CONCAT(?n, "!") AS ?d) { ?x :name ?n FILTER(LANGMATCHES(LANG(?n), "*")) }'
    assert rows(e, q) == [('"ANN"@en', 3, "en", '"Ann!"')]
    assert rows(e, 'SELECT (IF(1 < 2, "y", "n") AS ?a) (COALESCE(?u, 5) AS ?b) (STRBEFORE("abc", "b") AS ?c) (SUBSTR("abcd", 2) AS ?d) {}') == [("y", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', "a", "bcd")]
    assert rows(e, "SELECT (isNumeric(\"300\"^^xsd:byte) AS ?a) (isNumeric(\"30\"^^xsd:byte) AS ?b) (xsd:integer(\"x\") AS ?c) (ROUND(2.5) AS ?d) {}")[0][:3] == (False, True, None)


def test_custom_functions_and_namespaces(spark, people):
    from graphloom.functions.values import Val, number

    e = Engine(spark, people, {**PX, "other": "http://example.org/lib#"}, functions={"urn:double": lambda x: Val("dbl", number(x) * 2)}, aliases={"http://example.org/lib#": "urn:graphloom:ext#"})
    assert rows(e, "SELECT (<urn:double>(?a) AS ?b) (other:sq(?a) AS ?c) { :ann :age ?a }") == [(82.0, 1681.0)]


def test_operators_can_be_replaced(spark, people):
    from graphloom.functions.builtins import arithmetic
    from graphloom.functions.values import Val, plain
    from pyspark.sql import functions as F

    def plus(x, y):
        return Val("str", F.concat(plain(x), plain(y))) if x.kind == y.kind == "str" else arithmetic("+", x, y)

    e = Engine(spark, people, PX, functions={"+": plus})
    assert rows(e, 'SELECT ("a" + "b" AS ?x) (1 + 2 AS ?y) {}') == [("ab", 3)]


def test_modifiers_subqueries_values(e):
    assert [r[0] for r in e.select("SELECT ?n { ?x :name ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1").collect()] == ['"Cid"', '"Bob"']
    assert rows(e, "SELECT ?x ?m { ?x :age ?a { SELECT (MAX(?b) AS ?m) { ?y :age ?b } } FILTER(?a = ?m) }") == [("<urn:x#ann>", '"41"^^<http://www.w3.org/2001/XMLSchema#integer>')]
    assert rows(e, "SELECT ?x ?y { VALUES (?x ?y) { (:ann UNDEF) (UNDEF :cid) } ?x :knows ?y }") == sorted([("<urn:x#ann>", "<urn:x#bob>"), ("<urn:x#ann>", "<urn:x#cid>"), ("<urn:x#ann>", "<urn:x#cid>"), ("<urn:x#bob>", "<urn:x#cid>")])


def test_graphs_and_datasets(spark):
    src = read_text(spark, "@prefix : <urn:x#> . :a :p 1 . :g1 { :a :p 2 . :b :q :a } :g2 { :c :p 3 }", "trig")
    e = Engine(spark, src, PX)
    assert rows(e, "SELECT ?g { GRAPH ?g { ?x :p ?v } }") == [("urn:x#g1",), ("urn:x#g2",)]
    assert rows(e, "SELECT ?x { GRAPH :g2 { ?x :p ?v } }") == [("<urn:x#c>",)]
    assert rows(e, "SELECT (COUNT(*) AS ?n) FROM :g1 FROM :g2 { ?x :p ?v }") == [(2,)]
    assert rows(e, "SELECT ?g FROM NAMED :g2 { GRAPH ?g { ?x :p ?v } }") == [("urn:x#g2",)]
    assert rows(e, "SELECT ?g ?y { GRAPH ?g { :b :q+ ?y } }") == [("urn:x#g1", "<urn:x#a>")]
    assert rows(e, "SELECT DISTINCT ?g { GRAPH ?g { } }") == [("urn:x#g1",), ("urn:x#g2",)]


def test_quoted_triples(spark):
    src = read_text(spark, '@prefix : <urn:x#> . << :a :p "v" >> :sure 0.9 . << :b :p :c >> :sure 0.2 .')
    e = Engine(spark, src, PX)
    assert rows(e, "SELECT ?s ?o { << ?s :p ?o >> :sure ?c FILTER(?c > 0.5) }") == [("<urn:x#a>", '"v"')]
    assert rows(e, "SELECT (SUBJECT(?t) AS ?s) { ?t :sure ?c FILTER(isTRIPLE(?t) && OBJECT(?t) = :c) }") == [("<urn:x#b>",)]


def test_construct_and_describe(e, spark, people):
    got = e.query("CONSTRUCT { ?y :knownBy ?x ; :via [ :is ?x ] } WHERE { ?x :knows ?y }").triples
    assert got.count() == 4 + 4 + 4
    for way in ("cbd", "symmetric", "subject", "object", "simple", "labelled", "minimal-spanning"):
        assert Engine(spark, people, PX, describer=way).query("DESCRIBE :ann").triples.count() > 0
    assert e.query("DESCRIBE ?x WHERE { ?x :list ?l }").triples.count() == 8


def test_updates(spark):
    s = Store.of_text(spark, PEOPLE, prefixes=PX)
    n = s.source.quads.count()
    s.update("DELETE { ?x :age ?a } INSERT { ?x :years ?a } WHERE { ?x :age ?a }; INSERT DATA { GRAPH :g { :z :p 1 } . :z :p 2 }")
    assert s.source.quads.count() == n + 2 and not s.query("ASK { ?x :age ?a }").answer
    s.update("COPY :g TO :h; MOVE :h TO :i; ADD :i TO DEFAULT; CLEAR GRAPH :g; DELETE WHERE { ?x :years ?y }; DELETE DATA { :z :p 2 }")
    assert s.query("ASK { GRAPH :i { :z :p 1 } }").answer and s.query("ASK { :z :p 1 }").answer and not s.query("ASK { GRAPH :g { ?s ?p ?o } }").answer
    with pytest.raises(UpdateProblem):
        s.update("DROP GRAPH :missing")
    s.update("DROP SILENT GRAPH :missing; CREATE GRAPH :new; WITH :i DELETE { ?s ?p ?o } WHERE { ?s ?p ?o }; DROP ALL")
    assert s.source.quads.isEmpty()


def test_round_trips_of_syntaxes(spark, people, tmp_path):
    want = canon.canonical_lines(people)
    for how in ("turtle", "ntriples", "rdfxml", "rdfjson", "jsonld", "trix"):
        text = write_text(people.quads, how, {"x": "urn:x#"} if how == "turtle" else None)
        assert canon.canonical_lines(read_text(spark, text, how)) == want, how
    write_lines(people.quads, str(tmp_path / "out.nt"))
    assert canon.isomorphic(read_files(spark, str(tmp_path / "out.nt")), people)
    (tmp_path / "one.ttl").write_text(PEOPLE)
    assert canon.isomorphic(read_files(spark, str(tmp_path / "one.ttl")), people)
    assert lines_of(people.quads).count() == 26
    assert '"urn:x#ann" -> "urn:x#bob" [label="urn:x#knows"]' in write_text(people.quads, "dot") and "<td>&lt;urn:x#ann&gt;</td>" in write_text(people.quads, "html")


def test_more_syntaxes(spark):
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#"><e:T rdf:about="urn:a" e:k="v"><e:p rdf:resource="urn:b"/><e:q xml:lang="en">hi</e:q>
    <e:l rdf:parseType="Collection"><rdf:Description rdf:about="urn:c"/></e:l><e:n rdf:parseType="Resource"><e:m>1</e:m></e:n></e:T></rdf:RDF>"""
    assert read_text(spark, xml, "rdfxml").quads.count() == 9
    ld = {"@context": {"e": "urn:e#", "knows": {"@id": "e:knows", "@type": "@id"}, "n": "e:n"}, "@id": "urn:a", "@type": "e:T", "knows": ["urn:b", "urn:c"], "n": [1, 2.5, True, {"@value": "x", "@language": "de"}], "e:l": {"@list": [1]}}
    assert read_text(spark, json.dumps(ld), "jsonld").quads.count() == 10
    assert read_text(spark, "urn:a,urn:p,text\nurn:a,urn:p,urn:b\n", "csv").quads.count() == 2


def test_results(e):
    r = e.query("SELECT ?x ?n { ?x :name ?n FILTER(isIRI(?x)) } ORDER BY ?n")
    data = json.loads(write_result(r, "json"))
    assert data["head"]["vars"] == ["x", "n"] and len(data["results"]["bindings"]) == 4
    assert write_result(r, "csv").splitlines()[0] == "x,n" and '"Ann"@en' in write_result(r, "tsv") and "<binding" in write_result(r, "xml")
    assert json.loads(write_result(e.query("ASK { ?x :age 41 }"), "json"))["boolean"] is True


def test_inference(spark, people):
    e = Engine(spark, inference.rdfs(people), PX)
    assert rows(e, "SELECT ?x { ?x a :Agent }") == [("<urn:x#ann>",), ("<urn:x#bob>",), ("<urn:x#cid>",)]
    assert e.ask("ASK { :ann :met :bob }")
    got = inference.rules(people, "{ ?a :knows ?b . ?b :knows ?c } => { ?a :mayKnow ?c } . { ?a :mayKnow ?b } => { ?b :seenBy ?a } .", PX)
    assert Engine(spark, got, PX).ask("ASK { :cid :seenBy :ann }")
    sk = read_text(spark, "@prefix s: <http://www.w3.org/2004/02/skos/core#> . <urn:a> s:broader <urn:b> . <urn:b> s:broader <urn:c> .")
    assert Engine(spark, inference.skos(sk)).ask("ASK { <urn:c> <http://www.w3.org/2004/02/skos/core#narrowerTransitive> <urn:a> }")


def test_shapes(spark, people):
    shapes = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <urn:x#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    :S a sh:NodeShape ; sh:targetClass :Agent ; sh:property [ sh:path :age ; sh:minCount 1 ; sh:datatype xsd:integer ; sh:minInclusive 18 ] ;
      sh:property [ sh:path :name ; sh:maxCount 1 ; sh:pattern "^[A-Z]" ] ; sh:or ( [ sh:property [ sh:path :made ; sh:minCount 1 ] ] [ sh:class :Person ] ) ."""
    got = {(r.focus.lex[-3:], r.component.rpartition("#")[2].replace("ConstraintComponent", "")) for r in shacl.validate(people, shapes).collect()}
    assert got == {("cid", "MinCount"), ("bob", "Datatype"), ("bob", "MinInclusive"), ("ann", "MaxCount")}


def test_text_search(spark, people):
    e = Engine(spark, people, PX, properties=fulltext.text_property(people))
    assert rows(e, 'SELECT ?x { ?x <urn:graphloom:text#query> "anna" }') == [("<urn:x#ann>",)]
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red car"), (3, "")], "doc long, text string")
    assert {r.doc for r in fulltext.TextIndex.of(docs, "doc", "text").search("red fish").collect()} == {1}
    assert {r.doc for r in fulltext.TextIndex.of(docs, "doc", "text").search("red fish", every=False).collect()} == {1, 2}


def test_canonical_labels(spark):
    a = read_text(spark, "_:x <urn:p> _:y . _:y <urn:p> _:x . _:x <urn:q> 1 .")
    b = read_text(spark, "_:m <urn:q> 1 . _:n <urn:p> _:m . _:m <urn:p> _:n .")
    c = read_text(spark, "_:x <urn:p> _:y . _:y <urn:p> _:y . _:x <urn:q> 1 .")
    assert canon.isomorphic(a, b) and not canon.isomorphic(a, c)
    ring = read_text(spark, "_:a <urn:p> _:b . _:b <urn:p> _:c . _:c <urn:p> _:a .")
    again = read_text(spark, "_:z <urn:p> _:y . _:y <urn:p> _:w . _:w <urn:p> _:z .")
    assert canon.isomorphic(ring, again)
    removed, added = canon.difference(read_text(spark, "<urn:a> <urn:p> 1, 2 ."), read_text(spark, "<urn:a> <urn:p> 2, 3 ."))
    assert removed.count() == added.count() == 1


def test_builder_makes_the_parsed_query(e):
    q = select("?x", "COUNT(*) AS ?n", prefixes=PX).where("?x", ":knows", "?y").filter("isIRI(?y)").group_by("?x").having("COUNT(*) > 1").build()
    assert sorted(tuple(r) for r in e.query(q).df.collect()) == [("<urn:x#ann>", 2)]
    assert e.query(ask(PX).where(":ann", ":age", "?a").build()).answer


def test_views_streams_handlers(spark, tmp_path):
    s = Store.empty(spark)
    v = View(s, "SELECT (COUNT(*) AS ?n) { ?s ?p ?o }")
    assert v.df().first()[0] == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<urn:a> <urn:p> "x" .\n<urn:a> <urn:p> _:b .\n')
    stream_into(s, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    assert v.df().first()[0] == 2
    assert Handlers(s.source.quads).only("o.kind = 2").count().first()[0] == 1


def test_syntax_problems():
    for bad in ("SELECT { ?x ?y }", "SELECT ?x { ?x :p 1 }", "SELECT ?x { ?x <p> 1 BIND(1 AS ?x) }", "FOO"):
        with pytest.raises(SyntaxProblem):
            parse_query(bad)


def test_lines_that_are_no_quads_are_errors(spark):
    lines = spark.createDataFrame([("<urn:a> <urn:p> \"x\" .", "f"), ("# a comment", "f"), ("", "f"), ("<urn:a> <urn:p> .", "f")], "value string, file string")
    assert by_line(lines, on_error="skip").count() == 1
    with pytest.raises(Exception, match="no quad in f: <urn:a> <urn:p> ."):
        by_line(lines).collect()


def test_rules_that_go_on_are_an_error_only_if_asked(spark):
    data = read_text(spark, " ".join(f"<urn:c:{i}> <urn:p> <urn:c:{i + 1}> ." for i in range(6)))
    text = "{ ?a <urn:p> ?b . ?b <urn:p> ?c } => { ?a <urn:p> ?c }"
    assert inference.rules(data, text).quads.count() == 21
    with pytest.raises(RuntimeError):
        inference.rules(data, text, most=1)
