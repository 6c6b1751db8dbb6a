"""Queries over the mapped tables, one or more for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import feature_queries
from graphloom.engine import Engine
from graphloom.operators import canon, fulltext, inference, shacl
from graphloom.plans.algebra import AFN, EXT, FN, RDF, RDFS, XSD
from graphloom.sources.mapped import KEYS, REFS, tables_in
from graphloom.sources.quads import QuadSource
from graphloom.store import Store
from graphloom.streaming.views import Handlers

PREFIXES = {"xsd": XSD, "rdf": RDF, "rdfs": RDFS, "fn": FN, "afn": AFN, "ext": EXT, "t": "urn:table:"}
PREFIXES |= {n: f"urn:col:{n}#" for n in KEYS} | {f"{n}_": f"urn:ref:{n}#" for n in REFS}

#: name: (tables, SPARQL, DuckDB SQL)
PAIRS: dict[str, tuple[str, str, str]] = {}


def pair(name: str, tables: str, sparql: str, sql: str) -> None:
    PAIRS[name] = (tables, sparql, sql)


pair("bgp_scan", "nation", "SELECT ?name { ?n nation:n_name ?name }", "SELECT n_name AS name FROM nation")
pair("bgp_star", "part", "SELECT ?k ?name ?size ?price { ?p part:p_partkey ?k ; part:p_name ?name ; part:p_size ?size ; part:p_retailprice ?price ; part:p_brand ?b }", "SELECT p_partkey AS k, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part")
pair("bgp_join_2", "nation region", "SELECT ?n ?r { ?x nation:n_name ?n ; nation_:n_regionkey ?y . ?y region:r_name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
pair("bgp_join_3", "region nation customer", "SELECT ?c ?n ?r { ?x customer:c_name ?c ; customer_:c_nationkey ?y . ?y nation:n_name ?n ; nation_:n_regionkey ?z . ?z region:r_name ?r }", "SELECT c_name AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pair("bgp_join_5", "region nation customer orders lineitem", "SELECT ?r (ROUND(SUM(?p) * 100) AS ?cents) (COUNT(*) AS ?n) { ?l lineitem:l_extendedprice ?p ; lineitem_:l_orderkey ?o . ?o orders_:o_custkey ?c . ?c customer_:c_nationkey ?k . ?k nation_:n_regionkey ?g . ?g region:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, CAST(floor(sum(l_extendedprice) * 100 + 0.5) AS DOUBLE) AS cents, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
pair("bgp_constant_object", "customer", 'SELECT ?k { ?c customer:c_mktsegment "BUILDING" ; customer:c_custkey ?k }', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'")
pair("bgp_constant_subject", "nation", "SELECT ?name { <urn:row:nation/3> nation:n_name ?name }", "SELECT n_name AS name FROM nation WHERE n_nationkey = 3")
pair("bgp_repeated_variable", "orders", "SELECT ?k { ?o orders:o_orderkey ?k ; orders:o_custkey ?k }", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey = o_custkey")
pair("bgp_variable_predicate", "nation region", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p", "SELECT * FROM (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 30::BIGINT), ('urn:col:nation#n_nationkey', 25), ('urn:col:nation#n_name', 25), ('urn:col:nation#n_regionkey', 25), ('urn:ref:nation#n_regionkey', 25), ('urn:col:region#r_regionkey', 5), ('urn:col:region#r_name', 5)) v(p, n)")
pair("bgp_type", "nation region", "SELECT (COUNT(?x) AS ?n) { ?x a t:nation }", "SELECT count(*) AS n FROM nation")
pair("bgp_product", "region", "SELECT ?a ?b { ?x region:r_name ?a . ?y region:r_name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
pair("subject_iri", "region", "SELECT ?x ?name { ?x region:r_name ?name }", "SELECT 'urn:row:region/' || r_regionkey AS x, r_name AS name FROM region")
pair("filter_cmp", "orders", "SELECT ?k ?t { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t FILTER(?t > 100000 && ?t <= 200000.5) }", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000.5")
pair("filter_or_not", "part", 'SELECT ?k { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_brand ?b FILTER(?s < 5 || !(?b != "Brand#11")) }', "SELECT p_partkey AS k FROM part WHERE p_size < 5 OR NOT (p_brand <> 'Brand#11')")
pair("filter_regex", "part", 'SELECT ?k { ?p part:p_partkey ?k ; part:p_name ?n FILTER REGEX(?n, "part.*[05]$", "i") }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, 'part.*[05]$', 'i')")
pair("filter_in", "orders", 'SELECT ?k { ?o orders:o_orderkey ?k ; orders:o_orderstatus ?s FILTER(?s IN ("F", "P")) FILTER(?k NOT IN (1, 2, 3)) }', "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)")
pair("filter_langmatches", "documents", 'SELECT ?k { ?d documents:doc_id ?k ; documents:lang ?l BIND(STRLANG("x", ?l) AS ?v) FILTER(LANGMATCHES(LANG(?v), "en")) }', "SELECT doc_id AS k FROM documents WHERE lang = 'en'")
pair("filter_date", "orders", 'SELECT ?k { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00Z"^^xsd:dateTime && ?d < "1998-01-01T00:00:00Z"^^xsd:dateTime) }', "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
pair("filter_error_is_false", "part", "SELECT ?k { ?p part:p_partkey ?k ; part:p_name ?n FILTER(?n + 1 > 0) }", "SELECT p_partkey AS k FROM part WHERE false")
pair("filtered_product", "region nation", "SELECT ?a ?b { ?x region:r_name ?a . ?y nation:n_name ?b FILTER(STRLEN(?a) > STRLEN(?b)) }", "SELECT r_name AS a, n_name AS b FROM region, nation WHERE length(r_name) > length(n_name)")
pair("identity_filter", "nation region", "SELECT ?n { ?x nation:n_name ?n ; nation_:n_regionkey ?r FILTER(?r = <urn:row:region/1>) }", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
pair("implicit_join", "supplier customer", "SELECT (COUNT(*) AS ?n) { ?s supplier_:s_nationkey ?x . ?c customer_:c_nationkey ?y FILTER(?x = ?y) }", "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey")
pair("same_term_filter", "supplier customer", "SELECT (COUNT(*) AS ?n) { ?s supplier_:s_nationkey ?x . ?c customer_:c_nationkey ?y FILTER(sameTerm(?x, ?y)) }", "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey")
pair("optional_simple", "customer orders", "SELECT ?k ?o { ?c customer:c_custkey ?k OPTIONAL { ?x orders_:o_custkey ?c ; orders:o_orderkey ?o } }", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
pair("optional_filter", "customer orders", "SELECT ?k ?t { ?c customer:c_custkey ?k ; customer:c_acctbal ?b OPTIONAL { ?x orders_:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > ?b * 40) } }", "SELECT c_custkey AS k, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
pair("optional_notbound", "supplier nation lineitem", "SELECT ?k { ?s supplier:s_suppkey ?k OPTIONAL { ?l lineitem_:l_suppkey ?s ; lineitem:l_quantity ?q FILTER(?q > 49.5) } FILTER(!BOUND(?q)) }", "SELECT s_suppkey AS k FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5)")
pair("optional_nested", "region nation supplier", "SELECT ?r ?n ?s { ?x region:r_name ?r OPTIONAL { ?y nation_:n_regionkey ?x ; nation:n_name ?n OPTIONAL { ?z supplier_:s_nationkey ?y ; supplier:s_suppkey ?s FILTER(?s < 20) } } }", "SELECT r_name AS r, n_name AS n, s_suppkey AS s FROM region LEFT JOIN (nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey < 20) ON n_regionkey = r_regionkey")
pair("optional_then_join", "supplier nation", "SELECT ?k ?n { VALUES (?k ?x) { (1 <urn:row:nation/1>) (2 UNDEF) } ?x nation:n_name ?n }", "SELECT k, n_name AS n FROM (VALUES (1::BIGINT, 1), (2, NULL)) v(k, x) JOIN nation ON x IS NULL OR x = n_nationkey")
pair("union_bag", "region nation", "SELECT ?n { { ?x region:r_name ?n } UNION { ?x nation:n_name ?n } UNION { ?x region:r_name ?n } }", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
pair("union_missing", "region nation", "SELECT ?a ?b { { ?x region:r_name ?a } UNION { ?x nation:n_name ?b } }", "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")
pair("minus_shared", "customer orders", 'SELECT ?k { ?c customer:c_custkey ?k MINUS { ?o orders_:o_custkey ?c ; orders:o_orderstatus "P" } }', "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
pair("minus_disjoint", "region nation", "SELECT ?a { ?x region:r_name ?a MINUS { ?y nation:n_name ?b } }", "SELECT r_name AS a FROM region")
pair("exists", "customer orders", "SELECT ?k { ?c customer:c_custkey ?k FILTER EXISTS { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 400000) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
pair("not_exists", "customer orders", 'SELECT ?k { ?c customer:c_custkey ?k FILTER NOT EXISTS { ?o orders_:o_custkey ?c ; orders:o_orderpriority "1-URGENT" } }', "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
pair("exists_correlated", "customer orders", "SELECT ?k { ?c customer:c_custkey ?k ; customer:c_acctbal ?b FILTER EXISTS { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t < ?b) } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)")
pair("exists_in_or", "customer orders", "SELECT ?k { ?c customer:c_custkey ?k ; customer:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 450000) }) }", "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
pair("not_exists_disjoint", "region nation", "SELECT ?a { ?x region:r_name ?a FILTER NOT EXISTS { ?y nation:n_name ?b } }", "SELECT r_name AS a FROM region WHERE false")
pair("bind_expr", "lineitem", "SELECT (COUNT(*) AS ?n) { ?l lineitem:l_extendedprice ?p ; lineitem:l_discount ?d BIND(?p * (1 - ?d) AS ?v) FILTER(?v > 30000) }", "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000")
pair("let_assignment", "part", "SELECT ?k ?d { ?p part:p_partkey ?k ; part:p_size ?s LET (?d := ?s * 2) }", "SELECT p_partkey AS k, CAST(p_size * 2 AS BIGINT) AS d FROM part")
pair("values_inline", "nation", 'SELECT ?k ?n { VALUES ?n { "NATION_1" "NATION_2" "nowhere" } ?x nation:n_name ?n ; nation:n_nationkey ?k }', "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'nowhere')")
pair("values_undef", "nation", "SELECT ?k ?r { ?x nation:n_nationkey ?k ; nation:n_regionkey ?r } VALUES (?k ?r) { (1 UNDEF) (UNDEF 2) }", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation JOIN (VALUES (1, NULL), (NULL, 2)) v(a, b) ON (a IS NULL OR a = n_nationkey) AND (b IS NULL OR b = n_regionkey)")
pair("subquery_agg", "customer orders", "SELECT ?k ?m { ?c customer:c_custkey ?k { SELECT ?c (MAX(?t) AS ?m) { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t } GROUP BY ?c } FILTER(?m > 300000) }", "SELECT c_custkey AS k, m FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE m > 300000")
pair("distinct", "customer", "SELECT DISTINCT ?s { ?c customer:c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
pair("reduced", "orders", "SELECT REDUCED ?s { ?o orders:o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
pair("order_multi", "supplier", "SELECT ?n ?b ?k { ?s supplier:s_nationkey ?n ; supplier:s_acctbal ?b ; supplier:s_suppkey ?k } ORDER BY ?n DESC(?b) ?k LIMIT 50", "SELECT CAST(s_nationkey AS BIGINT) AS n, s_acctbal AS b, s_suppkey AS k FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 50")
pair("slice_offset", "orders", "SELECT ?k { ?o orders:o_orderkey ?k } ORDER BY DESC(?k) OFFSET 10 LIMIT 20", "SELECT o_orderkey AS k FROM orders ORDER BY 1 DESC LIMIT 20 OFFSET 10")
pair("order_by_expression", "orders", "SELECT ?k { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t } ORDER BY DESC(?t / 2) ?k LIMIT 25", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice / 2 DESC, 1 LIMIT 25")
pair("distinct_ordered", "orders", "SELECT DISTINCT ?p { ?o orders:o_orderpriority ?p } ORDER BY ?p LIMIT 3", "SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY 1 LIMIT 3")
pair("group_count", "orders", "SELECT ?s (COUNT(*) AS ?n) { ?o orders:o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
pair("group_sum_int", "part", "SELECT ?b (SUM(?s) AS ?n) { ?p part:p_brand ?b ; part:p_size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 1")
pair("group_avg", "lineitem", "SELECT ?f (FLOOR(AVG(?q) * 10000) AS ?a) { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, floor(avg(l_quantity) * 10000) AS a FROM lineitem GROUP BY 1")
pair("group_min_max", "orders", "SELECT ?s (MIN(?t) AS ?a) (MAX(?t) AS ?b) (MIN(?d) AS ?c) { ?o orders:o_orderstatus ?s ; orders:o_totalprice ?t ; orders:o_orderdate ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_orderdate) AS c FROM orders GROUP BY 1")
pair("group_sample", "nation", "SELECT ?r (SAMPLE(?n) AS ?s) { ?x nation:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, min(n_name) AS s FROM nation GROUP BY 1")
pair("group_concat", "nation", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?s) { ?x nation:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r', "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, ', ' ORDER BY n_name) AS s FROM nation GROUP BY 1")
pair("group_concat_distinct", "orders", 'SELECT (GROUP_CONCAT(DISTINCT ?s; SEPARATOR="/") AS ?a) { ?o orders:o_orderstatus ?s }', "SELECT string_agg(DISTINCT o_orderstatus, '/' ORDER BY o_orderstatus) AS a FROM orders")
pair("string_join_aggregate", "region", 'SELECT (fn:string-join(?n, ";") AS ?a) { ?x region:r_name ?n }', "SELECT string_agg(r_name, ';' ORDER BY r_name) AS a FROM region")
pair("group_count_distinct", "orders", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) { ?o orders:o_orderstatus ?s ; orders_:o_custkey ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
pair("count_all_distinct", "lineitem", "SELECT (COUNT(DISTINCT *) AS ?n) { { SELECT ?f ?s { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s } } }", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
pair("group_expression", "orders", "SELECT ?y (COUNT(*) AS ?n) { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
pair("aggregate_empty", "orders", 'SELECT (COUNT(?t) AS ?n) (SUM(?t) AS ?s) { ?o orders:o_totalprice ?t ; orders:o_orderstatus "none" }', "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s")
pair("having", "orders", "SELECT ?c (COUNT(*) AS ?n) { ?o orders:o_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 12 && MIN(?c) > 10)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND min(o_custkey) > 10")
pair("aggregate_arithmetic", "lineitem", "SELECT ?f (SUM(?q) / COUNT(?q) > 25.5 AS ?high) (MAX(?q) - MIN(?q) AS ?span) { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_quantity) / count(l_quantity) > 25.5 AS high, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1")
pair("ext_median", "part", "SELECT ?b (ext:median(?p) AS ?m) { ?x part:p_brand ?b ; part:p_retailprice ?p } GROUP BY ?b", "SELECT p_brand AS b, list_sort(list(p_retailprice))[(count(*) - 1) // 2 + 1] AS m FROM part GROUP BY 1")
pair("ext_mode", "orders", "SELECT ?s (ext:mode(?p) AS ?m) { ?o orders:o_orderstatus ?s ; orders:o_orderpriority ?p } GROUP BY ?s", "SELECT s, m FROM (SELECT o_orderstatus AS s, o_orderpriority AS m, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
pair("ext_nmin_nmax", "part", "SELECT ?b (ext:nmin(?s) AS ?a) (ext:nmax(?s) AS ?z) { ?x part:p_brand ?b ; part:p_size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(min(p_size) AS BIGINT) AS a, CAST(max(p_size) AS BIGINT) AS z FROM part GROUP BY 1")
pair("ext_all_any_none", "orders", "SELECT ?s (ext:all(?t > 1000) AS ?a) (ext:any(?t > 450000) AS ?b) (ext:none(?t > 490000) AS ?c) { ?o orders:o_orderstatus ?s ; orders:o_totalprice ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 450000) AS b, NOT bool_or(o_totalprice > 490000) AS c FROM orders GROUP BY 1")
pair("flagship_revenue", "nation customer orders", "SELECT ?name (FLOOR(SUM(?t)) AS ?revenue) (COUNT(*) AS ?orders) { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t . ?c customer_:c_nationkey ?n . ?n nation:n_name ?name } GROUP BY ?name ORDER BY DESC(?revenue)", "SELECT n_name AS name, floor(sum(o_totalprice)) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
pair("fn_string_basic", "part", 'SELECT ?k (STRLEN(?n) AS ?a) (UCASE(?n) AS ?b) (LCASE(?n) AS ?c) (SUBSTR(?n, 2, 3) AS ?d) (CONCAT(?n, "-", STR(?s)) AS ?e) { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_size ?s }', "SELECT p_partkey AS k, length(p_name) AS a, upper(p_name) AS b, lower(p_name) AS c, substring(p_name, 2, 3) AS d, p_name || '-' || p_size AS e FROM part")
pair("fn_string_tests", "part", 'SELECT ?k (STRSTARTS(?n, "P") AS ?a) (STRENDS(?n, "1") AS ?b) (CONTAINS(?n, "00") AS ?c) (STRBEFORE(?b0, "#") AS ?d) (STRAFTER(?b0, "#") AS ?e) { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_brand ?b0 }', "SELECT p_partkey AS k, starts_with(p_name, 'P') AS a, ends_with(p_name, '1') AS b, contains(p_name, '00') AS c, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS d, CASE WHEN contains(p_brand, '#') THEN substring(p_brand, position('#' IN p_brand) + 1) ELSE '' END AS e FROM part")
pair("fn_replace_encode", "part", 'SELECT ?k (REPLACE(?b, "[0-9]", "x") AS ?a) (ENCODE_FOR_URI(?b) AS ?c) { ?p part:p_partkey ?k ; part:p_brand ?b }', "SELECT p_partkey AS k, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS a, replace(p_brand, '#', '%23') AS c FROM part")
pair("fn_date_parts", "events", "SELECT ?k (YEAR(?t) AS ?a) (MONTH(?t) AS ?b) (DAY(?t) AS ?c) (HOURS(?t) AS ?d) (MINUTES(?t) AS ?e) (TZ(?t) AS ?z) { ?x events:event_id ?k ; events:ts ?t }", "SELECT event_id AS k, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS d, minute(ts) AS e, 'Z' AS z FROM events")
pair("fn_date_arithmetic", "orders", 'SELECT ?k (?d + "P1DT2H"^^xsd:dayTimeDuration AS ?later) { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }', "SELECT o_orderkey AS k, o_orderdate + INTERVAL 26 HOUR AS later FROM orders")
pair("fn_math_round", "lineitem", "SELECT (SUM(xsd:integer(CEIL(?q))) AS ?a) (SUM(xsd:integer(FLOOR(?p))) AS ?b) (SUM(xsd:integer(ROUND(?p))) AS ?c) (SUM(xsd:integer(ABS(0 - ?q))) AS ?d) { ?l lineitem:l_quantity ?q ; lineitem:l_extendedprice ?p }", "SELECT CAST(sum(ceil(l_quantity)) AS BIGINT) AS a, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS b, CAST(sum(floor(l_extendedprice + 0.5)) AS BIGINT) AS c, CAST(sum(floor(abs(0 - l_quantity))) AS BIGINT) AS d FROM lineitem")
pair("fn_math_ext", "part", "SELECT ?k (ext:sq(?s) AS ?a) (ext:cube(?s) AS ?b) (ext:sqrt(?s * ?s) AS ?c) (afn:max(?s, 10) AS ?d) (ext:factorial(5) AS ?e) { ?p part:p_partkey ?k ; part:p_size ?s }", "SELECT p_partkey AS k, CAST(p_size * p_size AS DOUBLE) AS a, CAST(p_size * p_size * p_size AS DOUBLE) AS b, CAST(p_size AS DOUBLE) AS c, CAST(greatest(p_size, 10) AS BIGINT) AS d, 120::BIGINT AS e FROM part")
pair("fn_trig", "part", "SELECT ?k (ROUND(ext:sin(?s) * 1000000) AS ?a) (ROUND(ext:cos(?s) * 1000000) AS ?b) (ROUND(ext:degrees-to-radians(?s) * 1000000) AS ?c) { ?p part:p_partkey ?k ; part:p_size ?s }", "SELECT p_partkey AS k, floor(sin(p_size) * 1000000 + 0.5) AS a, floor(cos(p_size) * 1000000 + 0.5) AS b, floor(radians(p_size) * 1000000 + 0.5) AS c FROM part")
pair("fn_hash", "region", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) { ?x region:r_name ?n }", "SELECT r_name AS n, md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c FROM region")
pair("fn_cast", "orders", "SELECT ?k (xsd:integer(?t) AS ?a) (xsd:string(?k) AS ?b) (xsd:double(?k) AS ?c) (xsd:boolean(?k) AS ?d) { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t }", "SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(o_orderkey AS VARCHAR) AS b, CAST(o_orderkey AS DOUBLE) AS c, o_orderkey <> 0 AS d FROM orders")
pair("fn_if_coalesce", "customer orders", 'SELECT ?k (IF(?b < 0, "debt", "credit") AS ?w) (COALESCE(?t, -1.0e0) AS ?v) { ?c customer:c_custkey ?k ; customer:c_acctbal ?b OPTIONAL { ?o orders_:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 400000) } }', "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS w, coalesce(o_totalprice, -1.0) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
pair("fn_term_tests", "nation", "SELECT ?k (isIRI(?x) AS ?a) (isLiteral(?n) AS ?b) (isBlank(?x) AS ?c) (isNumeric(?k) AS ?d) (STR(DATATYPE(?k)) AS ?e) (STR(?x) AS ?f) { ?x nation:n_nationkey ?k ; nation:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) AS k, true AS a, true AS b, false AS c, true AS d, 'http://www.w3.org/2001/XMLSchema#integer' AS e, 'urn:row:nation/' || n_nationkey AS f FROM nation")
pair("fn_xpath", "part", "SELECT ?k (fn:upper-case(?n) AS ?a) (fn:normalize-space(CONCAT(?n, '  x ')) AS ?b) (fn:compare(?n, 'Part') AS ?c) (fn:substring-after(?n, ' ') AS ?d) (fn:round-half-to-even(?s / 2.0e0) AS ?e) { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_size ?s }", "SELECT p_partkey AS k, upper(p_name) AS a, trim(regexp_replace(p_name || '  x ', '\\s+', ' ', 'g')) AS b, CAST(CASE WHEN p_name < 'Part' THEN -1 WHEN p_name > 'Part' THEN 1 ELSE 0 END AS BIGINT) AS c, CASE WHEN contains(p_name, ' ') THEN substring(p_name, position(' ' IN p_name) + 1) ELSE '' END AS d, round_even(p_size / 2.0, 0) AS e FROM part")
pair("fn_afn", "region", "SELECT ?x0 (afn:localname(?x) AS ?a) (afn:namespace(?x) AS ?b) (afn:sha1sum(?n) AS ?c) (afn:substring(?n, 1, 3) AS ?d) { ?x region:r_regionkey ?x0 ; region:r_name ?n }", "SELECT CAST(r_regionkey AS BIGINT) AS x0, CAST(r_regionkey AS VARCHAR) AS a, 'urn:row:region/' AS b, sha1(r_name) AS c, substring(r_name, 2, 2) AS d FROM region")
pair("arithmetic", "part", "SELECT ?k (?s + 1 AS ?a) (?s - 2.5e0 AS ?b) (-?s AS ?c) (xsd:double(?s / 4) AS ?d) (?s / 0 AS ?e) { ?p part:p_partkey ?k ; part:p_size ?s }", "SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS a, p_size - 2.5e0 AS b, CAST(-p_size AS BIGINT) AS c, p_size / 4 AS d, NULL::DOUBLE AS e FROM part")
pair("path_seq", "region nation customer", "SELECT ?c ?r { ?x customer:c_custkey ?c ; customer_:c_nationkey/nation_:n_regionkey/region:r_name ?r }", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pair("path_alt", "nation customer supplier", "SELECT ?n (COUNT(*) AS ?c) { ?x customer_:c_nationkey|supplier_:s_nationkey ?y . ?y nation:n_name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1")
pair("path_inverse", "region nation", "SELECT ?r ?n { ?x region:r_name ?r ; ^nation_:n_regionkey/nation:n_name ?n }", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey")
pair("path_neg", "region", "SELECT ?s ?o { ?s !(region:r_regionkey|rdf:type) ?o }", "SELECT '<urn:row:region/' || r_regionkey || '>' AS s, '\"' || r_name || '\"' AS o FROM region")
pair("path_plus", "region nation customer", "SELECT ?a ?b { ?a (customer_:c_nationkey|nation_:n_regionkey)+ ?b }", "WITH e AS (SELECT 'urn:row:customer/' || c_custkey AS a, 'urn:row:nation/' || c_nationkey AS b FROM customer UNION ALL SELECT 'urn:row:nation/' || n_nationkey, 'urn:row:region/' || n_regionkey FROM nation) SELECT a, b FROM e UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a")
pair("path_plus_cycle", "region nation supplier", "SELECT ?b { <urn:row:nation/1> (nation_:n_regionkey|^nation_:n_regionkey)+ ?b }", "WITH RECURSIVE e AS (SELECT 'urn:row:nation/' || n_nationkey AS a, 'urn:row:region/' || n_regionkey AS b FROM nation), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT b FROM f WHERE a = 'urn:row:nation/1' UNION SELECT f.b FROM r JOIN f ON r.b = f.a) SELECT b FROM r")
pair("path_star", "region nation", "SELECT ?b { <urn:row:nation/2> nation_:n_regionkey* ?b }", "SELECT 'urn:row:nation/2' AS b UNION ALL SELECT 'urn:row:region/' || n_regionkey FROM nation WHERE n_nationkey = 2")
pair("path_opt", "region nation", "SELECT ?b { <urn:row:nation/2> nation_:n_regionkey? ?b }", "SELECT 'urn:row:nation/2' AS b UNION ALL SELECT 'urn:row:region/' || n_regionkey FROM nation WHERE n_nationkey = 2")
pair("path_range", "region nation customer", "SELECT (COUNT(*) AS ?n) { ?a (customer_:c_nationkey|nation_:n_regionkey){2} ?b }", "SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")


def _query(tables: str, sparql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Engine(spark, tables_in(spark, folder, tables.split()), PREFIXES).select(sparql)


PAIRS |= feature_queries.PAIRS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(t, q) for n, (t, q, _) in PAIRS.items()}
SQL: dict[str, str] = {n: sql for n, (_, _, sql) in PAIRS.items()}


# Queries that need more than one SPARQL text: other forms, graphs, updates, inference, shapes, text.


def _engine(spark: SparkSession, folder: str, tables: str) -> Engine:
    return Engine(spark, tables_in(spark, folder, tables.split()), PREFIXES)


def _quads(spark: SparkSession, folder: str, tables: str) -> QuadSource:
    return tables_in(spark, folder, tables.split()).quads()


def _by_table(spark: SparkSession, folder: str, tables: str) -> QuadSource:
    """The mapped quads, each table in a named graph."""
    q = _quads(spark, folder, tables).quads
    return QuadSource(q.withColumn("g", F.concat(F.lit("urn:g:"), F.regexp_extract("s.lex", "^urn:row:([a-z]+)/", 1))))


def ask(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder, "orders").ask_frame("ASK { ?o orders:o_totalprice ?t FILTER(?t > 400000) }")


def ask_false(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder, "nation").ask_frame('ASK { ?n nation:n_name "Atlantis" }')


def construct(spark: SparkSession, folder: str) -> DataFrame:
    t = _engine(spark, folder, "nation region").query("CONSTRUCT { ?r <urn:has> ?n } WHERE { ?x nation:n_name ?n ; nation_:n_regionkey ?r }").triples
    return t.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


def construct_count(spark: SparkSession, folder: str) -> DataFrame:
    t = _engine(spark, folder, "customer").query("CONSTRUCT { ?s a <urn:Segment> } WHERE { ?c customer:c_mktsegment ?m BIND(IRI(CONCAT('urn:s:', ?m)) AS ?s) }").triples
    return t.agg(F.count(F.lit(1)).alias("n"))


def describe(spark: SparkSession, folder: str) -> DataFrame:
    t = _engine(spark, folder, "region nation").query("DESCRIBE ?n WHERE { ?n nation_:n_regionkey <urn:row:region/1> }").triples
    return t.groupBy(F.col("s.lex").alias("s")).agg(F.count(F.lit(1)).alias("n"))


def graph_var(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


def graph_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT (STR(?n) AS ?name) { GRAPH <urn:g:region> { ?x region:r_name ?n } }")


def graph_join(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT (STR(?a) AS ?n) (STR(?b) AS ?r) { GRAPH <urn:g:nation> { ?x nation:n_name ?a ; nation_:n_regionkey ?y } GRAPH ?h { ?y region:r_name ?b } }")


def from_graph(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT (COUNT(*) AS ?n) FROM <urn:g:nation> { ?s ?p ?o }")


def from_named(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT DISTINCT ?g FROM NAMED <urn:g:nation> { GRAPH ?g { ?s ?p ?o } }")


def select_distinct_graphs(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _by_table(spark, folder, "nation region"), PREFIXES).select("SELECT DISTINCT ?g { GRAPH ?g { ?s ?p ?o } }")


def union_default_graph(spark: SparkSession, folder: str) -> DataFrame:
    source = replace(_by_table(spark, folder, "nation region"), union=True)
    return Engine(spark, source, PREFIXES).select("SELECT (COUNT(*) AS ?n) { ?x nation_:n_regionkey ?y . ?y region:r_name ?r }")


def quads_star(spark: SparkSession, folder: str) -> DataFrame:
    """The same engine over generic quads: values keep their datatypes."""
    return Engine(spark, _quads(spark, folder, "part"), PREFIXES).select("SELECT (xsd:integer(?k) AS ?id) (xsd:integer(?s) + 1 AS ?size) (STR(?b) AS ?brand) { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_brand ?b FILTER(?s >= 45) }")


def quads_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, _quads(spark, folder, "part"), PREFIXES).select("SELECT (STR(?b) AS ?brand) (xsd:integer(SUM(?s)) AS ?total) (xsd:integer(MAX(?s)) AS ?most) (COUNT(DISTINCT ?s) AS ?sizes) { ?p part:p_size ?s ; part:p_brand ?b } GROUP BY ?b")


def quoted_triples(spark: SparkSession, folder: str) -> DataFrame:
    e = _engine(spark, folder, "nation")
    stated = e.query("CONSTRUCT { << ?x <urn:key> ?k >> <urn:name> ?n } WHERE { ?x nation:n_nationkey ?k ; nation:n_name ?n }").triples
    quads = stated.select("s", F.col("p.lex").alias("p"), "o", F.lit(None).cast("string").alias("g"))
    return Engine(spark, QuadSource(quads), PREFIXES).select("SELECT (xsd:integer(?k) AS ?key) (STR(?n) AS ?name) { << ?x <urn:key> ?k >> <urn:name> ?n FILTER(?k < 10) }")


def _updated(spark: SparkSession, folder: str, tables: str, text: str) -> Store:
    s = Store(spark, _quads(spark, folder, tables), PREFIXES)
    s.update(text)
    return s


def update_insert_delete(spark: SparkSession, folder: str) -> DataFrame:
    s = _updated(spark, folder, "nation", "DELETE { ?x nation:n_name ?n } INSERT { ?x <urn:label> ?u } WHERE { ?x nation:n_name ?n ; nation:n_nationkey ?k BIND(LCASE(?n) AS ?u) FILTER(?k < 5) } ; INSERT DATA { <urn:new> nation:n_name 'Nowhere' } ; DELETE WHERE { ?y nation:n_regionkey ?r }")
    return s.source.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def update_graphs(spark: SparkSession, folder: str) -> DataFrame:
    s = _updated(spark, folder, "region", "INSERT { GRAPH <urn:g:a> { ?x region:r_name ?n } } WHERE { ?x region:r_name ?n } ; COPY <urn:g:a> TO <urn:g:b> ; ADD DEFAULT TO <urn:g:b> ; MOVE <urn:g:a> TO <urn:g:c> ; CLEAR DEFAULT")
    return s.source.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def rdfs_subclass(spark: SparkSession, folder: str) -> DataFrame:
    """Customers are of their nation's class, and nations are sub-classes of their regions."""
    t = _engine(spark, folder, "region nation customer").query("CONSTRUCT { ?n rdfs:subClassOf ?r . ?c a ?n } WHERE { ?n nation_:n_regionkey ?r . ?c customer_:c_nationkey ?n }").triples
    data = QuadSource(t.select("s", F.col("p.lex").alias("p"), "o", F.lit(None).cast("string").alias("g")))
    return Engine(spark, inference.rdfs(data), PREFIXES).select("SELECT (STR(?r) AS ?class) (COUNT(DISTINCT ?c) AS ?n) { ?c a ?r FILTER(STRSTARTS(STR(?r), 'urn:row:region/')) } GROUP BY ?r")


def rules_transitive(spark: SparkSession, folder: str) -> DataFrame:
    q = _quads(spark, folder, "region nation supplier").quads.filter(F.col("p").startswith("urn:ref:"))
    got = inference.rules(QuadSource(q), "{ ?s supplier_:s_nationkey ?n . ?n nation_:n_regionkey ?r } => { ?s <urn:in> ?r } .", PREFIXES)
    return Engine(spark, got, PREFIXES).select("SELECT (STR(?r) AS ?region) (COUNT(*) AS ?n) { ?s <urn:in> ?r } GROUP BY ?r")


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix c: <urn:col:customer#> .
<urn:S> a sh:NodeShape ; sh:targetClass <urn:table:customer> ; sh:property [ sh:path c:c_acctbal ; sh:minCount 1 ; sh:minInclusive 0 ] ;
 sh:property [ sh:path c:c_mktsegment ; sh:in ("BUILDING" "MACHINERY") ] ; sh:property [ sh:path c:c_name ; sh:maxLength 5 ; sh:datatype xsd:string ] ; sh:property [ sh:path c:c_phone ; sh:minCount 1 ] ."""


def shacl_validate(spark: SparkSession, folder: str) -> DataFrame:
    found = shacl.validate(_quads(spark, folder, "customer"), SHAPES)
    return found.groupBy(F.regexp_extract("component", "#(.*)Constraint", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def fulltext_match(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.contains_words(spark.read.parquet(f"{folder}/documents.parquet"), "text", "the and was").select("doc_id")


def fulltext_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = fulltext.TextIndex.of(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    return index.postings.filter(F.col("word").isin("the", "and", "was")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


def handlers_by_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return Handlers(_quads(spark, folder, "region nation").quads).only(F.col("o.kind") == 2).by_predicate()


def graph_difference(spark: SparkSession, folder: str) -> DataFrame:
    a = _quads(spark, folder, "region")
    b = QuadSource(a.quads.filter(F.col("p") != "urn:col:region#r_name"))
    removed, added = canon.difference(a, b)
    return removed.agg(F.count(F.lit(1)).alias("removed")).crossJoin(added.agg(F.count(F.lit(1)).alias("added")))


QUERIES |= {f.__name__: f for f in (ask, ask_false, construct, construct_count, describe, graph_var, graph_fixed, graph_join, from_graph, from_named, select_distinct_graphs, union_default_graph, quads_star, quads_aggregate, quoted_triples, update_insert_delete, update_graphs, rdfs_subclass, rules_transitive, shacl_validate, fulltext_match, fulltext_counts, handlers_by_predicate, graph_difference)}
SQL |= {
    "ask": "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 400000",
    "ask_false": "SELECT count(*) > 0 AS answer FROM nation WHERE n_name = 'Atlantis'",
    "construct": "SELECT 'urn:row:region/' || n_regionkey AS s, 'urn:has' AS p, n_name AS o FROM nation",
    "construct_count": "SELECT count(DISTINCT c_mktsegment) AS n FROM customer",
    "describe": "SELECT 'urn:row:nation/' || n_nationkey AS s, 5::BIGINT AS n FROM nation WHERE n_regionkey = 1",
    "graph_var": "SELECT 'urn:g:nation' AS g, count(*) * 5 AS n FROM nation UNION ALL SELECT 'urn:g:region', count(*) * 3 FROM region",
    "graph_fixed": "SELECT r_name AS name FROM region",
    "graph_join": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "from_graph": "SELECT count(*) * 5 AS n FROM nation",
    "from_named": "SELECT 'urn:g:nation' AS g",
    "select_distinct_graphs": "SELECT * FROM (VALUES ('urn:g:nation'), ('urn:g:region')) v(g)",
    "union_default_graph": "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey",
    "quads_star": "SELECT p_partkey AS id, CAST(p_size + 1 AS BIGINT) AS size, p_brand AS brand FROM part WHERE p_size >= 45",
    "quads_aggregate": "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS BIGINT) AS most, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1",
    "quoted_triples": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation WHERE n_nationkey < 10",
    "update_insert_delete": "SELECT * FROM (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, count(*) AS n FROM nation UNION ALL SELECT 'urn:col:nation#n_nationkey', count(*) FROM nation UNION ALL SELECT 'urn:col:nation#n_name', count(*) - 5 + 1 FROM nation UNION ALL SELECT 'urn:label', 5 UNION ALL SELECT 'urn:ref:nation#n_regionkey', count(*) FROM nation)",
    "update_graphs": "SELECT 'urn:g:b' AS g, count(*) * 3 AS n FROM region UNION ALL SELECT 'urn:g:c', count(*) FROM region",
    "rdfs_subclass": "SELECT 'urn:row:region/' || n_regionkey AS class, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "rules_transitive": "SELECT 'urn:row:region/' || n_regionkey AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "shacl_validate": "SELECT * FROM (SELECT 'MinInclusive' AS component, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'In', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'MaxLength', count(*) FROM customer WHERE length(c_name) > 5 UNION ALL SELECT 'MinCount', count(*) FROM customer) WHERE n > 0",
    "fulltext_match": "SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'was')",
    "fulltext_counts": "SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents) WHERE word IN ('the', 'and', 'was') GROUP BY 1",
    "handlers_by_predicate": "SELECT * FROM (SELECT 'urn:col:nation#n_nationkey' AS p, count(*) AS n FROM nation UNION ALL SELECT 'urn:col:nation#n_name', count(*) FROM nation UNION ALL SELECT 'urn:col:nation#n_regionkey', count(*) FROM nation UNION ALL SELECT 'urn:col:region#r_regionkey', count(*) FROM region UNION ALL SELECT 'urn:col:region#r_name', count(*) FROM region)",
    "graph_difference": "SELECT count(*) AS removed, 0::BIGINT AS added FROM region",
}
QUERIES |= feature_queries.QUERIES
SQL |= feature_queries.SQL
