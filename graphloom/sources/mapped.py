"""A virtual graph over relational tables, by the direct mapping.

A row with key k of table T is <urn:row:T/k>; a column c is the predicate <urn:col:T#c>; a foreign key also is <urn:ref:T#c> to the
row that it names; every row has the type <urn:table:T>; NULL gives no triple. Patterns that share a subject are one scan of its
table, whatever their number, and references are joins of keys: the texts of IRIs are only made where they are returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import IRI, TERM_TYPE, Val, as_term, constant, term_struct
from graphloom.plans import algebra as A
from graphloom.plans.solutions import Info, Solutions, column
from graphloom.sources.quads import QuadSource

ROW, COL, REF, TABLE = "urn:row:", "urn:col:", "urn:ref:", "urn:table:"
KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "flt", "double": "dbl", "string": "str", "boolean": "bool", "timestamp": "dt", "timestamp_ntz": "dt", "date": "date"}


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    key: tuple[str, ...] = ()  # none: the hash of all columns
    refs: dict[str, str] = field(default_factory=dict)  # column to table

    def kind(self, c: str) -> str | None:
        t = self.df.schema[c].dataType.simpleString()
        return "dec" if t.startswith("decimal") else KINDS.get(t)

    def key_column(self) -> Column:
        if len(self.key) == 1:
            return F.col(f"`{self.key[0]}`")
        if self.key:
            return F.concat_ws("/", *(F.col(f"`{k}`").cast("string") for k in self.key))
        return F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in self.df.columns))))

    @property
    def prefix(self) -> str:
        return f"{ROW}{self.name}/"


@dataclass(frozen=True)
class MappedSource:
    spark: SparkSession
    tables: dict[str, Table]

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([], "g string")

    def dataset(self, default: list[str], named: list[str]) -> MappedSource:
        return self

    def quads(self) -> QuadSource:
        """The mapped graph as quads: a pass over each table."""
        out = None
        for t in self.tables.values():
            row = as_term(Val("iri", t.key_column(), t.prefix)).col.alias("s")
            parts = [F.struct(F.lit(A.RDF + "type").alias("p"), term_struct(IRI, F.lit(TABLE + t.name)).cast(TERM_TYPE).alias("o"))]
            for c in t.df.columns:
                if kind := t.kind(c):
                    parts.append(F.struct(F.lit(f"{COL}{t.name}#{c}").alias("p"), as_term(self.value(t, c, kind)).col.cast(TERM_TYPE).alias("o")))
            for c, to in t.refs.items():
                parts.append(F.struct(F.lit(f"{REF}{t.name}#{c}").alias("p"), as_term(Val("iri", F.col(f"`{c}`"), f"{ROW}{to}/")).col.cast(TERM_TYPE).alias("o")))
            part = t.df.select(row, F.explode(F.array(*parts)).alias("x")).select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g")).filter(F.col("o").isNotNull())
            out = part if out is None else out.unionAll(part)
        return QuadSource(out) if out is not None else QuadSource.empty(self.spark)

    def nodes(self, graph: A.Node | None) -> DataFrame:
        return self.quads().nodes(None)

    def value(self, t: Table, c: str, kind: str) -> Val:
        col = F.col(f"`{c}`")
        return Val(kind, col.cast("bigint") if kind == "int" else col.cast("timestamp") if kind == "dt" else col)

    def star(self, triples: list[A.Triple], graph: A.Node | None) -> list[Solutions]:
        if graph is not None:
            return [Solutions(self.spark.createDataFrame([], ", ".join(f"`{column(v)}` {TERM_TYPE}" for v in vs) or "x int").select(*(f"`{column(v)}`" for v in vs)), {v: Info("term") for v in vs}) for vs in [A.variables(A.Bgp(tuple(triples)))]]
        stars: dict[tuple, list[A.Triple]] = {}
        loose = []
        for t in triples:
            table = self.table_of(t)
            if table is None:
                loose.append(t)
            else:
                stars.setdefault((t.s, table), []).append(t)
        out = [self.scan(self.tables[name], s, ts) for (s, name), ts in stars.items()]
        if loose:
            out += self.quads().star(loose, None)
        return out

    def table_of(self, t: A.Triple) -> str | None:
        if not isinstance(t.p, A.Iri):
            return None
        p = t.p.value
        for head in (COL, REF):
            if p.startswith(head):
                name, _, c = p[len(head) :].partition("#")
                known = self.tables.get(name)
                return name if known and (c in known.refs if head == REF else c in known.df.columns) else None
        if p == A.RDF + "type" and isinstance(t.o, A.Iri) and t.o.value.startswith(TABLE) and t.o.value[len(TABLE) :] in self.tables:
            return t.o.value[len(TABLE) :]
        return None

    def scan(self, t: Table, subject: A.Node, triples: list[A.Triple]) -> Solutions:
        """One scan for all patterns of a subject."""
        cols: dict[str, Val] = {}
        conditions: list[Column] = []

        def bind(node: A.Node, v: Val) -> None:
            if isinstance(node, A.Var):
                if node.name in cols:
                    a = cols[node.name]
                    conditions.append(a.col == v.col if (a.kind, a.extra) == (v.kind, v.extra) else as_term(a).col == as_term(v).col)
                else:
                    cols[node.name] = v
            elif v.kind == "iri":
                if not isinstance(node, A.Iri) or not node.value.startswith(v.extra or ""):
                    conditions.append(F.lit(False))
                else:
                    conditions.append(v.col == F.lit(node.value[len(v.extra or "") :]).cast(t.df.schema[t.key[0]].dataType if v.extra == t.prefix and len(t.key) == 1 else "string"))
            else:
                c = constant(node)
                conditions.append(v.col == c.col if c.kind == v.kind else as_term(v).col == as_term(c).col)

        bind(subject, Val("iri", t.key_column(), t.prefix))
        for tr in triples:
            p = tr.p.value
            if p == A.RDF + "type":
                continue
            c = p.partition("#")[2]
            conditions.append(F.col(f"`{c}`").isNotNull())
            bind(tr.o, Val("iri", F.col(f"`{c}`"), f"{ROW}{t.refs[c]}/") if p.startswith(REF) else self.value(t, c, t.kind(c)))
        df = t.df
        for c in conditions:
            df = df.filter(c)
        return Solutions(df.select(*(v.col.alias(column(n)) for n, v in cols.items())), {n: Info(v.kind, v.extra) for n, v in cols.items()})


#: Keys and references of the tables that the benchmark queries run over.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",)}
REFS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}}


def tables_in(spark: SparkSession, folder: str, names: list[str] | None = None) -> MappedSource:
    """The mapped graph over a folder's tables."""
    names = list(KEYS) if names is None else names
    return MappedSource(spark, {n: Table(n, spark.read.parquet(f"{folder}/{n}.parquet"), KEYS[n], REFS.get(n, {})) for n in names})
