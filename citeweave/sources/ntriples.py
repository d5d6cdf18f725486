"""N-Triples files as a table of triples, and the typed tables of a graph from them."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeweave.functions import vocabulary as V
from citeweave.graph import Graph

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$'
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\", "b": "\b", "f": "\f"}


@F.pandas_udf(StringType())
def _unescaped(values):
    import re

    one = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1])
    return values.map(lambda v: None if v is None else re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, v))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind (uri, blank, literal), o_datatype, o_lang; blank and comment lines are skipped, others refused."""
    return parsed_lines(spark.read.text(path)).drop("g")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """g (null outside graphs) and the triple of each line (value) of N-Triples or N-Quads."""
    lines = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", LINE, k)
    kind = F.when(part(3) != "", "uri").when(part(4) != "", "blank").otherwise("literal")
    text = F.when(part(5).contains("\\"), _unescaped(part(5))).otherwise(part(5))
    checked = lines.withColumn("value", F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), "value"))))
    return checked.select(
        F.nullif(part(8), F.lit("")).alias("g"),
        F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"),
        F.when(kind == "uri", part(3)).when(kind == "blank", part(4)).otherwise(text).alias("o"), kind.alias("o_kind"),
        F.nullif(part(6), F.lit("")).alias("o_datatype"), F.nullif(part(7), F.lit("")).alias("o_lang"),
    )


def graph_of(triples: DataFrame) -> Graph:
    """The typed tables, each one aggregation over its entities' triples; ``triples`` keeps what no typed table holds.

    Of quads the graphs' names are left out.
    """
    triples = triples.drop("g")
    value = lambda predicate: F.min(F.when(F.col("p") == predicate, F.col("o")))
    types = F.array_sort(F.collect_set(F.when(F.col("p") == V.RDF_TYPE, F.col("o"))))
    is_a = lambda c: triples.where((F.col("p") == V.RDF_TYPE) & (F.col("o") == c)).select("s").distinct()
    entity = lambda c, **fields: triples.join(is_a(c), "s", "left_semi").groupBy(F.col("s").alias("uri")).agg(*[f.alias(n) for n, f in fields.items()])
    br = entity(V.EXPRESSION, types=types, title=value(V.TITLE), subtitle=value(V.SUBTITLE), pub_date=value(V.PUB_DATE), number=value(V.NUMBER), edition=value(V.EDITION), part_of=value(V.PART_OF))
    ra = entity(V.AGENT_CLASS, name=value(V.NAME), given_name=value(V.GIVEN), family_name=value(V.FAMILY))
    ar = entity(V.ROLE_CLASS, role_type=value(V.ROLE), held_by=value(V.HELD_BY), next=value(V.NEXT))
    ident = entity(V.IDENTIFIER_CLASS, scheme=value(V.SCHEME), literal=value(V.LITERAL))
    edges = triples.where(F.col("p") == V.HAS_ID).select(F.col("s").alias("owner"), F.col("o").alias("id")).distinct()
    kinds = br.select(F.lit("br").alias("owner_kind"), F.col("uri").alias("owner")).unionByName(ra.select(F.lit("ra").alias("owner_kind"), F.col("uri").alias("owner")))
    roles = triples.where(F.col("p") == V.CONTRIBUTOR).select(F.col("s").alias("br"), F.col("o").alias("ar")).distinct()
    typed = [V.RDF_TYPE, V.TITLE, V.SUBTITLE, V.PUB_DATE, V.NUMBER, V.EDITION, V.PART_OF, V.NAME, V.GIVEN, V.FAMILY, V.ROLE, V.HELD_BY, V.NEXT, V.SCHEME, V.LITERAL, V.HAS_ID, V.CONTRIBUTOR]
    return Graph(br=br, ra=ra, ar=ar, ident=ident, br_ar=roles, ent_id=kinds.join(edges, "owner").select("owner_kind", "owner", "id"), triples=triples.where(~F.col("p").isin(typed)))


#: What the columns of typed tables say: column, predicate, kind of object; entities' classes come first.
_TEXT = {"br": [("title", V.TITLE), ("subtitle", V.SUBTITLE), ("pub_date", V.PUB_DATE), ("number", V.NUMBER), ("edition", V.EDITION)], "ra": [("name", V.NAME), ("given_name", V.GIVEN), ("family_name", V.FAMILY)], "ident": [("literal", V.LITERAL)]}
_LINKS = {"br": [("part_of", V.PART_OF)], "ar": [("role_type", V.ROLE), ("held_by", V.HELD_BY), ("next", V.NEXT)], "ident": [("scheme", V.SCHEME)], "br_ar": [("ar", V.CONTRIBUTOR)], "ent_id": [("id", V.HAS_ID)]}
_CLASS = {"ra": V.AGENT_CLASS, "ar": V.ROLE_CLASS, "ident": V.IDENTIFIER_CLASS}
_SUBJECT = {"br_ar": "br", "ent_id": "owner"}
_XSD = "http://www.w3.org/2001/XMLSchema#"


def row_triples(name: str, table: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """The triples that the rows of a graph's table say, with the columns ``kept``; one pass over the table."""
    if name == "triples":
        return table.select(*kept, "s", "p", "o", "o_kind", "o_datatype", "o_lang")

    def said(predicate: str, o: Column, kind: str) -> Column:
        dated = F.when(F.length(o) == 4, _XSD + "gYear").when(F.length(o) == 7, _XSD + "gYearMonth").otherwise(_XSD + "date")
        datatype = F.lit(None).cast("string") if kind == "uri" else dated if predicate == V.PUB_DATE else F.lit(_XSD + "string")
        return F.struct(F.lit(predicate).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))

    facts = [said(V.RDF_TYPE, F.lit(_CLASS[name]), "uri")] if name in _CLASS else []
    facts += [said(p, F.col(c), "literal") for c, p in _TEXT.get(name, [])] + [said(p, F.col(c), "uri") for c, p in _LINKS.get(name, [])]
    listed = F.array(*facts)
    if name == "br":
        listed = F.concat(listed, F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: said(V.RDF_TYPE, t, "uri")))
    rows = table.select(*kept, F.col(_SUBJECT.get(name, "uri")).alias("s"), F.explode(listed).alias("t"))
    return rows.select(*kept, "s", "t.*").where("o is not null")


def triples_of(graph: Graph) -> DataFrame:
    """All triples of a graph, typed tables included."""
    parts = [row_triples(f.name, getattr(graph, f.name)) for f in dataclasses.fields(Graph)]
    return functools.reduce(DataFrame.unionByName, parts)


def line_column(graph: Column | None = None) -> Column:
    """The N-Triples line (value) of a row of triples, or the N-Quads line in a graph."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node(F.col("o")))
    last = F.lit(" .") if graph is None else F.concat(F.lit(" <"), graph, F.lit("> ."))
    return F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), value, last).alias("value")
