"""A knowledge graph projected from the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.graph import Graph

TABLES = ("orders", "part", "lineitem", "customer", "supplier")
_MONTH = "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)"
_DIGIT = "substr(o_orderpriority, 1, 1)"

#: name: SQL over the base tables, whose names stand in braces.
VIEWS = {
    "ra": "SELECT concat('ra/', p_partkey) AS uri, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN concat('Given', p_partkey % 10) END AS given_name, CASE WHEN p_partkey % 2 = 0 THEN concat('Family', p_partkey % 7) END AS family_name FROM {part}",
    "ra_id": f"SELECT concat('ra/', p_partkey) AS owner, concat('id/1', p_partkey) AS id, '{V.ORCID}' AS scheme, concat(p_partkey - p_partkey % 8, '-', p_size % 4) AS literal FROM {{part}} UNION ALL SELECT concat('ra/', p_partkey), concat('id/2', p_partkey), CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '{V.VIAF}' END, concat(p_partkey - p_partkey % 8, '-', p_type) FROM {{part}}",
    "article": f"SELECT concat('br/1', o_orderkey) AS uri, '{V.ARTICLE}' AS type1, CASE WHEN o_orderkey % 4 = 0 THEN '{V.FABIO}ReviewArticle' END AS type2, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN lower(concat('The Study of ', replace(o_orderpriority, ' ', '_'), ' ', o_custkey)) ELSE concat('The Study of ', replace(o_orderpriority, ' ', '_'), ' ', o_custkey) END AS title, CASE WHEN o_orderkey % 9 = 0 THEN 'a subtitle' END AS subtitle, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS pub_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 10 AS STRING) END AS number, CAST(NULL AS STRING) AS edition, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('br/i', {_DIGIT}, '-', {_MONTH}, '-', o_orderstatus) END AS part_of FROM {{orders}}",
    "container": f"SELECT DISTINCT concat('br/i', {_DIGIT}, '-', {_MONTH}, '-', o_orderstatus) AS uri, '{V.ISSUE}' AS type1, CAST(NULL AS STRING) AS type2, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS subtitle, {_MONTH} AS pub_date, substr({_MONTH}, 6, 2) AS number, CAST(NULL AS STRING) AS edition, concat('br/v', {_DIGIT}, '-', substr({_MONTH}, 1, 4), '-', o_orderstatus) AS part_of FROM {{orders}} UNION SELECT DISTINCT concat('br/v', {_DIGIT}, '-', substr({_MONTH}, 1, 4), '-', o_orderstatus), '{V.VOLUME}', CAST(NULL AS STRING), CASE WHEN o_orderstatus = 'F' THEN concat('Volume ', substr({_MONTH}, 1, 4)) ELSE concat('VOLUME  ', substr({_MONTH}, 1, 4)) END, CAST(NULL AS STRING), substr({_MONTH}, 1, 4), CASE WHEN {_DIGIT} = '2' THEN NULL ELSE substr({_MONTH}, 3, 2) END, CAST(NULL AS STRING), concat('br/j', {_DIGIT}, '-', o_orderstatus) FROM {{orders}} UNION SELECT DISTINCT concat('br/j', {_DIGIT}, '-', o_orderstatus), '{V.JOURNAL}', CAST(NULL AS STRING), CASE WHEN o_orderstatus = 'F' THEN concat('Journal of ', {_DIGIT}) ELSE concat('JOURNAL OF ', {_DIGIT}) END, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{orders}}",
    "br_id": f"SELECT concat('br/1', o_orderkey) AS owner, concat('id/3', o_orderkey) AS id, '{V.DOI}' AS scheme, concat('10.', o_custkey, '/Ab', {_MONTH}) AS literal FROM {{orders}} UNION ALL SELECT DISTINCT concat('br/j', {_DIGIT}, '-', o_orderstatus), concat('id/j', {_DIGIT}, o_orderstatus), '{V.ISSN}', concat('000', {_DIGIT}, '-', CASE WHEN o_orderstatus = 'P' THEN '9' ELSE '1' END) FROM {{orders}} WHERE {_DIGIT} <> '3'",
    "role": f"SELECT concat('ar/', l_orderkey, '-', l_linenumber, '-', n) AS ar, concat('br/1', l_orderkey) AS br, l_linenumber, n, CASE WHEN l_linenumber = 6 THEN NULL WHEN l_returnflag = 'A' THEN '{V.AUTHOR}' WHEN l_returnflag = 'N' THEN '{V.EDITOR}' ELSE '{V.PUBLISHER}' END AS role_type, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('ra/', CASE WHEN l_linenumber < 5 THEN l_partkey - l_partkey % 40 ELSE l_partkey END) END AS held_by FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM {{lineitem}}) AS numbered",
    "linked": "SELECT ar, br, l_linenumber, n, role_type, held_by, lead(ar) OVER (PARTITION BY br, role_type ORDER BY l_linenumber, n) AS next FROM ({role}) AS r",
}
VIEWS["linked"] = VIEWS["linked"].replace("{role}", VIEWS["role"])


#: Bytes of a table's files that a task takes: of lineitem, whose roles are sorted, and of part, whose rows meet seven others.
LINE_BYTES, PART_BYTES = 3_000_000, 200_000


def tasks(spark: SparkSession, sf_dir: str, table: str, share: int = LINE_BYTES) -> int:
    """So many tasks that each takes about ``share`` bytes of a table, however large it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, size // share + 1)


def projected(spark: SparkSession, sf_dir: str, view: str, dealt: bool = True) -> DataFrame:
    """A view. Lines need not be ``dealt`` where neither the roles' uris nor their order is read, as none are sorted then."""
    text = VIEWS[view]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if dealt and "lineitem" in tables:  # the window over a resource's lines sorts them
        tables["lineitem"] = tables["lineitem"].repartition(tasks(spark, sf_dir, "lineitem"), "l_orderkey")
    return spark.sql(text, **tables)


def with_views(*views: str) -> str:
    """The start of a DuckDB query that reads the views."""
    names = {t: t for t in TABLES}
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v].format(**names)})" for v in views) + " "


def resources(spark: SparkSession, sf_dir: str, containers: bool = True) -> DataFrame:
    rows = projected(spark, sf_dir, "article")
    rows = rows.unionByName(projected(spark, sf_dir, "container")) if containers else rows
    types = F.filter(F.array(F.lit(V.EXPRESSION), "type1", "type2"), lambda t: t.isNotNull())
    return rows.select("uri", types.alias("types"), "title", "subtitle", "pub_date", "number", "edition", "part_of")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    roles = projected(spark, sf_dir, "linked")
    ids = {kind: projected(spark, sf_dir, f"{kind}_id").withColumn("owner_kind", F.lit(kind)) for kind in ("br", "ra")}
    owned = ids["br"].unionByName(ids["ra"])
    return Graph.of(
        spark,
        br=resources(spark, sf_dir),
        ra=projected(spark, sf_dir, "ra"),
        ar=roles.select(F.col("ar").alias("uri"), "role_type", "held_by", "next"),
        ident=owned.select(F.col("id").alias("uri"), "scheme", "literal"),
        br_ar=roles.select("br", "ar"),
        ent_id=owned.select("owner_kind", "owner", "id"),
    )
