"""The registered queries: each operator applied to the projected graph, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.functions import text as X
from citeweave.functions import vocabulary as V
from citeweave.graph import Graph
from citeweave.operators import clusters, containers, contributors, filters, manual, provenance, redirects, survivors
from citeweave.plans import enrich
from citeweave.plans.projection import PART_BYTES, graph, projected, resources, tasks, with_views
from citeweave.sources import lookups
from citeweave.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _signatures(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return projected(spark, sf_dir, f"{kind}_id").select(F.col("owner").alias("uri"), "id", "scheme", "literal").where("scheme is not null and literal is not null")


#: Clusters of agents in SQL: shared identifiers, followed to a fixpoint.
_REACH = """held AS (SELECT DISTINCT owner AS uri, scheme, literal FROM ra_id WHERE scheme IS NOT NULL AND literal IS NOT NULL),
edge AS (SELECT DISTINCT a.uri, b.uri AS other FROM held a JOIN held b USING (scheme, literal) WHERE a.uri <> b.uri),
reach AS (SELECT uri, other FROM edge UNION SELECT r.uri, e.other FROM reach r JOIN edge e ON r.other = e.uri),
clustered AS (SELECT uri, least(uri, min(other)) AS cluster FROM reach GROUP BY uri) """
_SURVIVORS = """, quality AS (SELECT uri, (name IS NOT NULL)::int + (given_name IS NOT NULL)::int + (family_name IS NOT NULL)::int AS q1,
  coalesce(length(name), 0) + coalesce(length(given_name), 0) + coalesce(length(family_name), 0) AS q2 FROM ra),
picked AS (SELECT cluster, uri AS survivor FROM (SELECT c.*, row_number() OVER (PARTITION BY cluster ORDER BY q1 DESC, q2 DESC, uri) AS k
  FROM clustered c JOIN quality USING (uri)) WHERE k = 1) """
_AGENTS = with_views("ra", "ra_id")[:-1] + ", " + _REACH


@query(with_views("article", "container", "ra", "role", "ra_id", "br_id") + """
SELECT uri, 'br' AS kind, CAST(1 + (type2 IS NOT NULL)::int AS INT) AS n_types FROM (SELECT * FROM article UNION ALL SELECT * FROM container)
UNION ALL SELECT uri, 'ra', 0 FROM ra UNION ALL SELECT ar, 'ar', 0 FROM role UNION ALL SELECT id, 'ident', 0 FROM ra_id UNION ALL SELECT id, 'ident', 0 FROM br_id""")
def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    types = g.br.select("uri", F.size(filters.specific_types(F.col("types"))).alias("n_types"))
    return g.entities().join(types, "uri", "left").select("uri", "kind", F.coalesce("n_types", F.lit(0)).alias("n_types"))


@query(with_views("ra_id") + "SELECT owner, scheme, literal FROM ra_id WHERE scheme IS NOT NULL AND literal IS NOT NULL")
def valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.valid_identifiers(projected(spark, sf_dir, "ra_id")).select("owner", "scheme", "literal")


@query(with_views("br_id") + f"SELECT owner, CASE scheme WHEN '{V.DOI}' THEN 'doi' ELSE 'issn' END AS scheme, literal FROM br_id")
def supported_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.supported_identifiers(projected(spark, sf_dir, "br_id")).select("owner", "scheme", "literal")


@query(with_views("ra_id") + """SELECT uri, first_uri, scheme, literal FROM (SELECT DISTINCT owner AS uri, min(owner) OVER (PARTITION BY scheme, literal) AS first_uri, scheme, literal
FROM ra_id WHERE scheme IS NOT NULL) WHERE uri <> first_uri""")
def duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.duplicate_edges(_signatures(spark, sf_dir, "ra"))


@query(_AGENTS + "SELECT uri, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM clustered")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.duplicate_clusters(_signatures(spark, sf_dir, "ra"))


@query(with_views("article", "container") + """SELECT uri, (title IS NOT NULL)::int AS q_title, coalesce(length(pub_date), 0)::int AS q_date, (subtitle IS NOT NULL)::int AS q_subtitle,
(part_of IS NOT NULL)::int AS q_part_of, (number IS NOT NULL)::int AS q_number, (edition IS NOT NULL)::int AS q_edition, (2 + (type2 IS NOT NULL)::int)::int AS q_types
FROM (SELECT * FROM article UNION ALL SELECT * FROM container)""")
def entity_quality_br(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.with_quality(resources(spark, sf_dir), "br")


@query(with_views("ra") + """SELECT uri, (name IS NOT NULL)::int + (given_name IS NOT NULL)::int + (family_name IS NOT NULL)::int AS q_names,
(coalesce(length(name), 0) + coalesce(length(given_name), 0) + coalesce(length(family_name), 0))::int AS q_length FROM ra""")
def entity_quality_ra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.with_quality(projected(spark, sf_dir, "ra"), "ra")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(clusters.cluster_members(_signatures(spark, sf_dir, "ra")), "clusters")


def _agent_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _clusters(spark, sf_dir)
    return staged(survivors.cluster_redirects(found, survivors.surviving_entities(found, projected(spark, sf_dir, "ra"), "ra")), "redirects")


@query(_AGENTS + _SURVIVORS + "SELECT cluster, survivor FROM picked")
def surviving_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_entities(_clusters(spark, sf_dir), projected(spark, sf_dir, "ra"), "ra")


@query(_AGENTS + _SURVIVORS + """SELECT cluster, coalesce(chosen, survivor) AS survivor FROM picked LEFT JOIN
(SELECT cluster, max(uri) AS chosen FROM clustered GROUP BY cluster HAVING length(cluster) % 2 = 0) USING (cluster)""")
def preferred_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred survivors are the largest uris of the clusters whose names have an even length."""
    found = _clusters(spark, sf_dir)
    preferred = found.where("length(cluster) % 2 = 0").groupBy("cluster").agg(F.max("uri").alias("uri"))
    return survivors.surviving_entities(found, projected(spark, sf_dir, "ra"), "ra", preferred)


@query(_AGENTS + _SURVIVORS + """, member AS (SELECT survivor AS to_uri, r.*, (CASE WHEN r.uri = survivor THEN 0 ELSE 1 END) AS k FROM picked JOIN clustered USING (cluster) JOIN ra r USING (uri))
SELECT to_uri AS uri, arg_min(name, (k, uri)) FILTER (name IS NOT NULL) AS name, arg_min(given_name, (k, uri)) FILTER (given_name IS NOT NULL) AS given_name,
arg_min(family_name, (k, uri)) FILTER (family_name IS NOT NULL) AS family_name FROM member GROUP BY to_uri
UNION ALL SELECT uri, name, given_name, family_name FROM ra WHERE uri NOT IN (SELECT uri FROM clustered)""")
def coalesced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.coalesced_fields(projected(spark, sf_dir, "ra"), _agent_redirects(spark, sf_dir), survivors.RA_FIELDS)


_LINKS = "SELECT concat('ra/', p_partkey) AS from_uri, concat('ra/', p_partkey - 1) AS to_uri FROM {part} WHERE p_partkey % 8 > 0 AND p_size % 3 > 0"


@query(f"WITH RECURSIVE link AS ({_LINKS.format(part='part')}), walk AS (SELECT from_uri, to_uri FROM link UNION ALL SELECT w.from_uri, l.to_uri FROM walk w JOIN link l ON w.to_uri = l.from_uri) "
       "SELECT from_uri, to_uri FROM walk WHERE to_uri NOT IN (SELECT from_uri FROM link)")
def redirect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of merges within blocks of agents, followed to their ends."""
    return redirects.resolved(spark.sql(_LINKS, part=spark.read.parquet(f"{sf_dir}/part.parquet")))


@query(with_views("ra", "ra_id", "role")[:-1] + ", " + _REACH + _SURVIVORS + """, moved AS (SELECT br, ar, coalesce(survivor, held_by) AS agent FROM role LEFT JOIN (clustered JOIN picked USING (cluster)) ON held_by = uri)
SELECT agent AS survivor, count(*) AS n_roles, count(DISTINCT br) AS n_resources FROM moved WHERE agent IS NOT NULL GROUP BY agent""")
def rewritten_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents clustered by shared identifiers, the survivors chosen, roles repointed, and counted by agent."""
    roles = projected(spark, sf_dir, "role", dealt=False).where("held_by is not null").select("br", "held_by")
    moved = redirects.rewritten(roles, "held_by", _agent_redirects(spark, sf_dir)).select(F.col("held_by").alias("survivor"), "br")
    # few roles are an agent's second in a resource: counting them before they are dealt would be lost work
    dealt = moved.repartition(tasks(spark, sf_dir, "lineitem"), "survivor", "br")
    return dealt.groupBy("survivor").agg(F.count("*").alias("n_roles"), F.countDistinct("br").alias("n_resources"))


_SAME = """same AS (SELECT br, held_by AS agent, role_type, min(ar) AS kept_ar, count(*) - 1 AS n_merged FROM role
WHERE held_by IS NOT NULL AND role_type IS NOT NULL GROUP BY ALL HAVING count(*) > 1) """


@query(with_views("role")[:-1] + ", " + _SAME + "SELECT * FROM same")
def same_agent_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = projected(spark, sf_dir, "role").select("br", "ar", "held_by", "role_type")
    return contributors.same_agent_roles(roles.repartition(tasks(spark, sf_dir, "lineitem"), "br"))


@query(with_views("role")[:-1] + ", " + _SAME + f""", left_over AS (SELECT r.* FROM role r LEFT JOIN same s ON r.br = s.br AND r.held_by = s.agent AND r.role_type = s.role_type
WHERE r.role_type = '{V.AUTHOR}' AND (s.kept_ar IS NULL OR s.kept_ar = r.ar))
SELECT br, ar, lead(ar) OVER w AS next, CAST(row_number() OVER w - 1 AS INT) AS position FROM left_over WINDOW w AS (PARTITION BY br ORDER BY l_linenumber, n)""")
def unlinked_author_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of authors after the surplus roles of an agent have been taken out."""
    roles = staged(projected(spark, sf_dir, "linked").where(F.col("role_type") == V.AUTHOR).select("ar", "br", "role_type", "held_by", "next"), "roles")
    surplus = contributors.same_agent_redirects(roles.select("br", "ar", "role_type", "held_by"))
    order = contributors.unlinked_order(roles.select(F.col("ar").alias("uri"), "next"), staged(surplus, "surplus"))
    links = staged(roles.select("br", "ar").join(order.withColumnRenamed("uri", "ar"), "ar").select("br", "ar", "next"), "links")
    return links.join(contributors.author_order(links), ["br", "ar"]).select("br", "ar", "next", "position")


@query(with_views("role") + f"SELECT br, count(*) FILTER (held_by IS NULL AND role_type IS DISTINCT FROM '{V.PUBLISHER}') AS n_removed FROM role GROUP BY br")
def unheld_roles_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    kept = contributors.drop_unheld(g).br_ar.groupBy("br").agg(F.count("*").alias("kept"))
    return g.br_ar.groupBy("br").agg(F.count("*").alias("n")).join(kept, "br", "left").select("br", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("n_removed"))


@query(with_views("role", "ra") + """SELECT DISTINCT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity
FROM role x JOIN role y ON x.br = y.br AND x.role_type = y.role_type JOIN ra a ON a.uri = x.held_by JOIN ra b ON b.uri = y.held_by
WHERE a.name < b.name AND 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) > 0.5""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of contributors to one resource in one role that are more alike than not."""
    named = projected(spark, sf_dir, "role").join(projected(spark, sf_dir, "ra").select(F.col("uri").alias("held_by"), "name"), "held_by").where("name is not null and role_type is not null")
    side = named.select("br", "role_type", "name").distinct()
    met = side.withColumnRenamed("name", "a").join(side.withColumnRenamed("name", "b"), ["br", "role_type"]).where("a < b").select("a", "b").distinct()
    return met.withColumn("similarity", X.name_similarity(F.col("a"), F.col("b"))).where("similarity > 0.5").select("a", "b", F.round("similarity", 6).alias("similarity"))


#: Agents with names so long that one letter may differ, in mixed case and with odd spaces.
_LONG_NAMES = """SELECT uri, CASE WHEN length(uri) % 2 = 0 THEN upper(concat('Maximiliane  Josephine ', coalesce(given_name, ''))) ELSE concat('Maximiliane Josephine ', coalesce(given_name, '')) END AS given_name, family_name FROM {ra}"""


@query(with_views("role", "ra")[:-1] + f""", long_named AS (SELECT uri, lower(regexp_replace(trim(concat_ws(' ', given_name, family_name)), ' +', ' ', 'g')) AS name FROM ({_LONG_NAMES.format(ra='ra')})),
o AS (SELECT br, role_type, ar, name, row_number() OVER (PARTITION BY br, role_type ORDER BY ar) AS k FROM role JOIN long_named ON uri = held_by WHERE role_type IN ('{V.AUTHOR}', '{V.EDITOR}')),
step AS (SELECT DISTINCT br, role_type, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ar VARCHAR, name VARCHAR)[]) AS kept, CAST(NULL AS VARCHAR) AS from_uri, CAST(NULL AS VARCHAR) AS to_uri FROM o
  UNION ALL SELECT br, role_type, k, CASE WHEN into_uri IS NULL THEN list_append(kept, {{'ar': ar, 'name': name}}) ELSE kept END, CASE WHEN into_uri IS NOT NULL THEN ar END, into_uri
  FROM (SELECT o.*, s.kept, list_filter(s.kept, lambda l: 1 - levenshtein(l.name, o.name) / greatest(length(l.name), length(o.name)) > 0.95)[1].ar AS into_uri
    FROM step s JOIN o ON o.br = s.br AND o.role_type = s.role_type AND o.k = s.k + 1))
SELECT br, from_uri, to_uri FROM step WHERE to_uri IS NOT NULL""")
def similar_name_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that merge by their holders' given and family names, which differ in case, in spaces, and in letters."""
    agents = spark.sql(_LONG_NAMES, ra=projected(spark, sf_dir, "ra"))
    return contributors.similar_name_redirects(projected(spark, sf_dir, "role").select("br", "ar", "role_type", "held_by"), agents)


_CHAIN = """br AS (SELECT * FROM article UNION ALL SELECT * FROM container),
chain AS (SELECT uri AS br, part_of AS ancestor, 1 AS depth FROM br WHERE part_of IS NOT NULL
  UNION ALL SELECT c.br, b.part_of, c.depth + 1 FROM chain c JOIN br b ON c.ancestor = b.uri WHERE b.part_of IS NOT NULL) """


@query(with_views("article", "container")[:-1] + ", " + _CHAIN + "SELECT br, ancestor, CAST(depth AS INT) AS depth FROM chain")
def part_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.part_of_chain(resources(spark, sf_dir))


def _article_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.duplicate_edges(_signatures(spark, sf_dir, "br")).where(F.col("scheme") == V.DOI)
    return staged(found.select(F.col("first_uri").alias("first_br"), F.col("uri").alias("second_br")), "pairs")


_PAIRS = f"""pair AS (SELECT * FROM (SELECT min(owner) OVER (PARTITION BY literal) AS first_br, owner AS second_br FROM br_id WHERE scheme = '{V.DOI}') WHERE first_br <> second_br) """


@query(with_views("article", "container", "br_id")[:-1] + ", " + _CHAIN + ", " + _PAIRS + """,
met AS (SELECT p.first_br, p.second_br, c.ancestor AS first, d.ancestor AS second, c.depth AS level FROM pair p JOIN chain c ON c.br = p.first_br JOIN chain d ON d.br = p.second_br
  JOIN br x ON x.uri = c.ancestor JOIN br y ON y.uri = d.ancestor WHERE x.type1 = y.type1 AND x.uri <> y.uri),
facts AS (SELECT b.uri, b.number, lower(regexp_replace(trim(b.title), ' +', ' ', 'g')) AS title, i.literal FROM br b LEFT JOIN br_id i ON i.owner = b.uri AND i.scheme LIKE '%issn'),
judged AS (SELECT m.*, CASE WHEN f.literal IS NOT NULL AND s.literal IS NOT NULL THEN f.literal = s.literal WHEN f.number IS NOT NULL AND s.number IS NOT NULL THEN f.number = s.number
  WHEN f.title IS NOT NULL AND s.title IS NOT NULL THEN f.title = s.title ELSE false END AS equivalent FROM met m JOIN facts f ON f.uri = m.first JOIN facts s ON s.uri = m.second)
SELECT first_br, second_br, first, second, CAST(level AS INT) AS level, equivalent, bool_and(equivalent) OVER (PARTITION BY first_br, second_br ORDER BY level DESC) AS merges FROM judged""")
def container_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_pairs(resources(spark, sf_dir), _signatures(spark, sf_dir, "br"), _article_pairs(spark, sf_dir))


_FULL = "nullif(lower(regexp_replace(trim(coalesce(name, nullif(concat_ws(' ', given_name, family_name), ''))), ' +', ' ', 'g')), '')"


@query(with_views("br_id", "role", "ra", "ra_id")[:-1] + ", " + _PAIRS + f""",
pub AS (SELECT br, min((ar, held_by)) AS p FROM role WHERE role_type = '{V.PUBLISHER}' GROUP BY br),
named AS (SELECT br, p[1] AS publisher, p[2] AS agent, {_FULL} AS full_name, (SELECT list(scheme || literal) FROM ra_id i WHERE i.owner = p[2] AND scheme IS NOT NULL) AS sigs FROM pub LEFT JOIN ra ON uri = p[2])
SELECT first_br, second_br, a.publisher AS first, b.publisher AS second, coalesce(CASE WHEN a.agent IS NULL OR b.agent IS NULL THEN false WHEN a.agent = b.agent THEN true
WHEN len(a.sigs) > 0 AND len(b.sigs) > 0 THEN list_has_any(a.sigs, b.sigs) ELSE a.full_name = b.full_name END, false) AS equivalent
FROM pair JOIN named a ON a.br = first_br JOIN named b ON b.br = second_br WHERE a.publisher <> b.publisher""")
def publisher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.publisher_pairs(graph(spark, sf_dir), _article_pairs(spark, sf_dir))


@query(with_views("br_id", "role") + f"""SELECT cluster, role_type, br AS donor FROM (SELECT *, row_number() OVER (PARTITION BY cluster, role_type ORDER BY n DESC, br) AS k FROM
(SELECT literal AS cluster, role_type, br, count(*) AS n FROM br_id JOIN role ON owner = br WHERE scheme = '{V.DOI}' AND role_type IS NOT NULL GROUP BY ALL)) WHERE k = 1""")
def richest_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = projected(spark, sf_dir, "br_id").where(F.col("scheme") == V.DOI).select(F.col("literal").alias("cluster"), F.col("owner").alias("br"))
    roles, n = projected(spark, sf_dir, "role").where("role_type is not null").select("br", "role_type"), tasks(spark, sf_dir, "lineitem")
    return survivors.richest_donors(grouped.repartition(n, "br").join(roles.repartition(n, "br"), "br").repartition(n, "cluster"))


@query(with_views("ra_id", "br_id") + """SELECT scheme, literal, min(id) AS survivor, count(*) AS n FROM (SELECT * FROM ra_id UNION ALL SELECT * FROM br_id)
WHERE scheme IS NOT NULL GROUP BY scheme, literal HAVING count(*) > 1""")
def identifier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.identifier_groups(projected(spark, sf_dir, "ra_id").unionByName(projected(spark, sf_dir, "br_id")))


@query(with_views("ra_id") + "SELECT DISTINCT owner, min(id) OVER (PARTITION BY scheme, literal) AS id FROM ra_id WHERE scheme IS NOT NULL UNION SELECT owner, id FROM ra_id WHERE scheme IS NULL")
def identifier_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = projected(spark, sf_dir, "ra_id")
    held = ids.where("scheme is not null").select("id", "scheme", "literal")
    kept = clusters.identifier_groups(ids).select("scheme", "literal", F.col("survivor").alias("to_uri"))
    sent = redirects.resolved(held.join(kept, ["scheme", "literal"]).select(F.col("id").alias("from_uri"), "to_uri"))
    return redirects.rewritten(ids.select("owner", "id"), "id", sent).distinct()


#: Triples of other predicates that point at agents' identifiers, or at something else.
_POINTING = "SELECT concat('x/', p_partkey - p_partkey % 8) AS s, concat('http://example.org/p', p_size % 2) AS p, CASE WHEN p_partkey % 3 = 0 THEN concat('y/', p_partkey) ELSE concat('id/1', p_partkey) END AS o FROM {part}"


@query(with_views("ra_id")[:-1] + f""", kept AS (SELECT id, min(id) OVER (PARTITION BY scheme, literal) AS survivor FROM ra_id WHERE scheme IS NOT NULL)
SELECT DISTINCT s, p, coalesce(survivor, o) AS o FROM ({_POINTING.format(part='part')}) LEFT JOIN kept ON id = o""")
def identifier_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References on any predicate follow merged identifiers, and those that become equal are one."""
    ids = projected(spark, sf_dir, "ra_id")
    pointing = spark.sql(_POINTING, part=spark.read.parquet(f"{sf_dir}/part.parquet")).select("s", "p", "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    before = Graph.of(spark, ident=ids.select(F.col("id").alias("uri"), "scheme", "literal"), ent_id=ids.select(F.lit("ra").alias("owner_kind"), "owner", "id"), triples=pointing)
    held = ids.where("scheme is not null").select("id", "scheme", "literal")
    kept = clusters.identifier_groups(ids).select("scheme", "literal", F.col("survivor").alias("to_uri"))
    sent = redirects.resolved(held.join(kept, ["scheme", "literal"]).select(F.col("id").alias("from_uri"), "to_uri"))
    return redirects.merge_entities(before, "ident", sent).triples.select("s", "p", "o")


#: Requested clusters of other kinds: empty ones, identifiers, and containers with what isn't like them.
_OTHERS = f"""SELECT concat('ra/', p_partkey) AS survivor, CAST(NULL AS STRING) AS merged, CAST(0 AS INT) AS pos FROM {{part}} WHERE p_partkey % 50 = 0
UNION ALL SELECT concat('id/1', p_partkey), concat('id/1', p_partkey + 1), CAST(0 AS INT) FROM {{part}} WHERE p_partkey % 4 = 1
UNION ALL SELECT concat('id/2', p_partkey), concat('id/2', p_partkey + 1), CAST(0 AS INT) FROM {{part}} WHERE p_partkey % 4 = 1
UNION ALL SELECT uri, min(other), CAST(0 AS INT) FROM (SELECT c.uri, concat('br/1', a.o_orderkey) AS other FROM {{container}} c JOIN {{orders}} a ON substr(c.uri, 5, 1) = substr(a.o_orderpriority, 1, 1)) AS t GROUP BY uri"""


@query(with_views("ra_id", "container", "article")[:-1] + f""", asked AS ({_OTHERS.format(part='part', container='container', orders='orders')})
SELECT survivor AS cluster, 'empty' AS rule, survivor AS offender FROM asked WHERE merged IS NULL
UNION SELECT survivor, 'identifier_values', merged FROM asked JOIN ra_id a ON a.id = survivor JOIN ra_id b ON b.id = merged WHERE coalesce(a.scheme <> b.scheme OR a.literal <> b.literal, true)
UNION SELECT survivor, 'container_types', merged FROM asked JOIN container ON uri = survivor WHERE merged IS NOT NULL
  AND survivor IN (SELECT part_of FROM article WHERE part_of IS NOT NULL UNION SELECT part_of FROM container WHERE part_of IS NOT NULL)
UNION SELECT survivor, 'missing', merged FROM asked WHERE survivor LIKE 'id/%' AND merged NOT IN (SELECT id FROM ra_id)
UNION SELECT survivor, 'merged_twice', merged FROM asked WHERE merged IN (SELECT merged FROM asked GROUP BY merged HAVING count(DISTINCT survivor) > 1)""")
def cluster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on empty clusters, identifiers' values and containers' types, which the other query doesn't meet."""
    part, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders"))
    # of each priority's orders only the one of the smallest uri can be a container's smallest: the join needs no other
    smallest = F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.concat(F.lit("br/1"), F.col("o_orderkey").cast("string"))).alias("o")
    firsts = staged(orders.where("o_orderkey is not null").groupBy(F.substring("o_orderpriority", 1, 1).alias("digit")).agg(smallest).select("o.*"), "firsts")
    asked = spark.sql(_OTHERS, container=projected(spark, sf_dir, "container"), part=part, orders=firsts)
    return manual.cluster_violations(asked, graph(spark, sf_dir))


#: Requested clusters, some of which break a rule.
_ASKED = """SELECT concat('ra/', p_partkey - p_partkey % 4) AS survivor, CASE WHEN p_partkey % 40 = 1 THEN concat('ra/', p_partkey - 1) WHEN p_partkey % 40 = 5 THEN concat('br/1', p_partkey)
WHEN p_partkey % 40 = 9 THEN concat('ra/x', p_partkey) WHEN p_partkey % 40 = 13 THEN concat('ra/', p_partkey - 5) WHEN p_partkey % 40 = 17 THEN concat('ra/', p_partkey + 5) ELSE concat('ra/', p_partkey) END AS merged, CAST(0 AS INT) AS pos FROM {part} WHERE p_partkey % 4 > 0"""


@query(with_views("ra", "article", "container")[:-1] + f""", asked AS ({_ASKED.format(part='part')}),
known AS (SELECT uri, 'ra' AS kind FROM ra UNION ALL SELECT uri, 'br' FROM article UNION ALL SELECT uri, 'br' FROM container)
SELECT survivor AS cluster, 'self_merge' AS rule, merged AS offender FROM asked WHERE survivor = merged
UNION SELECT survivor, 'survivor_is_merged', merged FROM asked WHERE survivor <> merged AND merged IN (SELECT survivor FROM asked)
UNION SELECT survivor, 'merged_twice', merged FROM asked WHERE merged IN (SELECT merged FROM asked GROUP BY merged HAVING count(DISTINCT survivor) > 1)
UNION SELECT survivor, 'missing', merged FROM asked WHERE merged NOT IN (SELECT uri FROM known)
UNION SELECT survivor, 'mixed_kinds', merged FROM asked JOIN known ON uri = merged WHERE kind <> 'ra'""")
def cluster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manual.cluster_violations(spark.sql(_ASKED, part=spark.read.parquet(f"{sf_dir}/part.parquet")), graph(spark, sf_dir))


@query(with_views("article", "container", "ra", "ra_id")[:-1] + ", " + _CHAIN + """SELECT uri AS cluster, CAST(2 AS INT) AS rank, CAST(coalesce((SELECT max(depth) FROM chain WHERE chain.br = b.uri), 0) AS INT) AS depth FROM br b
UNION ALL SELECT uri, 1, 0 FROM ra UNION ALL SELECT id, 0, 0 FROM ra_id""")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which clusters would be merged, with every resource, agent and agent's identifier as a survivor."""
    g = graph(spark, sf_dir)
    agents_ids = projected(spark, sf_dir, "ra_id").select(F.col("id").alias("survivor"))
    asked = g.br.select(F.col("uri").alias("survivor")).unionByName(g.ra.select(F.col("uri").alias("survivor"))).unionByName(agents_ids)
    return manual.cluster_order(asked, g)


@query(with_views("article") + "SELECT uri, CAST(CASE WHEN try_cast(substr(pub_date, 1, 4) AS INT) = 1997 THEN 3 ELSE 0 END AS INT) AS score FROM article")
def year_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "article").select("uri", X.year_score(X.year_int(F.col("pub_date")), F.lit(1997)).alias("score"))


@query("""SELECT CAST(p_partkey AS STRING) AS item, CAST((CASE WHEN p_size % 3 = p_partkey % 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 = p_size % 4 THEN 2 ELSE 1 END ELSE 0 END) AS INT) AS score FROM part""")
def author_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An author against one candidate: families by threes, given names of one initial by fours, some without a given name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = F.concat(F.lit("Given"), (F.col("p_size") % 4).cast("string"))
    candidate = F.struct(F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("GIVEN"), (F.col("p_partkey") % 4).cast("string"))).alias("given"), F.concat(F.lit("Family"), (F.col("p_partkey") % 3).cast("string")).alias("family"))
    family = F.concat(F.lit("family"), (F.col("p_size") % 3).cast("string"))
    return part.select(F.col("p_partkey").cast("string").alias("item"), X.author_score(given, family, F.array(candidate)).alias("score"))


STOP_WORDS = ["The", "of", "a"]


@query(with_views("article") + "SELECT uri AS id, array_to_string(list_slice(list_filter(string_split(title, ' '), lambda w: w NOT IN ('The', 'of', 'a')), 1, 4), ' ') AS cleaned FROM article")
def title_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "article").select(F.col("uri").alias("id"), X.clean_title(F.col("title"), STOP_WORDS).alias("cleaned"))


_CANDIDATES = """SELECT concat('q', a.p_partkey) AS query, CAST(b.p_partkey % 8 AS INT) AS pos, concat('10.', b.p_partkey) AS doi, a.p_name AS wanted, b.p_name AS found,
CAST(CASE WHEN a.p_size % 3 = b.p_size % 3 THEN 1 ELSE 0 END AS INT) AS author_score, CAST(CASE WHEN a.p_size % 5 = b.p_size % 5 THEN 3 ELSE 0 END AS INT) AS year_score, a.p_partkey % 2 = 0 AS has_author
FROM {part} a JOIN {part} b ON a.p_partkey - a.p_partkey % 8 = b.p_partkey - b.p_partkey % 8 WHERE a.p_partkey <> b.p_partkey"""


@query(f"""WITH c AS (SELECT *, round(1 - levenshtein(wanted, found) / greatest(length(wanted), length(found)), 6) AS title_score FROM ({_CANDIDATES.format(part='part')})),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY title_score DESC, author_score DESC, year_score DESC, pos DESC) AS k FROM c)
SELECT query, doi, title_score, author_score, year_score FROM best WHERE k = 1 AND title_score > 0.6 AND (NOT has_author OR author_score >= 1)""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = spark.sql(_CANDIDATES, part=part.repartition(tasks(spark, sf_dir, "part", PART_BYTES), F.col("p_partkey") - F.col("p_partkey") % 8))
    return lookups.best_candidate(rows.withColumn("title_score", F.round(X.name_similarity(F.col("wanted"), F.col("found")), 6)), threshold=0.6)


@query(with_views("br_id") + f"SELECT owner, CASE WHEN literal = lower(literal) AND literal = upper(literal) THEN [literal] ELSE [literal, lower(literal), upper(literal)] END[k] AS variant, CAST(k - 1 AS INT) AS pos FROM br_id, range(1, 4) AS r(k) WHERE scheme = '{V.DOI}'")
def doi_case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projected(spark, sf_dir, "br_id").where(F.col("scheme") == V.DOI)
    return rows.select("owner", F.posexplode(X.doi_case_variants(F.col("literal"))).alias("pos", "variant")).select("owner", "variant", "pos")


@query(with_views("br_id") + "SELECT id, split_part(scheme, '/', -1) AS short FROM br_id")
def short_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "br_id").select("id", X.short_scheme(F.col("scheme")).alias("short"))


@query("SELECT o_orderkey AS number, CAST(ceil(o_orderkey / 10000.0) * 10000 AS BIGINT) AS dir_bucket, CAST(ceil(o_orderkey / 1000.0) * 1000 AS BIGINT) AS file_bucket FROM orders")
def bucket_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("number"), X.bucket(F.col("o_orderkey"), 10_000).alias("dir_bucket"), X.bucket(F.col("o_orderkey"), 1_000).alias("file_bucket"))


def _provider(spark: SparkSession, sf_dir: str) -> lookups.TableLookups:
    """A catalogue made from the same tables: journals of the even priorities, works of some DOIs."""
    issn = projected(spark, sf_dir, "br_id").where(F.col("scheme") == V.ISSN).select("literal").distinct()
    listed = F.to_json(F.struct(F.struct(F.array(F.col("literal"), F.concat("literal", F.lit("X"))).alias("ISSN")).alias("message")))
    journals = issn.where("literal not like '0001%'").select(F.lit("crossref").alias("source"), F.lit("journal").alias("op"), F.col("literal").alias("key"), listed.alias("body"))
    doi = projected(spark, sf_dir, "br_id").where((F.col("scheme") == V.DOI) & F.col("literal").contains("-0")).select("literal").distinct()
    item = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.length("literal").cast("string")).alias("value")).alias("item"))).alias("bindings")).alias("results")))
    items = doi.select(F.lit("wikidata").alias("source"), F.lit("item").alias("op"), lookups.wikidata_key(F.lit("doi"), F.col("literal")).alias("key"), item.alias("body"))
    works = F.to_json(F.struct(F.array(*[F.struct(F.concat(F.lit(f"https://openalex.org/W{k}"), F.substring("literal", 4, 2)).alias("id")) for k in (1, 2)]).alias("results")))
    openalex = doi.select(F.lit("openalex").alias("source"), F.lit("works").alias("op"), F.concat(F.lit("doi:"), "literal").alias("key"), works.alias("body"))
    member = F.to_json(F.struct(F.struct(F.substring("literal", 4, 2).alias("member")).alias("message")))
    members = doi.select(F.lit("crossref").alias("source"), F.lit("member").alias("op"), F.col("literal").alias("key"), member.alias("body"))
    titles = projected(spark, sf_dir, "article").where("title like '%6'").select("title").distinct()
    found = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("10.9/"), F.substring_index("title", " ", -1)).alias("DOI"), F.array(F.col("title")).alias("title"))).alias("items")).alias("message")))
    searches = titles.select(F.lit("crossref").alias("source"), F.lit("works").alias("op"), lookups.crossref_key(F.col("title"), STOP_WORDS).alias("key"), found.alias("body"))
    return lookups.TableLookups(journals.unionByName(items).unionByName(openalex).unionByName(members).unionByName(searches))


def _positioned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return projected(spark, sf_dir, f"{kind}_id").withColumn("pos", F.row_number().over(W.partitionBy("owner").orderBy("id")))


@query(with_views("br_id") + f"SELECT owner, scheme, concat(literal, 'X') AS literal FROM br_id WHERE scheme = '{V.ISSN}' AND literal NOT LIKE '0001%'")
def enriched_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched_issn(_provider(spark, sf_dir), _positioned(spark, sf_dir, "br"))


@query(with_views("article") + f"SELECT uri AS owner, '{V.DOI}' AS scheme, concat('10.9/', split_part(title, ' ', -1)) AS literal FROM article WHERE title LIKE '%6' AND number IS NULL AND title = lower(title)")
def enriched_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DOIs of resources without a number are left out of the identifiers; titles are compared as written with lower-cased candidates."""
    rows, ids = projected(spark, sf_dir, "article"), _positioned(spark, sf_dir, "br")
    bare = rows.where("number is null").select(F.col("uri").alias("owner"))
    return enrich.enriched_doi(_provider(spark, sf_dir), rows, ids.join(bare, "owner", "left_anti"), STOP_WORDS)


@query(with_views("br_id") + f"SELECT owner, '{V.WIKIDATA}' AS scheme, concat('Q', length(literal)) AS literal FROM br_id WHERE scheme = '{V.DOI}' AND literal LIKE '%-0%'")
def enriched_wikidata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched_wikidata(_provider(spark, sf_dir), _positioned(spark, sf_dir, "br"), V.RESOURCE_SCHEMES)


@query(with_views("br_id") + f"SELECT owner, '{V.OPENALEX}' AS scheme, concat('W', k, substr(literal, 4, 2)) AS literal FROM br_id, range(1, 3) AS r(k) WHERE scheme = '{V.DOI}' AND literal LIKE '%-0%'")
def enriched_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched_openalex(_provider(spark, sf_dir), _positioned(spark, sf_dir, "br"))


#: Agents that have a Crossref identifier already.
_MEMBERS = f"SELECT concat('ra/', p_partkey) AS owner, concat('id/4', p_partkey) AS id, '{V.CROSSREF}' AS scheme, CAST(p_partkey AS STRING) AS literal FROM {{part}} WHERE p_partkey % 6 = 0"


@query(with_views("role", "br_id")[:-1] + f""", member AS ({_MEMBERS.format(part='part')}),
pub AS (SELECT br, ar, held_by, max(CASE WHEN held_by IN (SELECT owner FROM member) THEN 1 ELSE 0 END) OVER (PARTITION BY br ORDER BY ar ROWS UNBOUNDED PRECEDING) AS so_far
  FROM role WHERE role_type = '{V.PUBLISHER}' AND held_by IS NOT NULL)
SELECT held_by AS owner, '{V.CROSSREF}' AS scheme, substr(min(literal), 4, 2) AS literal FROM pub JOIN br_id ON br = owner
WHERE so_far = 0 AND scheme = '{V.DOI}' AND literal LIKE '%-0%' GROUP BY held_by""")
def enriched_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource's publishers are asked for up to the first that has a Crossref identifier."""
    dois = filters.classify_resource_identifiers(_positioned(spark, sf_dir, "br")).where("doi is not null").select(F.col("owner").alias("br"), "doi")
    held = projected(spark, sf_dir, "ra_id").unionByName(spark.sql(_MEMBERS, part=spark.read.parquet(f"{sf_dir}/part.parquet")))
    return enrich.enriched_publishers(_provider(spark, sf_dir), projected(spark, sf_dir, "role"), held, dois)


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """br, agent, given, family, title of the authors of articles."""
    roles = projected(spark, sf_dir, "role").where((F.col("role_type") == V.AUTHOR) & F.col("held_by").isNotNull())
    agents = projected(spark, sf_dir, "ra").select(F.col("uri").alias("held_by"), F.col("given_name").alias("given"), F.col("family_name").alias("family"))
    titles = projected(spark, sf_dir, "article").select(F.col("uri").alias("br"), "title")
    return staged(roles.join(agents, "held_by").join(titles, "br").select("br", F.col("held_by").alias("agent"), "given", "family", "title"), "authors")


_AUTHORS = f"authors AS (SELECT DISTINCT br, held_by AS agent, given_name AS given, family_name AS family, title FROM role JOIN ra ON ra.uri = held_by JOIN article ON article.uri = br WHERE role_type = '{V.AUTHOR}') "


@query(with_views("role", "ra", "article", "br_id")[:-1] + ", " + _AUTHORS + f"""SELECT agent AS owner, '{V.ORCID}' AS scheme, concat('0000-B', right(max(family), 1), coalesce(right(max(given), 1), 'X')) AS literal
FROM authors JOIN br_id ON br = owner WHERE family IS NOT NULL AND scheme = '{V.DOI}' AND literal LIKE '%-0%' GROUP BY agent""")
def enriched_orcid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by the DOIs of some months find two people, of whom only the second bears the author's name."""
    authors, ids = _authors(spark, sf_dir), _positioned(spark, sf_dir, "br")
    found = authors.where("family is not null").join(ids.where((F.col("scheme") == V.DOI) & F.col("literal").contains("-0")).select(F.col("owner").alias("br"), "scheme", "literal"), "br")
    path = F.concat(F.lit("0000-b"), F.right("family", F.lit(1)), F.coalesce(F.right("given", F.lit(1)), F.lit("x")))
    hit = lambda value: F.struct(F.struct(value.alias("path")).alias("orcid-identifier"))
    body = F.to_json(F.struct(F.array(hit(F.lit("0000-a")), hit(path)).alias("result")))
    found = staged(found, "found")
    key = X.orcid_search(F.col("given"), F.col("family"), F.array(F.struct("scheme", "literal")))
    searches = found.select(F.lit("orcid").alias("source"), F.lit("search").alias("op"), key.alias("key"), body.alias("body"))
    person = lambda given, family: F.to_json(F.struct(F.struct(F.struct(given.alias("value")).alias("given-names"), F.struct(family.alias("value")).alias("family-name")).alias("name")))
    people = found.select(F.lit("orcid").alias("source"), F.lit("details").alias("op"), F.upper(path).alias("key"), person(F.concat(F.upper(F.coalesce("given", F.lit("any"))), F.lit(" M.")), F.concat(F.lit("Von "), "family")).alias("body"))
    others = found.select(F.lit("orcid").alias("source"), F.lit("details").alias("op"), F.lit("0000-A").alias("key"), person(F.lit("No"), F.lit("Body")).alias("body"))
    return enrich.enriched_orcid(lookups.TableLookups(searches.unionByName(people).unionByName(others)), authors, ids)


@query(with_views("role", "ra", "article")[:-1] + ", " + _AUTHORS + f"""SELECT agent AS owner, '{V.VIAF}' AS scheme, arg_min(concat(length(coalesce(title, '')), length(trim(concat(coalesce(given, ''), ' ', coalesce(family, ''))))), br) AS literal
FROM authors WHERE (given IS NOT NULL OR family IS NOT NULL) AND length(coalesce(title, '')) % 3 > 0 GROUP BY agent""")
def enriched_viaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose length is a multiple of three have two records, others one; an agent takes the answer of its first resource."""
    authors = _authors(spark, sf_dir)
    title, name = F.coalesce("title", F.lit("")), F.trim(F.concat(F.coalesce("given", F.lit("")), F.lit(" "), F.coalesce("family", F.lit(""))))
    number = F.concat(F.length(title).cast("string"), F.length(name).cast("string"))
    cluster = F.struct(F.struct(number.alias("content")).alias("v:viafID")).alias("v:VIAFCluster")
    count = F.when(F.length(title) % 3 > 0, "1").otherwise("2")
    response = F.struct(F.struct(count.alias("content")).alias("numberOfRecords"), F.struct(F.struct(F.struct(cluster).alias("recordData")).alias("record")).alias("records"))
    rows = authors.select(F.lit("viaf").alias("source"), F.lit("search").alias("op"), lookups.viaf_key(F.col("given"), F.col("family"), F.col("title")).alias("key"), F.to_json(F.struct(response.alias("searchRetrieveResponse"))).alias("body"))
    return enrich.enriched_viaf(lookups.TableLookups(rows), authors)


@query(with_views("ra_id") + f"""SELECT owner, '{V.WIKIDATA}' AS scheme, concat('Q', arg_min(length(literal), id)) AS literal FROM ra_id
WHERE scheme = '{V.ORCID}' AND (literal LIKE '%-1' OR literal LIKE '%-2') OR scheme = '{V.VIAF}' AND literal NOT LIKE '%STEEL' GROUP BY owner""")
def enriched_wikidata_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some ORCIDs resolve; agents whose doesn't are found by their VIAF identifier, if that does."""
    ids = projected(spark, sf_dir, "ra_id").where("scheme is not null")
    short = F.create_map(*[F.lit(x) for pair in enrich.AGENT_SCHEMES.items() for x in pair])[F.col("scheme")]
    answered = ids.where(((F.col("scheme") == V.ORCID) & F.col("literal").rlike("-[12]$")) | ((F.col("scheme") == V.VIAF) & ~F.col("literal").endswith("STEEL")))
    item = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.length("literal").cast("string")).alias("value")).alias("item"))).alias("bindings")).alias("results")))
    rows = answered.select(F.lit("wikidata").alias("source"), F.lit("item").alias("op"), F.concat_ws(":", short, "literal").alias("key"), item.alias("body"))
    return enrich.enriched_wikidata(lookups.TableLookups(rows), _positioned(spark, sf_dir, "ra"), enrich.AGENT_SCHEMES)


#: Further ISSNs of journals and PMIDs of articles, after and before the identifiers that they have.
_MORE = f"SELECT owner, concat('id/0', substr(id, 4)) AS id, CASE WHEN scheme = '{V.ISSN}' THEN scheme ELSE '{V.PMID}' END AS scheme, concat('p', literal) AS literal FROM {{ids}} WHERE length(owner) % 2 = 0 UNION ALL SELECT owner, concat('id/9', substr(id, 4)), scheme, concat('q', literal) FROM {{ids}} WHERE length(literal) % 2 = 0"


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = projected(spark, sf_dir, "br_id")
    return ids.unionByName(spark.sql(_MORE, ids=ids)).withColumn("pos", F.row_number().over(W.partitionBy("owner").orderBy("id")))


@query(with_views("br_id")[:-1] + f""", every AS (SELECT * FROM br_id UNION ALL {_MORE.format(ids='br_id')}),
answered AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM every WHERE scheme IN ('{V.DOI}', '{V.PMID}') AND (literal LIKE '%-0%' AND scheme = '{V.DOI}' OR literal LIKE '%-1%' AND scheme = '{V.PMID}'))
SELECT owner, '{V.WIKIDATA}' AS scheme, concat('Q', length(literal)) AS literal FROM answered WHERE k = 1""")
def enriched_wikidata_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners have up to three identifiers; the first of them that resolves counts."""
    ids = _several(spark, sf_dir)
    answered = ids.where(((F.col("scheme") == V.DOI) & F.col("literal").contains("-0")) | ((F.col("scheme") == V.PMID) & F.col("literal").contains("-1")))
    item = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.length("literal").cast("string")).alias("value")).alias("item"))).alias("bindings")).alias("results")))
    short = F.when(F.col("scheme") == V.DOI, "doi").otherwise("pmid")
    rows = answered.select(F.lit("wikidata").alias("source"), F.lit("item").alias("op"), lookups.wikidata_key(short, F.col("literal")).alias("key"), item.alias("body"))
    return enrich.enriched_wikidata(lookups.TableLookups(rows), ids, V.RESOURCE_SCHEMES)


@query(with_views("br_id")[:-1] + f""", every AS (SELECT * FROM br_id UNION ALL {_MORE.format(ids='br_id')}),
answered AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM every WHERE scheme = '{V.ISSN}' AND literal NOT LIKE 'p%')
SELECT owner, '{V.ISSN}' AS scheme, concat(literal, n) AS literal FROM answered, (VALUES ('Y'), ('Z')) AS t(n) WHERE k = 1""")
def enriched_issn_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals have up to three ISSNs, of which the first has no answer for some; the next that has one supplies all others."""
    ids = _several(spark, sf_dir)
    issn = ids.where((F.col("scheme") == V.ISSN) & ~F.col("literal").startswith("p")).select("literal").distinct()
    listed = F.to_json(F.struct(F.struct(F.array(F.concat("literal", F.lit("Y")), F.col("literal"), F.concat("literal", F.lit("Z"))).alias("ISSN")).alias("message")))
    return enrich.enriched_issn(lookups.TableLookups(issn.select(F.lit("crossref").alias("source"), F.lit("journal").alias("op"), F.col("literal").alias("key"), listed.alias("body"))), ids)


@query(with_views("br_id") + f"""SELECT scheme, count(*) AS n FROM (SELECT DISTINCT owner, '{V.ISSN}' AS scheme, concat(literal, 'X') FROM br_id WHERE scheme = '{V.ISSN}' AND literal NOT LIKE '0001%'
UNION ALL SELECT DISTINCT owner, '{V.WIKIDATA}', concat('Q', length(literal)) FROM br_id WHERE scheme = '{V.DOI}' AND literal LIKE '%-0%') GROUP BY scheme""")
def added_identifier_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider, ids = _provider(spark, sf_dir), _positioned(spark, sf_dir, "br")
    new = enrich.enriched_issn(provider, ids).unionByName(enrich.enriched_wikidata(provider, ids, V.RESOURCE_SCHEMES)).withColumn("owner_kind", F.lit("br"))
    owned = projected(spark, sf_dir, "br_id")
    before = Graph.of(spark, ident=owned.select(F.col("id").alias("uri"), "scheme", "literal"), ent_id=owned.select(F.lit("br").alias("owner_kind"), "owner", "id"))
    after = enrich.added_identifiers(before, new, "id/")
    return after.ident.where("uri rlike '^id/[0-9]+$'").join(before.ident.select("uri"), "uri", "left_anti").groupBy("scheme").agg(F.count("*").alias("n"))


@query(_AGENTS + _SURVIVORS + """, member AS (SELECT survivor AS to_uri, r.*, (CASE WHEN r.uri = survivor THEN 0 ELSE 1 END) AS k FROM picked JOIN clustered USING (cluster) JOIN ra r USING (uri))
SELECT to_uri AS entity, 'merge' AS kind, count(*) AS n_sources, CAST(NULL AS STRING) AS absorbed_by FROM member GROUP BY to_uri
UNION ALL SELECT uri, 'deletion', 1, to_uri FROM member WHERE k = 1""")
def provenance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, sent = projected(spark, sf_dir, "ra"), _agent_redirects(spark, sf_dir)
    after = survivors.coalesced_fields(before, sent, survivors.RA_FIELDS)
    found = provenance.provenance_diff(before, after, sent)
    return found.select("entity", "kind", F.size("derived_from").cast("long").alias("n_sources"), "absorbed_by")
