"""What a task holds, and how often a table is made, as tables grow."""

import os

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from citeweave import staging
from citeweave.llm import jaccard_join
from citeweave.operators import clusters, components, provenance, survivors
from citeweave.plans import projection, queries
from citeweave.sources import lookups


def noted(monkeypatch, module):
    """The tables that a module stages, by label."""
    written, real = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, label: (written.append((label, out := real(df, label))), out)[1])
    return written


def test_tasks_follow_the_size_of_a_table(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    few, many = (projection.tasks(spark, str(tmp_path), "t", share) for share in (10**9, 100))
    assert few == spark.sparkContext.defaultParallelism and many > 40


def test_roles_are_dealt_to_so_many_tasks(spark, monkeypatch):
    for module in (projection, queries):
        monkeypatch.setattr(module, "tasks", lambda *_: 37)
    assert projection.projected(spark, SF, "role").rdd.getNumPartitions() == 37
    assert queries.same_agent_roles(spark, SF).rdd.getNumPartitions() == 37


def test_containers_meet_one_order_of_each_priority(spark, monkeypatch):
    written = noted(monkeypatch, queries)
    queries.cluster_rules(spark, SF)
    assert [df.count() for label, df in written if label == "firsts"] == [5]


def test_authors_are_staged_once(spark, monkeypatch):
    written = noted(monkeypatch, queries)
    queries.unlinked_author_order(spark, SF)
    assert [label for label, _ in written].count("roles") == 1


def test_a_table_of_answers_is_made_once(spark, monkeypatch):
    written = noted(monkeypatch, lookups)
    table = spark.createDataFrame([("s", "o", "k", "b"), ("s", "o", "k", "a"), ("s", "o", "n", None)], "source string, op string, key string, body string")
    provider, asked = lookups.TableLookups(table), spark.createDataFrame([("s", "o", "k"), ("s", "o", "n")], "source string, op string, key string")
    for _ in range(2):
        assert [tuple(r) for r in provider.answers(asked.where(F.col("key") != "")).collect()] == [("s", "o", "k", "a")]
    assert [label for label, _ in written] == ["table"]


def test_components_of_near_nodes_are_whole_at_once(spark, monkeypatch):
    """Of agents numbered in turn, whose clusters lie near each other, hardly any are open after the first contraction."""
    held = spark.range(8000).selectExpr("concat('ra/', id) AS uri", "'o' AS scheme", "concat(id - id % 8, '-', hash(id) % 3) AS literal")
    held = held.unionByName(spark.range(8000).selectExpr("concat('ra/', id) AS uri", "'v' AS scheme", "concat(id - id % 8, '-', hash(id, 1) % 3) AS literal"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rounds, real = [], components.staged  # nodes that take part in a round; its tables are deleted after it
    monkeypatch.setattr(components, "staged", lambda df, label: (out := real(df, label), label == "low" and rounds.append(out.count()))[0])
    try:
        found = {r["uri"]: r["cluster"] for r in clusters.duplicate_clusters(held).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) > 7000 and sum(rounds) < 400
    by_key = {}
    for r in held.collect():
        by_key.setdefault((r["scheme"], r["literal"]), []).append(r["uri"])
    assert {u for of in by_key.values() if len(of) > 1 for u in of} == set(found)
    assert all(len({found[u] for u in of}) == 1 for of in by_key.values() if len(of) > 1) and all(c <= u and found[c] == c for u, c in found.items())


def test_components_of_far_nodes(spark):
    """Stars, chains and a ring whose nodes are dealt over the whole range."""
    place = lambda k: (k * 7919) % 100_003
    pairs = [(place(k), place(k + 1)) for k in range(300)] + [(place(5000), place(5000 + k)) for k in range(1, 50)] + [(place(9000 + k), place(9000 + (k + 1) % 30)) for k in range(30)]
    pairs += [(place(20_000 + k), place(40_000 + k)) for k in range(500)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, components.near_components(edges).collect())) == sorted(map(tuple, components.components(edges).collect()))
        assert components.near_components(edges.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clusters_and_fields_are_not_broadcast(spark):
    """However small the files are, of which a join is made."""
    agents = projection.projected(spark, SF, "ra")
    groups, sent = agents.selectExpr("uri", "uri AS cluster"), agents.selectExpr("uri AS from_uri", "concat(uri, 'x') AS to_uri")
    tables = [queries.duplicate_edges(spark, SF), survivors.surviving_entities(groups, agents, "ra"), survivors.coalesced_fields(agents, sent, survivors.RA_FIELDS)]
    assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in tables)


def test_roles_of_survivors_are_counted_where_they_are_dealt(spark, monkeypatch):
    """No lines are sorted, and roles are dealt once by agent and resource, to tasks by the size of the table."""
    monkeypatch.setattr(queries, "tasks", lambda *_: 37)
    plan = queries.rewritten_roles(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "l_orderkey#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert [line for line in plan.splitlines() if "Exchange" in line and "37)" in line and "survivor" in line and "br" in line]


def test_provenance_is_not_broadcast(spark):
    before = projection.projected(spark, SF, "ra")
    sent = before.selectExpr("uri AS from_uri", "concat(uri, 'x') AS to_uri")
    assert "Broadcast" not in provenance.provenance_diff(before, before, sent)._jdf.queryExecution().executedPlan().toString()


def test_few_edges_of_many_tasks_take_no_rounds(spark, monkeypatch):
    """What little is left of many tasks' edges is finished by one task; beyond the bound, rounds find the same."""
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(40).cache()
    want = sorted([(k, 0) for k in range(301)] + [(1000 + k, 1000) for k in range(200)])
    written = noted(monkeypatch, components)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, components.components(edges).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {label for label, _ in written} == {"edges"}
    monkeypatch.setattr(components, "EDGES_OF_ONE_TASK", 0)
    assert sorted(map(tuple, components.components(edges).collect())) == want
    assert "low" in {label for label, _ in written}


def test_near_copies_of_a_large_group_write_few_tables(spark, monkeypatch):
    """Numbers of blocks, largest components and documents' classes are not written as tables of their own."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, f"x{k}"]) for k in range(60)] + [" ".join(f"y{k}_{j}" for j in range(9)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = noted(monkeypatch, jaccard_join)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs).collect()}
    assert got == {k: 0 if k < 60 else k for k in range(80)}
    assert not {"blocks", "lists", "member", "first", "most"} & {label for label, _ in written}


def test_strangers_meet_in_no_lists(spark, monkeypatch, tmp_path):
    """Texts of few words, whose shingles are all in other texts too: only near copies come to the lists, however many texts there are."""
    real = jaccard_join._list_links

    def noting(share):
        links = real(share)

        def run(frames):
            def passed():
                for k, frame in enumerate(frames):
                    with open(f"{tmp_path}/{os.getpid()}-{frame['doc_id'].iloc[0]}-{k}", "w") as f:
                        f.write(str(len(frame)))
                    yield frame

            yield from links(passed())

        return run

    monkeypatch.setattr(jaccard_join, "_list_links", noting)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in draw.integers(20, size=100)) for _ in range(1500)]
    texts += [t + " end" for t in texts[:20]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: k if k < 1500 else k - 1500 for k in range(1520)}
    assert 40 <= sum(int(f.read_text()) for f in tmp_path.iterdir()) < 1000


@pytest.mark.parametrize("share", [(85, 100), (80, 100), (51, 100), (1, 2), (3, 10)])
def test_sets_that_link_share_a_run_of_their_prefixes(share):
    draw, linked = np.random.default_rng(6), 0
    for _ in range(4000):
        one = np.sort(draw.choice(60, draw.integers(1, 40), replace=False))
        other = np.union1d(one[draw.random(len(one)) > draw.random() / 3], draw.choice(60, draw.integers(len(one) // 4 + 1), replace=False))
        common = len(np.intersect1d(one, other))
        if common and share[1] * common >= share[0] * (len(one) + len(other) - common):
            linked += 1
            names = [jaccard_join.runs(x.astype(np.uint64), share)[: jaccard_join.prefix_length(len(x), share)] for x in (one, other)]
            assert len(np.intersect1d(*names))
    assert linked > 300


def shuffled(spark):
    """The files of shuffles that are there, with their bytes."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return {f: os.path.getsize(f"{folder}/{f}") for top in folders for folder, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_shuffles_go_with_the_step(spark):
    """A staged table is read from its own files, so those of its shuffles are deleted at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = set(shuffled(spark)), spark.conf.get(name)
    out = staging.staged(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert sum(r["count"] for r in out.collect()) == 1000
    assert not set(shuffled(spark)) - before and spark.conf.get(name) == setting


def test_near_copies_leave_hardly_any_shuffles(spark, monkeypatch):
    """After each table that the pipeline's stage writes, there are files of its few counts only, not those of the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, left, real = set(shuffled(spark)), [], jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df, label: (real(df, label), left.append(sum(size for f, size in shuffled(spark).items() if f not in before)))[0])
    assert 0 < corpus_pipeline.drop_near_copies(spark, docs, SF).count() <= docs.count()
    assert len(left) > 9 and max(left) < 0.1 * docs.agg(F.sum(F.octet_length("text"))).first()[0]
