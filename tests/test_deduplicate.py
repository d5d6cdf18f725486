import random

import pytest
from graphs import B, build, golden, u
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.operators import containers, contributors
from citeweave.operators.containers import part_of_chain
from citeweave.operators.contributors import author_order, contributions, similar_name_redirects
from citeweave.plans.deduplicate import GraphDeduplicator
from citeweave.sources.jsonld import read_jsonld
from citeweave.sources.ntriples import graph_of, line_column, read_triples, triples_of
from citeweave.sources.storage import directory_storage, single_file_storage


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_golden_graph(spark, tmp_path):
    worker = GraphDeduplicator(golden(spark), directory_storage(str(tmp_path / "out")))
    worker.deduplicate_and_save()
    g = worker.graph
    assert values(g.br, "uri") == [u("br", n) for n in (1, 2, 3, 4, 5, 7)]
    counts = {r["br"]: r["count"] for r in g.br_ar.groupBy("br").count().collect()}
    assert counts == {u("br", 3): 2, u("br", 7): 1}
    assert g.ident.select("scheme", "literal").distinct().count() == g.ident.count() == 10
    assert g.ra.count() == 3
    assert g.ent_id.where("owner_kind = 'ra'").count() == 4
    assert not g.ar.join(g.ra, g.ar.held_by == g.ra.uri, "left_anti").count()
    assert not g.br_ar.join(g.ar, g.br_ar.ar == g.ar.uri, "left_anti").count()
    kinds = {r["entity"]: r["kind"] for r in worker.provenance.collect()}
    assert kinds[u("ra", 3)] == "deletion" and kinds[u("br", 6)] == "deletion"
    back = graph_of(read_jsonld(spark, str(tmp_path / "out")))
    lines = lambda x: sorted(r[0] for r in triples_of(x).select(line_column()).collect())
    assert lines(back) == lines(g)
    assert sorted(p.relative_to(tmp_path).as_posix() for p in (tmp_path / "out" / "ar").rglob("*.zip")) == ["out/ar/_/10000/1000.zip", "out/ar/_/10000/1000/prov/se.zip"]


def test_survivor_is_the_richer_or_the_preferred(spark):
    two = lambda: build(spark, br=[(1, V.ARTICLE, None, None, None), (2, V.ARTICLE, "t", "2020", None)], ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "d")])
    worker = GraphDeduplicator(two())
    worker.deduplicate()
    assert values(worker.graph.br, "uri") == [u("br", 2)]
    worker = GraphDeduplicator(two(), preferred_survivors=[u("br", 1), "http://elsewhere/br/9"])
    worker.deduplicate()
    assert values(worker.graph.br, "uri", "title") == [(u("br", 1), "t")]
    with pytest.raises(ValueError, match="preferred"):
        GraphDeduplicator(two(), preferred_survivors=[u("br", 1), u("br", 2)]).deduplicate()


def test_author_order_is_spliced(spark):
    g = build(
        spark,
        br=[(1, V.ARTICLE, "t", None, None)],
        ra=[(n, None, "g", f"f{n}") for n in (1, 2, 3)],
        ar=[(1, 1, V.AUTHOR, 1, 2), (2, 1, V.AUTHOR, 2, 3), (3, 1, V.AUTHOR, 3)],
        ids=[(1, "ra", 1, "orcid", "x"), (2, "ra", 2, "orcid", "x")],
    )
    worker = GraphDeduplicator(g)
    worker.deduplicate_responsible_agents()
    rows = {r["uri"]: r["next"] for r in worker.graph.ar.collect()}
    assert rows == {u("ar", 1): u("ar", 3), u("ar", 3): None}


def test_similar_names_only_if_asked(spark):
    g = lambda: build(
        spark,
        br=[(1, V.ARTICLE, "t", None, None), (2, V.ARTICLE, "t", None, None)],
        ra=[(1, None, "Maximiliane", "Mustermannsen"), (2, None, "Maximiliane", "Mustermannsem")],
        ar=[(1, 1, V.AUTHOR, 1), (2, 2, V.AUTHOR, 2)],
        ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "d")],
    )
    for asked, expected in ((False, 2), (True, 1)):
        worker = GraphDeduplicator(g(), merge_similar_named_contributors=asked)
        worker.deduplicate()
        assert worker.graph.br_ar.count() == expected


@pytest.mark.parametrize("numbers, merged", [(("7", "7"), 1), (("7", "8"), 2)])
def test_containers_merge_by_number(spark, numbers, merged):
    g = build(spark, br=[(1, V.VOLUME, None, None, None, numbers[0]), (2, V.VOLUME, None, None, None, numbers[1]), (3, V.ARTICLE, "a", None, 1), (4, V.ARTICLE, "a", None, 2)], ids=[(1, "br", 3, "doi", "d"), (2, "br", 4, "doi", "d")])
    worker = GraphDeduplicator(g)
    worker.deduplicate_bibliographic_resources()
    assert worker.graph.br.count() == 1 + merged
    assert values(worker.graph.br.where("title = 'a'"), "part_of") == [u("br", 1)]


def test_a_failed_parent_blocks_its_children(spark):
    g = build(
        spark,
        br=[(1, V.JOURNAL, "One", None, None), (2, V.JOURNAL, "Two", None, None), (3, V.VOLUME, None, None, 1, "1"), (4, V.VOLUME, None, None, 2, "1"), (5, V.ARTICLE, "a", None, 3), (6, V.ARTICLE, "a", None, 4)],
        ids=[(1, "br", 5, "doi", "d"), (2, "br", 6, "doi", "d")],
    )
    worker = GraphDeduplicator(g)
    worker.deduplicate_bibliographic_resources()
    assert worker.graph.br.count() == 5


def test_identifiers_on_any_predicate(spark):
    refers = (u("ar", 9), B + "refersTo", u("id", 2), "uri", None, None)
    g = build(spark, br=[(1, V.ARTICLE, "a", None, None), (2, V.ARTICLE, "b", None, None)], ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "d")], triples=[refers])
    worker = GraphDeduplicator(g)
    worker.deduplicate_identifiers()
    assert values(worker.graph.triples, "o") == [u("id", 1)]
    assert values(worker.graph.ent_id, "owner", "id") == [(u("br", 1), u("id", 1)), (u("br", 2), u("id", 1))]


def test_publishers_merge_by_name(spark):
    g = build(
        spark,
        br=[(1, V.ARTICLE, "a", "2020", None), (2, V.ARTICLE, "a", None, None)],
        ra=[(1, "ACM  Press", None, None), (2, "acm press", None, None)],
        ar=[(1, 1, V.PUBLISHER, 1), (2, 2, V.PUBLISHER, 2)],
        ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "d")],
    )
    worker = GraphDeduplicator(g)
    worker.deduplicate_bibliographic_resources()
    assert values(worker.graph.br_ar, "br", "ar") == [(u("br", 1), u("ar", 1))]


def test_manual_clusters(spark):
    g = lambda: build(
        spark,
        br=[(1, V.ARTICLE, "a", None, None), (2, V.ARTICLE, "b", "2020", None), (3, V.ARTICLE, "c", None, None)],
        ra=[(1, None, "A", "A"), (2, None, "B", "B")],
        ar=[(1, 1, V.AUTHOR, 1), (2, 2, V.AUTHOR, 2), (3, 2, V.EDITOR, 2)],
    )
    worker = GraphDeduplicator(g())
    worker.merge_clusters({u("br", 1): [u("br", 2)]})
    assert values(worker.graph.br, "uri", "title") == [(u("br", 1), "a"), (u("br", 3), "c")]
    assert worker.graph.br.where("title = 'a'").first()["pub_date"] == "2020"
    # the survivor's authors win, and an editor it lacks is donated
    assert values(worker.graph.br_ar, "ar") == [u("ar", 1), u("ar", 3)]


@pytest.mark.parametrize(
    "mapping, rule",
    [
        ({u("br", 1): []}, "empty"), ({u("br", 1): [u("br", 1)]}, "self_merge"), ({u("br", 1): [u("br", 2)], u("br", 2): [u("br", 3)]}, "survivor_is_merged"),
        ({u("br", 1): [u("br", 3)], u("br", 2): [u("br", 3)]}, "merged_twice"), ({u("br", 1): [u("br", 99)]}, "missing"), ({u("br", 1): [u("ra", 1)]}, "mixed_kinds"),
        ({u("br", 1): [u("br", 4)]}, "container_types"), ({u("id", 1): [u("id", 2)]}, "identifier_values"),
    ],
)
def test_rejected_clusters(spark, mapping, rule):
    g = build(spark, br=[(1, V.ARTICLE, "a", None, 4), (2, V.ARTICLE, "b", None, None), (3, V.ARTICLE, "c", None, None), (4, V.ISSUE, "i", None, None)], ra=[(1, "x", None, None)], ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "e")])
    with pytest.raises(ValueError, match=rule):
        GraphDeduplicator(g).merge_clusters(mapping)


def test_argument_checks(spark, tmp_path):
    g = build(spark, br=[(1, V.ARTICLE, "a", None, None)])
    with pytest.raises(TypeError):
        GraphDeduplicator(g).merge_clusters({u("br", 1): u("br", 2)})
    with pytest.raises(ValueError, match="storage"):
        GraphDeduplicator(g).deduplicate_and_save()
    for bad in ({"output_dir": ""}, {"output_dir": "x", "items_per_directory": -1}, {"output_dir": "x", "items_per_file": 0}):
        with pytest.raises(ValueError):
            directory_storage(**bad)


def test_ntriples_round_trip(spark, tmp_path):
    g = golden(spark)
    single_file_storage(str(tmp_path / "g"), str(tmp_path / "p"), output_format="nt", zip_output=False).save(g)
    back = graph_of(read_triples(spark, str(tmp_path / "g")))
    lines = lambda x: sorted(r[0] for r in triples_of(x).select(line_column()).collect())
    assert lines(back) == lines(g)
    odd = tmp_path / "odd.nt"
    odd.write_text('<http://a> <http://p> "q\\"\\u00e9\\n"@fr .\n# comment\n\n_:b <http://p> <http://o> .\n')
    rows = {tuple(r) for r in read_triples(spark, str(odd)).collect()}
    assert rows == {("http://a", "http://p", 'q"é\n', "literal", None, "fr"), ("_:b", "http://p", "http://o", "uri", None, None)}


def test_deleted_entities_vanish_from_files(spark, tmp_path):
    g = build(spark, br=[(1, V.ARTICLE, "a", None, None), (2, V.ARTICLE, "b", None, None), (5000, V.ARTICLE, "far", None, None)], ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "d")])
    storage = directory_storage(str(tmp_path / "o"), output_format="nt", zip_output=False)
    storage.save(g)
    worker = GraphDeduplicator(g, storage)
    worker.deduplicate_and_save()
    text = "\n".join(p.read_text() for p in (tmp_path / "o").rglob("*.nt"))
    assert u("br", 2) + ">" not in text and u("br", 5000) + ">" in text
    assert (tmp_path / "o" / "br" / "_" / "10000" / "5000.nt").exists() and (tmp_path / "o" / "br" / "_" / "10000" / "1000" / "prov" / "se.nq").exists()
    # in Spark's own tables the buckets are partitions
    tables = directory_storage(str(tmp_path / "t"), output_format="parquet")
    tables.save(g)
    tables.save(worker.graph, worker.provenance, worker.provenance.selectExpr("entity as uri"))
    rows = spark.read.parquet(str(tmp_path / "t" / "graph")).collect()
    assert {r["s"] for r in rows} == {u("br", 1), u("br", 5000), u("id", 1)} and {r["file_bucket"] for r in rows} == {1000, 5000}


def test_long_chains_of_containers_and_cycles(spark):
    """Chains are followed to the root, 40 levels here, and a cycle ends where it began."""
    deep = build(spark, br=[(n, V.VOLUME, None, None, n + 1 if n < 41 else None) for n in range(1, 42)])
    found = {r["ancestor"]: r["depth"] for r in part_of_chain(deep.br, deep.br.where(f"uri = '{u('br', 1)}'")).collect()}
    assert found == {u("br", n): n - 1 for n in range(2, 42)}
    ring = build(spark, br=[(n, V.VOLUME, None, None, n % 3 + 1) for n in (1, 2, 3)])
    assert values(part_of_chain(ring.br), "br", "ancestor", "depth") == sorted((u("br", n), u("br", (n + d - 1) % 3 + 1), d) for n in (1, 2, 3) for d in (1, 2))


def test_containers_merge_until_nothing_changes(spark):
    """Each volume shares an identifier with the next one only, so each round makes one more equal to the first."""
    n = 11
    volumes = [(k, V.VOLUME, f"volume {k}", None, None) for k in range(1, n + 1)]
    articles = [(100 + k, V.ARTICLE, "a", None, k) for k in range(1, n + 1)]
    ids = [(k, "br", 100 + k, "doi", "d") for k in range(1, n + 1)]
    ids += [(100 + k, "br", k, "issn", f"s{k}") for k in range(1, n + 1)] + [(200 + k, "br", k, "issn", f"s{k - 1}") for k in range(2, n + 1)]
    worker = GraphDeduplicator(build(spark, br=volumes + articles, ids=ids))
    worker.deduplicate_bibliographic_resources()
    assert values(worker.graph.br, "uri", "part_of") == sorted([(u("br", 1), None), (u("br", 101), u("br", 1))], key=lambda r: r[0])
    assert {r["kind"] for r in worker.provenance.where("entity like '%/11'").collect()} == {"deletion"}


def test_order_of_authors_in_a_cycle(spark):
    links = [("b1", f"a{k}", f"a{k + 1}" if k < 4 else None) for k in range(5)] + [("b2", "c0", "c1"), ("b2", "c1", "c0"), ("b2", "c2", "c0"), ("b2", "d0", "d1"), ("b2", "d1", None)]
    got = {r["ar"]: r["position"] for r in author_order(spark.createDataFrame(links, "br string, ar string, next string")).collect()}
    assert got == {"a0": 0, "a1": 1, "a2": 2, "a3": 3, "a4": 4, "c0": None, "c1": None, "c2": None, "d0": 0, "d1": 1}


def test_similar_names_are_folded_and_without_the_full_name(spark):
    """The full name doesn't count; case and spaces are folded."""
    names = [(1, "Same Name", "Jo", "Ann"), (2, "Same Name", "Max", "Moritz"), (3, None, "MAX", "MORITZ"), (4, "x", None, None), (5, "x", None, None), (6, None, "Max", "Moritz")]
    g = build(spark, br=[(1, V.ARTICLE, "t", None, None)], ra=names, ar=[(k, 1, V.AUTHOR, k) for k in range(1, 7)])
    assert values(similar_name_redirects(contributions(g), g.ra), "from_uri", "to_uri") == [(u("ar", 3), u("ar", 2)), (u("ar", 6), u("ar", 2))]
    settled = spark.createDataFrame([(u("ar", 2),)], "uri string")
    assert values(similar_name_redirects(contributions(g), g.ra, settled=settled), "from_uri", "to_uri") == [(u("ar", 6), u("ar", 3))]


def test_discarded_roles_are_spliced_and_shared_ones_stay(spark):
    g = build(
        spark,
        br=[(1, V.ARTICLE, "a", None, None), (2, V.ARTICLE, "b", None, None), (3, V.ARTICLE, "c", None, None)],
        ra=[(k, None, "n", f"f{k}") for k in range(1, 5)],
        ar=[(1, 1, V.AUTHOR, 1), (2, 2, V.AUTHOR, 2, 3), (3, 2, V.AUTHOR, 3, 4), (4, 2, V.EDITOR, 4), (5, 3, V.AUTHOR, 2, 3)],
    )
    g = g.with_(br_ar=g.br_ar.union(spark.createDataFrame([(u("br", 3), u("ar", 2))], "br string, ar string")))
    worker = GraphDeduplicator(g)
    worker.merge_clusters({u("br", 1): [u("br", 2)]})
    assert {r["uri"]: r["next"] for r in worker.graph.ar.collect()} == {u("ar", 1): None, u("ar", 2): u("ar", 4), u("ar", 4): None, u("ar", 5): u("ar", 4)}
    assert values(worker.graph.br_ar, "br", "ar") == [(u("br", 1), u("ar", 1)), (u("br", 1), u("ar", 4)), (u("br", 3), u("ar", 2)), (u("br", 3), u("ar", 5))]


def test_a_cluster_whose_member_an_earlier_one_merged_is_refused(spark):
    """Identifiers go first, then resources by the depth of their containers; a cascade may take a later cluster's member."""
    g = build(
        spark,
        br=[(1, V.JOURNAL, "J", None, None), (2, V.JOURNAL, "J", None, None), (3, V.ARTICLE, "a", None, None), (4, V.ARTICLE, "b", None, 2), (5, V.ARTICLE, "c", None, 1), (6, V.ARTICLE, "d", None, 2), (7, V.ARTICLE, "e", None, 5)],
    )
    worker = GraphDeduplicator(g)
    worker.merge_clusters({u("br", 5): [u("br", 6)], u("br", 3): [u("br", 4)], u("br", 1): [u("br", 2)]})
    assert values(worker.graph.br, "uri") == [u("br", n) for n in (1, 3, 5, 7)]
    g = build(spark, br=[(1, V.VOLUME, None, None, None, "1"), (2, V.VOLUME, None, None, 9, "1"), (9, V.JOURNAL, "J", None, 10), (10, V.JOURNAL, "S", None, None), (3, V.ARTICLE, "a", None, 1), (4, V.ARTICLE, "b", None, 2), (8, V.VOLUME, None, None, None, "5")])
    # the survivor of the volumes' cluster lies deeper than the articles, so their cascade merges it first
    with pytest.raises(ValueError, match=f"{u('br', 2)} is deleted .merged into {u('br', 1)}. and cannot take part in the merge cluster of"):
        GraphDeduplicator(g).merge_clusters({u("br", 3): [u("br", 4)], u("br", 2): [u("br", 8)]})


@pytest.mark.parametrize("mapping, text", [({"br/1": ["br/1"]}, "cannot be merged into itself"), ({"br/1": ["br/9"]}, "Entity not found"), ({"br/1": ["ra/1"]}, "mixes entity types"), ({"br/1": ["br/3"], "br/2": ["br/3"]}, "already assigned"), ({"br/1": ["br/2"], "br/2": ["br/3"]}, "cannot be both survivor and merged entity"), ({"br/1": ["br/4"]}, "incompatible types"), ({"id/1": ["id/2"]}, "different scheme/literal")])
def test_what_is_said_of_rejected_clusters(spark, mapping, text):
    g = build(spark, br=[(1, V.ARTICLE, "a", None, 4), (2, V.ARTICLE, "b", None, None), (3, V.ARTICLE, "c", None, None), (4, V.ISSUE, "i", None, None)], ra=[(1, "x", None, None)], ids=[(1, "br", 1, "doi", "d"), (2, "br", 2, "doi", "e")])
    with pytest.raises(ValueError, match=text):
        GraphDeduplicator(g).merge_clusters({B + k: [B + x for x in v] for k, v in mapping.items()})


def edited(draw, name, times):
    """The name after so many random edits of a letter."""
    letters = list(name)
    for _ in range(times):
        at = draw.randrange(len(letters))
        letters[at : at + draw.choice([0, 1])] = draw.choice(["", "a", "b", " c"])
    return "".join(letters)


def test_similar_names_equal_the_plain_greedy_pass(spark):
    """Names of all lengths around the bounds, each with near and far neighbours."""
    draw, names = random.Random(1), []
    for size in (5, 19, 20, 21, 38, 39, 40, 41, 59, 60, 61, 80, 150):
        for _ in range(3):
            base = "".join(draw.choices("abcdefgh ", k=size)).strip() or "x"
            names += [edited(draw, base, k) for k in (0, 0, 1, 1, 2, 3, 4)] + [base.upper(), base.replace(" ", "  ")]
    draw.shuffle(names)
    roles = [(f"b{k % 2}", f"ar/{k:05d}", V.AUTHOR if k % 3 else V.EDITOR, f"ra/{k}") for k in range(len(names))]
    agents = [(f"ra/{k}", n if k % 2 else None, None if k % 2 else n) for k, n in enumerate(names)]
    want, kept = [], {}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    for (br, ar, kind, _), name in zip(roles, names, strict=True):
        name = " ".join(name.casefold().split())
        held = kept.setdefault((br, kind), [])
        into = next((k for k, other in held if abs(len(other) - len(name)) < 9 and 1 - distance(name, other) / max(len(name), len(other)) > 0.95), None)
        if into is None:
            held.append((ar, name))
        else:
            want.append((br, ar, into))
    found = similar_name_redirects(spark.createDataFrame(roles, "br string, ar string, role_type string, held_by string"), spark.createDataFrame(agents, "uri string, given_name string, family_name string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_short_lists_of_similar_names_write_no_grams(spark, monkeypatch):
    """Lists of up to 32 roles are settled in their rows, beside one longer list of the same resource."""
    written = []
    real = contributors.staged
    monkeypatch.setattr(contributors, "staged", lambda df, label: (written.append(label), real(df, label))[1])
    name = "maximiliane josephine abcdefghijklmnopqrstuvwxyz {}".format
    roles = [(f"b{k // 4}", f"ar/{k:03d}", V.AUTHOR, f"ra/{k}") for k in range(40)] + [("b0", f"ar/{k:03d}", V.EDITOR, f"ra/{k}") for k in range(40, 80)]
    agents = [(f"ra/{k}", None, name("xyz"[: k % 4]) if k < 60 else f"{k * 7919 ** 9:040d}") for k in range(80)]
    found = lambda r: similar_name_redirects(spark.createDataFrame(r, "br string, ar string, role_type string, held_by string"), spark.createDataFrame(agents, "uri string, given_name string, family_name string"))
    of_short = {(f"ar/{k:03d}", f"ar/{k - 1:03d}") for k in range(1, 40, 2)}
    assert {tuple(r)[1:] for r in found(roles[:40]).collect()} == of_short and "grams" not in written
    of_long = {(f"ar/{k:03d}", f"ar/{40 + k % 4 // 2 * 2:03d}") for k in range(40, 60)} - {("ar/040", "ar/040"), ("ar/042", "ar/042")}
    assert {tuple(r)[1:] for r in found(roles).collect()} == of_short | of_long and "grams" in written


def test_fifty_thousand_contributors_of_one_resource(spark):
    """A shared given name makes nobody similar; each tenth contributor has a namesake of one letter's difference."""
    n = 50_000
    ids = spark.range(n).withColumn("name", F.concat(F.lit("Family "), F.sha2(F.floor(F.col("id") - F.when(F.col("id") % 10 == 1, 1).otherwise(0)).cast("string"), 256).substr(1, 12), F.when(F.col("id") % 10 == 1, "x").otherwise("")))
    agents = ids.select(F.format_string("ra/%06d", "id").alias("uri"), F.lit("Maximiliane").alias("given_name"), F.col("name").alias("family_name"))
    roles = ids.select(F.lit("b").alias("br"), F.format_string("ar/%06d", "id").alias("ar"), F.lit(V.AUTHOR).alias("role_type"), F.format_string("ra/%06d", "id").alias("held_by"))
    found = {(r["from_uri"], r["to_uri"]) for r in similar_name_redirects(roles, agents).collect()}
    assert found == {(f"ar/{k + 1:06d}", f"ar/{k:06d}") for k in range(0, n, 10)}


def test_chains_of_what_contains_nothing_stay_out_of_the_rounds(spark, monkeypatch):
    """Rounds write rows of containers only, also around a cycle and for a part of two wholes."""
    up = {"i1": ["v1"], "v1": ["j"], "i2": ["v2"], "v2": ["i2"]} | {f"a{k}": ["i1"] if k % 2 else ["i2"] for k in range(50)} | {"both": ["i1", "v1"]}
    rows = [(uri, whole) for uri, wholes in up.items() for whole in wholes]
    written = []
    real = containers.staged
    monkeypatch.setattr(containers, "staged", lambda df, label: (written.append((label, out := real(df, label))), out)[1])
    found = {tuple(r) for r in containers.part_of_chain(spark.createDataFrame(rows, "uri string, part_of string")).collect()}
    want = set()
    for start in up:
        seen, now, depth = {start}, set(up[start]), 1
        while now := now - seen:
            want |= {(start, uri, depth) for uri in now}
            seen |= now
            now, depth = {w for uri in now for w in up.get(uri, [])}, depth + 1
    assert found == want
    assert all(df.count() < 20 for label, df in written if label == "chain")


def test_a_deep_chain_in_few_written_tables(spark, monkeypatch):
    deep = spark.range(1, 1001).select(F.format_string("br/%d", "id").alias("uri"), F.when(F.col("id") < 1000, F.format_string("br/%d", F.col("id") + 1)).alias("part_of"))
    written = []
    real = containers.staged
    monkeypatch.setattr(containers, "staged", lambda df, label: (written.append(label), real(df, label))[1])
    found = containers.part_of_chain(deep, deep.where("uri = 'br/1'").select("uri"))
    assert {r["depth"] for r in found.collect()} == set(range(1, 1000)) and len(written) <= 12
