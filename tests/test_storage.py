"""Files of graphs and provenance: JSON-LD, archives of exact names, chains of snapshots, and what failures leave."""

import json
import zipfile

import pytest
from graphs import B, build, u
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.graph import Graph
from citeweave.operators.provenance import TRIPLE, delta_changes, replayed, snapshots, triple_delta, update_queries
from citeweave.plans.deduplicate import GraphDeduplicator
from citeweave.sources.counters import MemoryCounters, StoredCounters
from citeweave.sources.jsonld import Context, read_jsonld
from citeweave.sources.members import write_members
from citeweave.sources.ntriples import graph_of, line_column, parsed_lines, triples_of
from citeweave.sources.storage import directory_storage, single_file_storage

ROW = "path string, grp string, text string"


def lines(graph: Graph):
    return sorted(r[0] for r in triples_of(graph).select(line_column()).collect())


def files(folder):
    return sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


@pytest.fixture(scope="module")
def small(spark):
    """An article with an odd title in a journal, an author, an identifier, and triples of other kinds."""
    others = [(u("br", 1), B + "says", 'a "b"\n\\ é', "literal", None, "fr"), (u("br", 1), B + "knows", "_:x", "blank", None, None), (u("br", 1), B + "rates", "5", "literal", "http://www.w3.org/2001/XMLSchema#int", None)]
    g = build(spark, br=[(1, V.ARTICLE, 'T "q" \\ {x}', "2020-05", 2500), (2500, V.JOURNAL, "J", None, None)], ra=[(1, None, "A", "É")], ar=[(1, 1, V.AUTHOR, 1)], ids=[(1, "br", 1, "doi", "10.1/x")], triples=others)
    return g.staged()


def changed(spark, entities, kind="modification", number=1):
    rows = [(e, kind, [] if kind == "creation" else [e], None) for e in entities]
    return snapshots(spark.createDataFrame(rows, "entity string, kind string, derived_from array<string>, absorbed_by string"), number, "urn:agent").withColumn("update", F.lit("INSERT DATA { }"))


def test_defaults_are_zipped_json_ld_in_the_layout(spark, small, tmp_path):
    storage = directory_storage(tmp_path / "o", supplier_prefix="060")
    storage.save(small, changed(spark, [u("br", 1)], "creation"))
    assert files(tmp_path / "o") == ["ar/060/10000/1000.zip", "br/060/10000/1000.zip", "br/060/10000/1000/prov/se.zip", "br/060/10000/3000.zip", "id/060/10000/1000.zip", "ra/060/10000/1000.zip"]
    with zipfile.ZipFile(tmp_path / "o" / "br" / "060" / "10000" / "1000.zip") as held:
        assert held.namelist() == ["1000.json"]
        (document,) = json.loads(held.read("1000.json"))
    (entity,) = document["@graph"]
    assert document["@id"] == B + "br/" and entity["@id"] == u("br", 1) and sorted(entity["@type"]) == sorted([V.EXPRESSION, V.ARTICLE])
    assert entity[V.PART_OF] == [{"@id": u("br", 2500)}] and entity[B + "says"] == [{"@value": 'a "b"\n\\ é', "@language": "fr"}]
    assert lines(graph_of(read_jsonld(spark, str(tmp_path / "o")))) == lines(small)
    quads = read_jsonld(spark, str(tmp_path / "o"), provenance=True)
    assert {r["g"] for r in quads.collect()} == {u("br", 1) + "/prov/"}


def test_plain_files_in_lines_and_without_directories(spark, small, tmp_path):
    storage = directory_storage(str(tmp_path / "n"), items_per_directory=0, output_format="nt11", zip_output=False, process_id=7)
    storage.save(small, changed(spark, [u("br", 1)]))
    assert files(tmp_path / "n") == ["ar/_/1000_7.nt", "br/_/1000/prov/se_7.nq", "br/_/1000_7.nt", "br/_/3000_7.nt", "id/_/1000_7.nt", "ra/_/1000_7.nt"]
    text = "".join((tmp_path / "n" / f).read_text() for f in files(tmp_path / "n") if f.endswith(".nt"))
    assert sorted(text.splitlines()) == lines(small)
    quads = parsed_lines(spark.read.text(str(tmp_path / "n" / "br" / "_" / "1000" / "prov"))).collect()
    assert {r["g"] for r in quads} == {u("br", 1) + "/prov/"} and {r["s"] for r in quads} == {u("br", 1) + "/prov/se/1"}


def test_prefixes_in_uris_name_their_directory(spark, tmp_path):
    g = Graph.of(spark, br=[("https://e.org/br/06104200", [V.EXPRESSION], "t", None, None, None, None, None)])
    directory_storage(tmp_path / "p", supplier_prefix="070").save(g)
    assert files(tmp_path / "p") == ["br/0610/10000/5000.zip"]


def test_a_context_shortens_and_is_expanded_again(spark, small, tmp_path):
    context = {"@context": {"dcterms": "http://purl.org/dc/terms/", "fabio": V.FABIO, "title": "dcterms:title", "part_of": V.PART_OF, "says": {"@id": B + "says", "@type": "@id"}}}
    contexts = {"http://e.org/context.json": context}
    storage = directory_storage(tmp_path / "c", zip_output=False, context_map=contexts, context_path="http://e.org/context.json")
    storage.save(small)
    (document,) = json.loads((tmp_path / "c" / "br" / "_" / "10000" / "1000.json").read_text())
    assert document["@context"] == "http://e.org/context.json"
    (entity,) = document["@graph"]
    assert "title" in entity and "part_of" in entity and "fabio:Expression" in entity["@type"] and B + "says" in entity
    assert lines(graph_of(read_jsonld(spark, str(tmp_path / "c"), contexts))) == lines(small)
    assert Context(context).expanded("title") == V.TITLE and Context(context).expanded("http://x/y") == "http://x/y"


def test_single_files(spark, small, tmp_path):
    storage = single_file_storage(tmp_path / "g.json", tmp_path / "p.json")
    storage.save(small, changed(spark, [u("br", 1), u("ra", 1)]))
    storage.save(small, changed(spark, [u("br", 1)]))
    assert files(tmp_path) == ["g.zip", "p.zip"]
    assert lines(graph_of(read_jsonld(spark, str(tmp_path / "g.zip")))) == lines(small)
    found = {r["s"] for r in read_jsonld(spark, str(tmp_path / "p.zip")).collect()}
    assert found == {u("br", 1) + "/prov/se/1", u("br", 1) + "/prov/se/2", u("ra", 1) + "/prov/se/1"}


def test_snapshots_are_chained_below_their_bucket(spark, small, tmp_path):
    """Two runs give se/1, which ends when se/2 begins; what is deleted ends at once; merges name what they absorbed."""
    storage = directory_storage(tmp_path / "o", output_format="nt", zip_output=False)
    storage.save(small, changed(spark, [u("br", 1), u("br", 2500)], "creation"))
    merge = spark.createDataFrame([(u("br", 1), "merge", [u("br", 1), u("br", 2500)], None), (u("br", 2500), "deletion", [u("br", 2500)], u("br", 1))], "entity string, kind string, derived_from array<string>, absorbed_by string")
    storage.save(small, snapshots(merge, 1, "urn:agent").withColumn("update", F.lit(None).cast("string")))
    assert [f for f in files(tmp_path / "o") if "prov" in f] == ["br/_/10000/1000/prov/se.nq", "br/_/10000/3000/prov/se.nq"]
    quads = parsed_lines(spark.read.text([str(tmp_path / "o" / f) for f in files(tmp_path / "o") if "prov" in f])).collect()
    said = lambda s, p: sorted(r["o"] for r in quads if r["s"] == s and r["p"] == p)
    first, second, other = (u("br", n) + f"/prov/se/{k}" for n, k in ((1, 1), (1, 2), (2500, 2)))
    assert said(first, V.ENDED) == said(second, V.BEGAN) and said(second, V.ENDED) == [] and said(other, V.ENDED) == said(other, V.BEGAN)
    assert said(second, V.DERIVED_FROM) == sorted([first, u("br", 2500) + "/prov/se/1"])
    assert said(second, V.DESCRIPTION) == [f"The entity '{u('br', 1)}' has been merged with '{u('br', 2500)}'."]
    assert len(said(first, V.LABEL)) == 1 and said(first, V.UPDATE) == ["INSERT DATA { }"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "a.txt").write_text("old")
    rows = spark.range(200).select(F.concat(F.lit("d/"), F.col("id") % 7, F.lit(".txt")).alias("path"), F.lit("").alias("grp"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="broken"):
        write_members(rows, str(tmp_path / "kept"), True, ".txt", None)
    assert files(tmp_path / "kept") == ["a.txt"]
    write_members(spark.createDataFrame([("a.txt", "", None), ("b/c.txt", "", "x"), ("b/c.txt", "", None)], ROW), str(tmp_path / "kept"), False, ".txt", None)
    assert files(tmp_path / "kept") == ["b/c.txt"] and (tmp_path / "kept" / "b" / "c.txt").read_text() == "x\n"


class Reporter:
    def __init__(self):
        self.said = []

    def add_sentence(self, text):
        self.said.append(text)


def test_reports_and_given_modified_entities(spark, small, tmp_path):
    good, bad = Reporter(), Reporter()
    storage = directory_storage(tmp_path / "o", zip_output=False, repok=good, reperr=bad, modified_entities={u("br", 1)}, wanted_label=False)
    storage.save(small, changed(spark, [u("br", 1)]))
    assert files(tmp_path / "o") == ["br/_/10000/1000.json", "br/_/10000/1000/prov/se.json"] and len(good.said) == 2 and not bad.said
    assert V.LABEL not in (tmp_path / "o" / "br" / "_" / "10000" / "1000" / "prov" / "se.json").read_text()
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):  # noqa: B017
        directory_storage(tmp_path / "file" / "below", repok=good, reperr=bad).save(small)
    assert len(good.said) == 2 and len(bad.said) == 1


def test_deltas_replayed_give_the_new_graph(spark, small):
    assert not triple_delta(small, small).count()
    rows = spark.createDataFrame([(u("br", 1), [V.EXPRESSION], "new title", None, "2020-05", None, None, None), (u("br", 9), [V.EXPRESSION], "more", None, None, None, None, None)], small.br.schema)
    doubled = small.triples.unionByName(small.triples.where(F.col("p") == B + "says"))
    new = small.with_(br=rows, triples=doubled)
    delta = triple_delta(small, new)
    again = replayed(triples_of(small), delta)
    assert sorted(map(repr, again.select(*TRIPLE).collect())) == sorted(map(repr, triples_of(new).select(*TRIPLE).collect()))
    none = small.br.selectExpr("uri as from_uri", "uri as to_uri").limit(0)
    kinds = {r["entity"]: r["kind"] for r in delta_changes(delta, small, new, none).collect()}
    assert kinds == {u("br", 1): "modification", u("br", 9): "creation", u("br", 2500): "deletion"}
    said = {r["entity"]: r["update"] for r in update_queries(delta).collect()}
    assert said[u("br", 9)].startswith("INSERT DATA { <") and "DELETE DATA" in said[u("br", 1)] and "; INSERT DATA" in said[u("br", 1)]


def test_counters_never_give_a_number_twice(spark, tmp_path):
    one, other = StoredCounters(spark, str(tmp_path / "n")), StoredCounters(spark, str(tmp_path / "n"))
    assert one.reserve("id", "060", 3, above=10) == 11 and other.reserve("id", "060", 2) == 14 and one.reserve("id", "060", 1, above=3) == 16
    assert one.reserve("id", "", 1) == 1 and one.reserve("br", "060", 5) == 1
    assert one.reserve("id", "060", 0, above=40) == 41 and other.reserve("id", "060", 1) == 41
    late = StoredCounters(spark, str(tmp_path / "n"))
    late._claims = lambda folder, real=late._claims, calls=[]: (calls.append(1), real(folder)[:-1] if len(calls) == 1 else real(folder))[1]
    assert late.reserve("id", "060", 1) == 42  # another run's claim came first
    memory = MemoryCounters()
    assert [memory.reserve("id", "", 2, 5), memory.reserve("id", "", 1)] == [6, 8]


def test_discarded_roles_are_recorded_and_vanish_from_files(spark, tmp_path):
    """The roles that give way to the survivor's are deleted by the step, so their files are rewritten too."""
    g = build(spark, br=[(1, V.ARTICLE, "a", None, None), (2, V.ARTICLE, "b", None, None)], ra=[(1, None, "A", "A"), (2, None, "B", "B")], ar=[(1, 1, V.AUTHOR, 1), (2001, 2, V.AUTHOR, 2)])
    storage = directory_storage(tmp_path / "o", output_format="nt", zip_output=False)
    storage.save(g)
    worker = GraphDeduplicator(g, storage)
    worker.merge_clusters_and_save({u("br", 1): [u("br", 2)]})
    assert {(r["entity"], r["kind"]) for r in worker.provenance.collect()} == {(u("br", 1), "merge"), (u("br", 2), "deletion"), (u("ar", 2001), "deletion")}
    assert [tuple(r) for r in worker.merges.select("from_uri", "to_uri").collect()] == [(u("br", 2), u("br", 1))]
    found = files(tmp_path / "o")
    assert "ar/_/10000/3000.nt" not in found and "ar/_/10000/3000/prov/se.nq" in found and u("br", 2) + ">" not in (tmp_path / "o" / "br" / "_" / "10000" / "1000.nt").read_text()
