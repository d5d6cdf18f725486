"""Enrichment: what is added, what is asked, and how catalogues are asked."""

import io
import json
import urllib.error
import urllib.request

import pytest
from conftest import SF
from graphs import build, u
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.functions.text import orcid_search
from citeweave.plans import enrich
from citeweave.plans.deduplicate import GraphDeduplicator
from citeweave.plans.queries import ORACLES, QUERIES
from citeweave.sources import lookups
from citeweave.sources.storage import single_file_storage


def test_doi_query_needs_the_anti_join(spark, duck, monkeypatch):
    """Without the identifiers, resources that have a DOI would be asked for too, and the SQL would differ."""
    want = sorted(duck.sql(ORACLES["enriched_doi"]).df()["owner"])
    assert sorted(r["owner"] for r in QUERIES["enriched_doi"](spark, SF).collect()) == want
    whole = enrich.enriched_doi
    monkeypatch.setattr(enrich, "enriched_doi", lambda provider, resources, ids, words: whole(provider, resources, ids.limit(0), words))
    assert len(QUERIES["enriched_doi"](spark, SF).collect()) > len(want)


class Catalogues:
    """Answers by source and op: a body, or a dictionary of bodies by key; counts what was asked."""

    def __init__(self, bodies):
        self.bodies, self.asked = bodies, []

    def answers(self, requests):
        rows = requests.select("source", "op", "key").where("key is not null").distinct().collect()
        self.asked += [tuple(r) for r in rows]
        found = [(*r, body[r.key] if isinstance(body, dict) else body) for r in rows if (body := self.bodies.get((r.source, r.op))) and (not isinstance(body, dict) or r.key in body)]
        return requests.sparkSession.createDataFrame(found, lookups.ANSWERS)


def viaf(n, number="88112233"):
    record = {"recordData": {"v:VIAFCluster": {"v:viafID": {"content": number}}}}
    return json.dumps({"searchRetrieveResponse": {"numberOfRecords": {"content": str(n)}, "records": {"record": record}}})


def details(given, family):
    return json.dumps({"name": {"given-names": {"value": given}, "family-name": {"value": family}}})


item = lambda q: json.dumps({"results": {"bindings": [{"item": {"value": f"http://www.wikidata.org/entity/{q}"}}]}})
EVERYTHING = {
    ("crossref", "journal"): json.dumps({"message": {"ISSN": ["2049-3630", "2049-3649"]}}),
    ("crossref", "works"): json.dumps({"message": {"items": [{"DOI": "10.4444/moss.7", "title": ["mosses of the northern forest"]}]}}),
    ("crossref", "member"): json.dumps({"message": {"member": "4141"}}),
    ("orcid", "search"): json.dumps({"result": [{"orcid-identifier": {"path": "0000-0003-0000-000x"}}, {"orcid-identifier": {"path": "0000-0003-5050-6060"}}]}),
    ("orcid", "details"): {"0000-0003-0000-000X": details("Tilda", "Moos"), "0000-0003-5050-6060": details("Ines Maria", "Farn-Ulme")},
    ("viaf", "search"): viaf(1),
    ("wikidata", "item"): {"doi:10.4444/MOSS.7": item("Q77001"), "orcid:0000-0003-5050-6060": item("Q77002")},
    ("openalex", "works"): {"doi:10.4444/moss.7": json.dumps({"results": [{"id": "https://openalex.org/W4400"}]})},
}


def lacking(spark, title="mosses of the northern forest", family="Ulme"):
    return build(
        spark,
        br=[(1, V.ARTICLE, title, "2020", 2), (2, V.ISSUE, "an issue", None, 3), (3, V.VOLUME, "a volume", None, None)],
        ra=[(1, None, "Ines" if family else None, family), (2, "Fern Press", None, None), (3, None, "Ed", "Itor")],
        ar=[(1, 1, V.AUTHOR, 1), (2, 1, V.PUBLISHER, 2), (3, 1, V.EDITOR, 3), (4, 2, V.AUTHOR, 3)],
        ids=[(1, "br", 1, "issn", "2049-3630")],
    )


def held(g, kind):
    rows = g.signatures(kind).groupBy("uri").agg(F.array_sort(F.collect_list("literal")).alias("x")).collect()
    return {r["uri"]: list(r["x"]) for r in rows}


def test_missing_identifiers_are_added_and_saved(spark, tmp_path):
    catalogues = Catalogues(EVERYTHING)
    worker = enrich.GraphEnricher(lacking(spark), single_file_storage(str(tmp_path / "g"), str(tmp_path / "p"), output_format="nt", zip_output=False), provider=catalogues, base="http://example.com/id/", checkpoint_interval=2)
    worker.enrich()
    assert worker.new_ids == 8
    assert held(worker.graph, "br") == {u("br", 1): ["10.4444/moss.7", "2049-3630", "2049-3649", "Q77001", "W4400"]}
    assert held(worker.graph, "ra") == {u("ra", 1): ["0000-0003-5050-6060", "88112233", "Q77002"], u("ra", 2): ["4141"]}
    assert worker.graph.br.count() == 3 and worker.graph.ident.select("uri").distinct().count() == 9
    assert "10.4444/moss.7" in "".join(r[0] for r in spark.read.text(str(tmp_path / "g")).collect())
    assert {r["kind"] for r in worker.provenance.collect()} == {"creation", "modification"}
    assert (tmp_path / "p").read_text().count("prov#Entity") == worker.provenance.count()
    assert ("viaf", "search", '{"title":"mosses of the northern forest","name":"Ines Ulme"}') in catalogues.asked
    # an existing identifier is asked before a new one, though its number is smaller only as a number
    assert [k for s, _, k in catalogues.asked if s == "wikidata"][:3] == ["issn:2049-3630", "issn:2049-3649", "doi:10.4444/MOSS.7"] or ("wikidata", "item", "issn:2049-3630") in catalogues.asked


@pytest.mark.parametrize("bodies, graph", [({}, {"title": "no result"}), (EVERYTHING | {("crossref", "works"): json.dumps({"message": {"items": []}}), ("crossref", "journal"): None, ("viaf", "search"): viaf(2), ("orcid", "search"): json.dumps({"result": None})}, {}), (EVERYTHING, {"title": "Unknown", "family": None})])
def test_nothing_is_added_without_answers(spark, bodies, graph):
    if graph.get("title") == "Unknown":
        bodies = {k: v for k, v in bodies.items() if k[0] not in ("crossref", "openalex")}
    before = lacking(spark, **graph)
    worker = enrich.GraphEnricher(before, None, provider=Catalogues(bodies))
    worker.enrich()
    assert worker.new_ids == 0 and held(worker.graph, "br") == held(before, "br") and held(worker.graph, "ra") == {}


def test_nothing_is_asked_where_identifiers_are_present(spark):
    ids = [(1, "br", 1, "doi", "10.4444/lichen"), (2, "br", 1, "wikidata", "Q1"), (3, "br", 1, V.OPENALEX, "W1"), (4, "ra", 1, "orcid", "o"), (5, "ra", 1, "viaf", "v"), (6, "ra", 1, "wikidata", "q"), (7, "ra", 2, "crossref", "9")]
    g = build(spark, br=[(1, V.ARTICLE, "t", "2020", None)], ra=[(1, None, "Ines", "Ulme"), (2, "P", None, None)], ar=[(1, 1, V.AUTHOR, 1), (2, 1, V.PUBLISHER, 2)], ids=ids)
    catalogues = Catalogues(EVERYTHING)
    worker = enrich.GraphEnricher(g, None, provider=catalogues)
    worker.enrich()
    assert worker.new_ids == 0 and catalogues.asked == []


def test_switches_disable_catalogues(spark):
    catalogues = Catalogues(EVERYTHING)
    worker = enrich.GraphEnricher(lacking(spark), None, provider=catalogues, use_wikidata=False, use_viaf=False, use_orcid=False)
    worker.enrich()
    assert worker.new_ids == 4 and {s for s, _, _ in catalogues.asked} == {"crossref", "openalex"}
    with pytest.raises(ValueError):
        enrich.GraphEnricher(worker.graph, None, provider=catalogues, checkpoint_interval=0)


def test_orcid_searches(spark):
    rows = [
        ("Zoë", "Müller", [(V.DOI, "10.1/aB"), (V.ISSN, "1"), (V.ISBN, "978"), (V.PMID, "5"), (V.DOI, None)], '(doi-self:"10.1/aB" OR doi-self:"10.1/ab" OR doi-self:"10.1/AB" OR isbn:"978" OR pmid-self:"5") AND (family-name:"Muller" AND given-names:"Zoe")'),
        (None, "Doe", [(V.ISSN, "1")], 'family-name:"Doe"'), ("A", None, [(V.PMID, "5")], '(pmid-self:"5")'), ("A", None, [(V.ISSN, "1")], None), ("", "Doe", [(V.PMID, "5")], '(pmid-self:"5") AND (family-name:"Doe")'),
    ]
    df = spark.createDataFrame(rows, "given string, family string, ids array<struct<scheme:string,literal:string>>, want string")
    assert [r["got"] for r in df.select(orcid_search(F.col("given"), F.col("family"), F.col("ids")).alias("got")).collect()] == [r[3] for r in rows]


def test_catalogue_urls():
    url = lookups.catalogue_url
    assert url("crossref", "journal", "0009-4722") == "https://api.crossref.org/journals/0009-4722"
    assert url("crossref", "member", "10.1/x") == "https://api.crossref.org/works/10.1/x"
    assert url("crossref", "works", "query.bibliographic=a b&rows=4") == "https://api.crossref.org/works?query.bibliographic=a b&rows=4"
    assert url("orcid", "search", '(doi-self:"10.1/a")') == "https://pub.orcid.org/v2.1/search?q=%28doi-self%3A%2210.1/a%22%29"
    assert url("orcid", "details", "0000-x") == "https://pub.orcid.org/v2.1/0000-X/personal-details"
    assert 'all+"A%20b"&query=local.names+all+"C%20d"&' in url("viaf", "search", '{"title":"A b","name":"C d"}')
    assert "p%3AP356" in url("wikidata", "item", "doi:10.1/A") and "%2210.1%2FA%22" in url("wikidata", "item", "doi:10.1/A")
    assert url("openalex", "works", "doi:10.1/a:b") == "https://api.openalex.org/works?filter=doi:10.1/a:b&select=id"
    assert url("openalex", "works", "issn:1-2") == "https://api.openalex.org/sources?filter=issn:1-2&select=id"
    with pytest.raises(ValueError):
        url("elsewhere", "x", "a:b")


class Response(io.BytesIO):
    status = 200


@pytest.mark.parametrize(
    "statuses, body, waits",
    [([503, 503, 200], "ok", [0.5, 1.0]), ([200], "ok", []), ([404], None, []), ([400], None, []), ([None, None, None], None, [0.5, 1.0]), ([429, 500, 502], None, [0.5, 1.0]), ([504, 404], None, [0.5])],
)
def test_attempts_and_waits(monkeypatch, statuses, body, waits):
    left, slept = list(statuses), []

    def fake(request, timeout):
        assert request.full_url == "http://x/a%20b" and timeout == 7
        status = left.pop(0)
        if status is None:
            raise TimeoutError
        if status != 200:
            raise urllib.error.HTTPError(request.full_url, status, "", None, None)
        return Response(b"ok")

    monkeypatch.setattr(urllib.request, "urlopen", fake)
    monkeypatch.setattr(lookups.time, "sleep", slept.append)
    assert lookups.fetch("http://x/a b", 7, wait=0.5) == body and slept == waits and left == []


def test_kept_answers_are_not_asked_again(spark, tmp_path, monkeypatch):
    """Neither are those that failed, until they expire; of one key's rows the newest counts, and one is left."""
    catalogues = Catalogues({("crossref", "member"): {"a": "A", "b": "B"}})
    kept = lookups.KeptLookups(catalogues, str(tmp_path / "kept"), expiry=100)
    ask = lambda *keys: sorted(tuple(r)[2:] for r in kept.answers(spark.createDataFrame([("crossref", "member", k) for k in keys], "source string, op string, key string")).collect())
    asked = lambda k: [key for *_, key in catalogues.asked].count(k)
    assert ask("a", "a", "x", None) == [("a", "A")]
    assert ask("a", "b", "x") == [("a", "A"), ("b", "B")]
    assert asked("a") == 1 and asked("x") == 1
    real = lookups.time.time
    monkeypatch.setattr(lookups.time, "time", lambda: real() + 200)
    catalogues.bodies["crossref", "member"]["x"] = "X"
    assert ask("x", "a") == [("a", "A"), ("x", "X")] and asked("x") == 2 and asked("a") == 1
    other = lookups.KeptLookups(catalogues, str(tmp_path / "kept"))  # another run had asked at the same time
    other.answers(spark.createDataFrame([("crossref", "member", "c")], "source string, op string, key string")).collect()
    kept.compact(spark)
    left = spark.read.parquet(str(tmp_path / "kept")).collect()
    assert sorted((r["key"], r["body"]) for r in left) == [("a", "A"), ("b", "B"), ("c", None), ("x", "X")]


def test_schemes_that_a_catalogue_does_not_know(spark, monkeypatch):
    assert lookups.catalogue_url("wikidata", "item", "isbn:1") is None and lookups.catalogue_url("openalex", "works", "viaf:1") is None
    monkeypatch.setattr(lookups, "fetch", lambda url, timeout: url)
    asked = spark.createDataFrame([("wikidata", "item", "isbn:1")], "source string, op string, key string")
    assert not lookups.HttpLookups().answers(asked).count()


def test_an_authors_resources_are_asked_in_order_until_one_answers(spark):
    g = build(
        spark, br=[(n, V.ARTICLE, f"title {n}", None, None) for n in range(1, 7)], ra=[(1, None, "Ines", "Ulme"), (2, None, "Olaf", "Ahorn")],
        ar=[(n, n, V.AUTHOR, 1) for n in range(1, 7)] + [(10 + n, n, V.AUTHOR, 2) for n in range(1, 7)], ids=[(n, "br", n, "doi", f"10.1/{n}") for n in range(1, 7)],
    )
    catalogues = Catalogues({("viaf", "search"): {json.dumps({"title": f"title {n}", "name": name}, separators=(",", ":")): viaf(1, str(n)) for n, name in ((1, "Ines Ulme"), (3, "Olaf Ahorn"), (6, "Olaf Ahorn"))}})
    authors = g.br_ar.join(g.ar, F.col("ar") == g.ar.uri).join(g.ra, F.col("held_by") == g.ra.uri).join(g.br.select(F.col("uri").alias("br"), "title"), "br").select("br", F.col("held_by").alias("agent"), F.col("given_name").alias("given"), F.col("family_name").alias("family"), "title")
    assert {(r["owner"], r["literal"]) for r in enrich.enriched_viaf(catalogues, authors).collect()} == {(u("ra", 1), "1"), (u("ra", 2), "3")}
    asked = sorted((json.loads(k)["name"], json.loads(k)["title"]) for *_, k in catalogues.asked)
    assert asked == [("Ines Ulme", "title 1"), ("Olaf Ahorn", "title 1"), ("Olaf Ahorn", "title 2"), ("Olaf Ahorn", "title 3")]


class Failing(Catalogues):
    """Catalogues that are lost after so many calls."""

    def __init__(self, bodies, calls):
        super().__init__(bodies)
        self.left = calls

    def answers(self, requests):
        self.left -= 1
        if self.left < 0:
            raise ConnectionError("lost")
        return super().answers(requests)


def test_a_run_that_was_killed_goes_on_after_its_last_batch(spark, tmp_path):
    bodies = {("crossref", "journal"): {f"0000-000{n}": json.dumps({"message": {"ISSN": [f"1000-000{n}"]}}) for n in (1, 2, 3)}}
    g = build(spark, br=[(n, V.ARTICLE, "unknown", None, None) for n in (1, 2, 3)], ids=[(n, "br", n, "issn", f"0000-000{n}") for n in (1, 2, 3)]).staged()
    more = {"base": "http://example.com/id/", "checkpoint_interval": 2, "use_wikidata": False, "use_viaf": False, "use_orcid": False}
    whole = Catalogues(bodies)
    straight = enrich.GraphEnricher(g, None, provider=whole, **more)
    straight.enrich()
    first = Failing(bodies, 4)
    with pytest.raises(ConnectionError):
        enrich.GraphEnricher(g, None, provider=first, resume_dir=str(tmp_path / "r"), **more).enrich()
    second = Catalogues(bodies)
    worker = enrich.GraphEnricher(g, None, provider=second, resume_dir=str(tmp_path / "r"), **more)
    worker.enrich()
    assert first.asked and not {k for k in first.asked if k[2].endswith("0001")} & set(second.asked) and set(first.asked) | set(second.asked) == set(whole.asked)
    rows = lambda w: sorted(map(tuple, w.graph.ident.collect())) + sorted(map(tuple, w.graph.ent_id.collect()))
    assert rows(worker) == rows(straight) and worker.new_ids == straight.new_ids == 3


def test_numbers_of_merged_identifiers_are_not_given_again(spark, tmp_path):
    g = build(spark, br=[(1, V.ARTICLE, "unknown", None, None)], ids=[(1, "br", 1, "issn", "0000-0001"), (2, "br", 1, "issn", "0000-0001")])
    storage = single_file_storage(tmp_path / "g.json", tmp_path / "p.json", info_dir=str(tmp_path / "info"))
    merged = GraphDeduplicator(g, storage)
    merged.deduplicate_identifiers()
    assert [r["uri"] for r in merged.graph.ident.collect()] == [u("id", 1)]
    bodies = {("crossref", "journal"): json.dumps({"message": {"ISSN": ["1000-0001", "1000-0002"]}})}
    worker = enrich.GraphEnricher(merged.graph, storage, provider=Catalogues(bodies), base="http://example.com/id/", use_wikidata=False, use_viaf=False, use_orcid=False)
    worker.enrich()
    assert sorted(r["uri"] for r in worker.graph.ident.collect()) == [u("id", n) for n in (1, 3, 4)]


def test_stop_words_are_read_from_a_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("the\nof \n\nthe\n")
    assert lookups.load_stop_words(spark, str(tmp_path / "words.txt")) == ["of", "the"]
