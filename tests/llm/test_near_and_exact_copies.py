"""Similarity joins, exact copies and repeated passages against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from corpora import SF, frame, odd_rows, pairs_of, read

from citeweave.llm import embedding_dedup, exact_dedup, jaccard_join, substring_dedup
from citeweave.operators.components import components
from citeweave.llm.suffix_groups import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["odd", "sf"])
def docs(spark, request):
    return frame(spark, odd_rows()) if request.param == "odd" else read(spark)


class Sets:
    """Union-find over ids."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        low, high = sorted((self.find(x), self.find(y)))
        self.up[high] = low


def shingles(text, words):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute_components(rows, words=4, share=(85, 100)):
    sets = {i: shingles(t, words) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    found = Sets()
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            common = len(s & sets[j])
            if share[1] * common >= share[0] * (len(s) + len(sets[j]) - common):
                found.join(i, j)
    return sorted((i, len(sets[i]), found.find(i)) for i, _ in rows)


def test_jaccard_components(docs):
    for words, share in ((4, (85, 100)), (5, (80, 100))):
        got = jaccard_join.similar_components(docs, words, share).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute_components(pairs_of(docs), words, share)


def test_jaccard_in_blocks_and_with_frequent_shingles(spark, monkeypatch):
    for name, value in (("BLOCK_SETS", 3), ("LIST_BLOCK", 2), ("FREQUENT", 4), ("LEAST_COUNTED", 1), ("FREQUENT_ONE_IN", 10**9), ("COUNTED_AT_ONCE", 50)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = odd_rows(8)
    got = jaccard_join.similar_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


@pytest.mark.parametrize("frequent", [4, 10**9])
def test_jaccard_group_that_leaders_do_not_close(spark, monkeypatch, frequent):
    """A drifting series of texts: neighbours link, distant ones don't, and one list holds all of them."""
    for name, value in (("BLOCK_SETS", 4), ("LIST_BLOCK", 4), ("FREQUENT", frequent), ("LEAST_COUNTED", 1), ("FREQUENT_ONE_IN", 10**9)):
        monkeypatch.setattr(jaccard_join, name, value)
    draw = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in draw.permutation(60).tolist():
        own = words[:100].copy()
        own[i % 20 * 5 : i % 20 * 5 + 1 + i // 20] = [f"x{i}"] * (1 + i // 20)
        rows.append((i, " ".join(own[: 60 + i // 4])))
    rows += [(100 + k, " ".join(words[100 + 3 * k : 140 + 3 * k])) for k in range(40)]
    got = jaccard_join.similar_components(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted(map(tuple, got)) == want and 3 < len({r[2] for r in want}) < 90


def test_one_shingle_in_all_documents(spark):
    """20,000 short documents that share their first four words and hardly link."""
    rows = [(k, f"all of these share w{k} v{k % 9973} u{k % 5003}" if k % 7 else "all of these share nothing else at all") for k in range(20_000)]
    got = jaccard_join.similar_components(frame(spark, rows)).collect()
    assert len(got) == 20_000 and all(r["component_id"] == (r["doc_id"] if r["doc_id"] % 7 else 0) for r in got)


def test_words_that_fool_polynomial_hashes():
    """The parity sequence and its complement have equal values under any polynomial modulo a power of two."""
    for length in (8, 64, 128, 1024, 2048, 4096):
        parity = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
        texts = [parity, parity.translate(str.maketrans("ab", "ba")), parity[:-1], parity + "a", "a" * length, "a" * (length + 1)]
        found = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
        assert all(len(s) == 1 for s in found) and len({s[0] for s in found}) == len(texts)


def test_near_copies_of_long_texts_in_bounded_blocks():
    """A block pair is bounded by shingles; joining one stays within a few hundred bytes a shingle."""
    import tracemalloc

    draw = np.random.default_rng(3)
    base = draw.integers(1 << 62, size=16_000, dtype=np.uint64)
    sets = [np.unique(np.where(draw.random(len(base)) < 0.01, draw.integers(1 << 62, size=len(base), dtype=np.uint64), base)) for _ in range(2 * jaccard_join.BLOCK_SHINGLES // len(base))]
    tracemalloc.start()
    low = jaccard_join.join_group(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (low == 0).all() and peak < 200 * 2 * jaccard_join.BLOCK_SHINGLES


def test_join_group_against_all_pairs():
    draw = np.random.default_rng(4)
    for _ in range(60):
        base = [draw.choice(60, draw.integers(1, 25), replace=False) for _ in range(4)]
        sets = []
        for _ in range(30):
            s = set(base[draw.integers(4)].tolist())
            for _ in range(draw.integers(0, 4)):
                s ^= {int(draw.integers(60))}
            sets.append(np.array(sorted(s), np.uint64))
        found = Sets()
        for a in range(30):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if len(sets[a]) and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    found.join(a, b)
        assert [found.find(k) for k in range(30)] == jaccard_join.join_group(sets).tolist()


def test_jaccard_odd_ids_and_empty_table(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (2, "a b c d e"), (None, None)]
    got = jaccard_join.similar_components(frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, 2, None), (5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 0, None)]))
    assert jaccard_join.similar_components(frame(spark, rows).limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 500), (300, 301)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(k, 0) for k in range(101)] + [(300, 300), (301, 300)]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key])[1]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup(docs):
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == brute_exact(pairs_of(docs))


def test_exact_dedup_by_small_blocks_and_colliding_fingerprints(spark):
    from pyspark.sql import functions as F

    rows = odd_rows(5)
    colliding = lambda data: (F.octet_length(data).cast("long"), F.lit(0).cast("long"))
    got = exact_dedup.exact_dedup(frame(spark, rows), block_bytes=4001, marks=colliding).collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)
    got = exact_dedup.exact_dedup(frame(spark, rows), block_bytes=7).collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)


def test_exact_dedup_without_ids_where_fingerprints_collide(spark):
    from pyspark.sql import functions as F

    constant = lambda data: (F.lit(1).cast("long"), F.lit(2).cast("long"))
    rows = [(None, "aa"), (None, "bb"), (7, "b b"), (8, "cc")]
    got = exact_dedup.exact_dedup(frame(spark, rows), marks=constant).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, None, 1, True), (None, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)]))


def test_exact_dedup_repeated_rows_and_sql(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab"), (3, None), (4, "")])).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, 4, True), (1, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 2, True), (4, 3, 2, False)]))
    assert exact_dedup.exact_dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    theirs = db.sql(exact_dedup.EXACT_DEDUP_SQL).df()[names]
    assert sorted(map(tuple, exact_dedup.exact_dedup(read(spark)).select(names).collect())) == sorted(map(tuple, theirs.itertuples(index=False)))


def brute_passages(rows, window=50):
    first = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, d in data:
        for k in range(len(d) - window + 1):
            first.setdefault(d[k : k + window], i)
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if first[d[k : k + window]] < i:
                gone[k : k + window] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_passages(docs):
    got = substring_dedup.repeated_passages(docs).collect()
    want = brute_passages(pairs_of(docs))
    assert sorted(map(tuple, got)) == want and any(r[2] for r in want)


def test_repeated_passages_odd_ids_and_empty_table(spark):
    long = "The same sentence stands in all of these documents, word for word. " * 3
    rows = [(None, long), (4, long), (4, "x" + long), (2, "start " + long), (9, long[:60] + "#" + long[70:])]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got[None, len(long)] == 0 and got[2, len(long) + 6] == 0
    assert got[4, len(long)] == len(long) and got[4, len(long) + 1] == len(long) and got[9, len(long)  - 9] == len(long) - 10
    assert substring_dedup.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def test_anchor_with_more_fragments_than_a_block_holds(spark, monkeypatch):
    """Every document runs on into its own text, so one anchor has as many different fragments as there are documents."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 400)
    draw = np.random.default_rng(8)
    own = lambda: "".join(draw.choice(list("abcdefgh "), draw.integers(20, 60)))
    passage, other = "".join(draw.choice(list("stuvwxyz"), 70)), "".join(draw.choice(list("klmnopq"), 55))
    rows = [(int(i), own() + passage + own() + (other if i % 3 else passage[:58]) + own()) for i in draw.permutation(80)]
    rows += [(3, rows[5][1]), (None, passage)]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    want = brute_passages(r for r in rows if r[0] is not None)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want and sum(r[2] > 0 for r in want) > 70
    code, length = draw.integers(3, size=500), draw.integers(50, 76, size=500)
    block = substring_dedup._blocks(code, length, 400)
    assert (block > 0).all() and np.bincount(block, length).max() < 400 + 76


@pytest.mark.parametrize("hot", [2, 10**9])
def test_passages_of_hot_anchors_and_long_texts(spark, monkeypatch, hot):
    """Texts scanned in parts, and anchors that many hold dealt out by their fragments, lose the same bytes."""
    for name, value in (("HOT", hot), ("SCAN_BYTES", 500), ("BLOCK_BYTES", 300)):
        monkeypatch.setattr(substring_dedup, name, value)
    draw = np.random.default_rng(9)
    own = lambda n: "".join(draw.choice(list("abcdefgh é"), n))
    passage, long = own(130), own(2500)
    rows = [(int(i), own(draw.integers(0, 40)) + passage[draw.integers(20) :] + own(30)) for i in draw.permutation(60)]
    rows += [(100, long), (101, own(700) + long[300:1900] + own(40)), (102, "ab" * 900), (103, "b" + "ab" * 400), (3, long[:80]), (-5, passage)]
    want = brute_passages([r for r in rows if r[0] != 3])
    got = substring_dedup.repeated_passages(frame(spark, [r for r in rows if r[0] != 3])).collect()
    assert sorted(map(tuple, got)) == want and sum(r[2] > 0 for r in want) > 60


def test_suffix_array_against_sorting():
    draw = np.random.default_rng(2)
    for _ in range(300):
        s = draw.integers(0, draw.integers(1, 6), draw.integers(0, 60)).tolist()
        assert suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


def brute_links(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    found = Sets()
    for a, b in zip(*np.nonzero(close), strict=True):
        found.join(ids[a], ids[b])
    return dict(zip(ids, close.sum(1).tolist(), strict=True)), {i: found.find(i) for i in ids}


def test_embeddings_recall_and_no_false_links(spark):
    """The table's vectors with copies of some, disturbed up to and beyond the threshold."""
    rows = read(spark, "embeddings").select("vec_id", "embedding").toPandas()
    draw = np.random.default_rng(6)
    table = np.array(rows["embedding"].tolist(), float)
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    noise = draw.normal(size=(300, unit.shape[1])) / unit.shape[1] ** 0.5
    copies = unit[draw.integers(100, size=300)] + noise * draw.uniform(0, 0.45, size=(300, 1))
    x = np.concatenate([unit, copies])
    ids = list(range(len(x)))
    counts, group = brute_links(ids, x)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(x) and all(r["n_links"] <= counts[r["vec_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(counts.values()) > 0
    assert all(group[r["component_id"]] == group[r["vec_id"]] and r["component_id"] <= r["vec_id"] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_just_above_the_threshold(spark):
    """Recall of pairs between cosine 0.95 and 0.96."""
    draw = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(draw.normal(size=(2000, 64)))
    apart = draw.normal(size=base.shape)
    apart = unit(apart - (apart * base).sum(1, keepdims=True) * base)
    cosine = draw.uniform(0.951, 0.96, size=(len(base), 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * apart])
    counts, _ = brute_links(list(range(len(x))), x)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] <= counts[r["vec_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(counts.values()) >= 0.99 * 4000


def test_equal_embeddings_are_counted_not_compared(spark):
    """50,000 equal vectors, a few near them and others: exact counts."""
    draw = np.random.default_rng(2)
    base = draw.normal(size=16)
    near = base + 0.02 * draw.normal(size=(3, 16))
    rows = [(k, base.tolist()) for k in range(50_000)] + [(60_000 + k, v.tolist()) for k, v in enumerate(near)] + [(70_000 + k, draw.normal(size=16).tolist()) for k in range(50)]
    rows += [(80_000, [0.0] * 16), (80_001, [0.0] * 16)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and all(got[k]["n_links"] == 50_002 and got[k]["component_id"] == 0 for k in [*range(0, 50_000, 997), 60_000, 60_002])
    assert got[80_000]["n_links"] == got[80_001]["n_links"] == 0 and got[80_001]["kept"]


def test_embeddings_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    draw = np.random.default_rng(1)
    base = draw.normal(size=(20, 8))
    x = base[draw.integers(20, size=120)] + 0.08 * draw.normal(size=(120, 8))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    counts, group = brute_links(list(range(120)), x)
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [1.0, None] + [0.0] * 6, 0), (203, [float("nan")] * 8, 1), (204, [float("inf")] + [0.0] * 7, 1), (205, [], 1), (206, [1e300] * 8, 1), (207, [1e-300] * 8, None), (208, [2.0], 0), (None, [1.0] * 8, 0)]
    kind = "vec_id long, embedding array<double>, component_id int"
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, kind)).collect()}
    assert len(got) == 130
    mine = [got[k] for k in range(120)]
    assert all(r["n_links"] <= counts[r["vec_id"]] for r in mine) and sum(r["n_links"] for r in mine) >= 0.9 * sum(counts.values())
    assert all(group[r["component_id"]] == group[r["vec_id"]] for r in mine)
    assert [got[k]["n_links"] for k in (200, 201, 202, 203, 204, 205)] == [0] * 6
    assert got[206]["n_links"] == got[207]["n_links"] == 1 and got[207]["component_id"] == 206 and got[None]["n_links"] == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    only_odd = embedding_dedup.near_duplicates(spark.createDataFrame(odd[:3], kind)).collect()
    assert all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in only_odd)


@pytest.mark.parametrize("n, noise, shift", [(2, 0.0, 0.0), (90, 0.1, 0.0), (90, 0.6, 1.5)])
def test_embeddings_with_few_pivots_apart(spark, monkeypatch, n, noise, shift):
    """Two equal vectors, near copies only, and vectors in a narrow cone, all close to the first pivot."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(4)
    x = draw.normal(size=8) + shift + noise * draw.normal(size=(n, 8))
    counts, group = brute_links(list(range(n)), x)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == counts and any(counts.values())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and group[r["component_id"]] == group[r["vec_id"]] for r in got)
    assert sum(r["kept"] for r in got) == len(set(group.values()))
