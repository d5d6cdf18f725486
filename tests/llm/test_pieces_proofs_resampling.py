"""Piece encoding against the library, Merkle proofs and importance resampling against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF, canonical
from corpora import SCHEMA, frame, odd_rows, pairs_of, read

from citeweave.llm import importance_resampling as R
from citeweave.llm import merkle, piece_codec, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected_pieces(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True


def test_pieces_of_whole_documents_and_odd_rows(spark, library):
    rows = [(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees)) for r in queries.op11_sentencepiece(spark, SF).collect()]
    assert sorted(rows) == sorted((i, expected_pieces(library, t)) for i, t in pairs_of(read(spark)))
    odd = odd_rows() + [(9001, "a▁b  c\n\r ▁"), (9002, "<s> </s> <0x0A> <unk>"), (9003, "word " * 90_000), (9003, "word " * 90_000), (9004, " ")]
    got = [(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees)) for r in piece_codec.piece_digests(frame(spark, odd), MODEL).collect()]
    assert sorted(got) == sorted((i, expected_pieces(library, t)) for i, t in odd)
    assert not piece_codec.piece_digests(frame(spark, []), MODEL).count()


def test_pieces_of_random_texts(library):
    """Words are cut where no merge crosses, whatever stands next to each other, and whatever is remembered."""
    draw, codec = random.Random(5), piece_codec.PieceCodec(open(MODEL, "rb").read())
    parts = [" ", "  ", "▁", "a", "the", "ing", " the", "\n", "\t", "é", "́", "😀", "梦", "\x00", "<s>", "<0x41>", "x" * 30, " " * 9, ".", "...", "--", "(", "12", "'", "ß", "ş"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 40))) for _ in range(6000)]
    assert list(codec.digests(texts)) == [expected_pieces(library, t) for t in texts]
    assert [codec.encode(t) for t in texts[:500]] == library.encode(texts[:500])
    codec.memo_bytes = piece_codec.MEMO_BYTES + 1
    assert list(codec.digests(texts[:50])) == [expected_pieces(library, t) for t in texts[:50]]


def test_pieces_round_trip(spark, library):
    encoded = piece_codec.encode_pieces(frame(spark, odd_rows()), MODEL)
    decoded = {(r.doc_id, r.text) for r in piece_codec.decode_pieces(encoded, MODEL).collect()}
    assert decoded == {(i, library.decode(library.encode(t or ""))) for i, t in odd_rows()}


def test_other_vocabularies_are_refused():
    whole = open(MODEL, "rb").read()
    with pytest.raises(ValueError, match="merge type"):
        piece_codec.PieceCodec(whole + bytes([0x12, 2, 3 << 3, 1]))  # a trainer of the unigram type
    with pytest.raises(ValueError, match="normaliser"):
        piece_codec.PieceCodec(whole + bytes([0x1A, 4, 2 << 3 | 2, 2, 1, 1]))  # a table of replacements


def test_differing_words_are_told(library):
    codec = piece_codec.PieceCodec(open(MODEL, "rb").read())
    codec.pair_rank[:] = piece_codec.NO_PIECE
    assert [f[3] for f in codec.digests(["the other", "", "\n"])] == [False, True, True]


def test_agendas_of_many_words_and_of_one_agree():
    draw, codec = random.Random(6), piece_codec.PieceCodec(open(MODEL, "rb").read())
    words = ["".join(draw.choices("▁thearoinsz'.é梦\n", k=draw.randrange(1, 30))) for _ in range(5000)]
    assert codec.all_word_ids(words) == [codec.word_ids(w) for w in words]


def brute_manifest(rows):
    """doc_id -> (leaf, subroot, root, proof, folded root, verified) of unique ids."""
    joined = lambda digests: sha("".join(digests))
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def tree(nodes):
        """The root, and for each leaf the (place, members) of its runs on the way up."""
        steps = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
            for leaf, place in enumerate(at):
                steps[leaf].append((place % 16, runs[place // 16]))
                at[leaf] = place // 16
            nodes = [joined(run) for run in runs]
        return nodes[0], steps

    def fold(leaf, steps):
        for place, members in steps:
            leaf = joined([*members[:place], leaf, *members[place + 1 :]])
        return leaf

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    below, subroots = {}, []
    for source in sources:
        held = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0]))
        root, steps = tree([sha("".join(map(said, r))) for r in held])
        subroots.append(root)
        below[source] = list(zip(held, steps, strict=True))
    root, above = tree(subroots)
    out = []
    for source, subroot, high in zip(sources, subroots, above, strict=True):
        for row, steps in below[source]:
            path = steps + high
            proof = sha("".join(d for place, members in path for d in members[:place] + members[place + 1 :]))
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            given = [*row[:4], row[4].translate(upper)] if tampered else row
            folded = fold(sha("".join(map(said, given))), path)
            out.append((row[0], sha("".join(map(said, row))), subroot, root, proof, folded, folded == root))
    return out


def manifest_rows(df):
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()]


def test_manifest_matches_the_plain_one(spark, duck):
    """More than 16 sources, sources of one leaf and of many levels, nulls in every column."""
    draw = random.Random(2)
    rows = [(k, draw.choice([None, "", "b", "B", "é", "hot", "hot", *"cdefghijklmnopqrst"]), draw.choice([None, "en"]), draw.choice([None, k]), draw.choice([None, "", "Abc é", "x"])) for k in range(900)]
    rows += [(1000 + k, "hot", None, None, f"T{k}") for k in range(300)] + [(5000, "lone", None, None, "AB"), (None, "lonely", None, None, "AB")]
    df = spark.createDataFrame([(*r, "z", 1, 1, "t", "p", True) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, n int, leaf string, path string, root boolean").repartition(5)
    assert sorted(manifest_rows(merkle.verified_manifest(df)), key=repr) == sorted(brute_manifest(rows), key=repr)
    ours, theirs = queries.op12_merkle_manifest(spark, SF).toPandas(), duck.sql(merkle.MERKLE_SQL).df()
    assert canonical(ours, sorted(ours)).equals(canonical(theirs, sorted(ours)))


def test_manifest_of_few_and_repeated_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert not manifest_rows(merkle.verified_manifest(df([])))
    one = [(7, "s", "en", 3, "Abc")]
    assert manifest_rows(merkle.verified_manifest(df(one))) == brute_manifest(one)
    found = manifest_rows(merkle.verified_manifest(df([(1, None, None, None, "same")] * 40 + one)))
    assert len(found) == 41 and len({r[1] for r in found}) == 2 and all(r[6] for r in found if r[0] == 1)


def brute_resampling(rows, target):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = pattern.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for f in found for b in f[2]), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10_000.0)) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for i, n, buckets in found:
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(eligible[: len(eligible) * 5 // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resampled_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_resampling_matches_the_plain_one(spark, duck):
    target = [r["text"] for r in read(spark, "benchmark").collect()]
    assert resampled_rows(queries.op13_importance_resampling(spark, SF)) == brute_resampling(pairs_of(read(spark)), target)
    ours, theirs = queries.op13_importance_resampling(spark, SF).toPandas(), duck.sql(R.RESAMPLING_SQL).df()
    for f in (ours, theirs):
        f["rank"] = f["rank"].astype("Int64")
    assert canonical(ours, sorted(ours)).equals(canonical(theirs, sorted(ours)))


def test_resampling_of_odd_rows(spark):
    odd = [(i, t) for i, t in odd_rows()] + [(None, "no id at all " * 9), (8000, "É" * 3000 + " ÀB'c\x7f{d}[e]"), (8001, "ab " * 400_000)]
    odd = list({i: (i, t) for i, t in odd}.values())
    target = spark.createDataFrame([("x w1 w2 W3",), (None,), ("",)], "text string")
    assert resampled_rows(R.resampled(frame(spark, odd), target)) == brute_resampling(odd, ["x w1 w2 W3", None, ""])
    assert resampled_rows(R.resampled(frame(spark, odd), target.limit(0))) == brute_resampling(odd, [])
    assert not R.resampled(spark.createDataFrame([], SCHEMA), target).count()
    twice = R.resampled(frame(spark, [(1, "word " * 30)] * 100), target)
    assert sorted(r["rank"] for r in twice.collect() if r["rank"]) == [1, 2, 3, 4, 5]


def test_composed_crcs():
    draw = random.Random(4)
    words = [bytes(draw.randrange(256) for _ in range(draw.choice([1, 2, 7, 31, 300, 70_000]))) for _ in range(60)]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    lengths = np.array([len(w) for w in words])
    assert R.joined_crc(crc[:-1], crc[1:], lengths[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:], strict=False)]
    data = np.frombuffer(b"".join(words), np.uint8)
    assert R.word_crcs(data, np.cumsum(lengths) - lengths, lengths).tolist() == crc.tolist()
