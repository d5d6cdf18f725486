"""Learned operators on held-out rows, tokenizers and packing against the libraries, personal data by plain patterns."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from corpora import frame, odd_rows, pairs_of, read
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeweave.llm import bpe, language_id, packing, pii, quality, toxicity

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(params=["odd", "sf"])
def docs(spark, request):
    return frame(spark, odd_rows()) if request.param == "odd" else read(spark)


# language


class PlainModel:
    """Prediction by partial matching over dictionaries, for comparison: counts, escapes and exclusion as they stand."""

    def __init__(self, texts, known, contexts):
        self.counts = defaultdict(lambda: defaultdict(int))
        self.known, self.contexts = known, contexts
        for t in texts:
            padded = bytes(language_id.ORDER) + t
            for at in range(language_id.ORDER, len(padded)):
                for order in range(language_id.ORDER + 1):
                    self.counts[padded[at - order : at]][padded[at]] += 1

    def probability(self, context, byte):
        if not context and not self.counts[b""]:
            return 1 / 256
        below = self.probability if context else (lambda _, b: 1 / 256)
        if context and context not in self.contexts[len(context)]:
            return below(context[1:], byte)
        seen = self.counts[context]
        if not seen:
            return below(context[1:], byte)
        total, kinds = sum(seen.values()), len(seen)
        left = 1 - sum(below(context[1:], b) for b in seen)
        escape = 0 if left <= 1e-12 else kinds / (total + kinds)
        if byte in seen:
            return seen[byte] / total * (1 - escape)
        return escape * below(context[1:], byte) / left


def test_code_lengths_against_dictionaries(spark):
    texts = {"a": ["abab abba abab ba ab", "baab abab"], "b": ["bcb cbc bcbc cc", "cab bca"], "c": ["été naïve été"]}
    rows = [(k * 10 + j, t, lang) for k, (lang, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    trees = language_id.ContextTrees(language_id.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    seen = [defaultdict(int) for _ in range(language_id.ORDER + 1)]
    for ts in texts.values():
        for t in ts:
            padded = bytes(language_id.ORDER) + t.encode()
            for at in range(language_id.ORDER, len(padded)):
                for order in range(1, language_id.ORDER + 1):
                    seen[order][padded[at - order : at]] += 1
    kept = [{c for c, n in s.items() if n >= language_id.LEAST_CONTEXT} for s in seen]
    for data in (b"abab", b"zz top", "été abc".encode(), b"b"):
        want = []
        for lang in trees.languages:
            model = PlainModel([t.encode() for t in texts[lang]], None, kept)
            padded = bytes(language_id.ORDER) + data
            cost = 0.0
            for at in range(language_id.ORDER, len(padded)):
                order = language_id.ORDER
                while order and not all(padded[at - k : at] in kept[k] for k in range(1, order + 1)):
                    order -= 1
                cost -= math.log(model.probability(padded[at - order : at], padded[at]))
            want.append(cost)
        assert trees.text_costs([data])[0] == pytest.approx(want, rel=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = read(spark, sf=SF)
    found = language_id.language_predictions(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(found) == docs.count()
    letters = found["text"].fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert (found["lang_pred"][~letters] == "und").all() and found["score"].between(0, 1).all()
    test = found[found["held_out"] & letters & found["lang"].notna()]
    assert len(test) > 50 and (test["lang"] == test["lang_pred"]).mean() > 0.95


def test_language_of_odd_documents(spark):
    grams = language_id.gram_counts(spark.createDataFrame([(1, "hello there my friend", "en"), (2, "bonjour mon ami", "fr"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    got = language_id.identify(frame(spark, [(1, None), (2, ""), (3, "12 34"), (None, "hello friend"), (5, "bonjour ami"), (5, "bonjour ami")]), grams).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("5", "fr"), ("5", "fr"), ("None", "en")]
    nothing = language_id.language_predictions(frame(spark, odd_rows()))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.language_predictions(frame(spark, odd_rows()).limit(0)).count() == 0


def test_long_texts_are_charged_in_pieces(monkeypatch):
    grams = pd.DataFrame({"lang": ["a", "b"] * 40, "gram": [k * 7919 % 2**32 for k in range(80)], "n": [3] * 80})
    trees, data = language_id.ContextTrees(grams), bytes(range(7, 250)) * 5
    whole = trees.text_costs([data, b"x"])
    monkeypatch.setattr(language_id, "BYTES_AT_ONCE", 100)
    assert trees.text_costs([data, b"x"]) == pytest.approx(whole, rel=1e-4)


# classifiers


@pytest.mark.parametrize("scores, label, least", [(quality.quality_scores, "quality", 0.9), (toxicity.toxicity_scores, "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, scores, label, least):
    docs, labels = read(spark, sf=LARGE), read(spark, "labels", LARGE)
    found = scores(docs, labels).join(labels, "doc_id").toPandas()
    test = found[found["held_out"] & found[label].notna()]
    good, bad = (test["score"][test[label] == v].to_numpy() for v in (1, 0))
    assert len(good) and len(bad)
    ranked = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)
    assert ranked > least and (test["predicted"] == test[label]).mean() > least
    assert found["score"].between(0, 1).all()


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_odd_rows(spark, scores, label):
    docs = frame(spark, [*odd_rows(), (None, "w1"), (77, "again"), (77, "again")])
    for rows in ([], [(1, None), (None, 1), (10**9, 1)], [(i, 1) for i, _ in odd_rows()], [(i, i % 2) for i, _ in odd_rows()] + [(14, 0), (14, 1)]):
        got = scores(docs, spark.createDataFrame(rows, f"doc_id long, {label} int")).collect()
        assert len(got) == len(odd_rows()) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert scores(docs.limit(0), spark.createDataFrame([], f"doc_id long, {label} int")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound", [toxicity.MOVE_BYTES, 2000])
def test_automaton_against_edit_distance(monkeypatch, bound):
    monkeypatch.setattr(toxicity, "MOVE_BYTES", bound)
    draw = np.random.default_rng(9)
    terms = [("".join(draw.choice(list("abc"), draw.integers(3, 8))), int(draw.integers(0, 3))) for _ in range(12)]
    terms = list(dict(terms).items())
    automaton = toxicity.LexiconAutomaton([(t, False, k) for t, k in terms] + [("zab", True, 0)])
    for _ in range(500):
        word = "".join(draw.choice(list("abcz"), draw.integers(1, 9)))
        want = min((d for t, k in terms if (d := edits(word, t)) <= k), default=None)
        assert automaton.match(word) == (0 if word.startswith("zab") else want)
    assert automaton.held < bound + 100 * toxicity.PAIR_BYTES


def test_quotation_is_told_from_abuse():
    scanner = toxicity.Scanner([("blargface", False, 1)], frozenset({(-1, "word"), (-1, "called"), (-2, "called"), (3, "slur")}))
    abuse, near, quoted = (scanner.features(t) for t in ("you are a blargface , go away", "you are a blargfacs , go away", 'she said "blargface" is a word'))
    assert abuse[1] > 0 and near[2] > 0 and quoted[1] == 0 and quoted[3] > 0
    assert not any(scanner.features("nothing of the kind")[:4]) and not any(scanner.features("")[:4])
    for text in ("every word you utter blargface", "you don’t get it blargface, it isn’t hard", "a 'fine' blargface and a 'real' one", "“yes” you blargface “no”", "one word. You blargface", "blargface word", "a slur blargface"):
        assert scanner.features(text)[1] > 0 and scanner.features(text)[3] == 0, text
    for text in ("the word blargface hurts", "they wrote “you are a blargface” on the wall", "«quel blargface !»", "blargface is a slur", "He called me blargface", "a ‘blargface’ don’t help"):
        assert scanner.features(text)[1] == 0 and scanner.features(text)[3] > 0, text


def test_cue_words_are_learned_from_labels(spark):
    """Cues are words near quoted terms in clean documents; not words of abuse too, nor words of one copied document."""
    draw = np.random.default_rng(8)
    common = ["".join(draw.choice(list("abcdefghij"), draw.integers(3, 8))) for _ in range(200)]
    bad = ["zorkles", "wumpling", "quibberish"]
    rows, marks = [], []
    for k in range(4000):
        words, term, toxic = draw.choice(common, 15).tolist(), bad[k // 10 % 3], k % 10 == 0
        words[10 + k % 2] = ["said", "begone"][k % 2]
        if toxic:
            words[4:6] = ["said", term] if k % 20 else ["begone", term]
        elif k % 200 in (7, 33):
            words[4:8] = ["utterance", "of", term, "reportedly"]
        elif k % 400 == 51:
            words[4:6] = ["said", term]
        elif k % 500 == 77:
            words = ["plonk", "zorkles", *common[:12], "begone"]
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    asked = ["it was an utterance of wumpling again", "quibberish reportedly hurts", "he said wumpling", "wumpling utterance", "plonk zorkles go"]
    docs = frame(spark, rows + [(10_000 + k, t) for k, t in enumerate(asked)])
    lexicon, cues, _ = toxicity.learn(docs, labels)
    assert {t for t, stem, _ in lexicon if not stem} == set(bad)
    assert {(-2, "utterance"), (1, "reportedly")} <= cues and not {(-1, "said"), (1, "utterance"), (-1, "plonk")} & cues
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert [got[10_000 + k] for k in range(4)] == [0, 0, 1, 1]
    assert all(got[k] == toxic for k, toxic in marks if k % 10 == 0 or k % 200 in (7, 33))


def test_hits_are_counted_by_tokens():
    scanner = toxicity.Scanner([("hate", False, 0)])
    assert scanner.features("hate whatever whatever whatever whatever")[1] == np.log1p(1)
    assert scanner.features("hate, hate hated hate")[1] == np.log1p(3)


def plain_hits(text, lexicon):
    """Unquoted hits by edit distances against every term; for words of letters only."""
    found = 0
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        found += len(word) >= toxicity.SHORTEST and any(word.startswith(t) if stem else edits(word, t) <= k for t, stem, k in lexicon)
    return found


def test_toxicity_query_against_brute_force(spark):
    """The whole query on a small table: the lexicon's counts by dictionaries, hits by edit distances, the same weights."""
    draw = np.random.default_rng(5)
    common = ["".join(draw.choice(list("abcdefghij"), draw.integers(3, 8))) for _ in range(60)]
    bad = ["zorkles", "wumpling", "quibberish"]
    rows, marks = [], []
    for k in range(400):
        words = draw.choice(common, 12).tolist()
        if toxic := k % 4 == 0:
            words[3] = bad[k // 4 % 3]
            words[7] = bad[(k // 4 + 1) % 3]
        if k % 20 == 0:
            words[7] = words[7][:4] + words[7][5:]
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = frame(spark, rows)
    lexicon, cues, weights = toxicity.learn(docs, labels)
    assert not cues
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    counts = defaultdict(lambda: [0, 0])
    for (k, text), (_, toxic) in zip(rows, marks, strict=True):
        if k not in held:
            for word in set(text.split()):
                counts[word][toxic] += 1
    n = [sum(t == v for k, t in marks if k not in held) for v in (0, 1)]
    telling = {w for w, (c, t) in counts.items() if len(w) >= 4 and t >= 4 and math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) >= 3.5}
    assert {t for t, stem, _ in lexicon if not stem} == telling and set(bad) <= telling
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for k, text in rows:
        hits = plain_hits(text, lexicon)
        near = sum(not any(w.startswith(t) if stem else w == t for t, stem, _ in lexicon) for w in text.split() if plain_hits(w, lexicon))
        x = [float(hits > 0), np.log1p(hits), np.log1p(near), 0.0, min(1.0, 20 * hits / 12)]
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1]))), rel=1e-9) and got[k]["held_out"] == (k in held)
        assert got[k]["predicted"] == marks[k][1] == (got[k]["score"] >= 0.3)


def test_misspelled_rare_terms_are_found(spark):
    """An insult in one abusive document of fifty allows edits as well as a common one."""
    draw = np.random.default_rng(6)
    common = ["".join(draw.choice(list("abcdefghij"), draw.integers(3, 8))) for _ in range(200)]
    rows, marks = [], []
    for k in range(3000):
        words = draw.choice(common, 15).tolist()
        if k % 5 == 0:
            words[2] = "snorkwad" if k % 250 == 0 else "blargface"
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 5 == 0)))
    lexicon, _, _ = toxicity.learn(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {(t, k) for t, stem, k in lexicon if not stem} == {("snorkwad", 1), ("blargface", 1)}
    scanner = toxicity.Scanner(lexicon)
    assert all(scanner.features(f"you utter {w} go")[1] > 0 for w in ("snorkwad", "snorkwod", "snorkwadd", "sorkwad", "blargfacs"))


def test_ranking_against_plain_gradients_on_all_pairs():
    """On a tiny table the learned order is that of plain gradient descent over every preference pair."""
    draw = np.random.default_rng(2)
    good = np.arange(40) % 2 == 0
    x = draw.normal(size=(40, 3)) + np.where(good, 1.0, -0.4)[:, None] * [1.5, -0.8, 0.0]
    ranking = quality.fit(x, good)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    pairs = np.array([a - b for a in z[good] for b in z[~good]])
    w = np.zeros(3)
    for _ in range(20_000):
        w -= 0.05 * (-(1 / (1 + np.exp(pairs @ w))) @ pairs / len(pairs) + quality.DECAY * w)
    assert np.dot(w, ranking.weights) / np.linalg.norm(w) / np.linalg.norm(ranking.weights) > 0.98
    scores = ranking.scores(x)
    assert np.corrcoef(np.argsort(np.argsort(scores)), np.argsort(np.argsort(z @ w)))[0, 1] > 0.98
    assert ((scores >= quality.ACCEPT) == good).mean() > 0.85


def test_ranking_learns_from_all_labels(spark):
    """More labelled documents than any bound of a sample: the ranking is that of all rows outside the held-out fold."""
    texts = [(k, f"Word{k % 7} " * (1 + k % 5) + ("!" * (k % 3) if k % 2 else "and some more words.")) for k in range(9500)]
    marks = [(k, int((k % 2 == 0) != (k % 11 == 0))) for k in range(9500)]
    chosen = [k for k in range(9500) if zlib.crc32(str(k).encode()) % 3 != 1]
    want = quality.fit(np.array([quality.features(texts[k][1]) for k in chosen]), np.array([marks[k][1] == 1 for k in chosen]))
    found = quality.learn(frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(chosen) > 6000 and found.middle == pytest.approx(want.middle) and found.weights == pytest.approx(want.weights, abs=1e-4) and found.cut == pytest.approx(want.cut, abs=1e-3)


# byte-level BPE


def test_encoding_against_tiktoken(docs):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = pairs_of(docs)
    want = []
    for i, t in texts:
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for spaced in (True, False):
        assert sorted(map(tuple, bpe.encoding_digests(docs, RANKS, public_tokenizers.PATTERN, spaced=spaced).collect())) == sorted(want)
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r[0], bytes(r[1])) for r in back) == sorted((i, (t or "").encode()) for i, t in texts)


@pytest.mark.parametrize("spaced, bound", [(False, 0), (True, 0), (True, bpe.MEMO_BYTES)])
def test_encoding_of_odd_text(monkeypatch, spaced, bound):
    monkeypatch.setattr(bpe, "MEMO_BYTES", bound)
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, spaced)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    draw = np.random.default_rng(3)
    marks = list("aZé 	\n\r'’s0123.,!?　 漢字😀\x00\x1ćß<|>_-") + ["  ", " the", "n't", "<|endoftext|>", "▁", "ĠĊ"]
    texts = ["".join(draw.choice(marks, draw.integers(0, 30))) for _ in range(2000)]
    for text, (n, ids, decoded) in zip(texts, codec.digests(texts), strict=True):
        want = whole.encode_ordinary(text)
        assert codec.encode(text) == want and n == len(want)
        assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and decoded == hashlib.sha256(text.encode()).hexdigest()


def test_patterns_that_do_not_join_spaces():
    """Each match is encoded on its own by any pattern, also one by which a space stands alone."""
    ranks = bpe.read_ranks(RANKS)
    codec, whole = bpe.Codec(ranks, r"\S+|\s"), tiktoken.Encoding("own", pat_str=r"\S+|\s", mergeable_ranks=ranks, special_tokens={})
    for text in ("the cat sat", " on the  mat ", ""):
        want = ",".join(map(str, whole.encode_ordinary(text)))
        assert next(codec.digests([text]))[1] == hashlib.sha256(want.encode()).hexdigest()


def test_memory_of_remembered_words_is_bounded(monkeypatch):
    """By bytes, and words that are too long aren't remembered."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 200_000)
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, True)
    for k in range(20):
        list(codec.digests([" ".join(f"w{k}x{i}" for i in range(200))]))
        assert 0 < codec.held < 200_000 + 200 * 400
    held = codec.held
    list(codec.digests([f"long {k}" + "ab" * 10_000 for k in range(5)]))
    assert codec.held <= held and all(len(w) <= bpe.LONGEST_WORD for w in codec.memo)


# packing


PLAIN = Tokenizer.from_file(WORDS)


def plain_ids(texts):
    return [[*PLAIN.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check_packing(rows, pieces, sequence):
    ids_of = defaultdict(list)
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        ids_of[i].append(ids)
    owned, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        (ids,) = ids_of[p["doc_id"]]
        part = ids[p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids) and len(part) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        owned[p["doc_id"]].append((p["start"], p["length"]))
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, (ids,) in ids_of.items():
        own = sorted(owned[i])
        assert own[0][0] == 0 and sum(own[-1]) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    lengths = []
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence
        lengths.append(at)
    return lengths


def test_packing(docs):
    rows = pairs_of(docs)
    check_packing(rows, packing.packed_documents(docs, WORDS).collect(), 4096)
    check_packing(rows, packing.packed_documents(docs, WORDS, sequence=1000).collect(), 1000)


def test_little_padding(spark):
    lengths = [r[1] for r in packing.packed_documents(read(spark, sf=LARGE), WORDS).groupBy("sequence_id").agg(F.sum("length")).collect()]
    assert sum(4096 - n for n in lengths if n & (n - 1)) < 0.01 * sum(lengths)


def test_packing_repeated_rows_and_empty_table(spark):
    got = packing.packed_documents(frame(spark, [(1, "a b"), (1, "a b"), (None, None), (3, "")]), WORDS).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == [("1", 3), ("1", 3), ("3", 1), ("None", 1)]
    assert packing.packed_documents(frame(spark, []), WORDS).count() == 0


def test_words_are_encoded_as_whole_texts():
    words = packing.WordTokenizer(WORDS)
    draw = np.random.default_rng(8)
    marks = list("aZéß 	\n'’0123.,!?　 漢İ😀\x1c\x85́Ǆ_-<|>") + [" ", " the", "n't", "<|endoftext|>", "don't", "</w>", "ÉTÉ,"]
    texts = ["".join(draw.choice(marks, draw.integers(0, 25))) for _ in range(3000)]
    for text, data in zip(texts, words.encode_all(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == plain_ids([text])[0][:-1], repr(text)


# personal data


def plain_base(text):
    """The base patterns as they are stated, by Python's own engine."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(int(c) for c in reversed(s))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [[m.span() for m in re.finditer(pattern, text) if passes(m.group())] for _, pattern, passes in kinds]


def test_base_spans_against_the_plain_patterns():
    draw = np.random.default_rng(12)
    marks = list("ab.%+-@ 0123456789") + ["4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 123-4567", "1.2.3.4", "256.1.1.1", "001.02.3.255", "x@y.zz", "é", "\n", "@@", ".."]
    for _ in range(4000):
        text = "".join(draw.choice(marks, draw.integers(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_personal_data_digests(docs):
    rows = pairs_of(docs)
    want = {}
    for i, t in rows:
        spans = plain_base(t or "")
        want[i] = (*map(len, spans), hashlib.sha256(pii.listed(spans).encode()).hexdigest())
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:6] == want[r["doc_id"]]
        base = set(filter(None, pii.listed(plain_base(dict(rows)[r["doc_id"]] or "")).split(",")))
        assert base <= set(filter(None, r["spans"].split(",")))


def test_field_finds_what_patterns_miss_and_leaves_text_alone():
    finder = pii._finder()
    for text, kind in (("please call (555) 123-4567 today", "phone"), ("write to jane (at) mail (dot) org soon", "email")):
        base, more = finder.find([text])
        assert not any(base[0]) and more[0][pii.KINDS.index(kind)]
    plain = ["In 2020 there were 12 cases, 3 of them at 10:30.", "Version 2.0 of 2019-05-12", "", "pp. 100-120 of 300"]
    assert not any(any(spans) for found in finder.find(plain) for spans in found)


def held_out_rows():
    """Sentences unlike those of the training table, with and without personal data: (text, kind, span's text)."""
    draw = np.random.default_rng(77)
    number = lambda pattern: re.sub("9", lambda m: str(draw.integers(10)), pattern)
    byte = lambda: str(draw.integers(256))

    def card(mark):
        digits = "4" + "".join(str(d) for d in draw.integers(0, 10, 14))
        digits = next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))
        return mark.join(digits[k : k + 4] for k in range(0, 16, 4))

    said = ["My colleague told me yesterday that {} is the one to use, as far as anybody knows.", "Please note: {} (valid until spring).", "{} was written on the door", "If it fails, try {} or wait until the morning.", "Nous avons reçu {} hier soir"]
    announced = ["reach us by phone {} on weekdays", "Our fax {} is always on.", "Tel. {}, ask for Anna", "mobile: {}"]
    out = []
    for k in range(60):
        for kind, found, frames in (
            ("phone", number(["(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 9999"][k % 4]), said),
            ("phone", number(["999-9999", "9999 9999"][k % 2]), announced),
            ("email", ["erika (at) post (dot) org", "jo at firma dot de", "max [at] web [dot] com", "info99 (at) shop.example.com"][k % 4], said),
            ("ip", [",", "-", " . ", "[.]"][k % 4].join(byte() for _ in range(4)), ["server {} is down", "the ip {} was banned", "host {} answered", "address {} of the router"]),
            ("card", card([".", "/", "_"][k % 3]), ["pay with card {} today", "card: {} expires", "Her card {} was refused"]),
        ):
            out.append((frames[int(draw.integers(len(frames)))].format(found), kind, found))
        clean = ["ISBN 978-3-16-148410-0", "Room 101-2003", "IBAN DE89 3704 0044 0532 0130 00", "a mix of 100:200:50:25", number("99.99.2021"), number("2021-99-99 99:99:99"), number("99,999.99 euros"), number("9999 items"), "version 10.4.2-17", number("pages 999-999 and 999-999"), number("ISSN 9999-9999"), number("section 9.9.9"), "1, 2, 3, 4 and 5", number("order 9999-99999"), "@home", "he looked at the dot"]
        out.append((said[k % len(said)].format(clean[k % len(clean)]), None, clean[k % len(clean)]))
    return out


def test_precision_and_recall_of_added_spans_on_held_out_sentences():
    finder, rows = pii._finder(), held_out_rows()
    bases, added = finder.find([t for t, _, _ in rows])
    right, found, wanted = (dict.fromkeys(pii.KINDS, 0) for _ in range(3))
    for (text, kind, span), base, more in zip(rows, bases, added, strict=True):
        if kind and not any(base):
            wanted[kind] += 1
        for k, spans in zip(pii.KINDS, more, strict=True):
            for a, b in spans:
                found[k] += 1
                right[k] += k == kind and text[a:b].strip() == span
    figures = {k: (right[k] / max(found[k], 1), right[k] / max(wanted[k], 1)) for k in pii.KINDS}
    print(figures)
    assert all(precision >= 0.9 and recall >= 0.9 for precision, recall in figures.values()), figures


@pytest.mark.parametrize("text", ["ISBN 978-3-16-148410-0", "Room 101-2003", "IBAN DE89 3704 0044 0532 0130 00", "mixed 100:200:50:25 by weight", "from 2020-01-01 12:30:45 on", "v10.4.2-17 of 01.02.2020"])
def test_numbers_that_are_no_personal_data(text):
    _, (more,) = pii._finder().find([text])
    assert not any(more)


def test_decoding_against_all_paths():
    field = pii._finder().field
    window = field.codes([s for _, _, s in pii.tokens_of("call 555-12", 0, 11)])
    padded, _ = field.padded([window])
    emission = field.scores(padded)[0]
    best = max(np.ndindex(*[len(pii.LABELS)] * len(window)), key=lambda p: sum(emission[k, x] for k, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert field.decode([window, window[:2]])[0].tolist() == list(best)


def test_masking(spark):
    docs = frame(spark, [(1, "mail a.b@c.org now"), (2, None), (3, "nothing")])
    assert sorted((r["doc_id"], r["text"]) for r in pii.masked(docs).collect()) == [(1, "mail [EMAIL] now"), (2, None), (3, "nothing")]


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = read(spark)
    sf = "/root/testdata/sf0.001"
    columns = docs.columns
    frames = [docs]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    rows = [dict(pairs_of(f)) for f in frames]
    scores = quality.quality_scores(docs, read(spark, "labels")).collect()
    assert set(rows[1]) == {r["doc_id"] for r in scores if r["predicted"]}

    from test_near_and_exact_copies import brute_components, brute_exact

    assert set(rows[2]) == {r[0] for r in brute_exact(list(rows[1].items())) if r[3]}
    assert set(rows[3]) == {r[0] for r in brute_components(list(rows[2].items()), 5, (80, 100)) if r[0] == r[2]}
    assert set(rows[4]) == set(rows[3])
    finder = pii._finder()
    for i, text in rows[3].items():
        (base,), (more,) = finder.find([text or ""])
        assert (rows[4][i] == text) == (not any(base) and not any(more))
    assert frames[4].where(F.col("n_chars") != F.length("text")).count() == 0
    last = P.STAGES[-1][1](spark, frames[4], sf).collect()
    check_packing(list(rows[4].items()), last, 4096)


def test_pipeline_rows_without_an_id_or_with_a_repeated_one(spark):
    import corpus_pipeline as P

    words = [f"word{k}" for k in range(60)]
    text, near, third = " ".join(words), " ".join([*words[:-1], "last"]), " ".join(reversed(words))
    rows = [(None, "alone"), (None, third), (None, third), (5, text), (5, text), (5, "other"), (2, near), (None, near + "  "), (9, "alone too"), (None, third + " end")]
    exact = P.drop_exact_copies(spark, frame(spark, rows), "")
    order = lambda found: sorted(((r[0], r[1]) for r in found), key=repr)
    want = [(None, "alone"), (None, third), (5, text), (5, "other"), (None, near + "  "), (9, "alone too"), (None, third + " end")]
    assert order(exact.collect()) == order(want)
    kept = P.drop_near_copies(spark, exact, "").collect()
    assert order(kept) == order([(None, "alone"), (None, third), (5, text), (5, "other"), (9, "alone too")])


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, null ids, clashing columns, no n_chars: no row is lost but copies."""
    import corpus_pipeline as P

    rows = odd_rows(6)
    rows += [(None, t) for _, t in rows[:4]] + rows[:5] + [(None, None), (None, "A text of its own, without an id, that nothing else repeats.")]
    docs = spark.createDataFrame([(i, t, "s", 2, 0.5) for i, t in rows], "doc_id long, text string, score string, row int, score_ double").repartition(3)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(repr, P.drop_low_quality(spark, docs, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    exact = P.drop_exact_copies(spark, docs, "")
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert exact.columns == docs.columns and sorted(plain(r["text"]) for r in exact.collect()) == sorted({plain(t) for _, t in rows})
    near = P.drop_near_copies(spark, docs, "")
    numbered = list(enumerate(t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))))

    from test_near_and_exact_copies import brute_components

    want = sorted(repr(dict(numbered)[r[0]]) for r in brute_components(numbered, 5, (80, 100)) if r[0] == r[2])
    assert near.columns == docs.columns and sorted(repr(r["text"]) for r in near.collect()) == want
    masked = P.mask_personal_data(spark, docs, "")
    assert masked.columns == docs.columns and masked.count() == len(rows) and masked.where("text is null").count() == sum(t is None for _, t in rows)
    assert P.pack_sequences(spark, docs, "").where("start = 0").count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_trees_of_a_hundred_languages_stay_small():
    """Sparse rows and the dense table give the same code lengths; a hundred languages take little memory."""
    import tracemalloc

    draw = np.random.default_rng(3)
    parts = []
    for k in range(100):
        letters = draw.choice(np.arange(33, 250), 40, replace=False)
        data = letters[np.minimum(draw.geometric(0.1, 30_000) - 1, 39)].astype(np.int64)
        found, n = np.unique(data[3:] | data[2:-1] << 8 | data[1:-2] << 16 | data[:-3] << 24, return_counts=True)
        parts.append(pd.DataFrame({"lang": f"l{k:03d}", "gram": found, "n": n}))
    few = pd.concat(parts[:3], ignore_index=True)
    texts = [bytes(draw.integers(1, 255, size).astype(np.uint8)) for size in (1, 2, 3, 50, 4000)] + [b"", b"zz"][1:]
    dense, sparse = language_id.ContextTrees(few, 1 << 40), language_id.ContextTrees(few, 0)
    assert dense.dense and not sparse.dense
    assert np.allclose(dense.text_costs(texts), sparse.text_costs(texts), rtol=1e-5)
    tracemalloc.start()
    many = language_id.ContextTrees(pd.concat(parts, ignore_index=True))
    costs = many.text_costs([t * 20 for t in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not many.dense and costs.shape == (len(texts), 100) and peak < 500 << 20
