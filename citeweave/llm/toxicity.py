"""Toxicity scores from a lexicon trie searched by Levenshtein automata, with context windows.

The lexicon is learned from labelled documents: words, and stems shared by several words, that abusive documents
hold far more often than others, by more than chance allows for so many words. Every word of a text runs through the
automaton of its edits against the trie, so misspelled terms are found too; a term allows edits unless words that near
it are common in clean documents. A hit's window tells a quotation (between an opening and a closing mark, or with a cue
word near it) from abuse, and the counts of both are turned into a probability with learned weights. Cue words and the
place in which they stand are learned too: words near hits in clean documents far more often than in abusive ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import drop_staged, staged
from citeweave.llm.language_id import in_fold
from citeweave.llm.samples import labelled_sample

#: Labelled documents that are fitted at most.
LABELLED = 20_000
#: Terms: shortest, longest stem, least abusive documents, least log odds.
SHORTEST, LONGEST_STEM, LEAST_DOCS, LEAST_ODDS = 4, 9, 4, 3.5
#: A stem must be shared by so many words, and be at least so long.
STEM_WORDS, SHORTEST_STEM = 4, 4
#: Words from these lengths on allow one and two edits, unless words that near them are in over such a share of clean documents.
ONE_EDIT, TWO_EDITS, NEAR_CLEAN = 5, 10, 0.001
#: Characters on both sides of a hit in which quote marks are paired and cue words are looked for, and words on each side.
WINDOW, CUE_WORDS = 48, 3
#: Terms beside which a cue word must be seen in clean documents, so that copies of one document teach none.
CUE_TERMS = 3
FLAGGED = 0.3
#: Bytes that remembered tokens take at most, about, and bytes of an entry besides its characters.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 160
#: Bytes that remembered moves of an automaton take at most, about, and bytes of a pair in a state.
MOVE_BYTES, PAIR_BYTES = 96 << 20, 120
#: Characters read for the letters they resemble.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
#: Marks that may open and close a quotation.
OPENING, CLOSING = "\"“„«‘'›‚", "\"”“»’'‹‘"

WORD, TOKEN, SENTENCE_END = re.compile(r"[^\W\d_]+"), re.compile(r"\S+"), re.compile(r"[.!?\n]")


def _terms(text: str) -> set[tuple[str, bool]]:
    """The words of a text, and their stems, marked True."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= SHORTEST}
    stems = {(w[:k], True) for w in words for k in range(SHORTEST_STEM, min(LONGEST_STEM, len(w)) + 1)}
    return {(w, False) for w in words} | stems


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each word or stem."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            for term in _terms(text):
                counts[term][label] += 1
        terms, stems = ([t[k] for t in counts] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["term", "stem", "clean", "toxic"])


def build_lexicon(telling: pd.DataFrame) -> list[tuple[str, bool, int]]:
    """(term, is_stem, edits allowed) from the telling words and stems: term, stem, kinds.

    A stem is a term if several words in abusive documents share it; stems, and short words, must be spelled exactly.
    """
    telling = telling.sort_values("term")
    stems: list[str] = []
    for stem in telling[telling["stem"] & (telling["kinds"] >= STEM_WORDS)].sort_values("term", key=lambda t: t.str.len(), kind="stable")["term"]:
        if not stem.startswith(tuple(stems)):
            stems.append(stem)
    words = telling[~telling["stem"]]["term"]
    return [(t, True, 0) for t in stems] + [(w, False, 0 if len(w) < ONE_EDIT else 1 if len(w) < TWO_EDITS else 2) for w in words]


class LexiconAutomaton:
    """The lexicon trie intersected with Levenshtein automata, made deterministic as words are read.

    A state is a set of (trie node, edits spent); a letter moves along a child, replaces a child's letter, or is
    extra, and a term's letter may be skipped. Edits are spent only on the way to terms that allow them. Stems match
    exactly and whatever follows them.
    """

    STEM = -1

    def __init__(self, lexicon: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: dict[int, int] = {}  # node where a word ends: the edits it allows
        self.words: dict[int, str] = {}
        self.stems: set[int] = set()
        self.budget = [0]  # most edits of any word below a node
        for term, stem, allowed in lexicon:
            at = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                at = self.children[at].setdefault(c, len(self.children))
                if at == len(self.children):
                    self.children.append({})
                    self.budget.append(0)
                self.budget[at] = max(self.budget[at], allowed)
            if stem:
                self.stems.add(at)
            else:
                self.word_edits[at] = allowed
                self.words[at] = term
        self.start = self._closed({0: 0})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.accepts: dict[frozenset, tuple[int, int] | None] = {}
        self.held = 0

    def _closed(self, spent: dict[int, int]) -> frozenset:
        """Add the states reached by skipping letters of terms; of two ways to a node the cheaper stays."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                cost = spent[node] + 1
                if cost <= self.budget[child] and cost < spent.get(child, 99):
                    spent[child] = cost
                    todo.append(child)
        return frozenset(spent.items())

    def _move(self, state: frozenset, letter: str) -> frozenset:
        if (self.STEM, 0) in state:
            return state
        spent: dict[int, int] = {}
        for node, edits in state:
            options = [(child, edits + (c != letter)) for c, child in self.children[node].items()] + [(node, edits + 1)]
            for target, cost in options:
                if target in self.stems and cost == 0:
                    return frozenset({(self.STEM, 0)})
                if cost <= self.budget[target] or cost == 0:
                    spent[target] = min(cost, spent.get(target, 99))
        return self._closed(spent)

    def _end(self, word: str) -> tuple[int, int] | None:
        """The fewest edits between the word and a term, and the node where that term ends."""
        state = self.start
        for letter in word:
            if (key := (state, letter)) in self.moves:
                state = self.moves[key]
            else:
                if self.held > MOVE_BYTES:
                    self.moves.clear()
                    self.accepts.clear()
                    self.held = 0
                state = self.moves[key] = self._move(state, letter)
                self.held += PAIR_BYTES * (len(state) + 3)
            if not state:
                return None
        if state not in self.accepts:
            ends = [(edits, node) for node, edits in state if node == self.STEM or edits <= self.word_edits.get(node, -1)]
            self.accepts[state] = min(ends, default=None)
        return self.accepts[state]

    def match(self, word: str) -> int | None:
        """The fewest edits between the word and a term, 0 for a word that begins with a stem; None without one."""
        end = self._end(word)
        return None if end is None else end[0]

    def misspelled(self, word: str) -> str | None:
        """The term of which the word is a misspelling."""
        end = self._end(word)
        return self.words[end[1]] if end and end[0] else None


def _side(text: str, at: int) -> int:
    """1 for a mark that opens a quotation there, -1 for one that closes it, 0 for an apostrophe inside a word or none."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if text[at] in OPENING and not before.isalnum() and after.strip():
        return 1
    return -1 if text[at] in CLOSING and before.strip() and not after.isalnum() else 0


def _beside(text: str, start: int, end: int) -> set[tuple[int, str]]:
    """The words near a term in its sentence and window, and how many words after it, or before it (below zero), they stand."""
    before = SENTENCE_END.split(text[max(0, start - WINDOW) : start])[-1]
    after = SENTENCE_END.split(text[end : end + WINDOW])[0]
    found = set(enumerate(WORD.findall(after.lower())[:CUE_WORDS], 1))
    return found | {(-k, w) for k, w in enumerate(reversed(WORD.findall(before.lower())[-CUE_WORDS:]), 1)}


def _quoted(text: str, start: int, end: int, cues: frozenset[tuple[int, str]] = frozenset()) -> bool:
    """Whether the last mark before the term in its window opens and the next one after it closes, or a cue word is near it in its place."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if cues and not cues.isdisjoint(_beside(text, start, end)):
        return True
    opened = next((side for at in range(start - 1, start - len(before) - 1, -1) if text[at] in OPENING + CLOSING and (side := _side(text, at))), 0)
    return opened == 1 and next((side for at in range(end, end + len(after)) if text[at] in OPENING + CLOSING and (side := _side(text, at))), 0) == -1


class Scanner:
    """Counts a text's hits: as spelled and misspelled, in abuse and in quotation, which cue words tell."""

    def __init__(self, lexicon: list[tuple[str, bool, int]], cues: frozenset[tuple[int, str]] = frozenset()):
        self.automaton, self.cues = LexiconAutomaton(lexicon), cues
        self.memo: dict[str, tuple[tuple[int, int, int], ...]] = {}
        self.held = 0

    def hits(self, token: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of the terms in a stretch of text without white space."""
        found = []
        for m in WORD.finditer(token.lower()):
            if m.end() - m.start() >= SHORTEST and (edits := self.automaton.match(m.group())) is not None:
                found.append((m.start(), m.end(), edits))
        if not found and (plain := token.lower().translate(LOOKALIKES)) != token.lower():
            found = [(m.start(), m.end(), 1) for m in WORD.finditer(plain) if m.end() - m.start() >= ONE_EDIT and self.automaton.match(m.group()) == 0]
        return tuple(found)

    def found(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """How many stretches without white space a text has, and (start, end, edits) of all its hits."""
        tokens = text.split()
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        for token in set(tokens).difference(memo):
            memo[token] = self.hits(token)
            self.held += ENTRY_BYTES + len(token)
        if not any(memo[t] for t in tokens):
            return len(tokens), []
        return len(tokens), [(m.start() + start, m.start() + end, edits) for m in TOKEN.finditer(text) for start, end, edits in memo[m.group()]]

    def features(self, text: str) -> list[float]:
        n, hits = self.found(text)
        plain = near = quoted = 0
        for start, end, edits in hits:
            if _quoted(text, start, end, self.cues):
                quoted += 1
            elif edits:
                near += 1
            else:
                plain += 1
        n = max(n, 1)
        return [float(plain + near > 0), np.log1p(plain + near), np.log1p(near), np.log1p(quoted), min(1.0, 20 * (plain + near) / n)]


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient descent; the last weight is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, slow, square = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), np.zeros(x1.shape[1])
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        gradient = x1.T @ (p - y) / max(len(y), 1) + decay * np.append(w[:-1], 0)
        slow, square = 0.9 * slow + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w -= rate * (slow / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def _part(n: Column, of: Column, p: float) -> Column:
    """A label's part of a log likelihood ratio: n of so many documents have it, where p is its share of all."""
    return F.when(n > 0, n * F.log(n / of / p)).otherwise(0.0)


def learn_cues(sample: DataFrame, lexicon: list[tuple[str, bool, int]]) -> frozenset[tuple[int, str]]:
    """(place, word), as of _beside(), of the words that tell quotation from abuse, from labelled documents: label, text.

    A word is a cue where documents that have it near a hit are clean more often than all that have hits, by more than
    chance allows for so many words, and if it is seen so near several terms. Without such words there are no cues.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            rows: list[tuple[int, str, str, int]] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                hits = [(start, end, text[start:end].lower()) for start, end, _ in scanner.found(text)[1]]
                near = {(place, word, term) for start, end, term in hits for place, word in _beside(text, start, end)}
                rows += [(place, word, term, label) for place, word, term in near]
                # a row without a word counts the document
                rows += [(0, "", "", label)] if hits else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))], ["place", "word", "term", "label"])

    clean, toxic = F.sum(1 - F.col("label")), F.sum("label")
    seen = sample.mapInArrow(run, "place int, word string, term string, label int").groupBy("place", "word", "term").agg(clean.alias("clean"), toxic.alias("toxic"))
    words = staged(seen.groupBy("place", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count_if(F.col("clean") > 0).alias("terms")), "cues")
    totals = words.where("word = ''").select("clean", "toxic").first()
    if totals is None or not totals["clean"]:
        return frozenset()
    share, of = totals["clean"] / (totals["clean"] + totals["toxic"]), F.col("clean") + F.col("toxic")
    likelihood = 2 * (_part(F.col("clean"), of, share) + _part(F.col("toxic"), of, max(1 - share, 1e-9)))
    telling = words.where((F.col("word") != "") & (F.col("clean") > share * of) & (F.col("terms") >= CUE_TERMS) & (likelihood >= 2 * float(np.log(max(words.count(), 2)))))
    cues = frozenset((r["place"], r["word"]) for r in telling.collect())
    drop_staged(words)
    return cues


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[tuple[str, bool, int]], frozenset[tuple[int, str]], np.ndarray]:
    """The lexicon, the cue words and the weights, from labels outside the held-out fold (crc32 of the id mod 4 is 2)."""
    sample = labelled_sample(docs, labels, "toxic", 4, 2, bound)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    counted = sample.mapInArrow(_count_terms, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = staged(counted, "terms")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # twice the log likelihood ratio against one rate for both kinds; chance alone takes it past 2 log n once in n words
    share = max(n_toxic, 1) / max(n_toxic + n_clean, 1)
    both = F.col("toxic") + F.col("clean")
    likelihood = 2 * (_part(F.col("toxic"), both, share) + _part(F.col("clean"), both, max(1 - share, 1e-9)))
    telling = counted.where((odds >= LEAST_ODDS) & (F.col("toxic") >= LEAST_DOCS) & (likelihood >= 2 * float(np.log(max(counted.count(), 2)))))
    stems = F.explode(F.transform(F.sequence(F.lit(SHORTEST_STEM), F.least(F.length("term"), F.lit(LONGEST_STEM))), lambda k: F.substring(F.col("term"), F.lit(1), k)))
    kinds = counted.where("not stem and toxic > 0").select(stems.alias("term"), F.lit(True).alias("stem")).groupBy("term", "stem").agg(F.count("*").alias("kinds"))
    lexicon = build_lexicon(telling.join(kinds, ["term", "stem"], "left").select("term", "stem", F.coalesce("kinds", F.lit(0)).alias("kinds")).toPandas())

    def misspelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton([t for t in lexicon if not t[1]])
        for frame in frames:
            frame = frame.assign(term=[automaton.misspelled(w) for w in frame["term"]])
            yield frame[frame["term"].notna()]

    near = counted.where("not stem and clean > 0").select("term", "clean").mapInPandas(misspelled, "term string, clean long")
    refused = {r["term"] for r in near.groupBy("term").agg(F.sum("clean").alias("n")).where(F.col("n") > NEAR_CLEAN * n_clean).collect()}
    lexicon = [(t, stem, 0 if t in refused else edits) for t, stem, edits in lexicon]
    drop_staged(counted)
    cues = learn_cues(sample, lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, cues)
        for batch in batches:
            x = [scanner.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    found = sample.mapInArrow(rows, "label int, x array<double>").toPandas()
    x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, 5))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)
    return lexicon, cues, fit_weights(x[order], found["label"].to_numpy(float)[order])


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text is empty, and a text of any length is read whole. Labels that are null, repeated or of unknown documents
    do no harm; with none every document scores one half or less by the empty model's intercept. Null ids are kept and
    in no fold, repeated rows give repeated rows; other columns are ignored; an empty table gives no row. Terms whose
    letters are parted by spaces or marks, and repeated terms written as one word, are missed.
    """
    lexicon, cues, weights = learn(docs, labels, bound)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(lexicon, cues)
        for column in texts:
            x = np.array([scanner.features(t or "") for t in column]).reshape(len(column), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500))) if len(column) else [], dtype=float)

    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted"))
