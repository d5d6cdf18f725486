"""Language identification by prediction by partial matching.

For every language, a variable-order context tree over bytes is counted from a bounded sample of its texts
and then frozen. A byte's probability comes from the longest context the tree holds; a byte not seen there
pays the escape probability and is predicted by the next shorter context, with the bytes already ruled out
excluded, down to a uniform distribution over all byte values. The code length of a text under each language
is exact, and the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
#: Expected number of sampled training texts of each language, the bound of what is fitted.
TEXTS_PER_LANGUAGE = 800
#: Contexts seen fewer times than this in the sample are left out of the trees.
LEAST_CONTEXT = 3
#: Bytes scored at once; bounds a task's memory for texts of any length.
BYTES_AT_ONCE = 1 << 21
#: Cells of the dense table of costs, 4 bytes each; bytes scored at once where there is none; bytes of a language's sample.
DENSE_CELLS, ROWS_AT_ONCE, SAMPLE_BYTES = 1 << 25, 1 << 15, 8 << 20
UNDETERMINED = "und"


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (ORDER + 1)-byte strings by language; texts begin after ORDER zero bytes."""
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            encoded = [t.encode() for t in texts]
            data = np.frombuffer(b"".join(bytes(ORDER) + t for t in encoded), np.uint8).astype(np.int64)
            padding = np.cumsum([0] + [len(t) + ORDER for t in encoded[:-1]])[:, None] + np.arange(ORDER)
            last = np.delete(np.arange(len(data)), padding.ravel())
            gram = sum(data[last - k] << 8 * k for k in range(ORDER + 1))
            found, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])


def gram_counts(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> pd.DataFrame:
    """lang, gram, n from a sample of about ``per_language`` texts and SAMPLE_BYTES bytes of each; labelled: doc_id, text, lang.

    Languages are as few as the values of a label; there is a row for each here and in the broadcast trees.
    """
    rows = labelled.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    share = {r["lang"]: min(1.0, per_language / r["n"], SAMPLE_BYTES / max(r["bytes"], 1)) for r in sizes.collect()}
    if not share:
        return pd.DataFrame({"lang": pd.Series(dtype=str), "gram": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
    chance = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance * (1 << 30)).select("lang", "text")
    return sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


def _rows(keys: np.ndarray, key: np.ndarray, language: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (language, cost) by key: where each key's rows begin, and the rows."""
    order = np.argsort(key, kind="stable")
    return np.searchsorted(key[order], np.append(keys, np.iinfo(np.int64).max)), language[order].astype(np.int32), cost[order].astype(np.float32)


def _add_rows(out: np.ndarray, count: int, owner: np.ndarray, keys: np.ndarray, wanted: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the rows of each wanted key to its owner's costs by language."""
    pointer, language, cost = rows
    if not len(keys):
        return
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    met = np.flatnonzero(keys[at] == wanted)
    first, times = pointer[at[met]], np.diff(pointer)[at[met]]
    row = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
    out += np.bincount(np.repeat(owner[met], times) * count + language[row], cost[row], len(out))


class ContextTrees:
    """The frozen trees of all languages over one set of contexts.

    What a tree holds is sparse: the cost of each byte seen in each of its contexts, and for each context the cost of
    escaping to the next shorter one. A few languages share a dense table of the costs of every byte in every context; for
    more than DENSE_CELLS cells of it, code lengths are added up from the sparse rows, so memory grows with what the sample
    holds and not with contexts by languages.
    """

    def __init__(self, grams: pd.DataFrame, dense_cells: int = DENSE_CELLS):
        self.languages = sorted(grams["lang"].unique())
        code = pd.Categorical(grams["lang"], self.languages).codes.astype(np.int64)
        gram, n = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)
        #: By order: keys of contexts and of pairs of a context and a byte; the pairs' and contexts' (language, cost) rows.
        self.contexts, self.pairs, self.pair_rows, self.escape_rows = [], [], [], []
        explicit = None
        for order in range(ORDER + 1):
            explicit = self._grow(order, code, gram, n, explicit)
        used = np.unique(np.concatenate([gram >> 8 * k & 0xFF for k in range(ORDER + 1)] + [np.zeros(1, np.int64)]))
        self.dense = sum(map(len, self.contexts)) * (len(used) + 1) * len(self.languages) <= dense_cells
        if self.dense:
            self._fill(used)

    def _grow(self, order: int, code: np.ndarray, gram: np.ndarray, n: np.ndarray, explicit: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Add the contexts of an order; takes and returns key (language, pair) and cost of what an order has seen."""
        pair = gram & (1 << 8 * (order + 1)) - 1
        if order:  # contexts that all languages together have seen too rarely are left out
            keys, inverse = np.unique(pair >> 8, return_inverse=True)
            kept = (np.bincount(inverse, n, len(keys)) >= LEAST_CONTEXT)[inverse]
            code, pair, n = code[kept], pair[kept], n[kept]
            del keys, inverse, kept
        entry, inverse = np.unique(code << 32 | pair, return_inverse=True)
        times = np.bincount(inverse, n, len(entry))
        del inverse
        node, of_node = np.unique(entry >> 8, return_inverse=True)
        total, kinds = np.bincount(of_node, times, len(node)), np.bincount(of_node, minlength=len(node))
        shorter = entry >> 32 << 32 | entry & (1 << 8 * order) - 1
        above = np.full(len(entry), np.log(256.0)) if explicit is None else explicit[1][np.searchsorted(explicit[0], shorter)]
        left = 1 - np.bincount(of_node, np.exp(-above), len(node))
        closed = left <= 1e-12  # nothing is left to escape to
        escape = np.where(closed, 0, kinds / np.maximum(total + kinds, 1))
        cost = -np.log(times / total[of_node] * (1 - escape[of_node]))
        leaving = -np.log(np.maximum(np.where(closed, 0, escape / np.where(closed, 1, left)), 1e-300))
        del shorter, times
        self.contexts.append(np.unique(node & 0xFFFFFF))
        self.pairs.append(np.unique(entry & 0xFFFFFFFF))
        # beyond the shorter context's cost: an escape in every byte, and what a byte that was seen saves of that
        self.escape_rows.append(_rows(self.contexts[-1], node & 0xFFFFFF, node >> 24, leaving))
        self.pair_rows.append(_rows(self.pairs[-1], entry & 0xFFFFFFFF, entry >> 32, cost - above - leaving[of_node]))
        return entry, cost

    def _fill(self, used: np.ndarray) -> None:
        """The dense table of costs, and the steps from each context to the longer ones."""
        #: Byte values that occur in the sample have classes of their own; all others share class 0.
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        width, count = len(used) + 1, len(self.languages)
        costs, self.steps, self.first_ids = [], [], []
        keys_before, table, start = np.zeros(1, np.int64), np.full((1, width, count), np.log(256.0), np.float32), 0
        for order in range(ORDER + 1):
            keys = self.contexts[order] if order else np.zeros(1, np.int64)
            up = np.searchsorted(keys_before, keys & ((1 << 8 * max(order - 1, 0)) - 1)) if order else np.zeros(1, int)
            table = table[up]
            pointer, language, cost = self.escape_rows[order]
            at = np.repeat(np.searchsorted(keys, self.contexts[order]), np.diff(pointer))
            for value in range(width):  # one row for each context and language
                table[at, value, language] += cost
            pointer, language, cost = self.pair_rows[order]
            pair = np.repeat(self.pairs[order], np.diff(pointer))
            table[np.searchsorted(keys, pair >> 8), self.classes[pair & 0xFF], language] += cost
            costs.append(table)
            # a longer context is reached from the row of its older bytes (order - 1) by the byte that follows them
            if order:
                step = np.zeros((len(keys_before), width), np.int32)
                older = np.minimum(np.searchsorted(keys_before, keys >> 8), len(keys_before) - 1)
                held = keys_before[older] == keys >> 8
                step[older[held], self.classes[keys[held] & 0xFF]] = start + np.flatnonzero(held)
                self.steps.append((step, start - len(keys_before)))
                zero = np.searchsorted(keys, 0)
                self.first_ids.append(start + zero if zero < len(keys) and keys[zero] == 0 else 0)
            start += len(keys)
            keys_before = keys
        self.cost = np.concatenate(costs)

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Nats of each text in each language; texts lie one after another in ``data``, none is empty."""
        return self._dense_lengths(data, starts) if self.dense else self._sparse_lengths(data, starts)

    def _sparse_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        count = len(self.languages)
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        out = np.zeros(len(starts) * count)
        out += np.repeat(sizes, count) * np.log(256.0)
        owner, pair = np.repeat(np.arange(len(starts)), sizes), data.astype(np.int64)
        for order in range(ORDER + 1):
            if order:  # bytes before a text's begin are zero
                older = np.zeros(len(data), np.int64)
                older[order:] = np.where(place[order:] >= order, data[:-order], 0)
                pair = older << 8 * order | pair
            for keys, wanted, rows in ((self.contexts[order], pair >> 8, self.escape_rows[order]), (self.pairs[order], pair, self.pair_rows[order])):
                for first in range(0, len(pair), ROWS_AT_ONCE):
                    _add_rows(out, count, owner[first : first + ROWS_AT_ONCE], keys, wanted[first : first + ROWS_AT_ONCE], rows)
        return out.reshape(len(starts), count)

    def _dense_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        symbol = self.classes[data]
        rows = np.zeros(len(data), np.int32)
        before = np.zeros(len(data), np.int32)  # ids of the contexts one shorter; the root is row 0
        for (step, base), first in zip(self.steps, self.first_ids, strict=True):
            ids = np.zeros(len(data), np.int32)
            older = before[:-1]
            held = (older >= base) & ((older > 0) | (base == 0)) & (len(step) > 0)
            if held.any():
                ids[1:] = np.where(held, step[np.where(held, older - base, 0), symbol[:-1]], 0)
            ids[starts] = first
            rows = np.where(ids > 0, ids, rows)
            before = ids
        return np.add.reduceat(self.cost[rows, symbol].astype(np.float64), starts, axis=0)

    def text_costs(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of non-empty texts, a bounded number of bytes at a time."""
        out = np.zeros((len(texts), len(self.languages)))
        pieces: list[tuple[int, bytes]] = []
        held = 0
        for at, text in enumerate(texts):
            for cut in range(0, len(text), BYTES_AT_ONCE):
                # later pieces of a very long text repeat the bytes before them as context, which are charged once
                pieces.append((at, text[max(0, cut - ORDER) : cut + BYTES_AT_ONCE]))
                if cut:
                    head = text[cut - ORDER : cut]
                    out[at] -= self.code_lengths(np.frombuffer(head, np.uint8), np.zeros(1, int))[0]
                held += len(pieces[-1][1])
                if held >= BYTES_AT_ONCE:
                    self._charge(out, pieces)
                    pieces, held = [], 0
        if pieces:
            self._charge(out, pieces)
        return out

    def _charge(self, out: np.ndarray, pieces: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        starts = np.cumsum([0] + [len(p) for _, p in pieces[:-1]])
        np.add.at(out, [at for at, _ in pieces], self.code_lengths(data, starts))


_TREES: dict[int, ContextTrees] = {}


def identify(docs: DataFrame, grams: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the winner's share of the posterior, 0 to 1).

    Null text, text without a letter, and every text when nothing was learned get ``und`` and score 0. Ties go to
    the language first in alphabetical order. Repeated rows give repeated rows; other columns are ignored; an empty table
    gives no rows. A very long text is charged piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None and id(shared.value) not in _TREES:
            _TREES.clear()
            _TREES[id(shared.value)] = ContextTrees(shared.value)
        trees = _TREES[id(shared.value)]
        for batch in batches:
            texts, letters = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            named = [i for i, (t, has) in enumerate(zip(texts, letters, strict=True)) if t and has and trees.languages]
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if named:
                cost = trees.text_costs([texts[i].encode() for i in named])
                best = cost.argmin(1)
                share = 1 / np.exp(cost.min(1, keepdims=True) - cost).sum(1)
                for i, b, s in zip(named, best, share, strict=True):
                    lang[i], score[i] = trees.languages[b], float(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def language_predictions(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows outside the held-out fold."""
    learn = docs.where(~in_fold("doc_id", 5, 0) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    found = identify(docs, gram_counts(learn, per_language))
    return found.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
