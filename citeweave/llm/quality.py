"""Quality classification by Bradley-Terry pairwise ranking.

Documents are described by shares of character classes and by how much their words and lines repeat. Every
preference pair takes a good and a bad labelled document, and the weights maximise the likelihood that the good
one wins: logistic loss on the difference of the features, over all pairs of all labelled documents. A pair's loss
depends on two scores only, so each Newton step counts the scores on a fine grid, folds the counts with the loss, and
sums gradient and curvature over the documents. The cut between accepted and rejected scores is the quantile of the
learned scores at the share of bad labels.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import drop_staged, staged
from citeweave.llm.language_id import in_fold

#: Newton steps at most, places of the grid of scores, and of the coarser one for what pairs share in the curvature.
STEPS, GRID, COARSE, DECAY, ENOUGH = 25, 4096, 64, 1e-3, 1e-6
ACCEPT = 0.5

#: The characters of each class; upper, lower, digits and other bytes have classes besides.
MARKS = [" ", "\n\r", "\t", ".", ",", "!?", "|", "#*", "$%&", "-_=~", "\"'`", "()[]{}<>", ":;/\\@+^"]
UPPER, LOWER, DIGIT, OTHER = (len(MARKS) + k for k in range(4))
CLASSES = len(MARKS) + 4


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[65:91], table[97:123], table[48:58] = UPPER, LOWER, DIGIT
    for at, marks in enumerate(MARKS):
        table[[ord(c) for c in marks]] = at
    return table


_TABLE = byte_classes()


def features(text: str) -> np.ndarray:
    """One document's features; every text has some, the empty one too."""
    data = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(_TABLE[data], minlength=CLASSES) / max(len(data), 1)
    words = text.split()
    distinct = set(words)
    lines = text.split("\n")
    seen_upper = share[UPPER] / max(share[UPPER] + share[LOWER], 1e-9)
    body = [
        np.log1p(len(words)) / 10,
        len(distinct) / max(len(words), 1),
        min(len(distinct) / (1 + len(words) ** 0.8), 2.0),
        min(len(text) / max(len(words), 1), 40.0) / 40,
        len(set(lines)) / len(lines),
        seen_upper,
        float(not words),
    ]
    return np.concatenate([share, np.sqrt(share), body])


@dataclasses.dataclass
class Ranking:
    """Learned weights over standardised features, and the score at which documents are accepted."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.middle) / self.spread, -8, 8) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(strength, -500, 500)))


#: Sums a function of some rows' features and of whether they are good over all labelled rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _counts(s: np.ndarray, low: float, high: float, places: int) -> np.ndarray:
    """Scores counted on an even grid, each shared between the places beside it."""
    at = np.clip((s - low) / (high - low), 0, 1) * (places - 1)
    left = np.minimum(at.astype(np.int64), places - 2)
    right = at - left
    return np.bincount(left, 1 - right, places) + np.bincount(left + 1, right, places)


def _folded(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each place the sum over the counts of the kernel at the distance from them."""
    return np.convolve(counts, kernel)[len(counts) - 1 : 2 * len(counts) - 1]


def _ranked_scores(total: Total, score: Callable[[np.ndarray], np.ndarray], ranks: list[int], reach: float) -> list[float]:
    """The scores of some ranks (from 0) in ascending order, by counts between bounds that close in."""
    bounds = [(-reach, reach) for _ in ranks]
    while bounds[0][1] - bounds[0][0] > 1e-9:
        now = bounds

        def inside(x: np.ndarray, good: np.ndarray, now=now) -> np.ndarray:
            s = score(x)
            return np.stack([np.bincount(np.searchsorted(np.linspace(low, high, GRID + 1)[1:-1], s, "right"), minlength=GRID) for low, high in now]).astype(float)

        bounds = []
        for (low, high), rank, counts in zip(now, ranks, total(inside), strict=True):
            edges, k = np.linspace(low, high, GRID + 1), int(np.searchsorted(np.cumsum(counts), rank + 0.5))
            bounds.append((float(edges[k]), float(edges[k + 1])))
    return [low for low, _ in bounds]


def _fit(total: Total, width: int) -> Ranking:
    """Fit the ranking; with labels of one kind only, every score is on that kind's side."""
    sums = total(lambda x, good: np.concatenate([[good.sum(), (~good).sum()], x.sum(0), (x * x).sum(0)]))
    wins, losses = sums[:2]
    if not wins or not losses:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if losses else -1.0)
    middle = np.round(sums[2 : 2 + width] / (wins + losses), 12)
    spread = np.round(np.sqrt(np.maximum(sums[2 + width :] / (wins + losses) - middle**2, 0)), 9) + 1e-6
    standard = lambda x: np.clip((x - middle) / spread, -8, 8)
    reach_of = lambda w: max(8 * float(np.abs(w).sum()), 1.0)
    pairs = wins * losses

    def counted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Both kinds' counts, the distances on the grid, and the loss."""
        reach = reach_of(w)
        both = total(lambda x, good: np.stack([_counts((s := standard(x) @ w)[k], -reach, reach, GRID) for k in (good, ~good)]))
        gaps = np.clip(np.arange(1 - GRID, GRID) * (2 * reach / (GRID - 1)), -500, 500)
        return both, gaps, float(both[0] @ _folded(both[1], np.logaddexp(0, -gaps)) / pairs + DECAY / 2 * w @ w)

    w, step = np.zeros(width), np.zeros(width)
    both, gaps, loss = counted(w)
    for _ in range(STEPS):
        reach, slope = reach_of(w), 1 / (1 + np.exp(-gaps))
        grid, coarse = np.linspace(-reach, reach, GRID), np.linspace(-reach, reach, COARSE)
        bend = slope * (1 - slope)
        tables = [_folded(both[1], 1 - slope), _folded(both[0], slope), _folded(both[1], bend), _folded(both[0], bend)]

        def moments(x: np.ndarray, good: np.ndarray, w=w, reach=reach, grid=grid, tables=tables) -> np.ndarray:
            z = standard(x)
            s = z @ w
            of = lambda a, b: np.where(good, np.interp(s, grid, tables[a]), np.interp(s, grid, tables[b]))
            place = np.rint((s + reach) / (2 * reach) * (COARSE - 1)).astype(np.int64) + np.where(good, 0, COARSE)
            by_place = np.zeros((2 * COARSE, len(w)))
            np.add.at(by_place, place, z)
            return np.concatenate([[np.where(good, 1.0, -1.0) * of(0, 1) @ z], (z * of(2, 3)[:, None]).T @ z, by_place])

        found = total(moments)
        apart = 1 / (1 + np.exp(np.clip(coarse[None, :] - coarse[:, None], -500, 500)))
        shared = found[1 + width : 1 + width + COARSE].T @ (apart * (1 - apart)) @ found[1 + width + COARSE :]
        values, axes = np.linalg.eigh((found[1 : 1 + width] - shared - shared.T) / pairs)
        step = axes @ ((axes.T @ (found[0] / pairs - DECAY * w)) / (np.maximum(values, 0) + DECAY))
        held = loss
        while True:
            both, gaps, loss = counted(w + step)
            if loss <= held + 1e-9 or np.abs(step).max() < ENOUGH:
                break
            step = step / 2
        w = w + step
        if np.abs(step).max() < ENOUGH or held - loss < 1e-8:
            break
    w = np.round(w, 6)
    at = int(round(losses))
    near = [k for k in (at - 1, at) if 0 <= k < wins + losses]
    return Ranking(middle, spread, w, float(np.mean(_ranked_scores(total, lambda x: standard(x) @ w, near, reach_of(w)))))


def fit(x: np.ndarray, good: np.ndarray) -> Ranking:
    """The ranking of rows at hand."""
    return _fit(lambda part: part(x, good), x.shape[1])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label (0 or 1), x: the features of every labelled document outside the held-out fold (crc32 of the id mod 3 is 1).

    Features meet labels, not texts. Of contradicting labels of one document the smaller counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", 3, 1)).select("doc_id", "text")
    return texts.mapInArrow(_feature_rows, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x array<double>").join(known, "doc_id").select("label", "x")


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking learned from all labels outside the held-out fold; each pass brings one sum of each task to the driver."""
    rows, width = staged(labelled_features(docs, labels), "features"), len(features(""))
    few = rows.coalesce(docs.sparkSession.sparkContext.defaultParallelism)

    def total(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if len(batch):
                    more = part(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column("label").to_numpy(zero_copy_only=False) == 1)
                    held = more if held is None else held + more
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        shape = part(np.zeros((0, width)), np.zeros(0, bool)).shape
        found = [r["sums"] for r in few.mapInArrow(run, "sums array<double>").collect()]  # a row a task
        return np.sum(np.array(found), axis=0).reshape(shape) if found else np.zeros(shape)

    ranking = _fit(total, width)
    drop_staged(rows)
    return ranking


def score_documents(docs: DataFrame, ranking: Ranking, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a score column (0 to 1) added, or replaced where they have one. Null text is empty."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            x = np.array([features(t or "") for t in column]) if len(column) else np.zeros((0, len(ranking.weights)))
            yield pd.Series(ranking.scores(x))

    return docs.withColumn(score_col, run(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Labels of unknown documents, null labels and repeated labels do no harm; with no usable labels every document
    is accepted. Repeated rows give repeated rows.
    """
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
