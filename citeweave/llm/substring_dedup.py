"""Removal of repeated passages by suffix arrays over the passages' surroundings.

1. Anchors: of the byte strings of GRAM bytes inside every window of WINDOW bytes, the one with the least hash marks
   the window. Equal windows have equal anchors. Neighbouring windows of one anchor are a fragment, which is described
   by the anchor's hash, a 64-bit mark of its bytes, its document and its place.
2. Of equal fragments of one anchor, all but those of the smallest document are removed whole: first inside each batch,
   so that what many documents share is thinned out before it is dealt out, then by ranges of anchor hashes.
3. What is left to settle are different fragments of one anchor. Only the smallest holders of each send its bytes. Those
   that may have a window in common go into a suffix array, built by linear grouping, which brings equal windows
   together; the smallest document that holds a window decides in which documents its bytes are removed.
   Where the different fragments of one anchor are more than a block, each block's suffix array gives the smallest and
   largest holders of its windows; those are merged over the blocks by anchor and window and sent back to each block.

Ranges grow in number with the text. Fragments of anchors that very many documents hold are dealt out by anchor and mark
instead, so that no range holds all of them, and are settled in blocks. Which anchors these are is read from a sample of
documents; it decides where fragments meet, and never what is removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import drop_staged, mix64, staged
from citeweave.llm.suffix_groups import suffix_array

WINDOW, GRAM = 50, 24
#: Bytes of text for each range of anchor hashes, and bytes that are scanned at once.
RANGE_BYTES, SCAN_BYTES = 8 << 20, 2 << 20
#: Texts, and about how many bytes of them, whose fragments are compared before they are dealt out.
TEXTS_AT_ONCE, TEXTS_BYTES = 2500, 8 << 20
#: Bytes of one anchor's different fragments that one task settles; with more, they are dealt to blocks of so many.
BLOCK_BYTES = 1 << 20
#: Documents sampled, about, to find the anchors that many hold, and how many of these must hold one.
SAMPLED, HOT = 32_768, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = _powers(1 << 16)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    out, covered = values, 1
    while 2 * covered <= width:
        out = np.minimum(out[:-covered], out[covered:])
        covered *= 2
    return np.minimum(out[: len(out) - (width - covered)], out[width - covered :]) if covered < width else out


def _scan(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of texts that lie one after another: anchor hash, mark, start and length."""
    global _POWERS
    n, grams = len(data), window - gram + 1
    if n < window:
        return (*(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(2)))
    if n > len(_POWERS[0]):
        _POWERS = _powers(2 * n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64)])
        hashes = mix64((sums[gram:] - sums[:-gram]) * _POWERS[1][: n - gram + 1])
    hashes |= np.uint64(1)
    least = _least(hashes, grams)[: n - window + 1].copy()
    for end in ends[:-1]:  # windows don't cross texts
        least[max(0, end - window + 1) : end] = 0
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    stop = np.append(first[1:], len(least)) + window - 1
    inside = least[first] != 0
    first, stop = first[inside], stop[inside]
    with np.errstate(over="ignore"):
        marks = mix64((sums[stop] - sums[first]) * _POWERS[1][first] + (stop - first).astype(np.uint64))
    return least[first], marks, first, stop - first


def fragments_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For a few texts at a time: the number of each fragment's text, anchor hash, mark, start in that text and length.

    A longer text is scanned in parts that overlap by less than a window, so a fragment may come in two.
    """
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SCAN_BYTES):
            size += len(texts[stop])
            stop += 1
        if size > SCAN_BYTES:
            for first in range(0, size - window + 1, SCAN_BYTES):
                part = np.frombuffer(texts[at], np.uint8)[first : first + SCAN_BYTES + window - 1]
                hashes, marks, start, length = _scan(part, np.array([len(part)]), window, gram)
                yield np.full(len(start), at), hashes, marks, start + first, length
        else:
            ends = np.cumsum([len(t) for t in texts[at:stop]])
            hashes, marks, start, length = _scan(np.frombuffer(b"".join(texts[at:stop]), np.uint8), ends, window, gram)
            owner = np.searchsorted(ends, start, "right")
            yield owner + at, hashes, marks, start - np.concatenate([[0], ends])[owner], length
        at = stop


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first: the many zero bytes lie together and compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _holders(anchor: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fragment: the smallest document that holds an equal one, and whether its anchor's fragments differ in that."""
    if not len(doc):
        return doc, np.zeros(0, bool)
    order = np.lexsort((doc, mark, anchor))
    a, m, d = anchor[order], mark[order], doc[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    starts = np.flatnonzero(new_anchor | np.concatenate([[True], m[1:] != m[:-1]]))
    least = d[starts]
    groups = np.flatnonzero(new_anchor[starts])
    differ = np.repeat(np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups), np.diff(np.append(groups, len(starts))))
    sizes = np.diff(np.append(starts, len(order)))
    first, open_ = np.empty_like(doc), np.empty(len(doc), bool)
    first[order], open_[order] = np.repeat(least, sizes), np.repeat(differ, sizes)
    return first, open_


_FOUND = ["range", "ids", "keys", "counts", "anchors", "marks", "starts", "lengths"]
_FOUND_KINDS = "range long, ids array<long>, keys array<long>, counts array<int>, anchors binary, marks binary, starts binary, lengths binary"


def _found_row(place: int, ids: np.ndarray, keys: np.ndarray, owner: np.ndarray, anchor: np.ndarray, mark: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple:
    """One row of fragments, which are in order of their owners."""
    docs, counts = np.unique(owner, return_counts=True)
    return (place, ids[docs].tolist(), keys[docs].tolist(), counts.tolist(), anchor.astype("<u4").tobytes(), mark.astype("<u8").tobytes(), _planes(start), _planes(length))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that long texts don't add up in a task's memory."""
    rows = max(1, min(TEXTS_AT_ONCE, TEXTS_BYTES * batch.num_rows // max(1, batch.column(2).nbytes)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _hot_anchors(rows: DataFrame, n: int, window: int, gram: int) -> np.ndarray:
    """The hashes of anchors that many of the sampled documents hold, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            found = list(zip(*fragments_of([t.encode() for t in batch.column(2).to_pylist()], window, gram), strict=True))
            if found:
                pairs = np.unique(np.stack([np.concatenate(found[1]), np.concatenate(found[0]).astype(np.uint64)], 1), axis=0)
                anchors, counts = np.unique(pairs[:, 0], return_counts=True)
                several = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(anchors[several].view(np.int64)), pa.array(counts[several])], ["anchor", "n"])

    sample = rows.sample(min(1.0, SAMPLED / max(n, 1)), 7)
    counted = sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(counted.select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))


def _fragment_rows(n_ranges: int, hot: Broadcast, window: int, gram: int):
    """The fragments of every document by range, those of hot anchors in ranges from n_ranges on, and spans that go
    already inside a batch, in ranges from 2 n_ranges on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in (part for whole in batches for part in _slices(whole)):
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = list(zip(*fragments_of([t.encode() for t in batch.column(2).to_pylist()], window, gram), strict=True))
            if not found:
                continue
            owner, hashes, mark, start, length = map(np.concatenate, found)
            first, _ = _holders(hashes, mark, ids[owner])
            gone = first < ids[owner]
            rows = []
            if gone.any():
                o, s, n = owner[gone], start[gone], length[gone]  # in order of text and start, and so of end
                breaks = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] > (s + n)[:-1])])
                begin = np.flatnonzero(breaks)
                end = (s + n)[np.append(begin[1:], len(o)) - 1]
                none = np.zeros(0, np.uint64)
                rows.append(_found_row(2 * n_ranges + int(ids[o[0]]) % n_ranges, ids, keys, o[begin], none, none, s[begin], end - s[begin]))
            stay = ~gone
            owner, hashes, mark, start, length = (x[stay] for x in (owner, hashes, mark, start, length))
            place = ((hashes >> np.uint64(33)) % np.uint64(n_ranges)).astype(np.int64)
            anchor = hashes & np.uint64(0xFFFFFFFF)
            if len(known):
                number = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                many = known[number] == hashes
                place[many] = n_ranges + (mix64(hashes[many] ^ mark[many]) % np.uint64(n_ranges)).astype(np.int64)
                anchor[many] = number[many].astype(np.uint64)
            order = np.lexsort((owner, place))
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(part):
                    rows.append(_found_row(int(place[part[0]]), ids, keys, *(x[part] for x in (owner, anchor, mark, start, length))))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _FOUND)

    return run


def _blocks(code: np.ndarray, length: np.ndarray, block_bytes: int) -> np.ndarray:
    """The block of each fragment: 0 but for those of anchors with more than block_bytes, which are numbered from 1 on."""
    _, inverse = np.unique(code, return_inverse=True)
    hot = np.flatnonzero(np.bincount(inverse, length)[inverse] > block_bytes) if len(code) else np.zeros(0, int)
    hot = hot[np.argsort(inverse[hot], kind="stable")]
    out = np.zeros(len(code), np.int64)
    out[hot] = 1 + (np.cumsum(length[hot]) - length[hot]) // block_bytes
    return out


def _judged(n_ranges: int, block_bytes: int):
    """Of one range, by document: spans to remove, and the fragments to settle (anchor code, block, start, length)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, keys, counts = (np.concatenate([np.asarray(v, np.int64) for v in frame[c]]) for c in ("ids", "keys", "counts"))
        start, length = (np.concatenate([_numbers(v) for v in frame[c]]) for c in ("starts", "lengths"))
        owner = np.repeat(np.arange(len(ids)), counts)
        block = np.zeros(len(owner), np.int64)
        if key[0] >= 2 * n_ranges:
            code, gone, asked = np.zeros(len(owner), np.int64), np.ones(len(owner), bool), np.zeros(len(owner), bool)
        else:
            anchor, mark = (np.frombuffer(b"".join(frame[c]), kind) for c, kind in (("anchors", "<u4"), ("marks", "<u8")))
            several = key[0] >= n_ranges  # fragments of hot anchors, which differ from others elsewhere
            code = (n_ranges if several else key[0]) << 32 | anchor.astype(np.int64)
            first, differ = _holders(anchor, mark, ids[owner])
            gone = first < ids[owner]
            asked = ~gone & (differ | several)
            block[asked] = key[0] << 24 | 1 + (np.cumsum(length[asked]) - length[asked]) // block_bytes if several else _blocks(code[asked], length[asked], block_bytes)
        rows = defaultdict(lambda: [b"", b""])
        for kind, chosen, columns in ((0, gone, (start, start + length)), (1, asked, (code, block, start, length))):
            at = np.flatnonzero(chosen)
            at = at[np.argsort(owner[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(owner[at])) + 1):
                if len(part):
                    rows[int(owner[part[0]])][kind] = np.stack([c[part] for c in columns], 1).astype("<i8" if kind else "<i4").tobytes()
        docs = list(rows)
        return pd.DataFrame({"doc_id": ids[docs], "text_key": keys[docs], "gone": [r[0] for r in rows.values()], "asked": [r[1] for r in rows.values()]})

    return run


def _asked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, block, ids, keys, starts, codes, fragments) of the fragments to settle."""
    for batch in batches:
        rows = defaultdict(lambda: ([], [], [], [], []))
        for doc, key, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = text.encode()
            for code, block, start, length in np.frombuffer(b"".join(asked), "<i8").reshape(-1, 4).tolist():
                for column, value in zip(rows[code >> 32, block], (doc, key, start, code, data[start : start + length]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        columns = [pa.array([r[k] for r in rows.values()], pa.list_(kind)) for k, kind in enumerate(kinds)]
        places = [pa.array([place[k] for place in rows], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*places, *columns], ["range", "block", "ids", "keys", "starts", "codes", "fragments"])


def first_holders(fragments: list[bytes], holders: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For every window of every fragment, the smallest holder of an equal window in any of the fragments."""
    symbols: list[int] = []
    bases = []
    for fragment in fragments:
        bases.append(len(symbols))
        symbols += fragment
        symbols.append(256)
    where = np.repeat(np.arange(len(fragments)), [len(f) + 1 for f in fragments]).tolist()
    out = [np.full(max(0, len(f) - window + 1), h) for f, h in zip(fragments, holders, strict=True)]
    run: list[tuple[int, int]] = []
    last: bytes | None = None
    for suffix in suffix_array(symbols):
        k = where[suffix]
        at = suffix - bases[k]
        if at + window > len(fragments[k]):
            continue
        text = fragments[k][at : at + window]
        if text != last:
            _settle(out, run)
            run, last = [], text
        run.append((k, at))
    _settle(out, run)
    return out


def _settle(out: list[np.ndarray], run: list[tuple[int, int]]) -> None:
    if len(run) > 1:
        least = min(out[k][at] for k, at in run)
        for k, at in run:
            out[k][at] = least


def _meeting(codes: np.ndarray, fragments: list[bytes], window: int) -> np.ndarray:
    """Which fragments may have a window in common with another of their anchor, by hashes of the windows."""
    global _POWERS
    data = np.frombuffer(b"".join(fragments), np.uint8)
    if len(data) > len(_POWERS[0]):
        _POWERS = _powers(2 * len(data))
    lengths = np.array([len(f) for f in fragments])
    counts = lengths - window + 1
    owner = np.repeat(np.arange(len(fragments)), counts)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)], dtype=np.uint64)])
        hashes = mix64((sums[at + window] - sums[at]) * _POWERS[1][at] + mix64(codes.astype(np.uint64))[owner])
    _, inverse, held = np.unique(hashes, return_inverse=True, return_counts=True)
    out = np.zeros(len(fragments), bool)
    out[owner[held[inverse] > 1]] = True
    return out


def _settled(window: int):
    """Of one range: the spans to remove, by document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, keys, starts, codes = (np.concatenate([np.asarray(v) for v in frame[c]]) for c in ("ids", "keys", "starts", "codes"))
        fragments = [f for row in frame["fragments"] for f in row]
        order = np.flatnonzero(_meeting(codes, fragments, window))
        order = order[np.argsort(codes[order], kind="stable")]
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for group in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            held: dict[bytes, list[int]] = defaultdict(list)
            for k in group.tolist():
                held[fragments[k]].append(k)
            distinct = list(held)
            holders = [min(ids[k] for k in held[f]) for f in distinct]
            for fragment, first in zip(distinct, first_holders(distinct, holders, window), strict=True):
                for k in held[fragment]:
                    hit = np.flatnonzero(first < ids[k])
                    if len(hit):
                        cuts = np.flatnonzero(np.diff(hit) > 1)
                        for a, b in zip(hit[np.append(0, cuts + 1)], hit[np.append(cuts, len(hit) - 1)], strict=True):
                            found[ids[k], keys[k]].append((int(starts[k] + a), int(starts[k] + b + window)))
        spans = [np.array(_merged(s), "<i4").tobytes() for s in found.values()]
        return pd.DataFrame({"doc_id": [d[0] for d in found], "text_key": [d[1] for d in found], "gone": spans})

    return run


def _window_holders(window: int):
    """Of one block: the smallest and the largest holder of every distinct window of an anchor."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, codes = (np.concatenate([np.asarray(v) for v in frame[c]]) for c in ("ids", "codes"))
        fragments = [f for row in frame["fragments"] for f in row]
        order = np.argsort(codes, kind="stable")
        rows = []
        for group in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            held: dict[bytes, list[int]] = defaultdict(list)
            for k in group.tolist():
                held[fragments[k]].append(int(ids[k]))
            distinct = list(held)
            low: dict[bytes, int] = {}
            high: dict[bytes, int] = {}
            for fragment, first in zip(distinct, first_holders(distinct, [min(held[f]) for f in distinct], window), strict=True):
                most = max(held[fragment])
                for at, least in enumerate(first.tolist()):
                    text = fragment[at : at + window]
                    low[text] = least
                    high[text] = max(most, high.get(text, most))
            code = int(codes[group[0]])
            rows += [(*key, code, text, least, high[text]) for text, least in low.items()]
        return pd.DataFrame(rows, columns=["range", "block", "code", "window", "low", "high"])

    return run


def _settled_block(window: int):
    """Of one block, with the smallest holders (code, window, least) of windows over all blocks: the spans to remove, by document."""

    def run(frame: pd.DataFrame, least: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(zip(least["code"], map(bytes, least["window"]), strict=True), least["least"], strict=True))
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for row in frame.itertuples():
            for doc, key, start, code, fragment in zip(row.ids, row.keys, row.starts, row.codes, row.fragments, strict=True):
                for at in range(len(fragment) - window + 1):
                    if known.get((code, fragment[at : at + window]), doc) < doc:
                        found[doc, key].append((int(start + at), int(start + at + window)))
        spans = [np.array(_merged(s), "<i4").tobytes() for s in found.values()]
        return pd.DataFrame({"doc_id": [d[0] for d in found], "text_key": [d[1] for d in found], "gone": spans})

    return run


def _settled_spans(asked: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, gone: the spans to remove of the fragments to settle."""
    kinds = "doc_id long, text_key long, gone binary"
    settled = asked.where("block = 0").groupBy("range").applyInPandas(_settled(window), kinds)
    blocks = asked.where("block > 0")
    if not blocks.limit(1).count():
        return settled
    held = staged(blocks.groupBy("range", "block").applyInPandas(_window_holders(window), "range long, block long, code long, window binary, low long, high long"), "windows")
    merged = held.groupBy("code", "window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").drop("most")
    least = held.join(merged, ["code", "window"]).where("high > least").select("range", "block", "code", "window", "least")
    both = blocks.groupBy("range", "block").cogroup(least.groupBy("range", "block"))
    return settled.unionByName(both.applyInPandas(_settled_block(window), kinds))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans united where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of every document."""
    for batch in batches:
        rows = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, at, kept = text.encode(), 0, []
            spans = _merged(np.frombuffer(b"".join(gone), "<i4").reshape(-1, 2).tolist()) if gone else []
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            rows.append((len(data), sum(e - s for s, e in spans), len(spans), b"".join(kept)))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def shortened(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents (doc_id, n_bytes, n_removed, n_spans) with what is left of them (kept)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    n, size = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()
    n_ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    whole = rows.where((F.octet_length("text") >= window) & F.col("doc_id").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(_hot_anchors(whole, n, window, gram))
    found = whole.mapInArrow(_fragment_rows(n_ranges, hot, window, gram), _FOUND_KINDS)
    judged = staged(found.groupBy("range").applyInPandas(_judged(n_ranges, BLOCK_BYTES), "doc_id long, text_key long, gone binary, asked binary"), "judged")
    asked = judged.where(F.octet_length("asked") > 0).groupBy("doc_id", "text_key").agg(F.collect_list("asked").alias("asked"))
    asked = rows.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "asked")
    asked = asked.mapInArrow(_asked_rows, "range long, block long, ids array<long>, keys array<long>, starts array<int>, codes array<long>, fragments array<binary>")
    settled = _settled_spans(staged(asked, "asked"), window)
    gone = judged.where(F.octet_length("gone") > 0).select("doc_id", "text_key", "gone").unionByName(settled)
    gone = staged(gone.groupBy("doc_id", "text_key").agg(F.collect_list("gone").alias("gone")), "gone")
    drop_staged(judged)
    return rows.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty. Texts shorter than the window, and documents with a null id, lose nothing. Rows repeated with
    one id are judged each by its own text and give a row each; they aren't smaller than one another. Other columns
    are ignored; an empty table gives an empty result.
    """
    return shortened(docs, window, gram, id_col, text_col).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
