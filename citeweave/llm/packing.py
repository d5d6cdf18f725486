"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

Documents are cut into full-length pieces and a tail. The tails' length histogram is packed longest first:
each length goes to the open pattern with the most room left, as often as the pattern has packs, and the packing
pattern counts are updated. Only the histogram reaches the driver, and it has at most as many entries as a
sequence has tokens. Pieces then find their pattern by length and by their rank among pieces of that length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from citeweave.llm.bpe import byte_letters
from citeweave.llm.common import staged

SEQUENCE, END_ID = 4096, 2
#: Bytes that remembered words take at most, about, and bytes of an entry besides its word and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 140
TEXTS_AT_ONCE = 200
#: Buckets in which pieces of one length are ranked: this many, or one for so many pieces where there are more of them.
RANK_BUCKETS, PIECES_PER_BUCKET = 1024, 1 << 14


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, by words between white space, which are remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words. A word of
    letters, and marks after it, are pre-tokens of their own; the letters go to the merges without the library's
    bookkeeping. All other words take the library's whole way, which reads the names of special tokens as these.
    """

    #: Up to here lower-casing is letter by letter, and every letter is its own normal form.
    LATIN_END = "\u024f"
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0
        #: Characters that str.split() treats as white space and the tokenizer may not.
        self.odd = regex.compile("[\x1c-\x1f\x85]")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        if word.isascii():
            mapped = word
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped)])

    def _part(self, part: str) -> bytes:
        """A lower-case word of letters, or a run of marks."""
        if part not in self.parts:
            self.parts[part] = self._letters(part) if part[0] not in self.MARKS else self.encode(part)
            self.held += ENTRY_BYTES + 5 * len(part)
        return self.parts[part]

    def encode_word(self, word: str) -> bytes:
        core = word.rstrip(self.MARKS)
        low = core.lower()
        if low.isalpha() and max(low) <= self.LATIN_END and core.isalpha():
            return self._part(low) + (self._part(word[len(core) :]) if len(core) < len(word) else b"")
        return self.encode(word)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.parts.clear()
            self.held = 0
        out = []
        for text in texts:
            if self.odd.search(text):
                out.append(self.encode(text))
                continue
            words = text.split()
            found = list(map(self.memo.get, words))
            if None in found:
                for word in {w for w, f in zip(words, found, strict=True) if f is None}:
                    self.memo[word] = self.encode_word(word)
                    self.held += ENTRY_BYTES + 5 * len(word)
                found = list(map(self.memo.__getitem__, words))
            out.append(b"".join(found))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    A document is the ids of its text and then ``end_id``; null text is empty.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokenizer(tokenizer_path)
        words = _TOKENIZERS[tokenizer_path]
        for batch in batches:
            texts, at, rows = [t or "" for t in batch.column(1).to_pylist()], [], []
            for first in range(0, len(texts), TEXTS_AT_ONCE):
                for k, data in enumerate(words.encode_all(texts[first : first + TEXTS_AT_ONCE]), first):
                    data += end
                    for start in range(0, len(data), 4 * sequence):
                        part = data[start : start + 4 * sequence]
                        at.append(k)
                        rows.append((start // 4, len(part) // 4, zlib.crc32(part), len(data) // 4))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Shortest-pack-first packing of a histogram of lengths.

    Returns rows (length, first rank, count, first sequence id, offset): the pieces of ``length`` with ranks from
    ``first rank`` on go, one each, to the sequences from ``first sequence id`` on, at ``offset``.
    """
    open_packs: list[tuple[int, int, int]] = []  # (used tokens, pattern, number of packs), the emptiest first
    parent: list[tuple[int, int, int]] = []  # of a pattern: the pattern it extends, the length added, at which offset
    closed: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        extended = []
        while left and open_packs and open_packs[0][0] + length <= sequence:
            used, pattern, packs = heapq.heappop(open_packs)
            here = min(left, packs)
            if packs > here:
                heapq.heappush(open_packs, (used, pattern, packs - here))
            parent.append((pattern, length, used))
            heapq.heappush(open_packs, (used + length, len(parent) - 1, here))
            left -= here
        if left:
            parent.append((-1, length, 0))
            extended.append((length, len(parent) - 1, left))
        for pack in extended:
            heapq.heappush(open_packs, pack)
        while open_packs and open_packs[0][0] == sequence:
            closed.append(heapq.heappop(open_packs)[1:])
    patterns = sorted(closed + [p[1:] for p in open_packs])
    segments, next_rank, sequence_id = [], dict.fromkeys(counts, 0), 0
    for pattern, packs in patterns:
        step = pattern
        while step >= 0:
            step, length, offset = parent[step]
            segments.append((length, next_rank[length], packs, sequence_id, offset))
            next_rank[length] += packs
        sequence_id += packs
    return np.array(sorted(segments), np.int64).reshape(-1, 5)


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with their sequence_id and offset; ``found`` must be a written table, as it is read twice.

    Pieces are ranked among those of their length by a bucket of their document's hash, then document and start,
    so a length that many pieces have is ranked in many tasks, whose size doesn't grow with the table.
    """
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(RANK_BUCKETS, found.count() // PIECES_PER_BUCKET))))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    running = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = staged(sizes.withColumn("base", F.coalesce(F.sum("n").over(running), F.lit(0))), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = found.sparkSession.sparkContext.broadcast(pack_histogram(counts, sequence))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("nth", F.row_number().over(within) - 1).join(bases.select("length", "bucket", "base"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            ids, offsets = table[at, 3] + rank - table[at, 1], table[at, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(ids), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; a text of any length is cut into pieces of a whole sequence and a rest.
    Null ids and repeated rows are packed as often as they occur; pieces alike in all their columns may change places.
    Other columns are ignored. An empty table gives an empty result.
    """
    return pack(staged(pieces(docs, tokenizer_path, sequence, end_id, id_col, text_col), "pieces"), sequence)
