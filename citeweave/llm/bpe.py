"""Byte-level BPE encoding and decoding through a sentencepiece model written from the vocabulary.

The rank file is turned into a serialised sentencepiece model: every piece is the byte string with each
byte mapped to a printable character, its score is the negative rank and the normaliser is the identity.
Merging the best-scored adjacent pair is then merging the lowest rank. Pre-tokens are encoded one by one,
and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that remembered words take at most, about, bytes of an entry besides its contents, and characters of the longest word.
MEMO_BYTES, ENTRY_BYTES, LONGEST_WORD = 256 << 20, 250, 1000
TEXTS_AT_ONCE = 200
#: Bytes that stand for themselves in a piece; the others take the code points from 256 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> list[str]:
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in PRINTABLE:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes after the last rank."""
    letters = byte_letters()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[token] for token in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1) for rank, token in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes pre-tokens and decodes ids; remembers what words encode to, up to MEMO_BYTES.

    ``spaced`` promises that the pattern joins a space to what follows it, unless the space is followed by another or
    ends the text, so that a text can be cut before its spaces. Without it every text is encoded as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = sorted(ranks, key=ranks.get)
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.spaced = spaced
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        data = [p.encode() for p in pieces]
        whole = [self.ranks.get(d) for d in data]
        rest = [i for i, w in enumerate(whole) if w is None]
        out = [[w] for w in whole]
        mapped = ["".join(map(self.letters.__getitem__, data[i])) for i in rest]
        for i, ids in zip(rest, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(self.pattern.findall(text)) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def words(self, text: str) -> tuple[str, list[str]] | None:
        """The text up to its first space, and the words after each space; None where spaces don't end pre-tokens, or a word is too long to be remembered."""
        if not self.spaced or "  " in text or text.endswith(" "):
            return None
        first, *rest = text.split(" ")
        return None if any(len(w) > LONGEST_WORD for w in rest) else (first, rest)

    def learn(self, words: set[str]) -> None:
        """Remember what a space and each of these words encode to."""
        ordered = list(words)
        split = [self.pattern.findall(" " + w) for w in ordered]
        pieces = list({p for found in split for p in found})
        ids_of = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for word, found in zip(ordered, split, strict=True):
            ids = [i for p in found for i in ids_of[p]]
            joined, data = ",".join(map(str, ids)), self.decode(ids)
            self.memo[word] = (joined, data)
            self.held += ENTRY_BYTES + 2 * len(word) + len(joined) + len(data)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, sha256 of the ids joined by commas, sha256 of the bytes decoded from them."""
        split = [self.words(t) for t in texts]
        new = {w for found in split if found for w in found[1]}.difference(self.memo)
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
            new = {w for found in split if found for w in found[1]}
        self.learn(new)
        for text, found in zip(texts, split, strict=True):
            ids = self.encode(found[0] if found else text)
            known = list(map(self.memo.__getitem__, found[1])) if found else []
            start = [",".join(map(str, ids))] if ids else []
            joined = ",".join(start + [k[0] for k in known])
            decoded = b"".join([self.decode(ids), *[k[1] for k in known]])
            yield joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _codec(cache: dict, path: str, pattern: str, spaced: bool = False) -> Codec:
    if (path, pattern, spaced) not in cache:
        cache[path, pattern, spaced] = Codec(read_ranks(path), pattern, spaced)
    return cache[path, pattern, spaced]


_CODECS: dict[tuple[str, str, bool], Codec] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids array<int>. Null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_CODECS, ranks_path, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document of encode_documents(): doc_id and the decoded text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_CODECS, ranks_path, pattern)
        for batch in batches:
            data = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, data binary")


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each match of ``pattern`` is encoded on its own; ``spaced`` is the promise of Codec about it, which makes long runs
    of known words cheap. Null text is empty: no ids, and both digests are those of the empty string. Texts of any
    length are encoded whole, in memory that grows with the texts of a batch only. Null ids are kept, repeated rows
    give repeated rows; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_CODECS, ranks_path, pattern, spaced)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [f for at in range(0, len(texts), TEXTS_AT_ONCE) for f in codec.digests(texts[at : at + TEXTS_AT_ONCE])]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
