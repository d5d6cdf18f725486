"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text starts as single characters. All adjacent pairs whose join is a piece wait in an agenda, the best score first
and the leftmost of equals; the pair taken becomes one symbol, and the pairs it makes with its neighbours are added. What no piece holds is spelled in
byte pieces. For words, which are short and many, the agendas of thousands are arrays from which each round takes every
word's best pair; for what is long the agenda is a heap, where a pair one of whose symbols has since been merged is
passed over.

Where no piece holds two characters next to each other, no merge can cross, so texts are cut there into words, which
are encoded one by one and remembered. The words that an Arrow batch brings are also encoded by the sentencepiece
library, in one call, and compared.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space.
MARK = "▁"
#: Fixed values of the model format: the merge type of model, and the types of pieces.
MERGES, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6
#: Bytes of words and their ids that a worker remembers, and of an entry besides these; longer words are never kept.
MEMO_BYTES, ENTRY_BYTES, MEMO_WORD = 160 << 20, 260, 64
#: The rank of pairs that are no piece.
NO_PIECE = 1 << 30
#: Characters of texts whose words are learned at once; a longer text is taken by itself.
PART = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """The fields of a protocol-buffer message: number and value, as integer, 32-bit float or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            width = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + width], at + width
            yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


class PieceCodec:
    """A vocabulary with its agenda, what it remembers, and the library's processor to compare with.

    ValueError for models that aren't of the merge type with byte pieces, or that normalise text in more ways than
    marking spaces and beginning with one.
    """

    def __init__(self, model: bytes):
        pieces, settings = [], {2: {}, 3: {}}
        for number, value in _fields(model):
            if number == 1:
                held = dict(_fields(value))
                pieces.append((held.get(1, b"").decode(), held.get(2, 0.0), held.get(3, NORMAL)))
            elif number in settings:
                settings[number] = dict(_fields(value))
        trainer, normaliser = settings[2], settings[3]
        if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the vocabulary must be of the merge type, with byte pieces and none that are unused or defined by a user")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model's normaliser must begin a text with a space and change nothing else")
        scores = sorted({score for _, score, kind in pieces if kind == NORMAL}, reverse=True)
        place = {score: i for i, score in enumerate(scores)}
        #: Pieces by the rank of their score, the best 0; equal scores have equal ranks.
        self.ranks = {piece: place[score] for piece, score, kind in pieces if kind == NORMAL}
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        of_byte = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [of_byte[f"<0x{b:02X}>"] for b in range(256)]
        self._pair_tables()
        self.word = regex.compile(self._word_pattern())
        held = {c for piece in self.ranks for c in piece}
        #: A character that no piece holds: what follows it is encoded by the library as if nothing came before.
        self.stop = next(c for c in map(chr, range(1, 0x110000)) if c not in held)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.stop_ids = len(self.library.encode(self.stop))
        self.memo: dict[str, tuple[str, list[int]]] = {}
        self.memo_bytes = 0
        #: Words that the library encodes otherwise.
        self.differing: set[str] = set()

    def _word_pattern(self) -> str:
        """Words: marks and characters linked, directly or through others, by standing together in pieces.

        Where a piece has a mark behind another character, a text is one word.
        """
        if any(MARK in piece.lstrip(MARK) for piece in self.ranks):
            return "(?s:.+)"
        group = {c: c for piece in self.ranks for c in piece if c != MARK}

        def first(c: str) -> str:
            while group[c] != c:
                c = group[c]
            return c

        for piece in self.ranks:
            bare = piece.lstrip(MARK)
            for a, b in zip(bare, bare[1:], strict=False):
                group[first(a)] = first(b)
        linked: dict[str, list[str]] = {}
        for c in group:
            linked.setdefault(first(c), []).append(c)
        twice = {first(c) for piece in self.ranks if len(piece.lstrip(MARK)) > 1 for c in piece.lstrip(MARK)[:1]}
        runs = ["[" + "".join(map(regex.escape, sorted(chars))) + "]+" for c, chars in sorted(linked.items(), key=lambda g: -len(g[1])) if c in twice]
        return f"{MARK}*(?:" + "|".join([*runs, f"[^{MARK}]"]) + f")|{MARK}+"

    def merged(self, word: str) -> list[str]:
        """The symbols that the agenda, a heap, leaves of a word."""
        ranks, symbols = self.ranks, list(word)
        last = len(symbols) - 1
        # an entry is the rank of a pair's score, the places of its symbols, and its length, which tells whether they still stand
        agenda = [(ranks[joined], left, left + 1, 2) for left, joined in enumerate(map(str.__add__, symbols, symbols[1:])) if joined in ranks]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != size:
                continue
            symbols[left], symbols[right] = joined, _ = first + second, ""
            after[left] = further = after[right]
            if further >= 0:
                before[further] = left
                if (wider := joined + symbols[further]) in ranks:
                    heapq.heappush(agenda, (ranks[wider], left, further, len(wider)))
            if (nearer := before[left]) >= 0 and (wider := symbols[nearer] + joined) in ranks:
                heapq.heappush(agenda, (ranks[wider], nearer, left, len(wider)))
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> list[int]:
        found: list[int] = []
        for symbol in self.merged(word):
            known = self.ids.get(symbol)
            found += [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]
        return found

    def _pair_tables(self) -> None:
        """Numbers for all symbols that may arise, and the adjacent pairs of them that are pieces, by number."""
        symbols = {c: i for i, c in enumerate(dict.fromkeys([*self.ranks, *(c for piece in self.ranks for c in piece)]))}
        self.of_char = np.full(0x110000, len(symbols), np.int64)
        self.of_char[[ord(c) for c in symbols if len(c) == 1]] = [i for c, i in symbols.items() if len(c) == 1]
        #: The id of each symbol; of one that is no piece, or of any other character, none.
        self.id_of = np.array([*(self.ids.get(c, -1) for c in symbols), -1])
        self.width = len(symbols) + 1
        pairs = {}
        for piece, rank in self.ranks.items():
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (rank, symbols[piece])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in self.pairs.tolist()), NO_PIECE], np.int64)
        self.pair_symbol = np.array([*(pairs[k][1] for k in self.pairs.tolist()), 0], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of pairs of symbols; the last number where they are no piece."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, len(self.pairs))

    def all_word_ids(self, words: list[str]) -> list[list[int]]:
        """word_ids() of many words at once: the agenda is an array of the words' pairs, of which each round takes every
        word's best, and the leftmost of equals."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        symbol = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(words)), sizes)
        pair = np.append(self._pair(symbol[:-1], symbol[1:]), len(self.pairs))
        pair[np.cumsum(sizes) - 1] = len(self.pairs)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(self.pair_rank[pair] << 32 | np.arange(len(pair)), starts)
            going = best >> 32 < NO_PIECE
            open_ = np.repeat(going, np.diff(starts, append=len(owner)))
            if not going.all():
                done.append((owner[~open_], symbol[~open_]))
            at = best[going] & 0xFFFFFFFF
            symbol[at] = self.pair_symbol[pair[at]]
            pair[at] = pair[at + 1]  # until the new neighbours' pairs are known
            open_[at + 1] = False
            place = np.cumsum(open_) - 1
            owner, symbol, pair, at = owner[open_], symbol[open_], pair[open_], place[at]
            if len(owner):
                after, before = at[(at + 1 < len(owner))], at[at > 0]
                after, before = after[owner[after] == owner[np.minimum(after + 1, len(owner) - 1)]], before[owner[before] == owner[before - 1]]
                pair[after] = self._pair(symbol[after], symbol[after + 1])
                pair[before - 1] = self._pair(symbol[before - 1], symbol[before])
        owner, symbol = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        ids, ends = self.id_of[symbol[order]], np.cumsum(np.bincount(owner, minlength=len(words)))
        spelled = set(owner[order][ids < 0].tolist())  # in byte pieces
        listed, begin, out = ids.tolist(), 0, []
        for k, end in enumerate(ends.tolist()):
            out.append(self.word_ids(words[k]) if k in spelled else listed[begin:end])
            begin = end
        return out

    def _words(self, text: str) -> list[str]:
        """The words of a text, which begins with a mark unless it is empty."""
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> dict[str, tuple[str, list[int]]]:
        """Encode words, compare them with the library's encoding, and remember all but the longest, which are returned."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        new, beside = [w for w in words if w not in self.memo], {}
        theirs = self.library.encode([self.stop + w for w in new], num_threads=1) if new else []
        short = [w for w in new if len(w) <= MEMO_WORD]
        found = dict(zip(short, self.all_word_ids(short), strict=True))
        for word, library in zip(new, theirs, strict=True):
            ids = found[word] if word in found else self.word_ids(word)
            if library[self.stop_ids :] != ids:
                self.differing.add(word)
            entry = ",".join(map(str, ids)), ids
            if len(word) > MEMO_WORD:
                beside[word] = entry
            else:
                self.memo[word] = entry
                self.memo_bytes += ENTRY_BYTES + 4 * len(word) + 16 * len(ids)
        return beside

    def encode(self, text: str) -> list[int]:
        return [i for word in self._words(text) for i in self.word_ids(word)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, bool]]:
        """For each text: number of ids, sha256 of the ids joined by commas, sha256 of the text decoded from them, and
        whether the library gives the same ids for all its words."""
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= PART:
                held, end = held + len(texts[end]), end + 1
            split = [self._words(t) for t in texts[at:end]]
            distinct = {w for words in split for w in words}
            known = self.memo if not (beside := self.learn(distinct)) else ChainMap(beside, self.memo)
            for words in split:
                found = list(map(known.__getitem__, words))
                ids = list(chain.from_iterable([f[1] for f in found]))
                joined, agrees = ",".join([f[0] for f in found]), self.differing.isdisjoint(words)
                yield len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest(), agrees
            at = end


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, made once in a process."""
    if path not in _CODECS:
        with open(path, "rb") as model:
            _CODECS[path] = PieceCodec(model.read())
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids array<int>, without begin and end. Null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec(model_path).encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """One row per document of encode_pieces(): doc_id and the decoded text; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model_path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees (the library gives the same ids).

    Null text is empty: no ids, and both digests are those of the empty string. A very long text is encoded by itself,
    word by word; one that can't be cut is one word. Repeated rows give repeated rows; null ids stay;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(codec(model_path).digests([t or "" for t in batch.column(1).to_pylist()]))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
