"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns give the base spans. The field labels the tokens around digits, at signs and spelled-out addresses by
the shapes of the word and its neighbours; it is trained from a small labelled table and decoded by Viterbi over
batches of windows in numpy. Its spans are added where they touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, so looking behind changes nothing but the time taken
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The labelled table: a pattern to fill in, and its kind between brackets. "9" stands for any digit and "w" for a
#: word; what stands outside brackets is no personal data.
TABLE = [
    "w w w [phone:999-9999] w w", "w call [phone:(999) 999-9999] w", "w w [phone:999 999 9999] w w", "w tel [phone:999.999.9999] w w",
    "phone : [phone:999-999-9999] w", "w w [phone:(999) 9999 9999] , w w", "w w [phone:99 99 99 99 99] w w", "w [phone:0999/999999] w",
    "w w [phone:(999)999-9999] w", "w . [phone:999-9999] . w", "mobile [phone:0999 9999999] w w", "w w [phone:00 99 999 9999999] w",
    "w w [email:w@w] w w", "w w [email:w (at) w (dot) w] w w", "w mail [email:w at w dot w] w w", "w w [email:w [at] w [dot] w] w",
    "w w [email:w99 (at) w9.w.w] w", "mail : [email:w.w (at) w.w] w w", "w w [email:w at w9 dot w dot w] , w",
    "w w [ip:999 . 99 . 99 . 999] w", "ip [ip:999,99,99,999] w w", "w ip [ip:99,9,9,9] w", "w w [ip:99-999-99-999] w", "w address [ip:999-99-9-99] w w", "w w [ip:999[.]99[.]99[.]999] w", "w host [ip:99,999,9,99] w", "w server [ip:99[.]9[.]9[.]9] , w", "w server [ip:9 . 99 . 999 . 9] w",
    "tel [phone:9999 9999] , w w", "w phone [phone:9999 9999] w", "w fax [phone:9999 9999] w w", "mobile : [phone:9999 9999] w", "fax [phone:999-9999] w", "tel . [phone:9999 9999] w", "w w [phone:0999 999 9999] w w", "w : [phone:0999 999 9999] (w w) .",
    "tel. [phone:999-9999] , w w", "w tel. [phone:9999 9999] , w", "[phone:999.999.9999] w w w", "w , w [phone:999.999.9999] w w", "w w w [phone:999.999.9999] , w", "[phone:0999 999 9999] w w w", "w w w [email:w at w dot w] w w", "[email:w at w dot w] w w w", "w , w [email:w at w dot w] w w", "w : [email:w at w dot w] (w w) .", "w [email:w99 (at) w.w.w] w w", "[email:w9 (at) w.w] w", "w : [email:w99 (at) w.w.w] (w w w) .",
    "w : [email:w (at) w (dot) w] (w w w) .", "w [email:w [at] w [dot] w] (w w) .", "w w at w w dot (w w) .", "w at w dot (w) w", "w w w at w dot .",
    "w card [card:9999.9999.9999.9999] w", "w w [card:9999/9999/9999/9999] w w", "w w [card:9999_9999_9999_9999] w w", "card : [card:9999.999999.99999] w",
    "w w [phone:+9 (999) 999-9999] w w", "w w [email:w.99@w9.w.w] w w", "w w w [email:w@w.w] w", "w w [ip:999.99.99.999] w w", "w w [ip:9.999.9.99] w",
    "w w 9999999999999999 w w", "w . w 9999999999999999 9999999999999999 w w .", "w w | 9999999999999999 | w w |", "w w w w 9999 9999 9999 9999 w w",
    "w w w w . w , w w w w w w 99 w w , w w w w . w w w", "w w , w w 999 w w w w . w w w w , w w w", "w w w w . License under CC w - w 9.9 . w w w w",
    "w*** w### w$$$ 999 w&&& w%%% w***", "w w w w token = \" 9w9999w9w99999w9w9999999w99w9 \" w w , w w w w . w w", "w . w w token = \" w9w999w99w9999w99w9999999w9 \" w w w , w",
    "w w w w w w", "w w , w w . w w", "w 99 w w", "w w 9999 w w", "w w 99999 w .", "w 9 w 9 w", "w w 99999999999999 w w", "w w 999999999999 w",
    "w , Version 9.9 .", "under CC w-w 9.9 .", "License , version 9 .", "w 9.99 w w", "w w 9,999.99 w", "99:99 w w", "w w 99:99:99 w", "w 9999-99-99 w w",
    "99/99/9999 w w", "w 99.99.9999 w", "token = \" 99w9w99ww999w9w99999w9w9 \" w", "key = \" w9w99w9w9999w99ww9w9w999 \" w w", "w9w w w", "w w w99 w w",
    "w 99 % w", "$ 99.99 w", "w # 99 w", "w @ w w", "w w @ 99 w", "@w w w", "w w at w w", "at w w w", "w ( 99 ) w", "w ( w ) w", "9 9 9 w", "w 99 w 99 w",
    "ISBN 999-9-99-999999-9 w w", "w ISBN 999-9-9999-9999-9 , w", "isbn : 9-999-99999-9 w", "w ISBN 9999999999999 w", "ISSN 9999-9999 w", "IBAN XX99 9999 9999 9999 9999 99 w", "w XX99 9999 9999 9999 9999 w",
    "w ratio 99:99:99:99 w", "w 999:999:99:99 w w", "w room 999-9999 w", "w order 9999-99999 w w", "invoice 999-9999-99 w", "w 9999-99-99 99:99:99 w", "w 99.99.9999 99:99 w", "w on 99-99-9999 w w",
    "version 9.9.9-99 w", "w v9.99.999 w", "w 9, 9, 9, 9 w w", "w 99, 99, 99 w 99 w", "w 9,999,999 w", "w 99-99 , 99-99 w", "w 999 999 999 w", "w 99.999.999 w w", "w section 9.9.99 w", "w section 9.9.9 w 9.9 w",
    "w 999-999 w", "pp. 99-999 w", "w 9999-9999 w w", "w w 9 - 9 w", "| w | 99 | w |", "w *** 99 w ### 9 w", "w [w] 99 w", "w dot w w", "w w dot w at w",
]
ROUNDS, STEPS, RATE, DECAY = 4, 150, 0.1, 1e-3
REACH = 2
#: Characters around a trigger that its window takes in; a token is never cut.
MARGIN = 40
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]| dot ", re.IGNORECASE)
CUES = ("at", "dot", "call", "tel", "phone", "mobile", "fax", "mail", "ip", "host", "server", "address", "card", "token", "key", "version", "section", "license", "isbn", "issn", "iban", "room", "order", "invoice", "ratio", "on")


def shape(token: str, spaced: bool) -> str:
    """A digit run's length, a cue word itself, a word's case, or the mark; and whether white space is before it."""
    if token[0].isdigit():
        kind = f"9x{min(len(token), 20)}"
    elif token[0].isalpha():
        low = token.lower()
        kind = low if low in CUES else "Word" if token[0].isupper() else "word"
    else:
        kind = token if token.isascii() else "?"
    return f"_{kind}" if spaced else kind


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, shape) of the tokens of a window."""
    out, last = [], -1
    for m in TOKEN.finditer(text, start, end):
        out.append((m.start(), m.end(), shape(m.group(), m.start() != last)))
        last = m.end()
    return out


def labelled_rows(rounds: int = ROUNDS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table filled in: texts with their spans (start, end, index in LABELS)."""
    draw, words = np.random.default_rng(5), ["the", "der", "maison", "Nord", "ando", "es", "Erin", "tion", "of", "Élan", "Th"]
    rows = []
    for _ in range(rounds):
        for line in TABLE:
            # ordinary words before and after, so that runs of them are known to be ordinary
            around = [" ".join(["w", "w,", "w", "w."][k % 4] for k in range(draw.integers(0, 9))) for _ in range(2)]
            text, spans = "", []
            line = f"{around[0]} {line} {around[1]}"
            for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[[^\[\]]*\])*\])", line):
                marked = re.fullmatch(r"\[(email|ip|card|phone):(.*)\]", part)
                body = marked[2] if marked else part
                filled = re.sub(r"(?<![A-Za-z])w+(?![A-Za-z])|9", lambda m: str(draw.integers(10)) if m[0] == "9" else "abcdef"[draw.integers(6)] if len(m[0]) > 1 else words[draw.integers(len(words))], body)
                if marked:
                    spans.append((len(text), len(text) + len(filled), LABELS.index(marked[1])))
                text += filled
            rows.append((text, spans))
    return rows


class Field:
    """The field: emission weights by label, offset and shape, and transition weights."""

    def __init__(self, rows: list[tuple[str, list[tuple[int, int, int]]]]):
        sentences = []
        for text, spans in rows:
            tokens = tokens_of(text, 0, len(text))
            sentences.append(([t[2] for t in tokens], [next((k for a, b, k in spans if a <= t[0] and t[1] <= b), 0) for t in tokens]))
        #: Shape 0 lies outside the window, shape 1 is any that the table doesn't hold.
        self.shapes = {s: k for k, s in enumerate(sorted({s for words, _ in sentences for s in words}), 2)}
        self.emit = np.zeros((2 * REACH + 1, len(self.shapes) + 2, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self._train([self.codes(words) for words, _ in sentences], [np.array(gold) for _, gold in sentences])

    def codes(self, shapes: list[str]) -> np.ndarray:
        return np.array([self.shapes.get(s, 1) for s in shapes], int)

    def scores(self, padded: np.ndarray) -> np.ndarray:
        """Emission scores of windows of shape codes, given with REACH zeros at both ends."""
        length = padded.shape[1] - 2 * REACH
        return sum(self.emit[k][padded[:, k : k + length]] for k in range(2 * REACH + 1))

    @staticmethod
    def padded(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in windows])
        out = np.zeros((len(windows), lengths.max() + 2 * REACH), int)
        for row, window in zip(out, windows, strict=True):
            row[REACH : REACH + len(window)] = window
        return out, lengths

    def _train(self, windows: list[np.ndarray], gold: list[np.ndarray]) -> None:
        """Gradient ascent on the conditional likelihood; expectations by the forward and backward recursions."""
        padded, lengths = self.padded(windows)
        n, length = len(windows), padded.shape[1] - 2 * REACH
        real = np.arange(length) < lengths[:, None]
        right = np.zeros((n, length, len(LABELS)))
        pairs = np.zeros_like(self.move)
        for at, labels in enumerate(gold):
            right[at, np.arange(len(labels)), labels] = 1
            np.add.at(pairs, (labels[:-1], labels[1:]), 1)
        moments = [np.zeros_like(w) for w in (self.emit, self.emit, self.move, self.move)]
        for step in range(1, STEPS + 1):
            emission = np.exp(self.scores(padded))
            jump = np.exp(self.move)
            forward, backward = np.zeros_like(emission), np.ones_like(emission)
            scale = np.ones((n, length))
            for t in range(length):
                new = emission[:, t] * (forward[:, t - 1] @ jump if t else 1)
                forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1] if t else new)
                scale[:, t] = np.where(real[:, t], forward[:, t].sum(1), 1)
                forward[:, t] /= scale[:, t, None] if t == 0 else np.where(real[:, t], scale[:, t], 1)[:, None]
            for t in range(length - 2, -1, -1):
                new = (emission[:, t + 1] * backward[:, t + 1]) @ jump.T / scale[:, t + 1, None]
                backward[:, t] = np.where(real[:, t + 1, None], new, 1)
            expected = forward * backward
            expected *= real[:, :, None] / np.maximum(expected.sum(2, keepdims=True), 1e-300)
            both = np.zeros_like(pairs)
            for t in range(length - 1):
                joint = forward[:, t, :, None] * jump * (emission[:, t + 1] * backward[:, t + 1])[:, None, :]
                both += (joint * (real[:, t + 1] / np.maximum(joint.sum((1, 2)), 1e-300))[:, None, None]).sum(0)
            slope = np.zeros_like(self.emit)
            for k in range(2 * REACH + 1):
                np.add.at(slope[k], padded[:, k : k + length][real], (right - expected)[real])
            for k, (weights, gradient) in enumerate(((self.emit, slope), (self.move, pairs - both))):
                gradient = gradient / n - DECAY * weights
                slow, square = moments[2 * k], moments[2 * k + 1]
                slow += 0.1 * (gradient - slow)
                square += 0.001 * (gradient**2 - square)
                weights += RATE * (slow / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)

    def decode(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequence of each window."""
        padded, lengths = self.padded(windows)
        emission = self.scores(padded)
        n, length, _ = emission.shape
        best, back = emission[:, 0], np.zeros((length, n, len(LABELS)), np.int8)
        for t in range(1, length):
            options = best[:, :, None] + self.move
            back[t] = options.argmax(1)
            inside = t < lengths
            best = np.where(inside[:, None], options.max(1) + emission[:, t], best)
            back[t][~inside] = np.arange(len(LABELS))
        path = np.zeros((n, length), np.int8)
        path[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = np.take_along_axis(back[t], path[:, t, None].astype(int), 1)[:, 0]
        return [row[:k] for row, k in zip(path, lengths, strict=True)]


def luhn(digits: str) -> bool:
    doubled = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        run = text[free:at] if at - free < 256 or text[at - 256 : at].strip(LOCAL) == "" else text[at - 256 : at]
        local = len(run) - len(run.rstrip(LOCAL))
        if local and (m := DOMAIN.match(text, at + 1)):
            found.append((at - local, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The pattern spans by kind: leftmost and non-overlapping, failing matches dropped without retries."""
    if not any(c in text for c in "0123456789@"):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    cards, phones = [], []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            cards.append(m.span())
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            phones.append(m.span())
    return [_emails(text) if "@" in text else [], ips, cards, phones]


def windows_of(text: str) -> list[tuple[int, int]]:
    """The stretches around triggers that the field decodes; all other tokens are ordinary."""
    out: list[tuple[int, int]] = []
    end = -1
    for m in TRIGGER.finditer(text):
        if m.end() + MARGIN // 2 < end:  # well inside the last window
            continue
        start = max(0, m.start() - MARGIN)
        while start and not text[start - 1].isspace() and m.start() - start < 4 * MARGIN:
            start -= 1
        end = min(len(text), m.end() + MARGIN)
        while end < len(text) and not text[end].isspace() and end - m.end() < 4 * MARGIN:
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: The forms of an address: a name, the at sign or its word, and a domain whose dots may be words too.
ADDRESS = re.compile(r"[\w.%+-]+(\s*(@|[\[(]at[\])])\s*[\w-]+((\.|\s*[\[(]dot[\])]\s*|\sdot\s)[\w-]+)*|\sat\s[\w-]+((\.|\s*[\[(]dot[\])]\s*|\sdot\s)[\w-]+)+)", re.IGNORECASE)
#: What makes a run of digits part of a longer one; and what a number too short to be whole must follow.
GOES_ON, GOES_BEFORE = re.compile(r"[-./:,_]\s?[0-9]|\s[0-9]{2}|[-/]\s?[A-Za-z]"), re.compile(r"([0-9][-./:,_]|[0-9]{2}\s|[A-Za-z][-/])$")
CALLED = re.compile(r"\b(call|tel|phone|mobile|fax|cell|telefon|handy|mobil|portable|móvil)\w*\W{0,4}$", re.IGNORECASE)


def _plausible(kind: str, text: str, start: int, end: int) -> bool:
    """What any span of the kind must hold; a span is never part of a longer word or number, and only addresses hold letters.

    Digits of an ip are four numbers up to 255 with one kind of separator; those of a card pass Luhn's check; a phone
    number of under ten digits follows a word that announces it.
    """
    span = text[start:end]
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    if kind == "email":
        return bool(ADDRESS.fullmatch(span))
    if any(map(str.isalpha, span)) or GOES_ON.match(text, end) or GOES_BEFORE.search(text[max(0, start - 2) : start]):
        return False
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and len(set(re.split(r"[0-9]+", span)[1:-1])) == 1 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 or (7 <= len(digits) and bool(CALLED.search(text[max(0, start - 24) : start])))


#: Tokens decoded at a time; windows of like length are decoded together.
TOKENS_AT_ONCE = 200_000


class Finder:
    """Finds all spans of texts: base spans and those that the field adds."""

    def __init__(self):
        self.field = Field(labelled_rows())

    def added(self, texts: list[str], bases: list[list[list[tuple[int, int]]]]) -> list[list[list[tuple[int, int]]]]:
        out: list[list[list[tuple[int, int]]]] = [[[], [], [], []] for _ in texts]
        held, tokens = [], 0
        for at, text in enumerate(texts):
            for start, end in windows_of(text):
                if words := tokens_of(text, start, end):
                    held.append((at, words))
                    tokens += len(words)
                    if tokens > TOKENS_AT_ONCE:
                        self._decode(held, texts, bases, out)
                        held, tokens = [], 0
        if held:
            self._decode(held, texts, bases, out)
        for spans in out:
            for kind in spans:
                kind.sort()
        return out

    def _decode(self, held: list, texts: list[str], bases: list, out: list) -> None:
        held.sort(key=lambda h: len(h[1]))
        for first in range(0, len(held), 256):
            part = held[first : first + 256]
            paths = self.field.decode([self.field.codes([w[2] for w in words]) for _, words in part])
            for (at, words), path in zip(part, paths, strict=True):
                if not path.any():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if path[a]:
                        start, end, kind = words[a][0], words[b - 1][1], LABELS[path[a]]
                        clear = all(end <= s or start >= e for spans in bases[at] for s, e in spans)
                        if clear and _plausible(kind, texts[at], start, end):
                            out[at][path[a] - 1].append((start, end))

    def find(self, texts: list[str]) -> tuple[list, list]:
        bases = [base_spans(t) for t in texts]
        return bases, self.added(texts, bases)


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end of all spans, by kind as listed, then start."""
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


_FINDER: list[Finder] = []
TEXTS_AT_ONCE = 500


def _finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans for every row.

    Positions are code points, ends exclusive. Null text is empty and has no spans; texts of any length are read whole.
    Base spans of different kinds may overlap and all stay; a span that touches one of them is not added. Null ids are
    kept, repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for first in range(0, len(texts), TEXTS_AT_ONCE):
                for base, more in zip(*_finder().find(texts[first : first + TEXTS_AT_ONCE]), strict=True):
                    whole = [sorted(a + b) for a, b in zip(base, more, strict=True)]
                    rows.append((*map(len, base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(whole)))
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null text stays null."""

    @F.pandas_udf("string")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            values = list(column)
            out = []
            for first in range(0, len(values), TEXTS_AT_ONCE):
                part = [t or "" for t in values[first : first + TEXTS_AT_ONCE]]
                for text, base, more in zip(part, *_finder().find(part), strict=True):
                    out.append(_masked_text(text, [(a, b, k) for k, spans in enumerate(base + more) for a, b in spans]))
            yield pd.Series([None if v is None else o for v, o in zip(values, out, strict=True)], dtype=object)

    return docs.withColumn(text_col, mask(F.col(text_col)))


def _masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are replaced as one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind % 4].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
