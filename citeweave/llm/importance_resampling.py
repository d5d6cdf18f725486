"""Resampling of a corpus towards a target distribution, by hashed n-gram features composed with CRC algebra.

A text's features are all runs of one to three consecutive words, hashed to buckets by the CRC of the words joined by
spaces. The CRC of each word is computed once; since a CRC is linear over GF(2), the CRC of two strings one after the
other is the first one's, carried over the length of the second by a 32 x 32 matrix of bits, plus the second one's. So
the buckets of n-grams come from the CRCs and lengths of words, and no n-gram is ever spelled.

One pass counts the buckets of the corpus and of the target texts, from which each bucket has a gain; a second pass
adds up the gains of every document's features. A fixed share of the documents is then drawn without replacement by
adding Gumbel noise, which hashes of ids give, and taking the highest sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import positioned, scratch, staged

BUCKETS, WORDS = 10_000, 3
#: Documents with fewer words aren't drawn; of the others this percentage is.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Fixed value: the reflected polynomial of the CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes of texts whose features are computed at once, and words up to this length whose CRCs are computed together.
BYTES_AT_ONCE, SHORT = 1 << 21, 32


def _byte_table() -> np.ndarray:
    """The CRC register's change for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _carried(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values times a matrix over GF(2), kept as the images of all bytes in each of four places."""
    return matrix[0][values & 0xFF] ^ matrix[1][values >> 8 & 0xFF] ^ matrix[2][values >> 16 & 0xFF] ^ matrix[3][values >> 24]


def _shift_matrices() -> list[np.ndarray]:
    """Matrices that carry a CRC over 1, 2, 4 ... bytes, each the square of the one before."""
    every = np.arange(256, dtype=np.uint32)
    step = BYTE_TABLE
    one = np.stack([step[every], *[every << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])
    found = [one]
    for _ in range(31):
        found.append(np.stack([_carried(found[-1], column) for column in found[-1]]))
    return found


BYTE_TABLE = _byte_table()
SHIFTS = _shift_matrices()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs carried over as many bytes, by the matrices of the lengths' binary digits."""
    out = crc
    for k in range(int(lengths.max(initial=0)).bit_length()):
        out = np.where(lengths >> k & 1, _carried(SHIFTS[k], out), out)
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, second_lengths: np.ndarray) -> np.ndarray:
    """CRCs of strings one after the other, from theirs and the lengths of the second ones."""
    return shifted(first, second_lengths) ^ second


#: Bytes of words: digits, letters without marks, and all of characters beyond ASCII; A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.array([b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each word, byte by byte for all words at once; long words one by one."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(lengths <= SHORT)
    for k in range(SHORT):
        left = left[lengths[left] > k]
        if not len(left):
            break
        register = crc[left]
        crc[left] = BYTE_TABLE[(register ^ data[starts[left] + k]) & 0xFF] ^ register >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    for at in np.flatnonzero(lengths > SHORT):
        crc[at] = zlib.crc32(data[starts[at] : starts[at] + lengths[at]])
    return crc


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature, and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = ends - starts
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, starts, side="right")
    crc = word_crcs(data, starts, lengths)
    space = np.full(1, zlib.crc32(b" "), np.uint32)
    owners, buckets, run = [owner], [crc % BUCKETS], crc
    for n in range(1, WORDS):
        # runs of n words, a space, and the word after them, where that is of the same text
        whole = np.flatnonzero(owner[n:] == owner[:-n]) if len(owner) > n else np.zeros(0, np.int64)
        last = whole + n
        spaced = joined_crc(run[whole], space, np.ones(1, np.int64))
        longer = np.zeros(len(owner), np.uint32)
        longer[whole] = joined_crc(spaced, crc[last], lengths[last])
        owners.append(owner[whole])
        buckets.append(longer[whole] % BUCKETS)
        run = longer
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts (null is empty), about BYTES_AT_ONCE at a time or one longer text, with the first one's place."""
    begin, held, size = 0, [], 0
    for at, text in enumerate(batch.column(column).to_pylist()):
        held.append(text.encode() if text else b"")
        size += len(held[-1])
        if size >= BYTES_AT_ONCE:
            yield begin, held
            begin, held, size = at + 1, [], 0
    if held:
        yield begin, held


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n: how often features of the texts fall in each bucket that occurs; one row a bucket leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, portion in _portions(batch, 0):
                counts += np.bincount(features(portion)[1], minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of all BUCKETS buckets, from the counts (bucket, n) of the corpus and of the target."""
    spark = corpus.sparkSession
    counts = spark.range(BUCKETS).select(F.col("id").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counts = counts.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.col("all_s") + BUCKETS)) / ((s + 1) * (F.col("all_t") + BUCKETS))
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # sums is one row


def weights(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document; gains: bucket, gain of all BUCKETS buckets."""
    gain = np.zeros(BUCKETS, np.int64)
    for row in gains.collect():  # a fixed number of rows
        gain[row["bucket"]] = row["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, portion in _portions(batch, 1):
                owner, bucket, words = features(portion)
                n = np.bincount(owner, minlength=len(portion))
                # sums of whole numbers far below 2 ** 53 are exact in doubles
                weight = np.bincount(owner, gain[bucket], len(portion)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(portion)), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel variate by an id, null as empty, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1 is the highest; null where it isn't drawn).

    Of the documents with ``least_words`` words or more the given percentage is drawn, rounded down, by score, then the
    smaller doc_id, a null one last. Null and empty texts have no features and weight 0; repeated rows are ranked one
    after another; other columns are ignored; without documents there are no rows, without target texts every bucket's
    share of the target is the same. A very long text's features are computed by themselves.
    """
    with scratch(docs.sparkSession) as keep:
        gains = staged(bucket_gains(bucket_counts(docs), bucket_counts(target)), "gains")
        found = staged(weights(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))).withColumn("_tie", F.rand(7)), "weights")
        eligible = found.where(F.col("n_words") >= least_words)
        drawn = eligible.count() * percent // 100
        ranked = positioned(eligible, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")], "rank")
        ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
        out = ranked.unionByName(found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
        return keep(out.select("doc_id", "n_features", "weight", "score", "rank"), "resampled")


RESAMPLING_SQL = """
WITH t AS (
  SELECT i AS byte, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)) AS change
  FROM range(256) r(i)
), c AS (SELECT list(change ORDER BY byte) AS changes FROM t),
x AS (
  SELECT doc_id, 1 AS of, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, 2, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), f AS (
  SELECT doc_id, of, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM x WHERE len(w) > 0
), n AS (SELECT doc_id, of, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(code) // 2 + 1), lambda i: ('0x' || code[2 * i - 1:2 * i])::bigint)),
    lambda crc, byte: xor(crc >> 8, changes[(xor(crc, byte) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(feature) AS code, changes FROM (SELECT DISTINCT feature FROM n) CROSS JOIN c)
), b AS (
  SELECT bucket, coalesce(sum(n) FILTER (of = 1), 0) AS s, coalesce(sum(n) FILTER (of = 2), 0) AS t FROM n JOIN h USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::double * ((SELECT sum(s) FROM b) + 10000)::double) / ((s + 1)::double * ((SELECT sum(t) FROM b) + 10000)::double)))::bigint AS gain FROM b
), v AS (SELECT doc_id, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS weight FROM n JOIN h USING (feature) JOIN g USING (bucket) WHERE of = 1 GROUP BY doc_id),
d AS (
  SELECT x.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || x.doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM x LEFT JOIN v ON v.doc_id = x.doc_id WHERE of = 1
), e AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE words >= 20
)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= n * 5 // 100 THEN rank END AS rank FROM d LEFT JOIN e USING (doc_id)
"""
