"""Target-distribution importance resampling: documents are drawn by how much their word n-grams look like a target's.

One scan of each text keeps a ring of running CRC-32 states, one for each of the last n word starts; a word extends every
state by a space and itself, and each state taken modulo the number of buckets is the bucket of the n-gram that ends there.
What a text leaves behind is its buckets, or their counts where it has very many, so that the corpus is read once. Counts
by bucket give each bucket's gain, gains give weights, and Gumbel noise from a hash of the id makes the highest scores a
draw without replacement. Ranks come from a histogram of the integer scores and a window within each score.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sliced, stored

#: Bytes of a text that are split into words at once.
SCAN_BYTES = 1 << 20
#: Features beyond which a text leaves counts by bucket and not each bucket.
LISTED = 1 << 16

#: Letters and digits in lower case and all bytes beyond ASCII stay; every other byte parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_in(text: bytes, step: int = SCAN_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, some at a time: no list holds more than about step bytes of text."""
    plain = text.translate(_WORD_BYTES)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + step) if start + step < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def crc_ring(words: Iterable[bytes], n: int, ring: list[int], out: array) -> list[int]:
    """Append to out the CRC-32 of every run of 1 to n words that ends in one of words. ring holds the states of the last
    starts, newest first; the ring after the last word is returned, so a text can be scanned in parts."""
    for word in words:
        spaced = b" " + word
        ring = [crc32(word), *[crc32(spaced, state) for state in ring[: n - 1]]]
        out.extend(ring)
    return ring


def scan_text(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray | None]:
    """(number of words, buckets, counts): each feature's bucket and no counts, or distinct buckets and their counts."""
    n_words, ring, out, total = 0, [], array("I"), None
    for words in words_in(text):
        n_words += len(words)
        ring = crc_ring(words, n, ring, out)
        if len(out) > LISTED:
            held = np.bincount(np.frombuffer(out, np.uint32) % buckets, minlength=buckets)
            total = held if total is None else total + held
            out = array("I")
    found = np.frombuffer(out, np.uint32) % buckets
    if total is None:
        return n_words, found.astype("<u4"), None
    total = total + np.bincount(found, minlength=buckets)
    seen = np.flatnonzero(total)
    return n_words, seen.astype("<u4"), total[seen].astype("<i8")


def scan(docs: DataFrame, n: int, buckets: int, id_col: str | None, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row. buckets are little-endian numbers of two bytes, or of four
    where there are more than 65,536 of them; counts are numbers of eight bytes, null where every count is one."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            got = [scan_text(x or b"", n, buckets) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_words": pa.array([g[0] for g in got], pa.int64()),
                    "n_features": pa.array([len(g[1]) if g[2] is None else int(g[2].sum()) for g in got], pa.int64()),
                    "buckets": pa.array([g[1].astype(kind).tobytes() for g in got], pa.binary()),
                    "counts": pa.array([None if g[2] is None else g[2].tobytes() for g in got], pa.binary()),
                }
            )

    ids = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")
    return docs.select(ids.alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary, counts binary")


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one partial histogram a task, then sums; as many numbers as buckets come back."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            plain = []
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c is None:
                    plain.append(b)
                else:
                    np.add.at(total, np.frombuffer(b, kind), np.frombuffer(c, "<i8"))
            total += np.bincount(np.frombuffer(b"".join(plain), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for bucket, n in scanned.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket: its share of the target over its share of the corpus, both with one feature more in every bucket."""
    k, s, t = len(raw), raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a row's features, 0 without any."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for b, c, n in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("buckets", "counts", "n_features")), strict=True):
                of = gain[np.frombuffer(b, kind)]
                total = int(of.sum()) if c is None else int(of @ np.frombuffer(c, "<i8"))
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return scanned.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored (a stored table) with rank: of the N rows of at least min_words words, the floor(percent N / 100) highest scores, from 1.

    Scores are whole thousandths of a logarithm, so there are some ten thousand of them whatever the rows: their histogram
    is small, and gives how many rows stand before each score. Rows of one score are ordered among themselves.
    """
    can = scored.where(F.col("n_words") >= min_words)
    levels = can.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = stored(levels.select("score", (above - F.col("n")).alias("before"), above.alias("upto")), "levels")
    top = levels.agg(F.max("upto")).first()[0] or 0
    drawn = top * percent // 100
    reached = levels.where(F.col("before") < drawn)
    lowest = reached.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", none)
    own = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", F.desc("weight"), "n_features"))
    rank = F.col("before") + own
    reaching = can.where(F.col("score") >= lowest).join(F.broadcast(reached.select("score", "before")), "score").withColumn("rank", F.when(rank <= drawn, rank)).drop("before")
    return reaching.unionByName(scored.where((F.col("n_words") < min_words) | (F.col("score") < lowest)).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null where the row was not drawn).

    A null text has no words; a row without features weighs 0 and still has a score. A null id hashes as an empty one and
    ranks before others of its score. Equal scores go by smaller id, then, for repeated ids, by larger weight and fewer
    features; rows that agree in all of these are alike, whichever gets the lower rank. Texts of any length are scanned
    whole, part by part. An empty table gives no rows, an empty target even shares. Other columns are not read.
    """
    scanned = stored(scan(docs, n, buckets, id_col, text_col), "buckets")
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(scan(target, n, buckets, None, target_text), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = stored(weigh(scanned, gain).withColumn("score", F.col("weight") + noise), "scores")
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
