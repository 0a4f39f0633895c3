"""Benchmark decontamination: shared word pairs vote for candidate places, Smith-Waterman alignment scores them.

A place that scores enough agrees in many words and has few edits between them, so a number of the item's
neighbouring word pairs stand in it unbroken (`_seeds` has the count). All pairs of all documents are joined to
those of the items; stretches of a document that hold that many are aligned with the item. No place that the
alignment accepts is left out, however frequent its phrases are; single words may be changed, dropped or added.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, bit_words, guarded, guarded_texts, may_hold, stored, text_or_empty, unused, words_of

#: Alignment score over the best possible one (2 a word that agrees, -1 a changed, dropped or added one):
#: 0.7 is reached with four words in five kept.
LEAST_SCORE = 0.7
MATCH, MISS, GAP = 2, -1, -1
#: Cells (places x item words x window words) that an aligning batch holds.
CELLS = 1 << 22


def _grams(words: str, k: int) -> Column:
    """Hash of each word k-gram, by place. Two n-grams of one hash only cost an alignment, which settles it."""
    every = f"transform({words}, (w, i) -> xxhash64({k}, w{''.join(f', get({words}, i + {j})' for j in range(1, k))}))"
    return F.expr(f"slice({every}, 1, greatest(0, size({words}) - {k - 1}))")


def align(docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Best local alignment score of each pair of padded rows of word numbers (0 is padding, never equal)."""
    n, width = docs.shape
    best = np.zeros(n, np.int32)
    row = np.zeros((n, width + 1), np.int32)
    ramp = -GAP * np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        diagonal = row[:, :-1] + np.where((docs == word) & (word > 0), MATCH, MISS)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(diagonal, row[:, 1:] + GAP), 0)
        # a gap along the window costs the same for each word, so a running maximum settles it
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        live = (word[:, 0] > 0)[:, None]
        row = np.where(live, new, row)
        best = np.maximum(best, np.where(live, row, 0).max(axis=1))
    return best


def score_pairs(windows: list[list[str]], items: list[list[str]]) -> list[float]:
    """Alignment score of each window of words with its item's, from 0 to 1."""
    out = [0.0] * len(windows)
    order = sorted(range(len(windows)), key=lambda i: (len(items[i]), len(windows[i])))
    i = 0
    while i < len(order):
        j, wide = i, 0
        while j < len(order):
            wide = max(wide, len(windows[order[j]]))
            if j > i and (j - i + 1) * wide > CELLS // 64:
                break
            j += 1
        part = order[i:j]
        numbers: dict[str, int] = {}
        put = lambda ws: [numbers.setdefault(w, len(numbers) + 1) for w in ws]  # noqa: B023, E731
        d = np.zeros((len(part), max(1, *(len(windows[x]) for x in part))), np.int32)
        t = np.zeros((len(part), max(1, *(len(items[x]) for x in part))), np.int32)
        for r, x in enumerate(part):
            d[r, : len(windows[x])] = put(windows[x])
            t[r, : len(items[x])] = put(items[x])
        for x, s in zip(part, align(d, t).tolist()):
            out[x] = s / (MATCH * len(items[x])) if items[x] else 0.0
        i = j
    return out


def _seeds(items: DataFrame, least: float) -> DataFrame:
    """k, gram, item, need, reach: the n-grams that vote for places of an item, and how many votes a place has.

    An alignment of M words that agree and E edits scores 2M - E. Where that is at least T, M >= T/2, and as M is at
    most the item's size L, E <= 2L - T. At most E of the M - 1 steps between words that agree are broken, so at
    least M - 1 - E >= T - L - 1 of the item's word pairs stand in the place. Where that says nothing (very short
    items, low scores), single words vote, at least T/2 of them.

    A place spans the item's words and at most E added ones, so it is at most L + 2L - T words long (reach).

    Of the votes that a place must have, up to half may be forgone: the pairs that most items share are not
    looked up, and as many votes less are asked for.
    """
    size = F.col("item_size")
    total = F.ceil(F.lit(MATCH * least) * size - F.lit(1e-9))
    pairs = total - size - 1
    reach = size + MATCH * size - total
    sized = items.select("item", "item_words", F.size("item_words").alias("item_size"))
    asked = sized.select(
        "item", "item_words",
        F.when(pairs >= 1, 2).otherwise(1).alias("k"),
        F.when(pairs >= 1, pairs).otherwise(F.greatest(F.lit(1), F.ceil(total / MATCH))).cast("int").alias("votes"),
        F.greatest(F.lit(1), reach).cast("int").alias("reach"),
    )
    own = reduce(DataFrame.unionByName, [asked.where(F.col("k") == k).select("item", "k", "votes", "reach", F.posexplode(_grams("item_words", k)).alias("t_at", "gram")) for k in (1, 2)])
    own = stored(own, "item-grams")
    shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("shared"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("shared"), "t_at"))
    forgone = (F.col("shared") > 1) & (F.col("nth") <= F.floor(F.col("votes") / 2))
    told = own.join(shared, "gram").withColumn("nth", nth).withColumn("forgone", forgone)
    need = F.col("votes") - F.sum(F.col("forgone").cast("int")).over(Window.partitionBy("item"))
    return told.withColumn("need", need.cast("int")).where("not forgone").select("k", "gram", "item", "need", "reach")


def _hits(worded: DataFrame, seeds: DataFrame, k: int, n: int) -> DataFrame:
    """Places of seeds of k words in the documents. Up to some number of seeds they are broadcast; beyond, a bitmap of them
    is, which lets few other grams of the corpus through to the shuffle of the join."""
    grams = worded.select("doc_id", "th", F.posexplode(_grams("words", k)).alias("at", "gram"))
    seeds = seeds.where(F.col("k") == k).drop("k")
    if n > BROADCAST_ROWS:
        grams = may_hold(grams, "gram", stored(bit_words(seeds.select(F.col("gram").alias("key"))), "seed-bits"))
    return grams.join(guarded(seeds, n), "gram")


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """doc_id, th, item_id, score, first_word, n_seeds: the best place of an item in each text (th is its hash)."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_or_empty("text")).alias("item_words")).where("size(item_words) > 0")
    # the texts of an item are sought one by one: its key is the words' hash, and equal words are sought once
    keyed = stored(named.withColumn("item", F.xxhash64("item_words")), "items")
    items = stored(keyed.groupBy("item").agg(F.first("item_words").alias("item_words")), "item-words")
    seeds = stored(_seeds(items, least), "seeds")
    sizes = {r["k"]: r["n"] for r in seeds.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} or {2: 0}
    text = text_or_empty("text")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id is not null")
    worded = told.select("doc_id", "th", words_of(F.col("text")).alias("words"))
    hits = reduce(DataFrame.unionByName, [_hits(worded, seeds, k, n) for k, n in sorted(sizes.items())])
    # a place is at most reach words long, so it lies in the cell where it starts and the next one
    cell = F.floor(F.col("at") / F.col("reach"))
    places = (
        hits.select("doc_id", "th", "item", "need", "reach", F.explode(F.array(cell, cell - 1)).alias("cell"))
        .where("cell >= 0")
        .groupBy("doc_id", "th", "item", "need", "reach", "cell")
        .agg(F.count(F.lit(1)).alias("n_seeds"))
        .where("n_seeds >= need")
        .select("doc_id", "th", "item", "n_seeds", (F.col("cell") * F.col("reach")).cast("int").alias("start"), ((F.col("cell") + 2) * F.col("reach")).cast("int").alias("stop"))
    )
    places = stored(places, "places")
    held = places.select("doc_id", "th").distinct()
    held = stored(held, "held")
    # the few documents that hold a place are cut out of the corpus first, then their windows, which are short, are joined
    near = stored(told.join(guarded(held, held.count()), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words_of(F.col("text")).alias("words")), "near")
    window = F.slice("words", F.col("start") + 1, F.greatest(F.lit(0), F.col("stop") - F.col("start")))
    cut = (
        near.join(guarded(places, places.count()), ["doc_id", "th"])
        .select("doc_id", "th", "item", "start", "n_seeds", window.alias("window"))
        .join(guarded_texts(items, F.expr("aggregate(item_words, 0L, (s, w) -> s + 16 + octet_length(w))")), "item")
        .select("doc_id", "th", "item", "start", "n_seeds", "window", "item_words")
    )

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                score = score_pairs(part.column(5).to_pylist(), part.column(6).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score, pa.float64()), part.column(3).cast(pa.int64()), part.column(4)], ["doc_id", "th", "item", "score", "first_word", "n_seeds"])

    scored = cut.mapInArrow(run, "doc_id long, th long, item long, score double, first_word long, n_seeds long").where(F.col("score") >= least)
    names = keyed.select("item", "item_id").distinct()
    return scored.join(guarded(names, names.count()), "item").drop("item")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, n_seeds: the best place of each test item in each document that holds it.

    Words are lower-cased runs of letters and digits. Items without words and null texts match nothing; an item that
    has several texts is found by any of them, and one without an id is sought too. first_word is where the aligned
    stretch starts, n_seeds the votes in it. Documents with a null id are not reported. Repeated rows of an id count as
    one document. Texts of any length are searched whole. Empty tables give no rows; other columns are not read.
    """
    best = F.max_by(F.struct("first_word", "n_seeds"), F.struct("score", -F.col("first_word"), "n_seeds"))
    return _found(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("b")).select("doc_id", "item_id", "score", "b.first_word", "b.n_seeds")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those that hold a test item; all columns stay. Of rows that share an id only those whose text holds
    an item go; rows without an id stay."""
    of, th = unused(docs, "__of"), unused(docs, "__th")
    gone = stored(_found(docs, benchmark, least).select(F.col("doc_id").alias(of), F.col("th").alias(th)).distinct(), "contaminated")
    return docs.join(guarded(gone, gone.count()), (F.col("doc_id").cast("long") == F.col(of)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th)), "left_anti")
