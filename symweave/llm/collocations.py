"""Phrase collocation mining by hierarchical pair naming.

Every frequent phrase of k words has a number. A text is once turned into blocks of numbers of words; from then on two
neighbouring numbers of phrases of k - 1 words, one word apart, name a phrase of k words: pairs are counted over all
blocks, frequent ones get numbers in one table, and that table is joined back to the blocks, whose numbers it replaces. A
block brings only its distinct pairs to the count and the join, and takes back a dictionary of its own frequent ones, so
what is counted grows with the distinct pairs of a piece of text and not with its words, and no task has to hold
the table of all phrases. As long as the tables are small (their rows are counted), tasks get them whole, and blocks
stay where they are and keep no pairs; results are the same.

The two halves of a phrase's pair are its parents: its first k - 1 words and its last k - 1. Counts of the parts of each
cut are handed down from parent to child, and a phrase is subsumed if one of its children is as frequent.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, discard, guarded, sliced, stored

#: Bytes of text in a block.
BLOCK_BYTES = 1 << 19
#: Frequent pairs of a level up to which each task gets the whole table of them (12 bytes each) in place of its blocks'
#: parts of it; for words the bound is BROADCAST_ROWS.
TABLE_ROWS = 1 << 20
#: Different words that a task counts before it hands them on.
WORDS_HELD = 200_000

#: A-Z in lower case; the bytes that part pieces become one that no UTF-8 text has, a tab and a space part words.
_BREAK = b"\xff"
_PLAIN = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = "block long, ctx int, numbers binary, code int, n long, "


def tokens_of(text: bytes, step: int) -> Iterator[list[bytes]]:
    """Words and breaks of a UTF-8 text in order, in lists that cover some step bytes each (a longer word stays whole)."""
    start = 0
    while start < len(text):
        end = start + step
        while end < len(text) and text[end] not in b" \t":
            end += 1
        yield text[start:end].translate(_PLAIN).replace(_BREAK, b" \xff ").split()
        start = end


def _rows(block: int, ctx: int, numbers: np.ndarray, n: np.ndarray, keys: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """A block as rows: one with its numbers, then one for each distinct key, with how often it counts."""
    size = len(n)
    fixed = {"block": pa.int64(), "ctx": pa.int32(), "numbers": pa.binary(), "code": pa.int32(), "n": pa.int64()}
    whole = [pa.array([block], pa.int64()), pa.array([ctx], pa.int32()), pa.array([numbers.astype("<u4").tobytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
    yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(1, k.type) for k in keys.values())], [*fixed, *keys])
    each = [pa.array(np.full(size, block), pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.array(np.arange(1, size + 1), pa.int32()), pa.array(n, pa.int64())]
    yield pa.RecordBatch.from_arrays([*each, *keys.values()], [*fixed, *keys])


class _Coder:
    """Gives words of a block numbers from 1, by language; breaks are 0."""

    def __init__(self) -> None:
        self.fresh = count(1).__next__
        self.langs: dict[str, defaultdict] = {}

    def encode(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        if lang not in self.langs:
            self.langs[lang] = defaultdict(self.fresh, {_BREAK: 0})
        return np.fromiter(map(self.langs[lang].__getitem__, tokens), np.uint32, len(tokens))

    def rows(self, block: int, ctx: int, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The block of these codes; the first ctx of them do not count."""
        size = sum(len(words) - 1 for words in self.langs.values())
        langs, words = [""] * size, [b""] * size
        for lang, known in self.langs.items():
            for word, code in known.items():
                if code:
                    langs[code - 1], words[code - 1] = lang, word
        n = np.bincount(codes[ctx:], minlength=size + 1)[1:]
        yield from _rows(block, ctx, codes, n, {"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary())})


def word_blocks(docs: DataFrame, longest: int, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """block, ctx, numbers, code, n, lang, word: texts as numbers of words, each text ended by a break. A block has one row with
    its numbers and one for each distinct one. A text longer than a block is dealt over several, which begin with the longest - 1
    tokens before them (ctx of them are there for phrases alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = count((task.partitionId() if task else 0) << 32).__next__
        for batch in sliced(batches, "text", block_bytes):
            texts, langs = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "lang"))
            if batch.num_rows == 1 and len(texts[0].as_py() or b"") > block_bytes:
                before: list[bytes] = []
                for part in tokens_of(texts[0].as_py(), block_bytes):
                    coder = _Coder()
                    yield from coder.rows(block(), len(before), coder.encode(langs[0].as_py(), before + part))
                    before = (before + part)[-(longest - 1) :] if longest > 1 else []
                continue
            coder, parts = _Coder(), []
            for lang, text in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
                for tokens in tokens_of(text or b"", block_bytes):
                    parts.append(coder.encode(lang, tokens))
                parts.append(np.zeros(1, np.uint32))
            yield from coder.rows(block(), 0, np.concatenate(parts))

    return _read(docs, text_col, lang_col).mapInArrow(run, _BLOCK + "lang string, word binary")


def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))


def word_counts(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """lang, word, f of every word: tasks count, and hand on what they have whenever it is WORDS_HELD words."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = counts.setdefault(lang.as_py(), Counter())
                for tokens in tokens_of(text.as_py() or b"", block_bytes):
                    own.update(tokens)
                    if sum(map(len, counts.values())) > WORDS_HELD:
                        yield from rows(counts)
                        own.clear()
                        counts = {lang.as_py(): own}
        yield from rows(counts)

    return _read(docs, text_col, lang_col).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def known_words(docs: DataFrame, words: DataFrame, longest: int, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """block, ctx, numbers as word_blocks has them, where all of words(lang, word, id) are few enough for every task to hold:
    numbers are those of the frequent words, 0 for others."""
    ids: dict[str, dict[bytes, int]] = {}
    for lang, word, i in words.select("lang", "word", "id").toLocalIterator():
        ids.setdefault(lang, {})[bytes(word)] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encoded(lang: str, tokens: list[bytes]) -> np.ndarray:
            return np.fromiter(map(ids.get(lang, {}).get, tokens, repeat(0)), np.uint32, len(tokens))

        def row(ctx: int, numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block()], pa.int64()), pa.array([ctx], pa.int32()), pa.array([numbers.astype("<u4").tobytes()], pa.binary())], ["block", "ctx", "numbers"])

        task = TaskContext.get()
        block = count((task.partitionId() if task else 0) << 32).__next__
        for batch in sliced(batches, "text", block_bytes):
            parts = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = np.zeros(0, np.uint32)
                for tokens in tokens_of(text or b"", block_bytes):
                    own = np.concatenate([before, encoded(lang, tokens)])
                    if len(text) > block_bytes:
                        yield row(len(before), own)
                        before = own[-(longest - 1) :] if longest > 1 else before
                    else:
                        parts.append(own)
                parts.append(np.zeros(1, np.uint32))
            yield row(0, np.concatenate(parts))

    return _read(docs, text_col, lang_col).mapInArrow(run, "block long, ctx int, numbers binary")


def packed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, pairs): where a frequent phrase and the one a word later both stand, and the pair of their numbers."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, packed(ids[at], ids[at + 1])


def renamed(ids: np.ndarray, pairs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The numbers of phrases of one word more: names of the (sorted) pairs that stand in ids, 0 where none does."""
    out = np.zeros(len(ids), np.uint32)
    at, own = neighbours(ids)
    if len(pairs) and len(at):
        place = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
        hit = pairs[place] == own
        out[at[hit]] = names[place[hit]]
    return out


def paired(block: int, ctx: int, ids: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """The block with these numbers of phrases and the pairs that stand in it, phrases of words words."""
    at, own = neighbours(ids)
    if len(at):
        pairs, which = np.unique(own, return_inverse=True)
        # a phrase counts in the block that holds its end
        n = np.bincount(which[at >= ctx - (words - 1)], minlength=len(pairs))
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield from _rows(block, ctx, ids, n, {"left": pa.array(left), "right": pa.array(right)})


def with_dictionary(named: DataFrame, words: int) -> DataFrame:
    """named(block, ctx, numbers, code, id), or with left and right for code: each block's dictionary, followed by the row
    that has its numbers -> block, ctx, numbers, code, n, left, right of the next level; numbers are those of the phrases
    that the dictionary names."""

    def ids_of(numbers: np.ndarray, known: list[list[np.ndarray]]) -> np.ndarray:
        *keys, ids = (np.concatenate(x) for x in zip(*known, strict=True))
        if len(keys) == 1:
            to = np.zeros(int(numbers.max(initial=0)) + 1, np.uint32)
            to[keys[0]] = ids
            return to[numbers]
        pairs = packed(*keys)
        order = np.argsort(pairs)
        return renamed(numbers, pairs[order], ids[order].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[list[np.ndarray]] = []
        for batch in batches:
            block, ctx, numbers, *entries = batch.columns
            start = 0
            for end in [*np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                if end > start:
                    known.append([c.slice(start, end - start).to_numpy() for c in entries])
                if end < batch.num_rows:
                    if known:
                        yield from paired(block[end].as_py(), ctx[end].as_py(), ids_of(np.frombuffer(numbers[end].as_buffer(), "<u4"), known), words)
                    known, start = [], end + 1

    return named.repartition("block").sortWithinPartitions("block", F.col("numbers").isNotNull()).mapInArrow(run, _BLOCK + "left long, right long")


def held(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """table(left, right, id) as sorted pairs and their names."""
    got = table.select("left", "right", "id").toPandas()
    pairs = packed(got["left"].to_numpy(), got["right"].to_numpy())
    order = np.argsort(pairs)
    return pairs[order], got["id"].to_numpy()[order].astype(np.uint32)


def with_tables(whole: DataFrame, tables: list[tuple[np.ndarray, np.ndarray]], words: int, keys_only: bool) -> DataFrame:
    """whole(block, ctx, numbers) of words -> what with_dictionary gives for phrases of words words, where the pairs of
    all levels before are few enough for every task to hold; keys_only: without the rows that have the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ctx, numbers in zip(*batch.columns, strict=True):
                ids = np.frombuffer(numbers.as_buffer(), "<u4")
                for pairs, names in tables:
                    ids = renamed(ids, pairs, names)
                yield from islice(paired(block.as_py(), ctx.as_py(), ids, words), int(keys_only), None)

    return whole.mapInArrow(run, _BLOCK + "left long, right long")


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df stored with id, numbers without gaps from 1, and how many there are: a place within its task, moved by the rows of tasks before."""
    rows = stored(df.withColumn("raw", F.monotonically_increasing_id()), name)
    tasks = sorted((r.task, r.n) for r in rows.groupBy(F.shiftright("raw", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for task, n in tasks:
        starts.append((task, total + 1))
        total += n
    if total >= 1 << 32:
        raise ValueError(f"{total} frequent phrases of one length; pairs are made of numbers of 32 bits")
    table = df.sparkSession.createDataFrame(starts, "task long, start long")
    out = rows.join(F.broadcast(table), F.shiftright("raw", 33) == F.col("task")).withColumn("id", F.col("start") + F.expr("raw & 8589934591L"))
    return out.drop("raw", "task", "start"), total


def _exact(*factors: Column | int) -> Column:
    """The product of whole numbers below 10^18, two at most besides small ones, in 38 digits."""
    out = F.lit(1).cast("decimal(1,0)")
    for f in factors:
        out = (out * (F.lit(f) if isinstance(f, int) else f.cast("decimal(18,0)"))).cast("decimal(38,0)")
    return out


def phrases(docs: DataFrame, longest: int, min_count: int, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES, word_rows: int = BROADCAST_ROWS, table_rows: int = TABLE_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """([level of words, of pairs, ...], totals): each level has id, f, lang, phrase, last, firsts, rests and, beyond words,
    left and right. firsts has the counts of the first 1, 2, ... words, rests of the last 1, 2, ..., both without the whole."""
    counted = stored(word_counts(docs, text_col, lang_col, block_bytes), "vocabulary")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words, size = numbered(counted.where(F.col("f") >= min_count), "level1")
    none = F.expr("cast(array() as array<bigint>)")
    text = F.col("word").cast("string")
    levels = [words.select("id", "f", "lang", text.alias("phrase"), text.alias("last"), none.alias("firsts"), none.alias("rests"))]
    if not size:
        return levels, totals
    whole = tables = blocks = None
    if size <= word_rows:
        whole, tables = stored(known_words(docs, words, longest, text_col, lang_col, block_bytes), "words"), []
    else:
        blocks = stored(word_blocks(docs, longest, text_col, lang_col, block_bytes), "words")
    keys, table = ["lang", "word"], words
    for k in range(2, longest + 1):
        if not size:
            break
        if whole is not None and k > 2 and size > table_rows:
            # from here on blocks take dictionaries: they bring the pairs of the level before
            before, whole, blocks = whole, None, stored(with_tables(whole, tables, k - 1, keys_only=False), f"pairs{k - 1}")
            discard(before)
        if whole is not None:
            tables = tables + [held(table)] if k > 2 else tables
            each = with_tables(whole, tables, k, keys_only=True)
        else:
            own = keys if k > 2 else ["code"]
            names = blocks.where("code is not null").join(guarded(table.select(*keys, "id"), size), keys)
            names = names.select("block", F.lit(None).cast("int").alias("ctx"), F.lit(None).cast("binary").alias("numbers"), *own, "id")
            longer = with_dictionary(names.unionByName(blocks.where("code is null").select("block", "ctx", "numbers"), allowMissingColumns=True), k)
            before, blocks = blocks, stored(longer, f"pairs{k}")
            discard(before)
            each = blocks.where("code is not null")
        keys = ["left", "right"]
        found = each.groupBy("left", "right").agg(F.sum("n").alias("f"))
        table, size = numbered(found.where(F.col("f") >= min_count), f"level{k}")
        shorter = levels[-1]
        left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.array_append("firsts", F.col("f")).alias("firsts"))
        right = shorter.select(F.col("id").alias("right"), "last", F.array_append("rests", F.col("f")).alias("rests"))
        level = table.join(left, "left").join(right, "right").withColumn("phrase", F.concat_ws(" ", "head", "last")).drop("head")
        levels.append(stored(level, f"phrases{k}"))
    discard(blocks if whole is None else whole)
    return levels, totals


def mine(docs: DataFrame, longest: int = 5, min_count: int = 100, keep_percent: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to longest words.

    a is a phrase's count, n its language's words, l and r the counts of the parts of the cut that scores least, of equal
    scores the first cut; score is floor(1000 a n / (l r)), exactly. Phrases below min_count are none; those inside a longer one
    that has at least keep_percent of their count are left out. Equal scores go by larger count, then by the phrase's
    bytes. A null text has no words, a null language is 'und'. Repeated rows count as often as they stand, texts of any
    length count whole. An empty table, or one without frequent phrases, gives no rows; other columns are not read.
    """
    levels, totals = phrases(docs, longest, min_count, text_col, lang_col)
    out = []
    for k in range(2, len(levels) + 1):
        own = levels[k - 1]
        if k < len(levels):
            above = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            # what a longer phrase has, every phrase between it and its part has as well, so children are all that has to be asked
            own = own.join(above, "id", "left").where(F.coalesce(_exact(100, F.col("longer")) < _exact(keep_percent, F.col("f")), F.lit(True)))
        out.append(own.select("lang", "phrase", F.col("f").alias("a"), "firsts", "rests"))
    if not out:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    every = out[0]
    for level in out[1:]:
        every = every.unionByName(level)
    cut = F.posexplode(F.arrays_zip(F.col("firsts").alias("l"), F.reverse("rests").alias("r"))).alias("k", "parts")
    cuts = every.join(guarded(totals, totals.count()), "lang").select("lang", "phrase", "a", "n", cut)
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.col("parts.l").alias("l"), F.col("parts.r").alias("r"))
    cuts = cuts.withColumn("product", _exact(1000, F.col("a"), F.col("n"))).withColumn("parts", _exact(F.col("l"), F.col("r")))
    cuts = cuts.withColumn("score", F.expr("product div parts").cast("long"))
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    w = Window.partitionBy("lang").orderBy(*order)
    return least.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
grams AS (SELECT lang, words[i:i + k - 1] AS g, k FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4), (5)) v(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, k, count(*) AS a FROM grams GROUP BY lang, array_to_string(g, ' '), k),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
inner_parts AS (SELECT DISTINCT lang, array_to_string(g[i:i + m - 1], ' ') AS phrase, a FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m) WHERE i + m - 1 <= k AND m < k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)),
cuts AS (SELECT kept.*, j, array_to_string(g[1:j], ' ') AS head, array_to_string(g[j + 1:], ' ') AS tail FROM kept, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * cuts.a * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
