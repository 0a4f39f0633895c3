import hashlib
import math
import re
from array import array
from zlib import crc32

import numpy as np

from symweave.llm import importance, queries

from .helpers import AWKWARD, LONG, docs, empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, n=2):
    w = words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(rows, target, n=2, buckets=10_000, percent=25, min_words=20, seed=7):
    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for f in features(x, n):
                into[f % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        fs = features(x, n)
        weight = sum(gain[f % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= min_words])
    can = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0], -r[2], r[1]))
    drawn = len(can) * percent // 100
    ranks = {id(r): k + 1 for k, r in enumerate(can[:drawn])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def test_ring_gives_every_run_of_words_however_the_text_is_cut():
    text = "One two, three; FOUR five é😀 six 7 eight".encode()
    want = sorted(features(text.decode(), 4))
    for step in (1, 5, 1 << 20):
        out, ring = array("I"), []
        for part in importance.words_in(text, step):
            ring = importance.crc_ring(part, 4, ring, out)
        assert sorted(out) == want


def test_long_texts_leave_counts(monkeypatch):
    n_words, seen, counts = importance.scan_text(LONG.encode(), 2, 10_000)
    assert n_words == 40_000 and counts is not None and counts.sum() == 2 * 40_000 - 1 and len(seen) == 4
    monkeypatch.setattr(importance, "LISTED", 1 << 30)
    _, each, none = importance.scan_text(LONG.encode(), 2, 10_000)
    assert none is None and np.array_equal(np.unique(each), seen) and np.array_equal(np.unique(each, return_counts=True)[1], counts)


def test_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect()]
    assert sorted(got, key=repr) == brute([tuple(r) for r in table], target)
    assert sum(r[4] is not None for r in got) > 10


def test_awkward_rows_ties_and_repeats(spark):
    rows = [*AWKWARD, *[(i, f"w{i} " * 25) for i in range(40)], (3, "again " * 30), (3, "again " * 30), (3, "other words " * 15), (None, "x " * 20)]
    target = docs(spark, [(None, None), (1, "again w3"), (1, "again w3")])
    got = [tuple(r) for r in importance.resample(docs(spark, rows), target, percent=60).collect()]
    assert sorted(got, key=repr) == brute(rows, [None, "again w3", "again w3"], percent=60)


def test_other_parameters_and_wide_buckets(spark):
    rows = [(i, f"a b{i % 3} c d{i % 5} e") for i in range(50)]
    got = [tuple(r) for r in importance.resample(docs(spark, rows), docs(spark, [(0, "a b1 c")]), n=4, buckets=100_003, percent=100, min_words=5, seed=3).collect()]
    assert sorted(got, key=repr) == brute(rows, ["a b1 c"], n=4, buckets=100_003, percent=100, min_words=5, seed=3)
    assert sorted(r[4] for r in got) == list(range(1, 51))


def test_empty_tables(spark):
    assert importance.resample(empty(spark), docs(spark, [(1, "a b")])).count() == 0
    got = [tuple(r) for r in importance.resample(docs(spark, AWKWARD), empty(spark)).collect()]
    assert sorted(got, key=repr) == brute(AWKWARD, [])
