import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from symweave.llm import simhash
from symweave.llm.components import connected_components

from .helpers import AWKWARD, docs, empty


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, k=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= k:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_by_definition():
    for _, t in AWKWARD[:3] + AWKWARD[4:]:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)
    assert simhash.fingerprint("the quick brown fox jumps over the lazy dog") == brute_fingerprint("the quick brown fox jumps over the lazy dog")


@pytest.mark.parametrize("block", [3, 4096])
def test_links_match_brute_force(spark, block):
    """Random fingerprints, a dense cluster and a chain; buckets beyond the block size are dealt out."""
    r = np.random.default_rng(block)
    centre = int(r.integers(0, 2**63))
    fps = [int(x) for x in r.integers(0, 2**63, 60)] + [centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(12), 2)]
    x = int(r.integers(0, 2**62))
    for _ in range(10):  # each four bits from the one before
        fps.append(x)
        for b in r.choice(62, 4, replace=False):
            x ^= 1 << int(b)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = connected_components(simhash.near_links(nodes, 4, block))
    root = {r.node: r.root for r in links.collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(root.get(f, f), set()).add(i)
    want = {}
    for i, c in enumerate(brute_components(fps)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_runs_reach_everything():
    r = np.random.default_rng(7)
    v = np.uint64(1 << 60) ^ np.left_shift(np.uint64(1), r.integers(0, 40, (500, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    forest = simhash._Forest()
    simhash._long_run(v, 4, forest)
    fps = [int(x) for x in np.unique(v)]
    want = brute_components(fps)
    assert all((forest.find(a) == forest.find(b)) == (want[i] == want[j]) for i, a in enumerate(fps[:80]) for j, b in enumerate(fps))


def test_allocation_is_cheapest():
    r = np.random.default_rng(5)
    for _ in range(20):
        costs = r.random((3, 6)).tolist()
        best, picks = simhash.allocate(costs, 2)
        every = [(sum(c[t + 1] for c, t in zip(costs, p)), list(p)) for p in np.ndindex(6, 6, 6) for p in [tuple(x - 1 for x in p)] if sum(p) == 2]
        assert best == pytest.approx(min(every)[0]) and sum(picks) == 2


def test_every_near_pair_shares_a_probe():
    r = np.random.default_rng(3)
    masks = simhash.plan(r.integers(0, 2**63, 500).astype(np.uint64), 10**7)
    for _ in range(300):
        x = int(r.integers(0, 2**63))
        y = x
        for b in r.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[5] == by[6] and {c for _, c in by[None]} == {5}  # the null id follows its copies
    assert by[8] == by[-9] and {c for _, c in by[8]} == {-9}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_documents_match_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()} == want
    left = {r.doc_id for r in simhash.drop_near_copies(table).collect()}
    assert left == {i for i, (_, c) in want.items() if i == c}


def test_drop_near_copies_tells_rows_apart_by_more_than_their_id(spark):
    body = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(0, body), (1, other), (1, body), (2, other), (2, other), (None, body)]
    left = sorted(((r.doc_id, r.text[0]) for r in simhash.drop_near_copies(docs(spark, rows)).collect()), key=str)
    assert left == sorted([(0, "w"), (1, "v"), (None, "w")], key=str)


def test_two_partitions_can_be_planned():
    few = np.random.default_rng(3).integers(0, 2**63, 50).astype(np.uint64)
    masks = simhash.plan(few, 10**12, 4, sizes=(2,))
    pairs = [(x, x ^ np.uint64(sum(1 << int(b) for b in np.random.default_rng(i).choice(64, 4, replace=False)))) for i, x in enumerate(few)]
    assert all(any(int(x ^ y) & m == 0 for m in masks) for x, y in pairs)


def test_columns_with_internal_names_stay(spark):
    for rows in ([(1, "a b c d e"), (2, "a b c d e"), (3, "other words")], [(1, "a b c d e"), (2, "a b c d e"), (2, "other words")]):
        table = docs(spark, rows).selectExpr("*", "doc_id * 10 as __row", "'kept' as __gone", "'id' as __id", "'key' as __key")
        left = simhash.drop_near_copies(table)
        assert left.columns == table.columns
        assert sorted((r.doc_id, r["__row"], r["__gone"], r["__id"], r["__key"]) for r in left.collect()) == [(i, 10 * i, "kept", "id", "key") for i, _ in (rows[0], rows[2])]
