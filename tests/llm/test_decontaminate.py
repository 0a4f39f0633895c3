import random

import numpy as np

from symweave.llm import decontaminate

from .helpers import AWKWARD, docs, empty


def brute_align(doc, item):
    best, table = 0, [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_recurrence():
    r = np.random.default_rng(1)
    for _ in range(40):
        d, t = r.integers(1, 5, (3, 12)).astype(np.int32), r.integers(1, 5, (3, 7)).astype(np.int32)
        d[1, 8:], t[2, 4:] = 0, 0
        got = decontaminate.align(d, t)
        assert got.tolist() == [brute_align([x for x in a if x], [x for x in b if x]) for a, b in zip(d.tolist(), t.tolist())]


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def test_planted_passages(spark):
    r = random.Random(5)
    items = [(i, words(r, 40)) for i in range(20)]
    rows, want = [], set()
    for i in range(200):
        body = words(r, 60)
        if i % 4 == 0:
            k, passage = items[i % 20][0], list(items[i % 20][1])
            for at in range(3, 40, 8) if i % 8 else []:  # one word in eight changed
                passage[at] = "changed"
            body[30:30] = passage
            want.add((i, k))
        rows.append((i, " ".join(body).capitalize()))
    rows += [(1000 + i, " ".join(items[3][1])) for i in range(150)]  # one passage in very many documents
    want |= {(1000 + i, 3) for i in range(150)}
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "short changed"), (None, "x y z w v")], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and len(got) == len(want)
    assert all(g.score == 1 for g in got if g.doc_id % 8 == 0 or g.doc_id >= 1000)
    assert all(g.first_word is not None for g in got)
    left = {x.doc_id for x in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_short_items_and_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "Four five!"), (2, "Four five!"), (3, "zzz")], "item_id long, text string")
    got = {(g.doc_id, g.item_id) for g in decontaminate.contaminated(docs(spark, AWKWARD), bench).collect()}
    assert got == {(5, 1), (5, 2), (6, 1), (6, 2)}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, AWKWARD), bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs(spark, AWKWARD), bench).count() == len(AWKWARD) - 3


def test_every_whole_passage_is_found(spark, sf):
    """Documents that hold a test item word for word, found by plain string search."""
    import re

    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " "
    table, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts, items = {r.doc_id: plain(r.text) for r in table.collect()}, {r.item_id: plain(r.text) for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert whole <= {(g.doc_id, g.item_id) for g in decontaminate.contaminated(table, bench).where("score = 1").collect()}


def found(spark, bodies, item, r):
    """Ids of the texts that are found to hold the item, and of those that whole-document alignment accepts."""
    rows = [(i, " ".join(b)) for i, b in enumerate(bodies)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words(r, 30)))], "item_id long, text string")
    got = {g.doc_id: g.score for g in decontaminate.contaminated(docs(spark, rows), bench).collect() if g.item_id == 1}
    want = {i: brute_align(b, item) / (2 * len(item)) for i, b in enumerate(bodies)}
    return got, {i: s for i, s in want.items() if s >= decontaminate.LEAST_SCORE}


def test_copies_without_a_run_of_four_words(spark):
    r = random.Random(6)
    short, long = ([f"{p}{i}" for i in range(n)] for p, n in (("s", 15), ("l", 40)))
    changed = ["other" if i in (3, 7, 11) else w for i, w in enumerate(short)]
    for item, copy in ((short, changed), (long, [x for i, w in enumerate(long) for x in ([w, "more"] if i % 3 == 2 else [w])]), (long[:2], [long[0], "more", long[1]])):
        bodies = [words(r, n) + copy + words(r, 30) for n in (0, 7, 20, 33, 90)] + [words(r, 200)]
        got, want = found(spark, bodies, item, r)
        assert got == want and set(want) == {0, 1, 2, 3, 4}


def test_edited_copies_match_whole_document_alignment(spark):
    """Copies with random edits around the least score, in documents of the item's own words, by no seed at all."""
    r = random.Random(7)
    item = [r.choice("abcdefghijklmnop") for _ in range(25)]
    bodies = []
    for n in range(150):
        copy = list(item)
        for _ in range(n % 12):
            at = r.randrange(len(copy))
            copy[at : at + r.randint(0, 1)] = [r.choice([*"abcdefghijklmnop", "new"]) for _ in range(r.randint(0, 2))]
        bodies.append([r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 90))] + copy + words(r, 20))
    got, want = found(spark, bodies, item, r)
    assert got == want and 30 < len(want) < 150


def test_documents_match_whole_document_alignment(spark, sf):
    from symweave.llm.common import words_of

    read = lambda name, key: {r[0]: r[1] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, words_of(decontaminate.F.col("text"))).collect() if r[1]}
    texts, items = read("documents", "doc_id"), read("benchmark", "item_id")
    want = {}
    for d, w in texts.items():
        scores = decontaminate.score_pairs([w] * len(items), list(items.values()))
        want |= {(d, i): s for i, s in zip(items, scores) if s >= decontaminate.LEAST_SCORE}
    got = decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {(g.doc_id, g.item_id): g.score for g in got.collect()} == want and want


def test_long_insertions(spark):
    r = random.Random(8)
    item = [f"w{i}" for i in range(40)]
    copies = [item[:20] + words(r, n) + item[20:] for n in (17, 20, 24, 25)]
    bodies = [words(r, n) + copy + words(r, 5) for copy in copies for n in (0, 31, 45, 50, 63, 64)]
    got, want = found(spark, bodies, item, r)
    assert got == want and set(want) == set(range(18))


def test_copies_that_keep_only_stock_phrases(spark):
    r = random.Random(9)
    item = [f"w{i}" for i in range(20)]
    edited = ["other" if i in (8, 11, 14, 17) else w for i, w in enumerate(item)]
    bodies = [words(r, 10) + item[:8] + words(r, 10) for _ in range(300)] + [words(r, 9) + item, words(r, 9) + edited]
    got, want = found(spark, bodies, item, r)
    assert got == want and set(want) == {300, 301}


def test_items_with_several_texts_or_no_id_and_shared_document_ids(spark):
    r = random.Random(10)
    first, second, third = words(r, 20), words(r, 20), words(r, 20)
    bench = spark.createDataFrame([(1, " ".join(first)), (1, " ".join(second)), (None, " ".join(third)), (2, " ".join(first))], "item_id long, text string")
    rows = [(1, " ".join(words(r, 9) + first)), (2, " ".join(second)), (3, " ".join(third)), (4, " ".join(words(r, 30))), (4, " ".join(second)), (5, None)]
    got = {(g.doc_id, g.item_id) for g in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, None), (4, 1)}
    left = [(x.doc_id, x.text) for x in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()]
    assert sorted(left, key=str) == sorted([rows[3], rows[5]], key=str)


def test_more_seeds_than_may_be_broadcast(spark, sf, monkeypatch):
    read = lambda: {(g.doc_id, g.item_id, g.score) for g in decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = read()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    assert read() == want and want


def test_columns_with_internal_names_stay(spark):
    item = "seven quick words that only this item has in such an order here today"
    table = spark.createDataFrame([(1, item, 5, "kept"), (2, "something else", 6, "kept")], "doc_id long, text string, __th long, __of string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(table, items).collect()] == [(2, "something else", 6, "kept")]
