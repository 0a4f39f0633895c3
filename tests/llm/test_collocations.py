import os
import random
import re
from collections import Counter

import duckdb
import pytest

from symweave.llm import collocations, queries

from .helpers import AWKWARD, LONG, empty

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, id string, block string, f string"


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, *["clash"] * 5) for i, (text, lang) in enumerate(rows)], SCHEMA)


def brute(rows, longest=5, min_count=100, keep_percent=100, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            own.update(tuple(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    out = []
    for lang, own in f.items():
        can = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + m] for p, a in can.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= keep_percent * own[p[i : i + m]]}
        scored = []
        for p, a in can.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def sample(seed, docs, words=12):
    draw = random.Random(seed)
    vocabulary = ["of", "the", "Of", "New", "york", "é", "日本", "a-b", "x\x00y", "#", " ", "w"]
    rows = []
    for _ in range(docs):
        parts = [draw.choice([*vocabulary[:words], "new york city hall now", "of the of the"]) + draw.choice([" ", "  ", "\t", " ", ", ", "\n", "\x0b", ".", "\x1c "]) for _ in range(draw.randint(0, 40))]
        rows.append(("".join(parts), draw.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize(("keep", "least", "longest"), [(100, 5, 5), (60, 3, 4), (100, 30, 2)])
def test_equals_brute_force(spark, keep, least, longest):
    rows = sample(keep + least, 150)
    got = sorted(tuple(r) for r in collocations.mine(table(spark, rows), longest=longest, min_count=least, keep_percent=keep, top=25).collect())
    assert got == brute(rows, longest, least, keep, 25) and got


@pytest.mark.parametrize("few", [(0, 0), (1000, 30), (1000, 1000)])  # words and pairs that tasks get whole: none, words alone, all
def test_texts_longer_than_a_block_and_joins_without_broadcast(spark, monkeypatch, few):
    rows = sample(9, 60) + [(LONG[:3000] + "one. two " * 300, "en"), ("word" * 100, "en"), ("a b " * 200, None)]
    monkeypatch.setattr(collocations, "guarded", lambda df, rows: df.hint("merge"))
    levels, totals = collocations.phrases(table(spark, rows), 5, 4, block_bytes=64, word_rows=few[0], table_rows=few[1])
    want, n = {}, {}
    for row in brute(rows, 5, 4, 10**9, 10**9):
        want[row[0], row[2]] = row[3]
        n[row[0]] = row[6]
    got = {(r.lang, r.phrase): r.f for level in levels[1:] for r in level.collect()}
    assert got == want
    assert {r.lang: r.n for r in totals.collect()}.items() >= n.items()


def test_whole_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(collocations.ORACLE).fetchall())
    assert sorted(tuple(r) for r in queries.op11_collocations(spark, sf).collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no larger table")
def test_larger_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = sorted(tuple(r) for r in queries.op11_collocations(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows) and len(got) > 50


def test_awkward_rows(spark):
    rows = [(text, "en") for _, text in AWKWARD] * 3 + [("same words here", None)] * 30 + [("same words here", "und")] * 30
    got = sorted(tuple(r) for r in collocations.mine(table(spark, rows), min_count=2).collect())
    assert got == brute(rows, min_count=2)
    assert collocations.mine(table(spark, rows), min_count=10**9).count() == 0
    assert collocations.mine(empty(spark)).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    a, n, left, right = 10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 11
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    top, bottom = collocations._exact(1000, df.a, df.n), collocations._exact(df.l, df.r)
    got = df.select(top.alias("t"), bottom.alias("b")).selectExpr("t", "b", "t div b as s").first()
    assert (int(got.t), int(got.b), got.s) == (1000 * a * n, left * right, 1000 * a * n // (left * right))
