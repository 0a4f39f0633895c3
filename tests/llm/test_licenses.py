import math
import random
import re
from collections import Counter

from symweave.llm import licenses

from .helpers import AWKWARD, docs, empty


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_matches_brute_force(spark):
    r = random.Random(8)
    bits = ["cc", "by", "CC BY", "general", "public", "license", "License,", "All", "rights", "reserved", "all rights reserved.", "é", "x", "\n", "K", "by\x00", "cc-by", "4"]
    rows = list(enumerate(" ".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [(2000, "all rights reserved " * 3000), (2001, "ſ Kcc by"), (2002, "all rights reserved")]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for g in got:
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(text[g.doc_id]), text[g.doc_id]
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1 and (g.score == 1) >= (g.n_base > 0)


def test_templates_survive_edits(spark):
    full = licenses.TEMPLATES[8][1]
    words = full.split()
    edited = " ".join(w for i, w in enumerate(words) if i != 9) + " and so on"
    rows = [(1, full), (2, "before " * 50 + edited), (3, " ".join(words[:6])), (4, "Released under the MIT License.")]
    got = {g.doc_id: g for g in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[1].labels == "mit" and got[1].score == 1
    assert got[2].labels == "mit" and licenses.LEAST_SHARE <= got[2].score < 1
    assert got[3].labels == "" and got[3].score == 0
    assert got[4].labels == "mit"


def test_awkward_rows(spark):
    rows = [*AWKWARD, (5, "all rights reserved"), (None, None), (None, "cc by")]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert sorted((str(g.doc_id), g.n_words, g.n_base) for g in got) == sorted((str(i), *brute(t)[:2]) for i, t in rows)
    assert licenses.scan_licenses(empty(spark)).count() == 0
    plan = licenses.scan_licenses(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_labels(text):
    """Labels and score from the description: cells of diagonals, nearest hits, longest rising chain, density."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for label, p in licenses.PHRASES:
        p = p.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for label, t in licenses.TEMPLATES:
        t = t.split()
        k = min(licenses.GRAM, len(t))
        size = len(t) - k + 1
        places = {}
        for j in range(size):
            places.setdefault(tuple(t[j : j + k]), []).append(j)
        hits = [(j, i) for i in range(len(words) - k + 1) for j in places.get(tuple(words[i : i + k]), [])]
        step = max(licenses.DRIFT, math.ceil(size * licenses.DRIFT_PART))
        for cell in {c for j, i in hits for c in ((i - j) // step, (i - j) // step - 1)}:
            own = [(j, i) for j, i in hits if cell * step <= i - j < (cell + 2) * step]
            votes = Counter(i - j for j, i in own)
            main = min(votes, key=lambda d: (-votes[d], d))
            one = {}
            for j, i in own:
                one[j] = min(one.get(j, (10**9, 0)), (abs(i - j - main), i))
            chains = []
            for j in sorted(one):
                at = one[j][1]
                n, first = max(((n, f) for a, n, f in chains if a < at), default=(0, at))
                chains.append((at, n + 1, first))
            n, wide = max((n, f - a) for a, n, f in chains)
            if n >= licenses.LEAST_SHARE * size and n >= licenses.LEAST_DENSITY * (1 - wide):
                labels.add(label)
                score = max(score, n / size)
    return ",".join(sorted(labels)), score


def test_labels_and_score_match_brute_force(spark, sf):
    r = random.Random(17)
    rows = []
    for i in range(150):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, len(words) // 2)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 2)] = [r.choice(["junk", "the", "software", "license"]) for _ in range(r.randint(0, 2))]
            words = words or ["x"]
        if r.random() < 0.3:
            cut = r.randrange(len(words))
            words = words[cut:] + words[:cut]
        rows.append((i, "text " * r.randint(0, 9) + " ".join(words) + " end" * r.randint(0, 9)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [(2000 + x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    text = dict(rows)
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    for g in got:
        labels, score = brute_labels(text[g.doc_id])
        assert g.labels == labels and abs(g.score - score) < 1e-12, (text[g.doc_id][:300], g.labels, labels, g.score, score)
    assert len({g.labels for g in got}) > 5


def test_scattered_words_are_no_license(spark):
    mit = licenses.TEMPLATES[8][1].split()
    phases = [[x for i, w in enumerate(mit[p:]) for x in ([w, "junk"] if i % 3 == 2 else [w])] for p in range(3)]
    rows = [(p, " ".join(words)) for p, words in enumerate(phases)] + [(3, " ".join(sum(phases, []))), (4, " ".join(reversed(mit))), (5, " ".join(x for w in zip(*[iter(mit)] * 3) for x in [*w, "junk"] * 3))]
    rows += [(6, " ".join(mit[i] for k in range(0, len(mit), 4) for i in range(max(0, len(mit) - k - 4), len(mit) - k)))]
    assert {g.labels for g in licenses.scan_licenses(docs(spark, rows)).collect()} == {""}
