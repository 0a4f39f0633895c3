import random
import re
from itertools import product

import numpy as np

from symweave.llm import pii

from .helpers import AWKWARD, docs, empty

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_match_the_patterns():
    r = random.Random(1)
    texts = ["a@b.c@d.e", "x..y@-.-", "@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111-1111 1111 4111", "+1 (632) 555-5381+44 20 7946 0958", "aa@bb@cc.dd.", "1" * 3000, "12345678901234567890 4111111111111111", "a" * 300 + "@x.yz é@q.w", "é.a@x.y-z.q@r.s"]
    texts += ["".join(r.choice("a1.@+ -()é") for _ in range(60)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_viterbi_is_exhaustive_search():
    r = np.random.default_rng(4)
    for n in (1, 2, 4):
        e, move, first = r.normal(size=(3, n, 3)), r.normal(size=(3, 3)), r.normal(size=3)
        got = pii.viterbi(e, np.full(3, n), move, first)
        for b in range(3):
            score = lambda p: first[p[0]] + sum(e[b, i, p[i]] for i in range(n)) + sum(move[p[i], p[i + 1]] for i in range(n - 1))  # noqa: B023, E731
            assert tuple(got[b]) == max(product(range(3), repeat=n), key=score)


def test_batches_of_mixed_length_agree_with_single_runs():
    field = pii.trained()
    runs = [[pii.token_features("", t, "") for t in text.split()] for text in ("+1 (632) 555-5381", "a@b.co", "1 2 3 4 5", "10.0.0.1 4111")]
    assert pii.decode(field, runs) == [pii.decode(field, [r])[0] for r in runs]


def test_field_generalises_to_unseen_sentences():
    field, right, total = pii.trained(), 0, 0
    for tokens, labels in pii.training_table(100, seed=99):
        rows = [pii.token_features(tokens[i - 1] if i else "", tokens[i], tokens[i + 1] if i + 1 < len(tokens) else "") for i in range(len(tokens))]
        path = pii.viterbi(field.scores(rows)[None], np.array([len(rows)]), field.move, field.first)[0]
        right += sum(pii.LABELS[p] == x for p, x in zip(path, labels))
        total += len(labels)
    assert right / total > 0.97


def test_method_adds_and_keeps(spark):
    rows = [(1, "call me at (555) 234-5678 today"), (2, "mail bob.12@mail3.example.com, thanks"), (3, "nothing to see in 1999"), *[(10 + i, t) for i, (_, t) in enumerate(AWKWARD)]]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1].n_phone == 0 and "crf_phone:11:25" in got[1].spans
    assert got[2].n_email == 1 and got[2].spans == "email:5:29"
    assert got[3].spans == "" and all(got[10 + i].spans == "" for i in range(len(AWKWARD)))
    assert pii.find_pii(empty(spark)).count() == 0
    assert len(pii.find_pii(docs(spark, AWKWARD)).collect()) == len(AWKWARD)


def test_long_runs_decode_like_one_batch(monkeypatch):
    field = pii.trained()
    r = random.Random(12)
    for n in (1, 5, 127, 128, 129, 700):
        tokens = [r.choice(["+1", "(632)", "555-5381", "4111", "10.0.0.1", "a@b.co", "7", "1999", "x1", "12:30"]) for _ in range(n)]
        e = field.around(["tel", *tokens, "end"])
        want = pii.decode_scores(field, e, [n])[0]
        assert field.scores([pii.token_features(*(["tel", *tokens, "end"][i : i + 3])) for i in range(n)]).round(9).tolist() == e.round(9).tolist()
        for block in (1, 50, 128, 300, 1000):
            assert pii.decode_long(field, lambda a, b: e[a:b], n, block).tolist() == want.tolist()
    texts = [" ".join(r.choice(["+1 (632) 555-5381", "call", "a@b.co,", "7", "12 30", "(555) 234-5678"]) for _ in range(400)) for _ in range(3)]
    want = pii.find_all(field, texts)
    monkeypatch.setattr(pii, "CELLS", 3)
    assert pii.find_all(field, texts) == want and any(e for _, e in want)


def test_memory_of_long_numeric_texts_is_bounded():
    import tracemalloc

    field = pii.trained()
    r = random.Random(13)
    text = " ".join(str(r.randrange(10**5)) for _ in range(60_000))
    tracemalloc.start()
    pii.find_all(field, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_whole_neighbours_are_seen():
    long = "w" * 1000
    assert pii._before(f"a {long}  ", 1002) == long and pii._before(" " * 500 + "x" + " " * 500, 1001) == "x"
    assert pii._after(f"  {long} b", 0) == long and pii._after(" " * 500, 3) == "" and pii._before("", 0) == ""


def test_planted_spans_precision_and_recall():
    """Sentences of another seed, in words the field has not seen: whole spans, found by find_all."""
    field = pii.trained()
    right = told = wanted = 0
    for tokens, labels in pii.training_table(300, seed=77):
        text, want, at = " ".join(tokens), set(), 0
        spans = []
        for t, x in zip(tokens, labels):
            if x[0] == "B":
                spans.append([at, at + len(t), x[2:]])
            elif x[0] == "I":
                spans[-1][1] = at + len(t)
            at += len(t) + 1
        for a, b, kind in spans:
            raw = text[a:b]
            inner = raw.rstrip(".,;")
            if kind != "card" or luhn(re.sub("[^0-9]", "", inner)):
                want.add((a, a + len(inner)))
        base, extra = pii.find_all(field, [text])[0]
        got = {(a, b) for a, b, _ in [*base, *extra]}
        right, told, wanted = right + len(got & want), told + len(got), wanted + len(want)
    print("precision", right / told, "recall", right / wanted)
    assert right / told > 0.9 and right / wanted > 0.9
