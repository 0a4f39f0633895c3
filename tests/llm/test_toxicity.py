import math
import random
import re
import zlib

from symweave.llm import toxicity

from .helpers import AWKWARD, docs, empty


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    terms = ["idiot", "scum", "moron", "worthless", "idiots", "disgusting"]
    machine = toxicity.Automaton(terms)
    r = random.Random(1)
    for _ in range(3000):
        word = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(word))
            word[i : i + r.choice([0, 1, 1])] = r.choice(["", "x", "é", r.choice("idotscum")])
            if r.random() < 0.3 and len(word) > 2:
                i = r.randrange(len(word) - 1)
                word[i], word[i + 1] = word[i + 1], word[i]
            word = word or ["x"]
        word = "".join(word)
        want = min((d for t in terms if (d := distance(word, t)) <= toxicity.allowed_errors(t)), default=None)
        got = machine.match(word)
        assert (got and got[1]) == want and (got is None or distance(word, got[0]) == got[1]), word


def test_stems_match_words_that_begin_so():
    machine = toxicity.Automaton(["idiot"], ["vequ"])
    assert machine.match("vequaire") == ("vequ", 0) and machine.match("vequ") == ("vequ", 0)
    assert machine.match("avequ") is None and machine.match("idiott") == ("idiot", 1)


def test_context_separates_quotation():
    scorer = toxicity.Scorer({"idiot": 5.0}, {})
    assert scorer.features("you are an idiot")[1] > 0 and scorer.features("you are an idiot")[3] == 0
    assert scorer.features('he said "idiot" and left')[1] == 0 and scorer.features('he said "idiot" and left')[3] > 0
    assert scorer.features("an idoit walks")[2] > 0
    assert scorer.features("") == [0.0] * 6


def planted(n, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdeno") for _ in range(r.randint(3, 7))) for _ in range(30)]
        bad = r.random() < 0.3
        if bad:
            words[r.randrange(30)] = r.choice(["grobian", "schuftig"])
            words[r.randrange(30)] = "zork" + r.choice(["ab", "ed", "on"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_separates_held_out_rows(spark):
    rows, labels = planted(600)
    table = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), table)
    assert {"grobian", "schuftig"} <= set(model.terms) and any(s.startswith("zork"[: len(s)]) for s in model.stems)
    got = toxicity.score_toxicity(docs(spark, rows), model).collect()
    truth = dict(labels)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) and g.predicted == int(g.score >= 0.7) for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.97
    assert toxicity.drop_toxic(docs(spark, rows), table).count() == sum(1 - g.predicted for g in got)


def test_held_out_labels_are_not_read(spark):
    rows, labels = planted(300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    models = [toxicity.learn(docs(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned)]
    assert models[0].weights == models[1].weights and models[0].terms == models[1].terms


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, AWKWARD), none)
    got = toxicity.score_toxicity(docs(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= g.score < 0.7 and g.predicted == 0 for g in got)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    assert toxicity.drop_toxic(docs(spark, AWKWARD), none).count() == len(AWKWARD)


def test_apostrophes_are_no_quotation_marks():
    scorer = toxicity.Scorer({"idiot": 5.0}, {})
    plain = scorer.features("we don't think you are an idiot but can't")
    assert plain[1] > 0 and plain[3] == 0
    assert scorer.features("we don’t think you are an idiot but can’t") == plain
    assert scorer.features("the dogs’ idiot can’t") [3] == 0 and scorer.features("the ‘idiot’ can’t")[3] > 0


def test_marks_must_enclose_the_hit():
    scorer = toxicity.Scorer({"idiot": 5.0}, {})
    for text in ('"hi" you are an idiot "bye"', "„hi“ you are an idiot „bye“", '"hi\nyou idiot\nbye"', '"hi you idiot', "»a« idiot »b«"):
        assert scorer.features(text)[1] > 0 and scorer.features(text)[3] == 0, text
    for text in ('she: "you idiot" ok', "„du idiot“", "»du idiot«", "«tu idiot»", "“an ‘idiot’ can’t”"):
        assert scorer.features(text)[1] == 0 and scorer.features(text)[3] > 0, text
    far = '"' + "walls " * 20 + "idiot " + "walls " * 20 + '"'
    assert scorer.features(far)[3] == 0  # beyond the window on either side


def brute_features(text, terms, stems, worth):
    """The features from their description, with edit distances instead of automata."""
    low = text.lower()
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", low)]
    n, total = toxicity.WINDOW, 0
    sums = {"exact": 0.0, "fuzzy": 0.0, "quoted": 0.0, "addressed": 0.0}
    pairs = []
    for line in re.finditer(r"[^\n]+", low):
        pairs += [(line.start() + m.start(1), line.start() + m.end(1)) for m in re.finditer(r'"([^"]*)"', line[0])]
    for i, (a, b, w) in enumerate(found):
        near = sorted((d, t) for t in terms if abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= toxicity.allowed_errors(t))
        stem = min((s for s in stems if w.startswith(s)), key=len, default=None)
        got = near[0] if near and (near[0][0] == 0 or stem is None) else (0, stem) if stem else None
        if got is None:
            continue
        total += 1
        around = [x for _, _, x in found[max(0, i - n) : i + n + 1]]
        left, right = found[max(0, i - n)][0], found[min(len(found) - 1, i + n)][1] + 1
        quoted = any(left <= p <= a and b <= q < right for p, q in pairs) or toxicity.REPORTING & set(around)
        sums["quoted" if quoted else "fuzzy" if got[0] else "exact"] += worth[got[1]]
        sums["addressed"] += worth[got[1]] * bool(toxicity.ADDRESS & set(around))
    if not total:
        return [0.0] * 6
    return [float(sums["exact"] + sums["fuzzy"] > 0), *(min(6.0, sums[k] / 4) for k in ("exact", "fuzzy", "quoted", "addressed")), min(5.0, 100.0 * total / len(found))]


def test_scores_match_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    terms = model.terms or {"worthless": 4.0, "idiot": 3.0, "moron": 3.0}
    model = toxicity.Model(terms, model.stems, model.weights)
    text = {r.doc_id: r.text or "" for r in table.collect()} | {-1: 'He said "worthles moron" and left', -2: "you are an iditо idoit"}
    got = {g.doc_id: g for g in toxicity.score_toxicity(docs(spark, list(text.items())), model).collect()}
    for i, t in text.items():
        x = [*brute_features(t, model.terms, model.stems, {**model.stems, **model.terms}), 1.0]
        z = sum(a * b for a, b in zip(x, model.weights))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9, (i, x)
        assert got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_rarer_terms_are_learned_from_larger_samples():
    counts = [("=vile", 12, 0), ("=often", 400, 40), ("=chance", 3, 0)]
    small, large = (toxicity.choose_lexicon([(f, p * k, n * k) for f, p, n in counts], 1000 * k, 9000 * k, 10**6)[0] for k in (1, 8))
    assert set(small) == {"vile", "often"} and set(large) == {"vile", "often", "chance"}


def test_many_opened_marks_take_no_longer_a_mark():
    import time

    def took(n):
        text = "“‘«(" * n + "word" + "”" * n
        began = time.process_time()
        found = toxicity.quotations(text)
        return time.process_time() - began, found

    assert took(200)[1] == brute_quotations("“‘«(" * 200 + "word" + "”" * 200)
    took(5_000)
    assert took(100_000)[0] < 60 * max(0.02, took(5_000)[0])


def brute_quotations(text):
    """Every mark looks through all that are open, newest first."""
    out, opened = [], []
    for m in toxicity._MARK.finditer(text):
        if m[0] == "\n":
            opened = []
            continue
        at = [i for i, (ch, _) in enumerate(opened) if m[0] in toxicity.CLOSERS[ch]]
        if at:
            out.append((opened[at[-1]][1], m.start()))
            opened = opened[: at[-1]]
        elif m[0] in toxicity.CLOSERS:
            opened.append((m[0], m.end()))
    return sorted(out)


def test_quotations_equal_looking_through_all_open_marks():
    import random

    draw = random.Random(3)
    marks = sorted(toxicity.CLOSERS) + sorted({c for closers in toxicity.CLOSERS.values() for c in closers}) + ["a", " ", "\n", "'"]
    for _ in range(300):
        text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 60)))
        assert toxicity.quotations(text) == brute_quotations(text)
