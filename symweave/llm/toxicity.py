"""Toxicity: Levenshtein automata over a learned lexicon trie, scored in context windows.

The lexicon (whole terms, which match with spelling errors, and word stems, which match as written) and
the weights are learned from a bounded sample of labelled rows. Scoring reads every whole text once, in
Arrow batches, and never looks at labels, lang, source or ids.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sliced, stored, text_or_empty

#: Labelled rows used for learning, at most about this many (drawn by a hash of their id).
SAMPLE_ROWS = 20_000
#: Words on either side of a hit that decide between quotation and abuse.
WINDOW = 6
#: Log odds from which a feature enters the lexicon, and the chance that any feature that says nothing does (all of them
#: are tested, so the bar rises with the logarithm of their number, and a larger sample teaches rarer terms).
LEAST_ODDS, CHANCE = 2.2, 0.01
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_STEM = range(4, 9)

# Words that introduce quoted speech, words that address a reader, and quotation marks.
REPORTING = frozenset("said says quote quoted quoting wrote writes called reported reports article term word sagte schrieb zitat zitierte dit écrit cité dijo escribió citó".split())
ADDRESS = frozenset("you your you're u ur du dich dein deine ihr tu toi ton ta vous votre tú te eres usted vosotros".split())
CLOSERS = {"\"": "\"", "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‹": "›"}
_MARK = re.compile(r"[\"“”„«»‹›\n]|(?<![^\W\d_])[‘’]|[‘’](?![^\W\d_])")


# ---- lexicon automaton ----------------------------------------------------------------------------------


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of the lexicon intersected with Levenshtein automata, made deterministic as words arrive.

    A state is a set of (trie node, errors so far, letter owed by a swap); an error is an inserted, missing,
    changed or swapped letter. match() gives (entry, errors) of the best entry, or None.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]
        for words, kind in ((terms, self.term), (stems, self.stem)):
            for w in sorted(set(words)):
                errors, node = allowed_errors(w) if kind is self.term else 0, 0
                self.most[0] = max(self.most[0], errors)
                for ch in w:
                    nxt = self.child[node].get(ch)
                    if nxt is None:
                        nxt = self.child[node][ch] = len(self.child)
                        self.child.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.most.append(0)
                    node = nxt
                    self.most[node] = max(self.most[node], errors)
                kind[node] = w
        self.letters = {c for d in self.child for c in d}
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.finals: list[tuple[str, int] | None] = []
        self.stems_at: list[str | None] = []
        self.start = self._state({(0, 0, "")})

    def _close(self, items: set) -> frozenset:
        todo, out = list(items), set(items)
        while todo:
            node, e, owed = todo.pop()
            if not owed:
                for nxt in self.child[node].values():  # a letter is missing from the word
                    if e < self.most[nxt] and (x := (nxt, e + 1, "")) not in out:
                        out.add(x)
                        todo.append(x)
        return frozenset(out)

    def _state(self, items: set) -> int:
        full = self._close(items)
        if full not in self.ids:
            self.ids[full] = len(self.states)
            self.states.append(full)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e, owed in full if not owed and self.term[n] is not None and e <= allowed_errors(self.term[n])]
            self.finals.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.stems_at.append(min((self.stem[n] for n, e, owed in full if not owed and e == 0 and self.stem[n] is not None), default=None))
        return self.ids[full]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e, owed in self.states[state]:
            if owed:
                if ch == owed:
                    out.add((node, e, ""))
                continue
            nxt = self.child[node].get(ch)
            if nxt is not None:
                out.add((nxt, e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))  # a letter too many
                for c, n in self.child[node].items():
                    if c != ch and e < self.most[n]:
                        out.add((n, e + 1, ""))  # another letter
                        swapped = self.child[n].get(ch)
                        if swapped is not None and e < self.most[swapped]:
                            out.add((swapped, e + 1, c))  # two letters swapped
        to = self._state(out) if out else -1
        self.steps[state][ch] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        state, stem, letters, steps = self.start, None, self.letters, self.steps
        for ch in word:
            if ch not in letters:
                ch = "\0"
            nxt = steps[state].get(ch)
            if nxt is None:
                nxt = self._step(state, ch)
            if nxt < 0:
                return (stem, 0) if stem else None
            state = nxt
            if stem is None:
                stem = self.stems_at[state]
        final = self.finals[state]
        if final and (final[1] == 0 or stem is None):
            return final
        return (stem, 0) if stem else None


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between paired quotation marks of one line, in order. A mark without its partner
    opens nothing; an apostrophe, straight or curly, between two letters is no mark, and straight ones never are.
    A line feed ends all quotations. Each mark is opened and dropped once, however many of them a line has."""
    out: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {c: [] for closers in CLOSERS.values() for c in closers}  # places in opened, by what closes them
    for m in _MARK.finditer(text):
        ch = m[0]
        if ch == "\n":
            opened.clear()
            for places in waiting.values():
                places.clear()
        elif waiting.get(ch):
            at = waiting[ch][-1]
            out.append((opened[at][1], m.start()))
            while len(opened) > at:
                for c in CLOSERS[opened.pop()[0]]:
                    waiting[c].pop()
        elif ch in CLOSERS:
            for c in CLOSERS[ch]:
                waiting[c].append(len(opened))
            opened.append((ch, m.end()))
    out.sort()
    return out


class Scorer:
    """Features of a text: how much evidence entries of the lexicon give, how exactly and in what context they occur."""

    NAMES = ("any", "exact", "misspelt", "quoted", "addressed", "density")
    #: Weights that the fit is drawn to where the sample says nothing.
    PRIOR = np.array([0.3, 1.5, 1.2, -0.3, 0.2, 0.1])
    CACHE = 400_000

    def __init__(self, terms: dict[str, float], stems: dict[str, float]) -> None:
        self.automaton = Automaton(terms, stems)
        self.worth = {**stems, **terms}
        self.known: dict[str, tuple[str, int] | None] = {}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        known, match, hits = self.known, self.automaton.match, {}
        if len(known) > self.CACHE:
            known.clear()
        for w in set(words):
            if w in known:
                got = known[w]
            else:
                got = known[w] = match(w)
            if got is not None:
                hits[w] = got
        if not hits:
            return [0.0] * len(self.NAMES)
        exact = fuzzy = quoted = addressed = 0.0
        total = 0
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        quotes = quotations(low)
        first = 0
        for i, w in enumerate(words):
            got = hits.get(w)
            if got is None:
                continue
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            worth = self.worth[got[0]]
            total += 1
            a, b = spans[i]
            # quoted: both marks of a pair stand within the window, one on either side
            low_end, high_end = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1] + 1
            while first < len(quotes) and quotes[first][0] < low_end:
                first += 1
            inside, k = False, first
            while not inside and k < len(quotes) and quotes[k][0] <= a:
                inside = b <= quotes[k][1] < high_end
                k += 1
            if inside or any(x in REPORTING for x in near):
                quoted += worth
            elif got[1]:
                fuzzy += worth
            else:
                exact += worth
            addressed += worth * any(x in ADDRESS for x in near)
        return [float(exact + fuzzy > 0), *(min(6.0, x / 4) for x in (exact, fuzzy, quoted, addressed)), min(5.0, 100.0 * total / len(words))]


# ---- learning -------------------------------------------------------------------------------------------


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3


def _word_features(words: set[str]) -> set[str]:
    return {"=" + w for w in words} | {w[:n] for w in words for n in _STEM if len(w) > n}


def evidence(p: int, n: int, rate: float) -> float:
    """Chernoff's bound: minus the log of the chance that p or more of p + n documents are toxic where each is at the rate."""
    own = p / (p + n)
    if own <= rate:
        return 0.0
    return p * math.log(own / rate) + (n * math.log((1 - own) / (1 - rate)) if n else 0.0)


def choose_lexicon(counts: list[tuple[str, int, int]], positives: int, negatives: int, tested: int) -> tuple[dict[str, float], dict[str, float]]:
    """counts: (feature, toxic documents, clean documents). Terms and stems that mark toxic documents, with their log odds.

    Features are taken in order of log odds times the root of their toxic documents, whole words before stems, longer before
    shorter; one that extends a taken stem, or whose documents are already explained, is passed over.
    """

    def odds(p: int, n: int) -> float:
        return math.log((p + 0.5) / (positives + 1)) - math.log((n + 0.5) / (negatives + 1))

    rate = (positives + 0.5) / (positives + negatives + 1)
    bar = math.log(max(1, tested) / CHANCE)
    good = [(odds(p, n) * math.sqrt(p), f, p, n) for f, p, n in counts if p and odds(p, n) >= LEAST_ODDS and evidence(p, n, rate) >= bar]
    good.sort(key=lambda x: (-round(x[0], 6), not x[1].startswith("="), -len(x[1]), x[1]))
    terms: dict[str, tuple[int, int]] = {}
    stems: dict[str, tuple[int, int]] = {}
    for z, f, p, n in good:
        word = f.removeprefix("=")
        if any(word.startswith(s) for s in stems):
            continue
        inner = [v for w, v in (*terms.items(), *stems.items()) if w.startswith(word)] if not f.startswith("=") else []
        more_p, more_n = p - sum(v[0] for v in inner), n - sum(v[1] for v in inner)
        if more_p > 0.02 * p and odds(more_p, max(0, more_n)) >= LEAST_ODDS and evidence(more_p, max(0, more_n), rate) >= bar:
            (terms if f.startswith("=") else stems)[word] = (p, n)
    return {w: odds(*terms[w]) for w in sorted(terms)}, {w: odds(*stems[w]) for w in sorted(stems)}


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    mean = np.append(prior, math.log(rate / (1 - rate)) if len(y) else -2.0)
    w, pull = mean.copy(), np.append(np.full(len(prior), ridge), 1e-3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - mean))
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, float], stems: dict[str, float], weights: list[float]) -> None:
        self.terms, self.stems, self.weights = terms, stems, weights


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 3 is not 1; about sample_rows of them at most.

    Null labels and ids are left out; of several labels of one id the toxic one counts. Without any
    usable label the lexicon is empty and the score is a low constant.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = int(min(1.0, sample_rows / max(1, n)) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select(F.col("doc_id").alias("labelled"), (F.col("toxic") == 1).alias("toxic"))
    # near copies of a text share the least hash of its five-word shingles with a chance of their similarity
    alike = F.expr("array_min(transform(sequence(1, greatest(1, size(w) - 4)), i -> xxhash64(slice(w, i, 5))))")
    sample = (
        docs.select("doc_id", text_or_empty("text").alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
        .withColumn("w", F.split(F.lower("text"), r"\s+"))
        .select("doc_id", "text", "toxic", alike.alias("alike"))
        .select("doc_id", "text", "toxic", F.pmod(F.xxhash64("alike", F.lit(7)), F.lit(2)).alias("fold"), "alike")
    )
    # copies and near copies count once, and fall into one fold
    sample = stored(sample, "drawn")
    once = sample.groupBy("alike", "toxic").agg(F.min("doc_id").alias("first")).select("first").distinct()
    sample = stored(sample.drop("alike").join(once, F.col("doc_id") == F.col("first"), "left_semi"), "labelled")

    def sets():
        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            keep = [(f, sorted(_word_features(set(_WORD.findall(t.lower()))))) for t, f, y in zip(texts, batch.column(3).to_pylist(), batch.column(2).to_pylist()) if y]
            return {"fold": [f for f, _ in keep], "features": [x for _, x in keep]}

        return call

    found = map_texts(sample, sets, "fold long, features array<string>").select("fold", F.explode("features").alias("feature"))
    toxic = found.groupBy("feature").agg(F.sum(F.when(F.col("fold") == 0, 1).otherwise(0)).alias("p0"), F.count(F.lit(1)).alias("p"))
    size = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    sizes = {y: sum(v for (_, t), v in size.items() if t == y) for y in (True, False)}
    toxic = stored(toxic, "toxic-features")
    tested = toxic.count()
    # fewer toxic documents than this pass no bar even if no clean one holds the feature (half a sample has a rate of its own)
    least = math.log(max(1, tested) / CHANCE) / -math.log(min(0.999, max(1e-9, (sizes[True] + 0.5) / (sum(sizes.values()) + 1))))
    marks = {r["feature"]: (r["p0"], r["p"] - r["p0"]) for r in toxic.where(F.col("p") >= least / 2).collect()}

    def clean():
        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            counts: dict[tuple[int, str], int] = {}
            for t, f, y in zip(texts, batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if not y:
                    for x in _word_features(set(_WORD.findall(t.lower()))):
                        if x in marks:
                            counts[f, x] = counts.get((f, x), 0) + 1
            return {"fold": [k[0] for k in counts], "feature": [k[1] for k in counts], "n": list(counts.values())}

        return call

    other: dict[tuple[int, str], int] = {(r["fold"], r["feature"]): r["n"] for r in map_texts(sample, clean, "fold long, feature string, n long").groupBy("fold", "feature").agg(F.sum("n").alias("n")).collect()}

    def lexicon(folds: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
        counts = [(f, sum(p[k] for k in folds), sum(other.get((k, f), 0) for k in folds)) for f, p in marks.items()]
        return choose_lexicon(counts, sum(size.get((k, True), 0) for k in folds), sum(size.get((k, False), 0) for k in folds), tested)

    halves = {0: lexicon((1,)), 1: lexicon((0,))}  # a row's features come from the other half's lexicon

    def rows():
        scorers = {k: Scorer(*v) for k, v in halves.items()}

        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            return {"y": [float(y) for y in batch.column(2).to_pylist()], "x": [scorers[f].features(t) for t, f in zip(texts, batch.column(3).to_pylist())]}

        return call

    table = map_texts(sample, rows, "y double, x array<double>").toPandas()  # a few numbers for each row of the bounded sample
    x = np.array(table["x"].tolist(), dtype=float).reshape(-1, len(Scorer.NAMES))
    y = table["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    return Model(*lexicon((0, 1)), fit(x[order], y[order], Scorer.PRIOR).tolist())


# ---- scoring --------------------------------------------------------------------------------------------


def _score(scorer: Scorer, weights: np.ndarray, texts: list[str]) -> np.ndarray:
    x = np.array([scorer.features(t) for t in texts], dtype=float).reshape(-1, len(Scorer.NAMES))
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without hits. A text of any length is scored whole. Repeated rows
    give repeated results; a null id has a null held_out. An empty table gives no rows; further columns are not read.
    """

    def make():
        scorer, weights = Scorer(model.terms, model.stems), np.array(model.weights)

        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            return {"doc_id": batch.column(0), "score": _score(scorer, weights, texts)}

        return call

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay. The model is learned from docs and labels."""
    model = learn(docs, labels)

    def run(batches):
        scorer, weights = Scorer(model.terms, model.stems), np.array(model.weights)
        for batch in sliced(batches, "text"):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(_score(scorer, weights, texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
