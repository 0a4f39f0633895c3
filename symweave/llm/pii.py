"""Personal data: exact patterns plus a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table that a rule with a fixed seed writes; it is decoded by
Viterbi in numpy, many token runs at once. Only tokens with a digit or an @ may carry a label, so the
lattice of a text falls apart, without loss, into the runs of such tokens.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Sentences of the labelled training table.
TRAIN_SENTENCES = 400

# The base patterns, with their first characters pinned where that does not change a match.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<!\S)(?=\S*?[0-9@])\S++")

_DOUBLE = {str(d): (2 * d if d < 5 else 2 * d - 9) for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLE[d] for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end, kind) as (start, end, kind) in order of start, then of KINDS."""
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        # the local part is the run before the @ that the last match has not taken; one pass over each run
        low = at
        while low > end:
            step = max(end, low - 64)
            rest = text[step:low].rstrip(_LOCAL)
            low = step + len(rest)
            if rest:
                break
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((low, 0, end))
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return [(a, b, KINDS[k]) for a, k, b in out]


# ---- conditional random field ---------------------------------------------------------------------------

_SHAPE = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_REPEAT = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Word shape: letters and digits by class, repeats folded, with the number of digits up to 20."""
    s = token.translate(_SHAPE)
    return f"{_REPEAT.sub(r'\1+', s)}|{min(20, s.count('d'))}"


def coarse(token: str) -> str:
    """What a neighbour shows: its first and last character class and whether it holds digits or an @."""
    if not token:
        return "none"
    s = (token[0] + token[-1]).translate(_SHAPE)
    return f"{s}{'d' if any(c.isdigit() for c in token) else ''}{'@' if '@' in token else ''}"


def training_table(sentences: int = TRAIN_SENTENCES, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (tokens, labels), written by a rule from a fixed seed."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(a, b)))
    end = lambda: r.choice(["", "", ".", ",", ";"])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([[f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{digits(2)}", a, b, c], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{digits(11)}"], [f"+{digits(1)}-{a}-{b}-{c}"]])

    def card() -> list[str]:
        return r.choice([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(15)]])

    def email() -> list[str]:
        return [r.choice([f"{letters(2, 7)}.{digits(2)}", letters(3, 9), f"{letters(1, 2)}_{letters(3, 6)}"]) + "@" + r.choice([letters(3, 8), f"mail{digits(1)}.{letters(3, 6)}"]) + r.choice([".com", ".org", ".net", ".de"])]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def other() -> list[str]:
        return [r.choice([digits(r.randint(1, 4)), f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}%", f"${digits(3)}", f"{letters(3, 6)}{digits(2)}", f"@{letters(3, 8)}", f"{digits(1)},{digits(3)}", f'"{r.choice("abcdef0123456789")}{digits(8)}{letters(8, 20)}{digits(6)}"', f"http://{letters(4, 8)}.com/{digits(3)}"])]

    cues = {"phone": ["call", "tel", "phone"], "card": ["card", "visa", "paid"], "email": ["mail", "write", "contact"], "ip": ["host", "from", "address"]}
    rows = []
    for _ in range(sentences):
        tokens, labels = [], []
        for _ in range(r.randint(2, 5)):
            for _ in range(r.randint(1, 4)):
                tokens.append(letters(2, 9) + r.choice(["", "", "", ",", "."]))
                labels.append("O")
            kind = r.choice([*KINDS, "other", "other"])
            got = {"phone": phone, "card": card, "email": email, "ip": ip, "other": other}[kind]()
            if kind != "other" and r.random() < 0.3:
                tokens.append(r.choice(cues[kind]) + r.choice(["", ":"]))
                labels.append("O")
            got[-1] += end()
            tokens += got
            labels += ["O"] * len(got) if kind == "other" else [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
        rows.append((tokens, labels))
    return rows


def own_features(token: str) -> tuple[str, ...]:
    s = shape(token)
    folded, _, digits = s.rpartition("|")
    return (f"s={s}", f"f={folded.rstrip('.,;')}", f"n={digits}", f"c={token[0] if token else ''}", f"d={min(6, token.count('.'))}{'@' in token}{'-' in token}")


def before_features(prev: str) -> tuple[str, ...]:
    return (f"p={coarse(prev)}", f"w={prev.lower().rstrip(':')}")


def after_features(nxt: str) -> tuple[str, ...]:
    return (f"x={coarse(nxt)}",)


def token_features(prev: str, token: str, nxt: str) -> tuple[str, ...]:
    return (*own_features(token), *before_features(prev), *after_features(nxt))


class Field:
    """Feature weights (rows of emit, the last one for unknown features) and transition weights."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> None:
        self.index, self.emit, self.move, self.first = index, emit, move, first

    def scores(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        none, get = len(self.index), self.index.get
        ids = np.array([[get(f, none) for f in r] for r in rows], np.int64)
        return self.emit[ids].sum(axis=1)

    def around(self, tokens: list[str]) -> np.ndarray:
        """Scores of tokens[1:-1]; what is the same for equal tokens is worked out once."""
        total = 0.0
        for make, part in ((before_features, tokens[:-2]), (own_features, tokens[1:-1]), (after_features, tokens[2:])):
            place: dict[str, int] = {}
            at = np.fromiter((place.setdefault(t, len(place)) for t in part), np.int64, len(part))
            total = total + self.scores([make(t) for t in place])[at]
        return total


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps with momentum; forward-backward over all sentences at once."""
    place = {x: i for i, x in enumerate(LABELS)}
    n, t, k = len(table), max(len(a) for a, _ in table), len(LABELS)
    rows = [[token_features(a[i - 1] if i else "", a[i], a[i + 1] if i + 1 < len(a) else "") for i in range(len(a))] for a, _ in table]
    index = {f: i for i, f in enumerate(sorted({f for r in rows for x in r for f in x}))}
    width = len(rows[0][0])
    ids = np.full((n, t, width), len(index), np.int64)
    gold = np.zeros((n, t), np.int64)
    there = np.zeros((n, t), bool)
    for i, ((_, labels), r) in enumerate(zip(table, rows)):
        ids[i, : len(r)] = [[index[f] for f in x] for x in r]
        gold[i, : len(labels)] = [place[x] for x in labels]
        there[i, : len(labels)] = True
    emit, move, first = np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move, first)]
    onehot = np.eye(k)[gold] * there[:, :, None]
    pair = there[:, 1:] & there[:, :-1]
    gold_move = np.zeros((k, k))
    np.add.at(gold_move, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    for step in range(1, steps + 1):
        e = emit[ids].sum(axis=2)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + first
        for i in range(1, t):
            new = _lse(alpha[:, i - 1, :, None] + move, 1) + e[:, i]
            alpha[:, i] = np.where(there[:, i, None], new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = _lse(move + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(there[:, i + 1, None], new, 0.0)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * there[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        diff = (node - onehot) / n
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, ids.reshape(-1, width), np.repeat(diff.reshape(-1, 1, k), width, axis=1))
        g_emit[-1] = 0
        grads = (g_emit + ridge * emit, (edge.sum(axis=(0, 1)) - gold_move) / n + ridge * move, diff[:, 0].sum(axis=0) + ridge * first)
        for w, g, m in zip((emit, move, first), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move, first)


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(training_table())


def viterbi(e: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label paths of a padded batch: e is (runs, steps, labels); steps beyond a run's length are 0."""
    n, t, k = e.shape
    back = np.zeros((n, t, k), np.int8)
    score = e[:, 0] + first
    for i in range(1, t):
        cand = score[:, :, None] + move
        back[:, i] = cand.argmax(axis=1)
        score = np.where((i < lengths)[:, None], cand.max(axis=1) + e[:, i], score)
    path = np.zeros((n, t), np.int64)
    now = score.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        live = i < lengths
        path[live, i] = now[live]
        if i:
            now = np.where(live, back[np.arange(n), i, now], now)
    return path


#: Cells (runs x steps) of one Viterbi batch, and tokens that are scored at once: longer runs are decoded block by block.
CELLS = 1 << 15
#: Steps of a block's parts, which are decoded side by side from every state that they may be entered in.
PART = 128


def decode_scores(field: Field, e: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Label ids of runs, whose scores stand in e one after another; runs of like length share numpy batches."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    outside = LABELS.index("O")
    # a run stands between tokens that carry O, so its first label follows an O and its last one precedes an O
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * lengths[order[j]] <= CELLS:
            j += 1
        part = np.array(order[i:j])
        n = np.array([lengths[x] for x in part])
        where = np.arange(n.max()) < n[:, None]
        batch = np.zeros((len(part), n.max(), len(LABELS)))
        batch[where] = e[(starts[part][:, None] + np.arange(n.max()))[where]]
        batch[np.arange(len(part)), n - 1] += field.move[:, outside]
        path = viterbi(batch, n, field.move, field.move[outside])
        for x, p, m in zip(part.tolist(), path, n.tolist()):
            out[x] = p[:m]
        i = j
    return out


def decode(field: Field, runs: list[list[tuple[str, ...]]]) -> list[list[int]]:
    """Label ids for each run of token features."""
    flat = [f for r in runs for f in r]
    return [x.tolist() for x in decode_scores(field, field.scores(flat), [len(r) for r in runs])] if flat else [[] for _ in runs]


def _block(e: np.ndarray, move: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """Scores of the last step's labels of a block that is entered with the given scores of the label before it, and a
    function from that last label to the block's best path. The parts of the block run side by side, each from every
    label before it; then their ends are joined."""
    k = e.shape[1]
    n = -(-len(e) // PART)
    sizes = np.minimum(PART, len(e) - PART * np.arange(n))
    padded = np.zeros((n, PART, k))
    padded.reshape(-1, k)[: len(e)] = e
    back = np.broadcast_to(np.arange(k, dtype=np.int8), (PART, n, k, k)).copy()
    score = move[None] + padded[:, None, 0]  # part, label before it, label
    for i in range(1, PART):
        cand = score[:, :, :, None] + move
        live = (i < sizes)[:, None, None]
        back[i] = np.where(live, cand.argmax(axis=2), back[i])
        score = np.where(live, cand.max(axis=2) + padded[:, None, i], score)
    entered = np.zeros((n, k), np.int64)  # best label before each part, for each of its last labels
    for j in range(n):
        cand = enter[:, None] + score[j]
        entered[j], enter = cand.argmax(axis=0), cand.max(axis=0)

    def trace(last: int) -> np.ndarray:
        ends, begins = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(n - 1, -1, -1):
            ends[j], begins[j] = last, entered[j, last]
            last = begins[j]
        path, now = np.zeros((n, PART), np.int8), ends
        for i in range(PART - 1, -1, -1):
            path[:, i] = now
            now = back[i, np.arange(n), begins, now]
        trace.before = int(begins[0])
        return path.reshape(-1)[: len(e)]

    return enter, trace


def decode_long(field: Field, scores: Callable[[int, int], np.ndarray], n: int, block: int = CELLS) -> np.ndarray:
    """Label ids of one run of n tokens, whose scores are made block by block and twice: forwards to the scores at the
    blocks' borders, then backwards for the path. Nothing but those and the labels is held of the whole run."""
    outside = LABELS.index("O")
    enter = np.full(len(LABELS), -np.inf)
    enter[outside] = 0.0
    borders = []
    for a in range(0, n, block):
        borders.append(enter)
        enter, _ = _block(scores(a, min(n, a + block)), field.move, enter)
    out, last = np.zeros(n, np.int8), int((enter + field.move[:, outside]).argmax())
    for a in reversed(range(0, n, block)):
        _, trace = _block(scores(a, min(n, a + block)), field.move, borders.pop())
        out[a : a + block] = trace(last)
        last = trace.before
    return out


_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<", "\"'.,;:!?)]}>"


def _enough(kind: str, text: str) -> bool:
    """What a decoded span must also show; a card number must pass its checksum."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "card" and not luhn("".join(c for c in text if c in "0123456789")):
        return False
    return {"email": "@" in text[1:-1], "ip": 4 <= digits <= 12 and text.count(".") == 3, "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def candidate_runs(text: str) -> Iterator[tuple[array, array]]:
    """Starts and ends of tokens with a digit or an @, in runs that only white space separates."""
    starts, ends = array("q"), array("q")
    for m in _CANDIDATE.finditer(text):
        if ends and not text[ends[-1] : m.start()].isspace():
            yield starts, ends
            starts, ends = array("q"), array("q")
        starts.append(m.start())
        ends.append(m.end())
    if ends:
        yield starts, ends


def _before(text: str, at: int) -> str:
    """The whole word before a place, or nothing."""
    wide = 64
    while True:
        left = text[max(0, at - wide) : at]
        found = left.split()
        if wide >= at or len(found) > 1 or (found and left[0].isspace()):
            return found[-1] if found else ""
        wide *= 8


def _after(text: str, at: int) -> str:
    wide = 64
    while True:
        right = text[at : at + wide]
        found = right.split(None, 1)
        if at + wide >= len(text) or len(found) > 1 or (found and right[-1].isspace()):
            return found[0].strip() if found else ""
        wide *= 8


def _labelled(text: str, starts: array, ends: array, path: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Spans of a run's labels that show what their kind must show."""
    outside, j = LABELS.index("O"), 0
    for j_ in np.flatnonzero(path != outside).tolist():
        if j_ < j:
            continue
        kind, n = LABELS[path[j_]][2:], j_ + 1
        while n < len(path) and LABELS[path[n]] == f"I-{kind}":
            n += 1
        j = n
        a, b = starts[j_], ends[n - 1]
        raw = text[a:b]
        a += len(raw) - len(raw.lstrip(_TRIM_LEFT if kind != "phone" else "\"'[{<"))
        b -= len(raw) - len(raw.rstrip(_TRIM_RIGHT))
        if a < b and _enough(kind, text[a:b]):
            yield a, b, f"crf_{kind}"


def find_all(field: Field, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, spans that the field adds) for each text; added ones touch no base span."""
    extra: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held: list[tuple[int, array, array]] = []
    scores: list[np.ndarray] = []

    def around(text: str, starts: array, ends: array, a: int, b: int) -> np.ndarray:
        tokens = [text[x:y] for x, y in zip(starts[a:b], ends[a:b])]
        left = text[starts[a - 1] : ends[a - 1]] if a else _before(text, starts[0])
        right = text[starts[b] : ends[b]] if b < len(starts) else _after(text, ends[-1])
        return field.around([left, *tokens, right])

    def flush() -> None:
        if held:
            paths = decode_scores(field, np.concatenate(scores), [len(x[1]) for x in held])
            for (i, starts, ends), path in zip(held, paths):
                extra[i] += _labelled(texts[i], starts, ends, path)
        held.clear()
        scores.clear()

    tokens, waiting = [], 0
    for i, text in enumerate(texts):
        for starts, ends in candidate_runs(text):
            n = len(starts)
            if n > CELLS:
                path = decode_long(field, lambda a, b: around(text, starts, ends, a, b), n)  # noqa: B023
                extra[i] += _labelled(text, starts, ends, path)
                continue
            held.append((i, starts, ends))
            tokens += [_before(text, starts[0]), *(text[x:y] for x, y in zip(starts, ends)), _after(text, ends[-1])]
            waiting += n
            if waiting >= CELLS:
                scores.append(_inner(field, tokens, held))
                flush()
                tokens, waiting = [], 0
    if held:
        scores.append(_inner(field, tokens, held))
        flush()
    out = []
    for text, e in zip(texts, extra):
        base = base_spans(text)
        kept, k = [], 0
        for a, z, kind in sorted(e):
            while k < len(base) and base[k][1] <= a:
                k += 1
            # base spans of different kinds may overlap; one that begins before z and ends after a touches this one
            j = k
            while j < len(base) and base[j][0] < z and base[j][1] <= a:
                j += 1
            if j == len(base) or base[j][0] >= z:
                kept.append((a, z, kind))
        out.append((base, kept))
    return out


def _inner(field: Field, tokens: list[str], held: list[tuple[int, array, array]]) -> np.ndarray:
    """Scores of the runs' tokens, without those of the words around each run, which stand among them."""
    inside = np.ones(len(tokens), bool)
    at = 0
    for _, starts, _ in held:
        inside[at] = inside[at + len(starts) + 1] = False
        at += len(starts) + 2
    return field.around(["", *tokens, ""])[inside]


_ORDER = {k: i for i, k in enumerate((*KINDS, *(f"crf_{k}" for k in KINDS)))}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]])))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf.

    A null text is an empty one (no spans; the digest of the empty string). Null ids are kept, repeated rows give
    repeated results, an empty table none; other columns are not read. A text of any length is read whole; long runs
    of candidate tokens are decoded block by block, in memory that does not grow with them but for a few bytes a token.
    """
    field = field or trained()

    def make():
        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            found = find_all(field, texts)
            out: dict[str, list] = {f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [_joined(b + e) for b, e in found]
            out["n_crf"] = [len(e) for _, e in found]
            return out | {"doc_id": batch.column(0)}

        return call

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
