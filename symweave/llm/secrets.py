"""Secret scan with DataFrame functions only: exact patterns, and a battery of randomness tests.

The battery looks at runs of encoding characters that the patterns leave: one scan takes base spans and the runs
between them, so a run ends where a base span begins and none is seen twice. For the alphabet that a run seems to be
written in it measures chi-squared uniformity, runs about the middle of the alphabet and serial correlation.

It is asked twice. Against random symbols, the three are combined by Fisher: a run that they tell from random symbols
is no secret. Against ordinary text, the first two are combined by Stouffer with the weights that tell the two apart
best (in text the letters' middle is crossed nearly as often as at random, and serial correlation is the same): what is
left is the chance that ordinary text of this length spreads so evenly. Those chances, weighted in proportion to
length, go through one Benjamini-Hochberg step-up over all runs of the table, so that the share of false discoveries
holds for the table however many documents it has. The step-up works on a histogram of the chances (rounded up to the
next twentieth of a power of e), which is all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# The base patterns.
_LEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _LEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more characters; a longer start never follows a shorter one in a run
HEX = r"[0-9a-f]{16,}"
LEAST_TOKEN = 16
_SYMBOL = "[A-Za-z0-9+/_-]"  # and up to two = at the end, as padding
_BASE_AHEAD = rf"{_LEAD}[A-Za-z0-9+/_.=-]{{12}}|[0-9a-f]{{16}}|AKIA[A-Z0-9]{{14}}"
#: Base matches and, between them, runs that no base span begins in; a hexadecimal span gives way to an assignment.
SCAN = rf"{ASSIGN}|{ACCESS}|(?:(?!{_LEAD})[0-9a-f]){{16,}}+|(?:(?<!{_SYMBOL})|(?<=[0-9a-f]{{16}}))(?:(?!{_BASE_AHEAD}){_SYMBOL}){{{LEAST_TOKEN},}}+={{0,2}}+"

KINDS = ("assign", "access", "hex", "random")
#: False-discovery rate over the runs of a table, and the least p-value of the battery under randomness.
FDR = 0.05
LEAST_RANDOM = 1e-3
#: In ordinary text, by alphabet: the share of symbol pairs that agree, and of neighbours on different sides of the middle.
TEXT_REPEAT = {16: 0.14, 32: 0.075, 64: 0.066}
TEXT_CHANGE = {16: 0.45, 32: 0.43, 64: 0.455}
#: Weight of the runs test beside chi-squared's: how far text and random symbols are apart in either, in deviations.
RUNS_WEIGHT = 0.2
#: Steps of the histogram of chances, for each power of e.
STEPS = 20
_BLOCK = 128

_ALPHABETS = {
    16: "0123456789ABCDEF",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_spans(df: DataFrame, name: str, pattern: str, groups: tuple[int, ...] = ()) -> DataFrame:
    """Add name: array of (start, end, match, groups) of leftmost non-overlapping matches, in code points.

    Starts are prefix sums over the pieces between matches; sums run in blocks, so that a text with very
    many matches costs little more than one with few.
    """
    p = _sql(pattern)
    hit = f"text rlike {p}"
    empty = "cast(array() as array<string>)"
    df = df.withColumn("_gaps", F.expr(f"if({hit}, split(text, {p}, -1), {empty})")).withColumn("_all", F.expr(f"if({hit}, regexp_extract_all(text, {p}, 0), {empty})"))
    for g in groups:
        df = df.withColumn(f"_g{g}", F.expr(f"if({hit}, regexp_extract_all(text, {p}, {g}), {empty})"))
    df = df.withColumn("_steps", F.expr("transform(_all, (m, i) -> cast(length(m) + length(_gaps[i]) as bigint))"))
    df = df.withColumn("_blocks", F.expr(f"if(size(_steps) = 0, cast(array() as array<array<bigint>>), transform(sequence(0, (size(_steps) - 1) div {_BLOCK}), b -> slice(_steps, b * {_BLOCK} + 1, {_BLOCK})))"))
    df = df.withColumn("_tops", F.expr("aggregate(_blocks, array(0L), (acc, b) -> array_append(acc, element_at(acc, -1) + aggregate(b, 0L, (s, x) -> s + x)))"))
    df = df.withColumn("_ends", F.expr("flatten(transform(_blocks, (b, i) -> transform(b, (x, j) -> _tops[i] + aggregate(slice(b, 1, j + 1), 0L, (s, y) -> s + y))))"))
    extra = "".join(f", '_g{g}', _g{g}[i]" for g in groups)
    df = df.withColumn(name, F.expr(f"transform(_all, (m, i) -> named_struct('start', _ends[i] - length(m), 'end', _ends[i], 'match', m{extra}))"))
    return df.drop("_gaps", "_all", "_steps", "_blocks", "_tops", "_ends", *(f"_g{g}" for g in groups))


def normal_cdf(z: str) -> str:
    """SQL for the standard normal distribution function (logistic form, error below 2e-4)."""
    return f"(1 / (1 + exp(-least(30D, greatest(-30D, 1.5976 * ({z}) + 0.07056 * pow({z}, 3))))))"


def _battery(df: DataFrame) -> DataFrame:
    """tokens: array of (start, end, match) -> tests: array of (start, end, n, p_text, p_random), by start."""
    kinds = " ".join(f"when x.body rlike {_sql(p)} then {k}" for k, p in ((16, "^([0-9A-F]+|[0-9a-f]+)$"), (32, "^[A-Z2-7]+$")))
    df = df.withColumn("_t", F.expr("transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'body', translate(rtrim('=', t.match), '-_', '+/')))"))
    df = df.withColumn("_t", F.expr(f"transform(_t, x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'k', case {kinds} else 64 end))"))
    alphabet = "case x.k " + " ".join(f"when {k} then '{a}'" for k, a in _ALPHABETS.items()) + " end"
    written = "if(x.k = 16, upper(x.body), x.body)"
    df = df.withColumn("_t", F.expr(f"transform(_t, x -> named_struct('start', x.start, 'end', x.end, 'k', cast(x.k as double), 'n', cast(length(x.body) as double), 'v', transform(split({written}, ''), c -> cast(locate(c, {alphabet}) as double)), 'squares', aggregate(sequence(1, x.k), 0D, (s, i) -> s + pow(length({written}) - length(replace({written}, substr({alphabet}, i, 1), '')), 2))))"))
    df = df.withColumn("_t", F.expr("transform(_t, x -> named_struct('t', x, 'mean', aggregate(x.v, 0D, (s, y) -> s + y) / x.n))"))
    df = df.withColumn(
        "_t",
        F.expr(
            "transform(_t, y -> named_struct('start', y.t.start, 'end', y.t.end, 'n', y.t.n, 'k', y.t.k, 'pairs', (y.t.squares - y.t.n) / 2,"
            " 'chi', (y.t.k / y.t.n * y.t.squares - y.t.n - (y.t.k - 1)) / sqrt(2 * (y.t.k - 1) * (y.t.n - 1) / y.t.n),"
            " 'runs', (aggregate(zip_with(slice(y.t.v, 1, cast(y.t.n as int) - 1), slice(y.t.v, 2, cast(y.t.n as int) - 1), (a, b) -> if((a > y.t.k / 2) <> (b > y.t.k / 2), 1D, 0D)), 1D, (s, z) -> s + z) - (y.t.n + 1) / 2) / sqrt((y.t.n - 1) / 4),"
            " 'serial', sqrt(y.t.n) * aggregate(zip_with(slice(y.t.v, 1, cast(y.t.n as int) - 1), slice(y.t.v, 2, cast(y.t.n as int) - 1), (a, b) -> (a - y.mean) * (b - y.mean)), 0D, (s, z) -> s + z) / greatest(1e-9D, aggregate(y.t.v, 0D, (s, a) -> s + pow(a - y.mean, 2)))))"
        ),
    )
    by = lambda values: "case x.k " + " ".join(f"when {k} then {v}D" for k, v in values.items()) + " end"
    expected = f"(x.n * (x.n - 1) / 2 * {by(TEXT_REPEAT)})"
    changes = f"((x.n - 1) * {by(TEXT_CHANGE)})"
    p = [f"greatest(1e-12D, 1 - {normal_cdf('x.chi')})", f"greatest(1e-12D, 2 * (1 - {normal_cdf('abs(x.runs)')}))", f"greatest(1e-12D, 2 * (1 - {normal_cdf('abs(x.serial)')}))"]
    stat = "(" + " + ".join(f"-ln({q})" for q in p) + ")"
    # x.runs counts from what random symbols give; (n + 1) / 2 - 1 changes are theirs
    more = f"(x.runs * sqrt((x.n - 1) / 4) + (x.n - 1) / 2 - {changes}) / sqrt({changes} * (1 - {by(TEXT_CHANGE)}))"
    text = f"(((x.pairs - {expected}) / sqrt(1.5 * {expected}) - {RUNS_WEIGHT}D * {more}) / sqrt(1 + {RUNS_WEIGHT}D * {RUNS_WEIGHT}D))"
    df = df.withColumn("_t", F.expr(f"transform(_t, x -> named_struct('start', x.start, 'end', x.end, 'n', x.n, 'p_text', {normal_cdf(text)}, 'stat', {stat}))"))
    # Fisher: minus twice the log of the product has six degrees of freedom
    return df.withColumn("tests", F.expr("transform(_t, x -> named_struct('start', x.start, 'end', x.end, 'n', x.n, 'p_text', x.p_text, 'p_random', exp(-x.stat) * (1 + x.stat + pow(x.stat, 2) / 2)))")).drop("_t")


def step_up(bins: list[tuple[int, int, float]], rate: float = FDR) -> int | None:
    """bins: (step, runs, sum of their lengths). The lowest step whose runs are discoveries, or None.

    A run of length n and chance p is on step floor(STEPS * ln(n / p)), so its weighted chance p * mean / n is at most
    mean * exp(-step / STEPS); those are what the step-up compares with rate * rank / runs."""
    total, mean, seen, found = sum(c for _, c, _ in bins), sum(x for _, _, x in bins), 0, None
    for step, count, _ in sorted(bins, reverse=True):
        seen += count
        if mean / total * math.exp(-step / STEPS) <= rate * seen / total:
            found = step
    return found


def _step(x: str) -> str:
    return f"cast(floor({STEPS} * (ln({x}.n) - ln({x}.p_text))) as int)"


def _discoveries(df: DataFrame) -> DataFrame:
    """tests -> found: array of (start, end) that pass the table's step-up and look random. df must be a stored table."""
    steps = df.select(F.explode("tests").alias("x")).groupBy(F.expr(_step("x")).alias("step")).agg(F.count(F.lit(1)).alias("runs"), F.sum("x.n").alias("symbols"))
    least = step_up([tuple(r) for r in steps.collect()])  # at most STEPS rows for each power of e that chances span
    passed = "false" if least is None else f"{_step('x')} >= {least}"
    return df.withColumn("found", F.expr(f"transform(filter(tests, x -> {passed} and x.p_random >= {LEAST_RANDOM}D), x -> named_struct('start', x.start, 'end', x.end))"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text is an empty
    one: no spans, the digest of the empty string. Null ids are kept, repeated rows give repeated results, an empty
    table none; other columns are not read. A text of any length is scanned whole. random spans never touch base
    spans; which of them count depends, through the false-discovery rate, on the whole table.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    df = _with_spans(df, "assign", ASSIGN, (1,)).withColumn("assign", F.expr("filter(assign, s -> length(s._g1) >= 12)"))
    df = _with_spans(df, "access", ACCESS)
    df = _with_spans(df, "hex", HEX)
    df = _with_spans(df, "tokens", SCAN)
    df = df.withColumn("tokens", F.expr(f"filter(tokens, t -> not (t.match rlike {_sql(f'^(?:{_LEAD}|[0-9a-f]{{16}}|AKIA[A-Z0-9]{{14}})')}))"))
    df = _discoveries(stored(_battery(df.drop("text")).drop("tokens"), "tested"))

    def tagged(col: str, rank: int) -> Column:
        return F.expr(f"transform({col}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end))")

    names = "case s.rank " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    df = df.withColumn("base", F.array_sort(F.concat(tagged("assign", 0), tagged("access", 1), tagged("hex", 2))))
    df = df.withColumn("every", F.array_sort(F.concat(F.col("base"), tagged("found", 3))))
    line = f"array_join(transform({{}}, s -> concat({names}, ':', s.start, ':', s.end)), ',')"
    return df.select(
        "doc_id",
        *(F.size(c).cast("long").alias(n) for c, n in (("assign", "n_assign"), ("access", "n_access"), ("hex", "n_hex"), ("found", "n_random"))),
        F.sha2(F.expr(line.format("base")), 256).alias("base_sha256"),
        F.expr(line.format("every")).alias("spans"),
    )
