"""Positions within spans, however many of both a file has, and postings of identifiers."""

import random

from pyspark.sql import functions as F

from symweave.operators import spans
from symweave.sources import workspace
from symweave.sources.postings import PostingIndex, postings

HITS, SPANS = "file_path string, line int, col int, id int", "file_path string, s_line int, s_col int, e_line int, e_col int, span int"


def test_around_equals_comparing_all(spark):
    draw = random.Random(8)
    place = lambda: (draw.choice([0, 1, 2, 3, 15, 16, 17, 400]), draw.choice([0, 1, 15, 16, 300, 1 << 20, (1 << 20) + 5, 1 << 22]))
    hits = [(draw.choice("ab"), *place(), i) for i in range(120)] + [("a", 1, 1, 3), ("a", 1, 1, 3), ("c", 1, 1, 5)]
    held = []
    for i in range(80):
        a, b = place(), place()
        held.append((draw.choice("ab"), *min(a, b), *max(a, b), i))
    held += [("a", 1, 1, 1, 1, 900), ("a", 5, 0, 4, 0, 901), ("a", 0, 0, 1 << 23, 1 << 21, 902)]
    got = sorted((r.file_path, r.line, r.col, r.id, r.span) for r in spans.around(spark.createDataFrame(hits, HITS), spark.createDataFrame(held, SPANS), ["file_path"]).collect())
    assert got == sorted((f, line, c, i, s[5]) for f, line, c, i in hits for s in held if s[0] == f and (s[1], s[2]) <= (line, c) <= (s[3], s[4]))
    out = spans.outside(spark.createDataFrame(hits, HITS), spark.createDataFrame(held, SPANS))
    inside = {g[:3] for g in got}
    assert sorted(tuple(r) for r in out.collect()) == sorted(h for h in hits if h[:3] not in inside) and out.columns == ["file_path", "line", "col", "id"]


def test_blocks_cover_a_span_once(spark):
    ends = [(0, 0), (5, 5), (0, 255), (15, 16), (1, 4094), (17, 100_000), (3 << 20, (9000 << 20) + 77), (0, (1 << 44) - 1)]
    for first, last, blocks in spark.createDataFrame(ends, "a long, b long").select("a", "b", spans.blocks_of(F.col("a"), F.col("b"))).collect():
        covered = sorted((b.block << b.size, (b.block + 1 << b.size) - 1) for b in blocks)
        assert covered[0][0] == first and covered[-1][1] == last and all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:])) and len(blocks) <= 330


def test_plans_of_spans_stay_small(spark):
    """A query's plan holds the blocks of all sizes as one expression, and what lies outside is found by one shuffle, with spans over pages."""
    hits = spark.createDataFrame([("a", 5, 1, 1), ("a", 1023, 9, 2), ("a", 1024, 0, 3), ("a", 5000, 3, 4), ("a", 5000, 4, 5), ("b", 5, 1, 6), (None, 5, 1, 7), ("a", None, 1, 8)], HITS)
    held = spark.createDataFrame([("a", 1000, 0, 5000, 3, 1), ("a", 2, 0, 2, 9, 2), ("a", 9, 0, 3, 0, 3), (None, 0, 0, 9, 9, 4)], SPANS)
    assert sorted((r.id, r.span) for r in spans.around(hits, held, ["file_path"]).collect()) == [(2, 1), (3, 1), (4, 1)]
    pairs = spans.around(hits, held, ["file_path"], few=0)
    assert sorted((r.id, r.span) for r in pairs.collect()) == [(2, 1), (3, 1), (4, 1)]
    assert len(pairs._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    out = spans.outside(hits, held)
    assert sorted(r.id for r in out.collect()) == [1, 5, 6, 7, 8]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_huge_file_is_no_product(spark):
    """100,000 names, and as many comments of which each holds one name, in one file, and in one line of another."""
    n = 100_000
    i = F.col("id").cast("int")
    hits = spark.range(n).select(F.lit("/many").alias("file_path"), i.alias("line"), F.lit(4).alias("col")).unionByName(spark.range(n).select(F.lit("/one").alias("file_path"), F.lit(0).alias("line"), (i * 8 + 2).alias("col")))
    held = spark.range(n).select(F.lit("/many").alias("file_path"), i.alias("s_line"), F.lit(2).alias("s_col"), i.alias("e_line"), F.lit(9).alias("e_col")).unionByName(
        spark.range(n).select(F.lit("/one").alias("file_path"), F.lit(0).alias("s_line"), (i * 8).alias("s_col"), F.lit(0).alias("e_line"), (i * 8 + 5).alias("e_col"))
    )
    assert spans.around(hits, held, ["file_path"]).count() == 2 * n
    assert spans.outside(hits.where("line % 2 = 0"), held.where("s_line % 4 = 0 and file_path = '/many'")).count() == n + n // 4


def test_postings_follow_their_files_and_requests_read_few_buckets(spark, tmp_path):
    files = [("/A", "one two\n/* one */ one"), ("/B", "two $two two_x x.two"), ("/C", None), ("/D", "three")]
    contents = spark.createDataFrame(files, "path string, text string")
    held = spark.createDataFrame([("/A", 1, 0, 1, 9, "comment")], "file_path string, s_line int, s_col int, e_line int, e_col int, kind string")
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=64)
    index.build(contents, held)
    ask = lambda *names: sorted((r.name, r.file_path, r.line, r.col) for r in index.references(spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert ask("one") == [("one", "/A", 0, 0), ("one", "/A", 1, 10)]
    assert ask("two", "gone") == [("two", "/A", 0, 4), ("two", "/B", 0, 0), ("two", "/B", 0, 5), ("two", "/B", 0, 17)]
    read = index.references(spark.createDataFrame([("one",)], "name string")).inputFiles()
    assert 0 < len([f for f in read if "__bucket" in f]) <= 2
    one = index.table.touched(spark.createDataFrame([("one",)], "name string"))[0]
    new = spark.createDataFrame([("/D", "one four")], "path string, text string")
    publish = index.names.publish_buckets
    index.names.publish_buckets = None  # the replacement breaks off before it is noted
    try:
        index.replace(new, held.limit(0), spark.createDataFrame([("/B",)], "file_path string"))
        raise AssertionError
    except TypeError:
        index.names.publish_buckets = publish
    index.replace(new, held.limit(0), spark.createDataFrame([("/B",)], "file_path string"))
    assert ask("one", "two", "three", "four") == [("four", "/D", 0, 4), ("one", "/A", 0, 0), ("one", "/A", 1, 10), ("one", "/D", 0, 0), ("two", "/A", 0, 4)]
    parts = index.table._pointer()["parts"]
    assert parts[str(one)] == 1 and set(parts.values()) <= {0, 1} and index.version == 1


def test_words_and_their_kinds_are_found_in_one_pass(spark, tmp_path):
    """As by the parser's spans, joined to the words; and no shuffle, parse or stored table is needed for it."""
    draw = random.Random(3)
    parts = ["a1", " ", "\n", '"', "'", '"""', "//", "/*", "*/", "`", "\\", "${", "}", "/=", "1.5e3", "x$y", "#!", "=", "\n  b"]
    texts = [(f"/{language}{i}", language, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))) for language in ("java", "groovy", "kotlin") for i in range(300)]
    texts += [("/none", "java", None), ("/first", "groovy", "#! one\ntwo"), ("/named", "kotlin", 'fun `it\'s "so"` one'), ("/open", "java", "/* one\n\n two")]
    files = spark.createDataFrame(texts, "path string, language string, text string")
    fields = [F.col("path").alias("file_path"), F.col("line_start").alias("s_line"), F.col("char_start").alias("s_col"), F.col("line_end").alias("e_line"), F.col("char_end").alias("e_col"), "kind"]
    held = workspace.facts(workspace.parse(files), "spans").select(*fields)
    found = postings(files)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, postings(files.drop("language"), held).collect()))
    assert {r[0] for r in found.select("kind").distinct().collect()} == {"code", "string", "comment"}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=4)
    index.build(files.where("path = '/open'"))
    index.replace(files.where("path = '/named'"))
    assert [r.file_path for r in index.references(spark.createDataFrame([("one",)], "name string")).collect()] == ["/named"]
