"""Small tables with the awkward cases that every operator must take."""

LONG = "alpha beta " * 20_000

#: id, text: nulls, empties, blanks, a very long text, repeats, ties and characters of all widths.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one two three four five"), (5, "one two three four five"), (6, "One two  three four five"), (None, "one two three four five"), (7, "é😀 日本語"), (8, "x"), (-9, "X")]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, norm string, words string, fp string, key string, score string, a string, b string"


def docs(spark, rows):
    """A documents table with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, *["clash"] * 8) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
