"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of a document is joined on its hash to the places of that k-gram in the templates
(the words are compared as well). A hit votes for the diagonal document place - template place. Neighbouring
diagonals are merged in overlapping cells of bounded width, so that drift does not add up. A cell's span is
verified in order and density: of each template place the hit nearest the cell's main diagonal is taken, the longest
chain of them that rises in the document is the aligned stretch, and it counts if it holds enough of the template's
k-grams and lies close enough together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, stored, text_or_empty, words_of

GRAM = 3
#: A cell is two steps wide; a step is this many diagonals, or this part of the template's k-grams.
DRIFT, DRIFT_PART = 3, 0.25
#: Share of a template's k-grams that a span must show, and of the span's own places that must be such k-grams.
LEAST_SHARE = 0.6
LEAST_DENSITY = 0.5

#: Base phrases and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Openings of public licence notices, whole public licences, and their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> tuple[DataFrame, int]:
    """(label, base, size, template, t_at, gram): one row per k-gram place, and how many rows there are."""
    rows = []
    for t, (base, (label, text)) in enumerate([(True, p) for p in phrases] + [(False, p) for p in templates]):
        words = text.split()
        k = min(GRAM, len(words))
        rows += [(label, base, len(words) - k + 1, t, i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "label string, base boolean, size int, template int, t_at int, gram string"), len(rows)


def _grams(words: str, short: list[tuple[int, str]]) -> Column:
    """Array of (at, gram): all k-grams, and the shorter ones that begin like a template of fewer words."""
    full = f"transform({words}, (w, i) -> if(i + {GRAM} <= size({words}), named_struct('at', i, 'gram', concat_ws(' ', {', '.join(f'get({words}, i + {j})' for j in range(GRAM))})), null))"
    parts = [f"slice({full}, 1, greatest(0, size({words}) - {GRAM - 1}))"]
    for k in sorted({k for k, _ in short}):
        first = ", ".join("'" + w.replace("'", "\\'") + "'" for n, w in short if n == k)
        some = f"filter(transform({words}, (w, i) -> if(w in ({first}) and i + {k} <= size({words}), named_struct('at', i, 'gram', concat_ws(' ', {', '.join(f'get({words}, i + {j})' for j in range(k))})), null)), s -> s is not null)"
        parts.append(some)
    return F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])


def _hashes(words: str, short: list[tuple[int, str]]) -> Column:
    """The hashes of what _grams gives, without its strings."""
    gram = lambda k: f"xxhash64(concat_ws(' ', w{''.join(f', get({words}, i + {j})' for j in range(1, k))}))"
    parts = [f"slice(transform({words}, (w, i) -> {gram(GRAM)}), 1, greatest(0, size({words}) - {GRAM - 1}))"]
    for k in sorted({k for k, _ in short}):
        first = ", ".join("'" + w.replace("'", "\\'") + "'" for n, w in short if n == k)
        parts.append(f"filter(transform({words}, (w, i) -> if(w in ({first}), {gram(k)}, null)), h -> h is not null)")
    return F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases; first_word and last_word are their least and greatest start, in
    words from 0, else null. labels holds base labels and those of templates found; score is the greatest
    share of a template (1 for a base phrase) and 0 without any. A null text is an empty one; a text of any length is
    scanned whole. Rows that repeat an id and a text repeat the result; rows that share an id but not the text are
    told apart. Null ids are kept. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    places, n = template_grams(spark, templates)
    short = [(len(t.split()), t.split()[0]) for _, t in [*PHRASES, *templates] if len(t.split()) < GRAM]
    text = text_or_empty(text_col)
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    worded = told.select("doc_id", "th", words_of(F.col("text")).alias("words"))
    # first all k-grams by their hashes alone, then, in the documents that any of them hit, word by word
    keys = guarded(places.select(F.xxhash64("gram").alias("h")).distinct(), n)
    touched = stored(worded.select("doc_id", "th", F.explode(_hashes("words", short)).alias("h")).join(keys, "h").select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).distinct(), "touched")
    near = guarded(touched, touched.count())
    close = told.join(near, (F.col("th") == F.col("c_th")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi").select("doc_id", "th", words_of(F.col("text")).alias("words"))
    grams = close.select("doc_id", "th", F.explode(_grams("words", short)).alias("g")).select("doc_id", "th", F.col("g.at").alias("at"), F.col("g.gram").alias("d_gram"), F.xxhash64("g.gram").alias("h"))
    hits = (
        grams.join(guarded(places.withColumn("h", F.xxhash64("gram")), n), "h")
        .where(F.col("d_gram") == F.col("gram"))
        .groupBy("doc_id", "th", "template", "label", "base", "size", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.collect_set("t_at").alias("seen"))  # at most the template's own length
    )
    base = hits.where(F.col("base") & (F.size("seen") == F.col("size"))).select("doc_id", "th", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    step = F.greatest(F.lit(DRIFT), F.ceil(F.col("size") * DRIFT_PART))
    cell = F.floor(F.col("diagonal") / step)
    # a cell holds at most its diagonals times the template's places, whatever the document's length
    cells = (
        hits.where(~F.col("base"))
        .select("doc_id", "th", "template", "label", "size", F.explode(F.array(cell, cell - 1)).alias("cell"), F.struct((-F.size("seen")).alias("votes"), "diagonal", "seen").alias("hit"))
        .groupBy("doc_id", "th", "template", "label", "size", "cell")
        .agg(F.collect_list("hit").alias("hits"))
        .where(f"size(array_distinct(flatten(hits.seen))) >= {LEAST_SHARE} * size")
    )
    best = "array_max(transform(filter(acc, x -> x.at < h.at), x -> named_struct('l', x.len, 'f', x.first)))"
    chain = f"""aggregate(filter(near, (x, i) -> i = 0 or near[i - 1].t <> x.t), cast(array() as array<struct<at: bigint, len: int, first: bigint>>),
        (acc, h) -> array_append(acc, named_struct('at', h.at, 'len', 1 + coalesce({best}.l, 0), 'first', coalesce({best}.f, h.at))))"""
    spans = (
        cells.withColumn("main", F.expr("array_min(hits).diagonal"))
        .withColumn("near", F.expr("array_sort(flatten(transform(hits, x -> transform(x.seen, t -> named_struct('t', t, 'far', abs(x.diagonal - main), 'at', cast(x.diagonal + t as bigint))))))"))
        .withColumn("top", F.expr(f"array_max(transform({chain}, x -> named_struct('len', x.len, 'wide', x.first - x.at)))"))
        .select("doc_id", "th", "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("start"), (F.col("top.len") / F.col("size")).alias("share"), (F.col("top.len") / (1 - F.col("top.wide"))).alias("density"))
        .where((F.col("share") >= LEAST_SHARE) & (F.col("density") >= LEAST_DENSITY))
        .drop("density")
    )
    found = (
        base.unionByName(spans)
        .groupBy("doc_id", "th")
        .agg(
            F.sum(F.col("base").cast("long")).alias("n_base"),
            F.min("start").cast("long").alias("first_word"),
            F.max("start").cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        .withColumnRenamed("doc_id", "f_id")
        .withColumnRenamed("th", "f_th")
    )
    counted = worded.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    return counted.join(found, (counted["th"] == found["f_th"]) & counted["doc_id"].eqNullSafe(found["f_id"]), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
