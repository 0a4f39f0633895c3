import inspect
import re
from itertools import combinations

import sentencepiece

import corpus_pipeline
from symweave.llm import decontaminate, simhash, spm, toxicity

from .test_decontaminate import brute_align
from .test_simhash import brute_components, brute_fingerprint


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_run_matches_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(table, model).where("predicted = 1").collect()}
    text = {r.doc_id: r.text for r in table.collect() if r.doc_id not in toxic}
    groups = {}
    for i, t in text.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    text = {i: text[i] for g in groups.values() for i in [min(g, key=lambda i: (-len(text[i]), i))]}
    ids = sorted(text)
    roots = brute_components([brute_fingerprint(text[i]) for i in ids])
    text = {i: text[i] for k, i in enumerate(ids) if roots[k] == k}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in items]
    dirty = set()
    for i, t in text.items():
        w = words(t)
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        dirty |= {i for item, g in zip(items, grams) if own & g and brute_align(w, item) >= decontaminate.LEAST_SCORE * 2 * len(item)}
    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    want = {i: library.encode(t) for i, t in text.items() if i not in dirty}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert toxic or dirty or len(groups) < table.count()


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
