import random

import pytest
import sentencepiece

from symweave.llm import spm

from .helpers import AWKWARD, docs, empty


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.default_model())


def texts(n=600):
    r = random.Random(2)
    out = ["", "  a  b\n c\t d  ", " ", "   ", "ﬁ①é́", "😀 😀😀 x", "a" * 2000, "\n\n\n", "the " * 300, "日本語テキスト and עברית", "aaa  aaa"]
    return out + ["".join(r.choice("ab éthein ①\n") for _ in range(40)) for _ in range(n)]


def test_ids_equal_the_library_and_decode(library):
    tool = spm.Codec(spm.default_model())
    for batch in (texts(), texts(50)):
        got = tool.encode_batch(batch)
        assert [g.tolist() for g in got] == library.encode(batch, num_threads=1)
        assert [tool.decode(g) for g in got] == batch


def test_unigram_scores_are_maximal():
    lex = spm.Lexicon(spm.default_model(), kind="unigram")

    def best(word):  # plain forward search over all cuts
        table = [0.0] + [-float("inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                k = lex.ids.get(word[start:end])
                if k is not None or end - start == 1:
                    table[end] = max(table[end], table[start] + (lex.score[k] if k is not None else lex.lowest - 10))
        return table[-1]

    words = ["▁information", "▁informal", "▁inform", "▁the", "▁theory", "▁x①y", "▁▁ab", "in", "▁information"]
    for word, ids in spm.encode_words(lex, words).items():
        score = sum(lex.score[k] if k in lex.ids.values() else 0.0 for k in ids)
        unknown = [c for c in word if c not in lex.ids]
        assert score + len(unknown) * (lex.lowest - 10) == pytest.approx(best(word))


def test_documents(spark, sf, library):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    rows = spm.encode_documents(table).collect()
    assert len(rows) == len(text) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.ids == library.encode(text[r.doc_id]) for r in rows[:60])


def test_awkward_rows(spark):
    rows = spm.encode_documents(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD) and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert spm.encode_documents(docs(spark, [(1, "▁x")])).first().round_trip is False
    assert spm.encode_documents(empty(spark)).count() == 0


def test_models_that_normalise_are_refused(library):
    import unicodedata

    spm.refuse_normaliser(library.normalize)
    for rule in (lambda t: library.normalize(unicodedata.normalize("NFKC", t)), lambda t: library.normalize(t.strip()), lambda t: t):
        with pytest.raises(ValueError):
            spm.refuse_normaliser(rule)


def test_null_ids_stay(spark):
    rows = spm.encode_documents(docs(spark, [(None, "a b"), (None, None)])).collect()
    assert [(r.doc_id, r.round_trip) for r in rows] == [(None, True)] * 2
