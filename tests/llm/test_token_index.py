import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from symweave.llm import common, token_index

from .helpers import AWKWARD, docs, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_index.default_tokenizer())


def test_pieces_encode_like_whole_texts(library):
    r = random.Random(6)
    texts = ["", " ", "a b  c", "x <|endoftext|> y", " a", "a ", "a\n b", "a \nb", "it's 'x ' y's", "\x1c a", "a \x85 b", "a　 b", "日本 語"]
    texts += ["<|endoftext|>", " <|endoftext|> ", "a<|endoftext|>b c", "a <|endoftext|><|endoftext|> b", "<|endoftext|> <|endoftext|>", "<|endof text|> <|endoftext |>", "x  <|endoftext|>\n y"]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "a", "b c", "<|", "\n"]) for _ in range(12)) for _ in range(500)]
    texts += ["".join(r.choice("a ' s\n1.,é\x85\x1c\t") for _ in range(30)) for _ in range(1500)]
    tool = token_index.Encoder(token_index.default_tokenizer())
    for batch in (texts, texts[::-1]):
        got = [np.frombuffer(b, tool.kind).tolist() for b in tool.encode(batch)]
        assert got == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        mph = token_index.PerfectHash.build(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def expected(library, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [token_index.SHARD_IDS, 5])
def test_files_give_back_every_id(spark, library, shard_ids):
    rows = [*AWKWARD, (2**62, "far away"), (11, "<|endoftext|>")]
    folder = common.shared_path(spark, "test-tokens")
    manifest = token_index.write_shards(docs(spark, rows), folder, shard_ids=shard_ids)
    got = token_index.read_shards(manifest, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(library, rows)
    # the key of a repeated document leads to the first of its shard, where both are in one
    assert all(r.indexed is None if r.doc_id is None else r.indexed for r in got)


def test_documents_bound_a_shard(spark, library):
    rows = [(i, "" if i % 3 else None) for i in range(50)]
    folder = common.shared_path(spark, "test-tokens")
    manifest = token_index.write_shards(docs(spark, rows), folder, shard_docs=4)
    assert max(r.n_docs for r in manifest.collect()) == 4
    got = token_index.read_shards(manifest, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(library, rows)


def test_keyed_access(spark, sf, library):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    folder = common.shared_path(spark, "test-tokens")
    store = token_index.TokenStore(token_index.write_shards(table, folder, shard_ids=20_000), folder)
    text = {r.doc_id: r.text for r in table.collect()}
    for key in list(text)[:40]:
        assert store.get(key).tolist() == [*library.encode(text[key], add_special_tokens=False).ids, 2]
    assert [store.get(k) for k in range(10**9, 10**9 + 200)] == [None] * 200 and store.get(-5) is None


def test_empty_table(spark):
    assert token_index.round_trip(empty(spark)).count() == 0
