"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files: .ids holds nothing but the ids of its documents, little-endian, two bytes each for a
vocabulary of up to 65,536 and else four; .idx holds where each document starts, the document keys, and a
minimal perfect hash that sends each distinct key to a slot with a 32-bit fingerprint and the document's place
in the shard. Keyed access is one hash walk, one fingerprint check and one read, whatever the shard's size.

Index layout, all little-endian: 8 bytes b"SYMTIX01"; six u64 (documents, of them without key, bytes of an id,
distinct keys, hash levels, ids); u64 starts[documents + 1]; i64 keys[documents]; u64 bits[levels]; then each
level's bit words u64; u32 fingerprints[distinct keys]; u64 places[distinct keys].
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, sliced, stored

MAGIC = b"SYMTIX01"
#: Ids, and documents, after which a task begins its next shard; its index is held in memory until it is written.
SHARD_IDS = 1 << 26
SHARD_DOCS = 1 << 20
#: Pieces of text whose ids a worker remembers.
MEMO = 800_000
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder's URI (file, hdfs, s3, ...) and the path in it."""
    if re.match(r"file:/(?!/)", uri):
        uri = uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


# ---- encoding -------------------------------------------------------------------------------------------

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s")


def cut(text: str) -> list[str]:
    """Pieces that the tokenizer treats alike alone and in the text, each but the first to be read with a space
    before it: cut at each single space between two characters that are not white space. Byte-level
    pre-tokenisation always begins a token there."""
    if text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return _SAFE.split(text)
    return text.split(" ")


class Encoder:
    """Ids of texts as bytes; each distinct piece goes through the tokenizer once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        # markers that stand in a text become their ids, as the library has it; one that takes in its surroundings, or
        # holds a blank, could span a cut
        self.whole = any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in self.tool.get_added_tokens_decoder().values())
        self.kind = np.dtype("<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tool.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has one character for each byte
        for token, k in vocab.items():
            self.bytes[k] = len(token)
        self.known: dict[str, bytes] = {}  # pieces after a space

    def _alone(self, text: str) -> bytes:
        return np.array(self.tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Pieces after a space are encoded side by side in one text and told apart by their bytes."""
        size = self.kind.itemsize
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            ids = np.array(self.tool.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) + 1 for p in part])) + 1
            flat, at = ids.tobytes(), 0
            for p, end in zip(part, (ends * size).tolist()):
                self.known[p] = flat[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [[t] if self.whole else cut(t) for t in texts]
        firsts = [self._alone(c.pop(0)) for c in cuts]
        used = set().union(*cuts)
        if len(self.known) > MEMO:  # what this batch uses stays, so frequent pieces are never lost
            self.known = {p: self.known[p] for p in used if p in self.known}
        self._learn(list(used.difference(self.known)))
        get = self.known.__getitem__
        return [f + b"".join(map(get, c)) for f, c in zip(firsts, cuts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, which Spark uses again."""
    return Encoder(path)


# ---- minimal perfect hash -------------------------------------------------------------------------------


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts over salted keys."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bit words: a key is placed on the first level where no other key shares its bit."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        rest, levels = keys.view(np.uint64), []
        while len(rest):
            bits = max(64, -(-2 * len(rest) // 64) * 64)
            at = mix(rest, len(levels)) % np.uint64(bits)
            spot, count = np.unique(at, return_counts=True)
            alone = spot[count == 1].astype(np.int64)
            words = np.zeros(bits // 64, np.uint64)
            np.bitwise_or.at(words, alone >> 6, np.uint64(1) << (alone & 63).astype(np.uint64))
            levels.append(words)
            rest = rest[~np.isin(at, spot[count == 1])]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_, k = np.arange(len(keys)), keys.view(np.uint64)
        for i, words in enumerate(self.levels):
            if not len(open_):
                break
            at = (mix(k[open_], i) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.ranks[i][at[hit] >> 6] + below
            open_ = open_[~hit]
        return out


# ---- shards ---------------------------------------------------------------------------------------------


class ShardWriter:
    """Streams ids to the payload; the index follows at close. Keys come in ascending order, those without first."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, kind: np.dtype) -> None:
        self.fs, self.path, self.kind = fs, path, kind
        self.file = fs.open_output_stream(f"{path}.ids")
        self.starts, self.keys, self.n_null = array("q", [0]), array("q"), 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.file.write(ids)
        self.starts.append(self.starts[-1] + len(ids) // self.kind.itemsize)
        self.n_null += key is None
        self.keys.append(0 if key is None else key)

    def close(self) -> None:
        self.file.close()
        keys = np.array(self.keys, "<i8")
        own, first = np.unique(keys[self.n_null :], return_index=True)
        mph = PerfectHash.build(own)
        slots = mph.slots(own)
        prints, places = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u8")
        prints[slots], places[slots] = fingerprint(own), first + self.n_null
        head = np.array([len(keys), self.n_null, self.kind.itemsize, len(own), len(mph.levels), self.starts[-1]], "<u8")
        with self.fs.open_output_stream(f"{self.path}.idx") as f:
            for x in (head, np.array(self.starts, "<u8"), keys, np.array([64 * len(w) for w in mph.levels], "<u8"), *mph.levels, prints, places):
                f.write(x.tobytes() if x is not head else MAGIC + x.tobytes())


class Shard:
    """Reads a shard: its index at once, payload ranges on demand."""

    def __init__(self, fs: pa.fs.FileSystem, path: str) -> None:
        self.fs, self.path = fs, path
        with fs.open_input_file(f"{path}.idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path}.idx is not a token index")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.n, self.n_null, width, own, levels, self.n_ids = (int(x) for x in take("<u8", 6))
        self.kind = np.dtype(f"<u{width}")
        self.starts, self.keys = take("<u8", self.n + 1).astype(np.int64), take("<i8", self.n)
        bits = take("<u8", levels)
        self.mph = PerfectHash([take("<u8", int(b) // 64) for b in bits])
        self.prints, self.places = take("<u4", own), take("<u8", own).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the shard (the first of repeated keys), -1 where the fingerprint differs."""
        keys = np.ascontiguousarray(keys, np.int64)
        if not len(self.places):
            return np.full(len(keys), -1, np.int64)
        slot = self.mph.slots(keys)
        ok = (slot >= 0) & (self.prints[slot] == fingerprint(keys.view(np.uint64)))
        return np.where(ok, self.places[slot], -1)

    def ids(self, place: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            a, b = self.starts[place] * self.kind.itemsize, self.starts[place + 1] * self.kind.itemsize
            f.seek(int(a))
            return np.frombuffer(f.read(int(b - a)), self.kind).astype(np.uint32)

    def documents(self, piece: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of every document in order; the payload is read in pieces, a longer document at once."""
        size = self.kind.itemsize
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            i = 0
            while i < self.n:
                j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + piece, "right")) - 1)
                flat = np.frombuffer(f.read(int(self.starts[j] - self.starts[i]) * size), self.kind)
                for k in range(i, j):
                    yield k, flat[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
                i = j


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Write docs in ascending order of doc_id; the manifest (one row per shard) is stored and returned:
    part, seq, path, first_key, last_key, n_docs, n_ids.

    Every attempt of a task writes files of its own names and the manifest lists those of the attempts that
    counted, so a lost or repeated task leaves no trace in it. Null texts are empty (the end id alone); rows
    without an id come first and have no key; repeated ids stand together, by a hash of the text and then by text,
    and may be spread over tasks and shards. A text of any length is encoded whole, in memory for a few times its size.
    """
    path = tokenizer or default_tokenizer()
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        tool = encoder(path)
        end = b"" if end_id is None else np.array([end_id], tool.kind).tobytes()
        writer, rows = None, []

        def close() -> None:
            writer.close()
            n = len(writer.keys)
            keyed = n > writer.n_null
            rows.append((part, len(rows), writer.path, writer.keys[writer.n_null] if keyed else None, writer.keys[-1] if keyed else None, n, writer.starts[-1]))

        for batch in sliced(batches, "text"):
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, tool.encode([t or "" for t in batch.column(1).to_pylist()])):
                if writer is not None and (writer.starts[-1] >= shard_ids or len(writer.keys) >= shard_docs):
                    close()
                    writer = None
                if writer is None:
                    writer = ShardWriter(fs, f"{base}/shard-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}", tool.kind)
                writer.add(key, ids + end)
        if writer is not None:
            close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "seq", "path", "first_key", "last_key", "n_docs", "n_ids"])

    # texts are dealt out before they are encoded: the sampling pass of the range exchange then only reads
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text")).repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text").drop("th")
    return stored(ordered.mapInArrow(run, "part long, seq long, path string, first_key long, last_key long, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, indexed for each document, from the files alone.

    start counts the ids of all documents before it; ids_crc32 is over little-endian unsigned 32-bit ids;
    indexed tells whether the key, looked up through the hash and its fingerprint, leads to its document
    (null for a document without a key).
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, in one task
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(fs, path)
                crc = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for _, x in shard.documents()), np.int64, shard.n)
                found = shard.find(shard.keys)
                right = (found >= 0) & (shard.keys[np.maximum(found, 0)] == shard.keys)
                none = np.arange(shard.n) < shard.n_null
                sizes = np.diff(shard.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, pa.int64(), mask=none), pa.array(base + shard.starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc), pa.array(right, pa.bool_(), mask=none)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "indexed"],
                )

    n = max(1, manifest.count())
    return based.repartition(min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, indexed boolean")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to the shared folder and read them back. An empty table gives no rows."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer), folder)


class TokenStore:
    """Keyed access over all shards: a key's shard by its range, its document by the shard's index."""

    def __init__(self, manifest: DataFrame, folder: str) -> None:
        self.fs = filesystem(folder)[0]
        rows = manifest.where("first_key is not null").orderBy("first_key", "part", "seq").collect()  # one row per shard
        self.first = np.array([r["first_key"] for r in rows], np.int64)
        self.paths = [r["path"] for r in rows]
        self.open: dict[str, Shard] = {}

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a document, or None for a key that is not stored."""
        i = int(np.searchsorted(self.first, key, "right")) - 1
        while i > 0 and self.first[i - 1] == key:  # a key repeated over shards: its first document
            i -= 1
        if i < 0:
            return None
        shard = self.open.setdefault(self.paths[i], None) or Shard(self.fs, self.paths[i])
        self.open[self.paths[i]] = shard
        place = int(shard.find(np.array([key]))[0])
        return shard.ids(place) if place >= 0 else None
