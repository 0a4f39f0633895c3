"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

The distinct marked words of a batch are sorted, which lays out their trie; it is traversed depth first and
the forward table of a common prefix is kept from one word to the next. For a unigram model the forward score
is the best sum of piece scores. For a BPE model it is 0 for the path whose neighbouring pieces would all
survive the model's own merges and minus infinity for any other; exactly one path is finite for each prefix,
and it is what the merges give. Texts whose characters the model lacks use its byte pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
#: Words, and pairs of pieces, that a worker remembers between batches.
MEMO_WORDS = 400_000
MEMO_PAIRS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Text that every normaliser but the identity with a leading mark changes: ligatures, width, accents, blanks.
PROBE = "  ﬁ①Ａ e\u0301  x\ty\n "


def refuse_normaliser(normalise: Callable[[str], str]) -> None:
    if normalise(PROBE) != MARK + PROBE.replace(" ", MARK):
        raise ValueError("the model normalises texts by rules that are not handled here")


class Lexicon:
    """Pieces and scores of a model file. kind: 'bpe' or 'unigram' (how its scores are to be read)."""

    def __init__(self, model_file: str, kind: str = "bpe") -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        refuse_normaliser(sp.normalize)
        n = sp.get_piece_size()
        self.kind = kind
        self.unk = sp.unk_id()
        self.ids: dict[str, int] = {}
        self.score: list[float] = [sp.get_score(i) for i in range(n)]
        self.raw: list[bytes] = [b""] * n
        self.byte = [-1] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value], self.raw[i] = i, bytes([value])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.ids[piece] = i
                self.raw[i] = piece.encode()
        self.bytewise = all(b >= 0 for b in self.byte)
        #: Every ending of a piece: where a stretch of text is none, no longer one that ends there is a piece.
        self.tails = {piece[i:] for piece in self.ids for i in range(len(piece))}
        self.lowest = min(self.score[i] for i in self.ids.values())
        self.pairs: dict[tuple[str, str], bool] = {}
        # within a marked word no piece may hold a mark after another character, else words are not independent
        self.wordwise = not any(MARK in p.lstrip(MARK) for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """What the merges of a BPE model leave of a short text: best score first, leftmost of equals."""
        parts, ids, score = list(text), self.ids, self.score
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and score[k] > best:
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces survive the merges of their joined text."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def spell(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        if got is not None:
            return [got]
        if self.bytewise:
            return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unk]


def encode_words(lex: Lexicon, words: Iterable[str]) -> dict[str, list[int]]:
    """Token ids of each distinct word, by a depth-first walk over the trie of the sorted words."""
    out: dict[str, list[int]] = {}
    ids, tails, bpe, stable, pairs, score = lex.ids, lex.tails, lex.kind == "bpe", lex.stable, lex.pairs, lex.score
    unknown = lex.lowest - 10.0
    last: list[str] = [""]  # forward table: the piece that ends at each prefix of the word ...
    best: list[float] = [0.0]  # ... and its score
    old = ""
    for word in sorted(set(words)):
        keep, most = 0, min(len(old), len(word))
        while keep < most and old[keep] == word[keep]:
            keep += 1
        del last[keep + 1 :], best[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            piece, top, start = word[end - 1 : end], -float("inf"), end - 1
            found = [start]  # starts of the pieces that end here, and of the single character
            while start > 0:
                start -= 1
                p = word[start:end]
                if p not in tails:
                    break
                if p in ids:
                    found.append(start)
            if bpe:
                for start in reversed(found):
                    key = (last[start], word[start:end])
                    ok = pairs.get(key)
                    if ok is None:
                        ok = stable(*key)
                    if ok:
                        piece, top = key[1], 0.0
                        break
            else:
                for start in found:
                    p = word[start:end]
                    k = ids.get(p)
                    s = best[start] + (score[k] if k is not None else unknown)
                    if s > top:
                        piece, top = p, s
            last.append(piece)
            best.append(top)
        old, at, pieces = word, len(word), []
        while at:
            piece = last[at]
            pieces.append(piece)
            at -= len(piece)
        row: list[int] = []
        for p in reversed(pieces):
            k = ids.get(p)
            if k is None:
                row += lex.spell(p)
            else:
                row.append(k)
        out[word] = row
    return out


def marked_words(text: str) -> list[str]:
    """The normalised text (a mark before it and for each space) cut before each mark that follows another character."""
    if not text:
        return []
    out: list[str] = []
    marks = ""
    for part in (MARK + text.replace(" ", MARK)).split(MARK)[1:]:
        marks += MARK
        if part:
            out.append(marks + part)
            marks = ""
    if marks:
        out.append(marks)
    return out


class Codec:
    def __init__(self, model_file: str, kind: str = "bpe") -> None:
        self.lex = Lexicon(model_file, kind)
        self.known: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = marked_words if self.lex.wordwise else lambda t: [MARK + t.replace(" ", MARK)] if t else []
        split = [cut(t) for t in texts]
        used = {w for ws in split for w in ws}
        if len(self.known) > MEMO_WORDS:  # what this batch uses stays, so frequent words are never lost
            self.known = {w: self.known[w] for w in used if w in self.known}
        new = used.difference(self.known)
        for w, ids in encode_words(self.lex, new).items():
            self.known[w] = array("i", ids).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.lex.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model_file: str, kind: str = "bpe") -> Codec:
    return Codec(model_file, kind)


def encode_documents(docs: DataFrame, model_file: str | None = None, kind: str = "bpe") -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, round_trip (whether decoding gives the text back).

    A null text is an empty one: no ids, and it round-trips. A text that itself holds the mark U+2581 decodes
    to spaces there. A text of any length is encoded whole. Null ids are kept, repeated rows give repeated results,
    an empty table none; other columns are not read. Models whose normaliser changes texts are refused.
    The model file must be at the same path on every executor, as an installed package is.
    """
    path = model_file or default_model()

    def make():
        tool = codec(path, kind)

        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            ids = tool.encode_batch(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            same = [tool.decode(x) == t for x, t in zip(ids, texts)]
            return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": [len(x) for x in ids], "round_trip": same}

        return call

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
