"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document's tokens end with the separator id 1. Whole windows are cut off its front; what is
left of it, less than a window, is packed with the remainders of a block of neighbouring
documents. Differencing starts with one partial partition for each remainder and repeatedly
joins the two partial partitions of the largest spread, the fullest windows of the one with the
emptiest of the other, until one near-equal partition is left. While a window of it exceeds the
capacity, the number of windows rises and all is dealt again (``whole``). Where documents may be
cut, which leaves no padding, only what exceeds a window is cut off and dealt again: that is what
raises the number of windows then.

A block is a bounded run of one input split's documents, so packing needs no shuffle, its
memory doesn't grow with the table, and a lost executor's splits are simply packed again.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

from .tables import give_back, read

WINDOW = 2048
SEPARATOR = 1
TOKENIZER = "word_bpe_49k.json"
#: Remainders that are packed together.
BLOCK = 512
#: The mean of a round's windows over their capacity, so that few stay below it.
SURPLUS = 1.03
#: Bits of a sequence id for its number within a split.
SPLIT_BITS = 33
#: Chunks between white space, and words, whose ids a worker remembers, and the length of the longest such.
CACHE, CACHED_LENGTH = 600_000, 64

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Chunks whose lower case and word split need no look at their neighbours, one or many between newlines.
_PLAIN = re.compile(r"[\n\x21-\x7e\u00c0-\u00ff]*").fullmatch
#: Words of plain lower-case chunks, and the newlines between these.
_WORDS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|\n|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
_CHUNKS = re.compile(r"[ \t\n\r]+").split
#: What ``str.split`` parts words at besides the four characters of ``_CHUNKS``.
_OTHER_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a newline between chunks becomes among ids: no token's id.
_MARK = 0xFFFFFFFF


def chunks_of(text: str) -> list[str]:
    """A text's chunks between ASCII white space."""
    for c in _OTHER_SPACE:
        if c in text:
            return _CHUNKS(text)
    return text.split()


def _forget(known: dict[str, bytes], fresh: dict[str, bytes]) -> None:
    """Drop what is long, and what came last once there is too much: what came first is mostly what is frequent."""
    for c in fresh if len(known) > CACHE else [c for c in fresh if len(c) > CACHED_LENGTH]:
        del known[c]


def _parts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]


class ChunkTokenizer:
    """The ids of a text, from those of its chunks between ASCII white space.

    This equals encoding the text at once with the word-end tokenizer, which drops white space
    and never joins characters across it: a chunk's ids depend on the chunk only. Plain chunks
    are split into words here, all at once, and only unknown words are encoded, as one text whose
    ids are parted at the tokens that end words; other chunks are encoded whole. What is known is
    kept for a worker's life, up to ``CACHE`` chunks and words.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.words.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.chunk_ids: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {"\n": np.array([_MARK], dtype="<u4").tobytes()}

    def _of_words(self, new: list[str]) -> dict[str, bytes]:
        if not new:
            return {}
        [e] = self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return dict(zip(new, _parts(ids, np.append(0, ends[:-1]), ends), strict=True))

    def _of_plain(self, new: list[str]) -> dict[str, bytes]:
        if not new:
            return {}
        words, known = _WORDS("\n".join(new).lower()), self.word_ids
        fresh = self._of_words(list(set(words).difference(known)))
        known.update(fresh)
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4")
        _forget(known, fresh)
        marks = np.flatnonzero(ids == _MARK)
        return dict(zip(new, _parts(ids, np.append(0, marks + 1), np.append(marks, len(ids))), strict=True))

    def _of_chunks(self, new: list[str]) -> dict[str, bytes]:
        together, odd = "\n".join(new), []
        if "<|" in together or not _PLAIN(together):
            odd = [c for c in new if "<|" in c or not _PLAIN(c)]
            new = [c for c in new if "<|" not in c and _PLAIN(c)]
        out = self._of_plain(new)
        for c, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            out[c] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known = self.chunk_ids
        chunks = [chunks_of(t) for t in texts]
        fresh = self._of_chunks(list(set().union(*chunks).difference(known)))
        known.update(fresh)
        out = [np.frombuffer(b"".join(map(known.__getitem__, cs)), dtype="<u4") for cs in chunks]
        _forget(known, fresh)
        return out


@cache
def tokenizer_of(path: str) -> ChunkTokenizer:
    """A worker's tokenizer, shared by all its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkTokenizer(path)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """``sizes`` dealt into ``windows`` near-equal windows: the indices of each window's items."""
    follow = np.full(len(sizes), -1)
    tie = count()
    # A partial partition: (negative spread, tie, sums falling, first item, last item); only filled windows are stored.
    heap = [(-s, next(tie), np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s1, h1, t1 = heapq.heappop(heap)
        _, _, s2, h2, t2 = heapq.heappop(heap)
        both = max(0, len(s1) + len(s2) - windows)
        if both:  # the emptiest of the one take the fullest of the other
            a, b = len(s1) - both, both
            joined = s1[a:] + s2[:b][::-1]
            follow[t1[a:]] = h2[:b][::-1]
            sums = np.concatenate([s1[:a], joined, s2[b:]])
            head = np.concatenate([h1[:a], h1[a:], h2[b:]])
            tail = np.concatenate([t1[:a], t2[:b][::-1], t2[b:]])
        else:
            sums, head, tail = np.concatenate([s1, s2]), np.concatenate([h1, h2]), np.concatenate([t1, t2])
        by = np.argsort(-sums, kind="stable")
        sums, head, tail = sums[by], head[by], tail[by]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (-(int(sums[0]) - int(least)), next(tie), sums, head, tail))
    if not heap:
        return []
    out = []
    for i in heap[0][3]:
        window = []
        while i >= 0:
            window.append(int(i))
            i = follow[i]
        out.append(window)
    return out


def pack(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Uncut items in windows of at most ``capacity``: their number rises while one exceeds it."""
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        windows += 1


@dataclass
class Piece:
    """A run of one document's tokens that has no sequence yet."""

    doc: object
    start: int
    ids: np.ndarray
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


def fill(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """One round of differencing: full windows, and the pieces that need further windows.

    There are as many windows as make the mean a little more than the capacity. What exceeds
    the capacity is cut off and left over, and so are windows that stay below it; whatever is
    left raises the number of windows in the next round.
    """
    sizes = [len(p.ids) for p in pieces]
    windows = max(1, int(sum(sizes) / capacity / SURPLUS))
    full, left = [], []
    for members in difference(sizes, windows):
        chosen = [pieces[i] for i in members]
        if sum(len(p.ids) for p in chosen) < capacity:
            left += chosen
            continue
        window, room = [], capacity
        for p in chosen:
            if len(p.ids) <= room:
                window.append(p)
                room -= len(p.ids)
            elif room:
                head, tail = p.cut(room)
                window.append(head)
                left.append(tail)
                room = 0
            else:
                left.append(p)
        full.append(window)
    return full, left


def close(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """All pieces in windows without padding: full ones, then one for each power of two."""
    out = []
    while sum(len(p.ids) for p in pieces) >= capacity:
        full, pieces = fill(pieces, capacity)
        out += full
    size = capacity
    while pieces:
        while size > sum(len(p.ids) for p in pieces):
            size //= 2
        window, room = [], size
        while room:
            p = pieces.pop()
            if len(p.ids) > room:
                p, rest = p.cut(room)
                pieces.append(rest)
            window.append(p)
            room -= len(p.ids)
        out.append(window)
    return out


def _packer(path: str, window: int, block: int, whole: bool):
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, left, made, base = tokenizer_of(path), [], 0, 0

        def rows(windows: list[list[Piece]]) -> list[tuple]:
            nonlocal made
            out = []
            for members in windows:
                at = 0
                for p in members:
                    out.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, base + made, at))
                    at += len(p.ids)
                made += 1
            return out

        def uncut(pieces: list[Piece]) -> list[list[Piece]]:
            return [[pieces[i] for i in members] for members in pack([len(p.ids) for p in pieces], window)]

        for pdf in batches:
            if not len(pdf):
                continue
            base, out = int(pdf["split"].iat[0]) << SPLIT_BITS, []
            texts, docs = [t if isinstance(t, str) else "" for t in pdf["text"]], pdf["id"].tolist()
            for a in range(0, len(texts), 64):
                for doc, ids in zip(docs[a : a + 64], tokenizer.ids(texts[a : a + 64]), strict=True):
                    rest = Piece(doc, 0, np.append(ids, SEPARATOR).astype("<u4"), len(ids) + 1)
                    while len(rest.ids) >= window:
                        head, rest = rest.cut(window)
                        out += rows([[head]])
                    if len(rest.ids):
                        left.append(rest)
                    if len(left) >= block:
                        full, left = (uncut(left), []) if whole else fill(left, window)
                        out += rows(full)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if left:
            yield pd.DataFrame(rows(uncut(left) if whole else close(left, window)), columns=columns)
        give_back()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, block: int = BLOCK,
                   id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``whole`` only documents longer than a window are cut, in whole windows and a rest, and
    windows are padded; else documents are cut so that no window but the last few is.

    A null text counts as empty: its document is the separator alone. Ids may be null or
    repeated; each row's tokens lie in pieces of their own. Texts of any length are read whole;
    of windows that are equally full the earlier takes the next piece. Only the two named columns
    are read, so other columns may have any name. An empty table gives no pieces. Sequences are
    numbered within an input split, so another layout of the files numbers them otherwise.
    """
    path = tokenizer_path or str(public_tokenizers.path(TOKENIZER))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("split"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(_packer(path, window, block, whole), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
