"""Byte-level BPE over a corpus by merge replay.

Texts are split into words by the tokenizer's public pattern on the JVM.  The
words of an Arrow batch are dictionary-encoded, and only words not met before by
the worker are encoded: all of them at once, by an inverted index from token pair to
word positions, replaying the merges in rank order and touching only a merge's
neighbours.  The ids of the texts are then assembled by array operations.  No shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public splitting pattern, with white space as Unicode has it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
#: Distinct words whose ids a worker keeps; beyond, it starts anew (only speed depends on it).
KEPT_WORDS = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.tiktoken in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class MergeReplay:
    """A vocabulary of ranked byte strings and the ids of the words met so far."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.by_id = {v: k for k, v in self.ranks.items()}
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[int, int] = {}  # (left id, right id) -> id of the merged token, -1 for none
        self.known: dict[str, int] = {}  # word -> place in self.flat's offsets
        self.chunks: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.kept = kept
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _pair(self, a: int, b: int) -> int:
        key = a << 20 | b
        r = self.pair_rank.get(key)
        if r is None:
            r = self.pair_rank[key] = self.ranks.get(self.by_id[a] + self.by_id[b], -1)
        return r

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (not empty), all words at once."""
        byte_id, pair = self.byte_id, self._pair
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_id[b] for b in w])
            sym.append(-1)  # a wall between words
        n = len(sym)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        index: dict[int, list[int]] = {}  # rank of a pair -> places of its left token
        get = self.pair_rank.get
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a < 0 or b < 0:
                continue
            r = get(a << 20 | b)
            if r is None:
                r = pair(a, b)
            if r >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()  # leftmost first, as pairs of one rank may overlap
            for i in places:
                a = sym[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = sym[j]
                if b < 0 or get(a << 20 | b) != rank:
                    continue  # a neighbour's merge has taken part of the pair
                sym[i] = rank
                k = nxt[j]
                nxt[i] = k
                prv[k] = i
                sym[j] = -2
                c = sym[k]
                if c >= 0:
                    r = get(rank << 20 | c)
                    if r is None:
                        r = pair(rank, c)
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(heap, r)
                h = prv[i]
                c = sym[h] if h >= 0 else -1
                if c >= 0:
                    r = get(c << 20 | rank)
                    if r is None:
                        r = pair(c, rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = [h]
                            heapq.heappush(heap, r)
        out = []
        for s, w in zip(starts, words):
            end = s + len(w)
            ids, i = [], s
            while i < end:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def _places(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > self.kept:
            self.known.clear()
            self.chunks, self.lengths, self._table = [], [], None
        listed = words.to_pylist()
        known = self.known
        new = [w for w in listed if w not in known]
        if new:
            raw = [w.encode() for w in new]
            whole = [self.ranks.get(w) for w in raw]
            hard = [k for k, r in enumerate(whole) if r is None]
            coded: list = [[r] for r in whole]
            for k, ids in zip(hard, self.encode_words([raw[k] for k in hard])):
                coded[k] = ids
            base = len(self.lengths)
            for k, w in enumerate(new):
                known[w] = base + k
            self.lengths.extend(map(len, coded))
            self.chunks.append(np.fromiter((i for ids in coded for i in ids), dtype=np.int32))
            self._table = None
        return np.fromiter((known[w] for w in listed), dtype=np.int64, count=len(listed))

    def encode_lists(self, words: pa.ListArray) -> pa.ListArray:
        """Ids of each text, given as the list of its words; null lists become empty."""
        flat = words.flatten()
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) == 0:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(words) + 1, np.int32)), pa.array([], pa.int32()))
        coded = flat.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy()]
        if self._table is None:
            lengths = np.array(self.lengths, dtype=np.int64)
            self.chunks = [np.concatenate(self.chunks)]
            self._table = (np.concatenate([[0], np.cumsum(lengths)]), self.chunks[0])
        offsets, ids = self._table
        size = offsets[places + 1] - offsets[places]
        ends = np.cumsum(size)
        shift = np.repeat(offsets[places] - (ends - size), size)
        values = ids[np.arange(int(ends[-1])) + shift]
        word_end = np.concatenate([[0], np.cumsum(counts)])
        text_end = np.concatenate([[0], ends])[word_end]
        return pa.ListArray.from_arrays(pa.array(text_end.astype(np.int32)), pa.array(values.astype(np.int32)))


_BY_PATH: dict[str, MergeReplay] = {}


def replay(path: str) -> MergeReplay:
    """One per worker process and vocabulary."""
    if path not in _BY_PATH:
        _BY_PATH[path] = MergeReplay(path)
    return _BY_PATH[path]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _slices(batch: pa.RecordBatch, words: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has much more than ``most`` words (long texts stay whole)."""
    counts = pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(counts) - 1) // most
    at = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
            at = end


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) for each row of df.

    ``ids`` is a list of integers without special tokens.  Null and empty texts get an
    empty list; the strings of special tokens are ordinary text; texts are encoded
    whole, however long; repeated rows are repeated; a null id stays null.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replay(path)
        for batch in batches:
            for part in _slices(batch, 1, 1_000_000):
                ids = coder.encode_lists(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), words_of(F.col(text_col)).alias("words")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
