"""Held-out passages inside a large corpus, by q-gram filtering and banded alignment.

Texts and passages are reduced to words joined by single blanks.  All character
q-grams of the passages form one index; the texts of a chunk are looked up at every
position at once.  Shared q-grams are counted per passage in overlapping diagonal
bands; by the q-gram lemma a band with a run of ``min_words`` words within the edit
budget holds at least length - q + 1 - q * edits of them.  Bands that reach this
bound within one text are verified by a banded word alignment.  The corpus is never shuffled: only
the passages travel, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of passages that travels at once has about so many characters; its index takes about 100 bytes for each of them in a worker.
BLOCK_CHARS = 2_000_000
CHUNK_BYTES = 2_000_000
#: Shared q-grams looked at together (more only where a stretch of text as long as a passage has more).
POSTINGS = 4_000_000
_NOT_WORD = re.compile(r"[\W_]+")
_LOWER = bytes(
    (c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() and c < 128 else 32 for c in range(256)
)
_BITS = 22
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FOUND = "item_id long, score int, matched_words int, edits int, longest_run int, passage_words int, first_word int"


def normal(text: str) -> bytes:
    """Words (runs of letters and digits) in lower case, joined by single blanks."""
    if text.isascii():
        return b" ".join(text.encode().translate(_LOWER).split())
    return _NOT_WORD.sub(" ", text.lower()).strip().encode()


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place."""
    n = len(raw) - 15
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = at[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += at[8 : 8 + n] * _C[1]
    h *= _C[0]
    return h


class PassageIndex:
    """q-grams of a block of passages."""

    q = 16

    def __init__(self, items: list[tuple[int, str]], min_words: int, edits: int, band: int):
        self.ids, self.words, self.ends, self.bounds = [], [], [], []
        self.code: dict[bytes, int] = {}
        self.min_words, self.edits, self.band = min_words, edits, band
        grams, owner, place = [], [], []
        for item_id, passage in items:
            text = normal(passage or "")
            words = text.split()
            if len(words) < min_words:
                continue
            ends = np.cumsum([len(w) + 1 for w in words])
            run = ends[min_words - 1 :] - 1 - np.concatenate([[0], ends[:-min_words]])
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(np.array([self.code.setdefault(w, len(self.code)) for w in words]))
            self.ends.append(ends)
            self.bounds.append(max(1, int(run.min()) - self.q + 1 - self.q * edits))
            h = _grams(np.frombuffer(text, np.uint8))
            grams.append(h)
            owner.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int32))[order]
        self.grams, self.start, self.count = np.unique(h, return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.bound = np.array(self.bounds, dtype=np.int64)
        self.length = np.array([int(e[-1]) - 1 for e in self.ends], dtype=np.int64)

    def candidates(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(passage, first place, last place, diagonal) of each band that meets its bound within one text; the texts begin at ``starts``."""
        h = _grams(raw)
        hit = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(hit) or not len(self.grams):
            return
        at = np.searchsorted(self.grams, h[hit])
        at = np.minimum(at, len(self.grams) - 1)
        same = self.grams[at] == h[hit]
        hit, at = hit[same], at[same]
        if not len(hit):
            return
        n = self.count[at]
        # a band's hits lie within a passage's length of text, so slices that overlap by it hold every band whole
        reach = int(self.length.max()) + self.band
        upto = np.concatenate([[0], np.cumsum(n)])
        seen: set[tuple[int, int, int]] = set()
        lo = 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + POSTINGS, side="right")) - 1)
            back = int(np.searchsorted(hit, hit[lo] - reach))
            for cand in self._bands(hit[back:hi], at[back:hi], starts):
                if cand[:3] not in seen:
                    seen.add(cand[:3])
                    yield cand
            lo = hi

    def _bands(self, hit: np.ndarray, at: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        n = self.count[at]
        # every shared q-gram as (passage, diagonal, place in the text)
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(self.start[at], n) + within
        where = np.repeat(hit, n)
        owner = self.owner[posting]
        diagonal = where - self.place[posting] + 2 * int(self.length.max())
        for shift in (0, self.band // 2):
            key = owner.astype(np.int64) * (1 << 40) + (diagonal + shift) // self.band
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            who = owner[order[first]]
            for j in np.flatnonzero(size >= self.bound[who]):
                rows = order[first[j] : first[j] + size[j]]
                rows = rows[np.argsort(where[rows], kind="stable")]
                w = where[rows]
                # shared q-grams of different texts belong to separate regions
                text = np.searchsorted(starts, w, side="right")
                for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(text) > 0) + 1):
                    if len(part) >= self.bound[who[j]]:
                        mid = rows[part[len(part) // 2]]
                        yield int(who[j]), int(w[part[0]]), int(w[part[-1]]) + self.q, int(where[mid] - self.place[posting[mid]])


def align(item: np.ndarray, text: np.ndarray, centre: int, band: int) -> tuple[int, int, int, int, int]:
    """Best local word alignment (score, matches, edits, longest exact run, its place in the item), words being numbers.

    A match scores 1, an edit -1.  Only cells within ``band`` words of the diagonal ``centre`` (place in the text less place in
    the item) are looked at: memory and time are those of the band.
    """
    width = 2 * band + 1
    columns = np.arange(width)
    score, packed, run = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    best, best_packed, longest, first = 0, 0, 0, 0
    one = 1 << 20  # matches and edits side by side, so that a maximum keeps them together
    padded = np.full(len(text) + 2 * width, -1, dtype=np.int64)
    padded[width : width + len(text)] = text
    for i in range(len(item)):
        j = i + centre - band  # place in the text of the first cell
        inside = padded[max(0, min(j + width, len(padded) - width)) :][:width] if -width <= j <= len(text) else np.full(width, -2)
        equal = inside == item[i]
        run = np.where(equal, run + 1, 0)
        k = int(run.argmax())
        if run[k] > longest:
            longest, first = int(run[k]), i + 1 - int(run[k])
        up_score, up_packed = np.r_[score[1:], 0] - 1, np.r_[packed[1:], 0] + 1
        along = score + np.where(equal, 1, -1)
        s = np.maximum(along, up_score)
        p = np.where(along >= up_score, packed + np.where(equal, one, 1), up_packed)
        # gaps along the row: the best of s[k'] - (k - k')
        lifted = s + columns
        top = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == top, columns, 0))
        s, p = top - columns, p[src] + columns - src
        s[s <= 0], p[s <= 0] = 0, 0
        score, packed = s, p
        k = int(s.argmax())
        if s[k] > best:
            best, best_packed = int(s[k]), int(p[k])
    return best, best_packed >> 20, best_packed & (one - 1), longest, first


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """Normalised texts of about CHUNK_BYTES joined by line ends: (bytes, rows, start of each row)."""
    part: list[bytes] = []
    rows: list[int] = []
    size = 0
    for r, text in enumerate(texts):
        if not text:
            continue
        n = normal(text)
        part.append(n)
        rows.append(r)
        size += len(n) + 1
        if size >= CHUNK_BYTES:
            yield _joined(part, rows)
            part, rows, size = [], [], 0
    if part:
        yield _joined(part, rows)


def _joined(part: list[bytes], rows: list[int]) -> tuple[np.ndarray, list[int], np.ndarray]:
    starts = np.cumsum([0, *[len(p) + 1 for p in part]])
    return np.frombuffer(b"\n".join(part) + b"\n", np.uint8), rows, starts


def _search(index: PassageIndex, texts: list[str | None]) -> Iterator[tuple]:
    """(row, item_id, score, matched, edits, longest run, passage words, first word) of each row and passage."""
    slack = index.band
    for raw, rows, starts in _chunks(texts):
        buffer = raw.tobytes()
        best: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
        for k, first, last, diagonal in index.candidates(raw, starts):
            r = int(np.searchsorted(starts, first, side="right")) - 1
            pad = int(index.length[k]) + slack
            a, b = max(int(starts[r]), first - pad), min(int(starts[r + 1]) - 1, last + pad)
            words = buffer[a:b].split(b" ")
            # the word of the passage, and of the region, at the first place of the region that both have on the diagonal
            place = max(0, first - diagonal)
            there = int(np.searchsorted(index.ends[k], place, side="right"))
            centre = buffer.count(b" ", a, diagonal + place) - there
            coded = np.array([index.code.get(w, -1) for w in words])
            if a > starts[r] and buffer[a - 1 : a] != b" ":
                coded[0] = -1  # the first may be cut
            if b < starts[r + 1] - 1 and buffer[b : b + 1] != b" ":
                coded[-1] = -1
            got = align(index.words[k], coded, centre, index.band)
            old = best[rows[r], k]
            if got[3] > old[3]:
                old[3:] = got[3:]
            if got[0] > old[0]:
                old[:3] = got[:3]
        for (r, k), v in best.items():
            yield (r, index.ids[k], v[0], v[1], v[2], v[3], len(index.words[k]), v[4])


def leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 15, edits: int = 1, band: int = 32
) -> DataFrame:
    """Texts that hold a passage wholly or partly, one row per text and item.

    Columns: the id, item_id, score (matches less edits of the best local alignment),
    matched_words, edits, longest_run (of consecutive equal words), passage_words, first_word (of the
    run, in the passage).  Every text with a run of ``min_words`` words of a passage
    with up to ``edits`` changed characters is found.  Items of fewer words cannot leak; passages
    that serve two items are reported for both; null and empty texts or passages give
    no rows; texts are searched whole; repeated rows are reported each.
    """
    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").alias("passage")).where("passage is not null")
    n_blocks = 1 + int(chosen.agg(F.sum(F.length("passage"))).first()[0] or 0) // BLOCK_CHARS
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[c.split()[0] for c in FOUND.split(", ")]]
    found = None
    for block in range(n_blocks):
        own = chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else chosen
        passages = [tuple(r) for r in own.collect()]  # at most about BLOCK_CHARS characters

        def run(batches: Iterable[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(passages, min_words, edits, band)
            for batch in batches:
                out = list(_search(index, batch.column(1).to_pylist()))
                if out:
                    rows, *cols = zip(*out)
                    arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), *[pa.int32()] * 6])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *arrays], names=names)

        part = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {FOUND}")
        found = part if found is None else found.unionByName(part)
    return found.where(F.col("longest_run") >= 1).where((F.col("score") >= min_words - 3 * edits) | (F.col("longest_run") >= min_words))
