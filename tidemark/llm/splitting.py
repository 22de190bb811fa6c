"""Cut oversized texts at natural boundaries by recursive bisection.

A text of more than ``limit`` tokens is cut at the strongest boundary near its
midpoint (at a word or character only if it has no file, hunk, paragraph or line
end at all), and the parts again while they exceed ``limit - overlap``; then every
piece but the first gets the last ``overlap`` tokens before it in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import _slices, default_vocabulary, replay, words_of

#: Boundaries from strong to weak; a boundary lies before the matched text, or after it for the ends.
BEFORE = (("file", re.compile(rb"^(?:diff |Index: |# HG changeset|From [0-9a-f]{12,40} |commit [0-9a-f]{40})", re.M)), ("hunk", re.compile(rb"^@@ ", re.M)))
AFTER = (("paragraph", re.compile(rb"\n[ \t\r]*\n(?:[ \t\r]*\n)*")), ("line", re.compile(rb"\n")))
KINDS = ("file", "hunk", "paragraph", "line", "word", "character")
#: A character has at most four bytes, so the middle half of a segment of more tokens than this holds the beginning of one.
LEAST_ROOM = 8
#: Bytes that continue a character.
CONTINUED = bytes(range(0x80, 0xC0))
PIECES = "piece_no int, first_token int, last_token int, n_tokens int, overlap int, overlap_chars int, boundary string, text string, ids array<int>"


def boundaries(raw: bytes, starts: np.ndarray) -> list[np.ndarray]:
    """Token places before which a cut of each kind may fall, sorted."""
    found: list[np.ndarray] = []
    for (_, pattern), end in [*((b, False) for b in BEFORE), *((a, True) for a in AFTER)]:
        at = np.array([m.end() if end else m.start() for m in pattern.finditer(raw)], dtype=np.int64)
        place = np.searchsorted(starts, at)
        inside = place < len(starts)
        at, place = at[inside], place[inside]
        # where white space before the text is one token with the line end, the cut is after it
        exact = starts[place] == at
        for k in np.flatnonzero(~exact):
            exact[k] = raw[at[k] : starts[place[k]]].isspace()
        found.append(np.unique(place[exact]))
    first = np.frombuffer(raw, np.uint8)[starts]
    found.append(np.flatnonzero(np.isin(first, np.frombuffer(b" \t\n\r", np.uint8))))
    found.append(np.flatnonzero((first & 0xC0) != 0x80))
    return found


def bisect(n: int, places: list[np.ndarray], most: int) -> list[tuple[int, int, int]]:
    """Segments (start, end, kind of the boundary at the start; -1 for the first) of at most ``most`` tokens.

    The strongest natural boundary in the middle half of a segment is taken, else the strongest anywhere in
    it, else a word or character in the middle half; of one kind the nearest to the midpoint.
    """
    natural = len(BEFORE) + len(AFTER)
    done, todo = [], [(0, n, -1)]
    while todo:
        a, b, kind = todo.pop()
        if b - a <= most:
            done.append((a, b, kind))
            continue
        mid, slack = (a + b) / 2, (b - a) / 4
        near_mid, all_of_it = (max(a + 1, mid - slack), min(b - 1, mid + slack)), (a + 1, b - 1)
        kinds = range(len(places))
        for k, (lo, hi) in [*((k, near_mid) for k in kinds[:natural]), *((k, all_of_it) for k in kinds[:natural]), *((k, near_mid) for k in kinds[natural:])]:
            at = places[k]
            i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
            if i < j:
                near = at[i:j]
                cut = int(near[np.argmin(np.abs(near - mid))])
                break
        todo.append((cut, b, k))
        todo.append((a, cut, kind))
    return done


def split_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1000, overlap: int = 50, vocabulary: str | None = None
) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    Columns: the id, piece_no (from 1), first_token and last_token (exclusive) in the
    text's tokens, n_tokens (at most ``limit``), overlap (tokens repeated in front: 0 for the first
    piece, else ``overlap``), overlap_chars (how many characters of text those are), boundary
    (kind of the cut at the piece's own beginning, ``start`` for the first), text, ids (its tokens).
    Cuts lie between characters, so without their first overlap_chars characters the texts make
    up the whole text, and without their first overlap tokens the ids make up all its tokens.  An
    overlap that begins within a character has that character in full in the piece before, and
    its text begins with the next one.  Null, empty and shorter texts give no rows; a text without
    any boundary is cut between characters.  Repeated rows are split each.
    """
    path = vocabulary or default_vocabulary()
    if not 0 <= overlap <= limit - LEAST_ROOM:
        raise ValueError(f"the overlap must be smaller than the limit by at least {LEAST_ROOM}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replay(path)
        width = np.array([len(coder.by_id[i]) for i in range(len(coder.by_id))])
        for batch in batches:
            for part in _slices(batch, 1, 1_000_000):
                ids = coder.encode_lists(part.column(1))
                lengths = pc.list_value_length(ids).to_numpy()
                offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                rows: list[tuple] = []
                keys: list[int] = []
                for r in np.flatnonzero(lengths > limit):
                    tokens = flat[offsets[r] : offsets[r + 1]]
                    raw = b"".join([coder.by_id[t] for t in tokens.tolist()])
                    ends = np.cumsum(width[tokens])
                    starts = ends - width[tokens]
                    for no, (a, b, kind) in enumerate(bisect(len(tokens), boundaries(raw, starts), limit - overlap), 1):
                        over = min(overlap, a)
                        front = raw[starts[a - over] : starts[a]].lstrip(CONTINUED).decode()
                        text = front + raw[starts[a] : ends[b - 1]].decode()
                        rows.append((no, a - over, b, b - a + over, over, len(front), KINDS[kind] if no > 1 else "start", text, tokens[a - over : b]))
                        keys.append(r)
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 6, pa.string(), pa.string(), pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keys)), *cols],
                        names=[id_col, "piece_no", "first_token", "last_token", "n_tokens", "overlap", "overlap_chars", "boundary", "text", "ids"],
                    )

    kind = df.schema[id_col].dataType.simpleString()
    # a token has at least one byte
    long_ones = df.where(F.octet_length(F.col(text_col)) > limit)
    return long_ones.select(F.col(id_col), words_of(F.col(text_col)).alias("words")).mapInArrow(run, f"{id_col} {kind}, {PIECES}")
