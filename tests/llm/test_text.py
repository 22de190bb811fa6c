"""Tokenizer encoding, leak search and splitting against brute force."""

import base64
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, leaks, splitting

regex = pytest.importorskip("regex")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

ODD = [
    None, "", " ", "\n\n", "a", "Hello world's 42 'll  test\r\n\tx  ", "naïve café — ŝtrange ÅÄÖ", "日本語のテキスト。混在 text", "Привет, мир! nbsp em", "👩‍👩‍👧‍👦 emoji 🎉🎉", "a" * 5000, " " * 3000 + "x",
    "<|endoftext|> is text", "\x00\x01control\x7f", "१२३ ४५६ ²³ Ⅷ", "é combining", "x line par\u0085nel", "the" * 400, "﻿bom", "İstanbul ß ſ",
]


@pytest.fixture(scope="module")
def enc():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, ids int, words string")


def test_ids(spark, enc):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeft hns'.,\n  0123é中") for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += texts[3:30]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t or ""), repr(t)[:80]
        assert enc.decode_bytes(got[i]) == (t or "").encode()


def test_replay_of_overlapping_pairs(enc):
    m = bpe.MergeReplay(P.path("byte_bpe_50k.tiktoken"), kept=3)
    words = [b"aaaaaaa", b"lalalalala", b"=-=-=-=-=", b"x", b"zzzzzzzzzzzzzzzzzzzzzz"]
    assert m.encode_words(words) == [enc.encode_ordinary(w.decode()) for w in words]
    lists = pa.array([["a", " the"], [], None, ["zz", " of", "q", "zz", "lalala"]])
    for _ in range(3):  # the kept words are dropped in between
        assert m.encode_lists(lists).to_pylist() == [enc.encode_ordinary("a the"), [], [], enc.encode_ordinary("zz") + enc.encode_ordinary(" of") + enc.encode_ordinary("q") + enc.encode_ordinary("zz") + enc.encode_ordinary("lalala")]


def test_no_documents(spark):
    assert bpe.encode(docs(spark, [])).count() == 0
    assert splitting.split_texts(docs(spark, [])).count() == 0


# ---- splitting


def test_pieces(spark, enc):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 14)))
    diff = "".join(f"diff --git a/{word()} b/{word()}\n@@ -1 +1 @@\n" + "\n".join(line() for _ in range(rng.randrange(5, 60))) + "\n\n" for _ in range(12))
    texts = [diff, "\n\n".join(line() for _ in range(300)), "x" * 30_000, "混" * 4000, " ".join(word() for _ in range(900)), None, "", "short", "é" * 1200, diff.replace("\n", "\r\n"), diff, "👩‍👩‍👧‍👦नम混" * 600]
    rows = splitting.split_texts(docs(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if len(enc.encode_ordinary(t or "")) > 1000}
    for i, pieces in by.items():
        ids = enc.encode_ordinary(texts[i])
        pieces.sort(key=lambda r: r.piece_no)
        at = 0
        for r in pieces:
            assert r.n_tokens == r.last_token - r.first_token <= 1000
            assert r.overlap == (50 if r.piece_no > 1 else 0) and r.first_token + r.overlap == at
            assert r.text == enc.decode_bytes(ids[r.first_token : r.last_token]).decode("utf-8", "ignore") and r.ids == ids[r.first_token : r.last_token]
            at = r.last_token
        assert at == len(ids)
        assert "".join(r.text[r.overlap_chars :] for r in pieces) == texts[i]  # nothing is lost
        assert [t for r in pieces for t in r.ids[r.overlap :]] == ids
    assert any(r.text != enc.decode_bytes(r.ids).decode("utf-8", "replace") for r in by[11])  # an overlap that begins within a character
    assert {r.boundary for r in by[0]} <= {"start", "file", "hunk", "line"} and any(r.boundary == "file" for r in by[0])
    assert {r.boundary for r in by[1]} == {"start", "paragraph"}
    with pytest.raises(ValueError):
        splitting.split_texts(docs(spark, []), limit=50, overlap=50)


def test_a_line_that_fits_is_not_cut(spark, enc):
    # line ends only outside the middle half: a short line, then one that fits whole into a piece
    texts = ["a" + " b" * 140 + "\n" + "c" + " d" * 910, "a" + " b" * 910 + "\n" + "c" + " d" * 140, "a b\n" * 3 + "c" + " d" * 1500]
    by = {}
    for r in splitting.split_texts(docs(spark, texts)).orderBy("piece_no").collect():
        by.setdefault(r.doc_id, []).append((r.boundary, r.first_token + r.overlap))
    end = lambda t, line: len(enc.encode_ordinary("".join(t.splitlines(True)[:line])))
    assert by[0] == [("start", 0), ("line", end(texts[0], 1))] and by[1] == [("start", 0), ("line", end(texts[1], 1))]
    assert by[2][:2] == [("start", 0), ("line", end(texts[2], 3))] and {b for b, _ in by[2][2:]} == {"word"}


# ---- leaks


def brute(texts, items, n=15):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {}
    for i, p in items:
        w = words(p or "")
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for d, t in enumerate(texts):
        w = words(t or "")
        for k in range(len(w) - n + 1):
            found |= {(i, d) for i in runs.get(tuple(w[k : k + n]), ())}
    return found


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéö中") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(10, 60)))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, ""), (33, " ".join("a" for _ in range(20))), (34, items[5][1])]
    texts = [None, "", " \n", "a " * 400]
    for _ in range(60):
        w = say(rng.randrange(5, 200))
        src = (rng.choice(items)[1] or "").split()
        k = rng.randrange(0, max(1, len(src) - 10))
        part = src[k : k + rng.choice([13, 14, 15, 16, 40])]
        if rng.random() < 0.3 and len(part) > 8:
            part[7] = "changed"
        j = rng.randrange(len(w))
        joint = rng.choice([" ", "\n+", ", ", "__"])
        texts.append(" ".join(w[:j]) + " " + joint.join(part).upper() + " " + " ".join(w[j:]))
    texts.append(" ".join(say(30_000)) + " " + items[7][1] + " " + " ".join(say(2000)))
    texts += [items[3][1]] * 3
    d = docs(spark, texts)
    it = spark.createDataFrame([(i, "s", p, 0, 5) for i, p in items], "item_id long, suite string, passage string, n_chars int, doc_id int")
    rows = leaks.leaks(d, it).collect()
    got = {(r.item_id, r.doc_id) for r in rows if r.longest_run >= 15}
    want = brute(texts, items)
    assert got == want and len(want) > 20
    assert len({(r.item_id, r.doc_id) for r in rows}) == len(rows)


def test_a_passage_broken_over_neighbouring_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30)]
    stray = " ".join(words[:3])  # a shared q-gram at the end of the row before, on the same diagonal
    texts = [" ".join(words[:15]), " ".join(words[15:]), "zz", "yy " + stray, " ".join(words[3:18]), None, " ".join(words[:14]), " ".join(words[14:])]
    items = [(1, " ".join(words))]
    found = leaks.leaks(docs(spark, texts).coalesce(1), spark.createDataFrame(items, "item_id long, passage string")).where("longest_run >= 15").collect()
    assert {(r.item_id, r.doc_id) for r in found} == brute(texts, items) == {(1, 0), (1, 1), (1, 4), (1, 7)}


def test_changed_characters_are_still_found(spark):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30))
    words = passage.split()
    broken = " ".join(w if i % 10 else w[:3] + "x" + w[4:] for i, w in enumerate(words))
    r = leaks.leaks(docs(spark, ["zz " + broken + " yy"]), spark.createDataFrame([(1, passage)], "item_id long, passage string")).collect()
    assert [(x.item_id, x.matched_words, x.edits, x.score, x.longest_run, x.first_word) for x in r] == [(1, 27, 2, 25, 9, 1)]


def edited(rng, words, changes):
    """Words with some changed, left out, put in or swapped."""
    w = list(words)
    for _ in range(changes):
        i = rng.randrange(1, len(w) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            w[i] = w[i][:2] + rng.choice("xyz") + w[i][3:]
        elif kind == 1:
            del w[i]
        elif kind == 2:
            w.insert(i, "extra")
        else:
            w[i], w[i + 1] = w[i + 1], w[i]
    return w


@pytest.mark.parametrize(("every", "least"), [(30, 0.99), (20, 0.95), (12, 0.9)])
def test_recall_of_edited_passages(spark, every, least):
    """One edit to ``every`` words, anywhere; the texts around are of the same words."""
    rng = random.Random(every)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(900)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(30, 90)))) for i in range(60)]
    texts, planted = [], set()
    for d in range(120):
        i, p = items[d % 60]
        w = p.split()
        texts.append(" ".join(say(rng.randrange(200)) + edited(rng, w, max(1, len(w) // every)) + say(rng.randrange(200))))
        planted.add((i, d))
    rows = leaks.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, passage string")).collect()
    got = {(r.item_id, r.doc_id) for r in rows}
    recall = len(got & planted) / len(planted)
    print(f"one edit to {every} words: recall {recall:.3f}, others {len(got - planted)}")
    assert recall >= least and got <= planted


def test_repetitive_passages_and_texts(spark, monkeypatch):
    """Every q-gram of the one is everywhere in the other; looked at in small slices, the result is the same."""
    passage, text = " ".join(["ab cd"] * 200), " ".join(["cd ab"] * 3000 + ["zz"] + ["ab cd"] * 7)
    it = spark.createDataFrame([(1, passage), (2, "q " * 30)], "item_id long, passage string")
    key = lambda x: sorted((r.item_id, r.doc_id, r.longest_run) for r in x.collect())
    whole = key(leaks.leaks(docs(spark, [text, "ab cd " * 7]), it))
    assert whole[0][:2] == (1, 0) and whole[0][2] == 400
    real = leaks.leaks
    monkeypatch.setattr(leaks, "POSTINGS", 1000)
    assert key(real(docs(spark, [text, "ab cd " * 7]), it)) == whole


def test_no_items(spark):
    assert leaks.leaks(docs(spark, ["a b c"]), spark.createDataFrame([], "item_id long, passage string")).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(25))) for i in range(20)]
    texts = [p + " tail" for _, p in items[:10]]
    it = spark.createDataFrame(items, "item_id long, passage string")
    key = lambda x: sorted((r.item_id, r.doc_id, r.longest_run) for r in x.collect())
    whole = key(leaks.leaks(docs(spark, texts), it))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 500)
    assert key(leaks.leaks(docs(spark, texts), it)) == whole and len(whole) == 10


def test_alignment():
    a = np.arange(6)
    code = lambda w: np.array(w)
    assert leaks.align(a, a, 0, 8) == (6, 6, 0, 6, 0)
    assert leaks.align(a, code([9, 0, 1, 2, 9, 4, 5, 9]), 1, 8)[:3] == (4, 5, 1)
    assert leaks.align(a, code([0, 1, 2, 4, 5]), 0, 8)[:4] == (4, 5, 1, 3)
    assert leaks.align(a, code([9]), 0, 8) == (0, 0, 0, 0, 0)
    assert leaks.align(a, np.r_[np.full(50, 9), a], 50, 2) == (6, 6, 0, 6, 0) and leaks.align(a, np.r_[np.full(50, 9), a], 20, 2)[0] == 0  # only the band counts
