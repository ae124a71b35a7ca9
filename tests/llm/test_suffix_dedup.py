import hashlib
import random

import numpy as np
import pytest

from tracewell.llm import suffix_dedup as S


def brute(rows):
    """Result of each (id, text) by a set of all windows, in order of id."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rnd.randint(15, 80))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.4:
                p = rnd.choice(passage)
                a = rnd.randrange(len(p))
                parts.append(p[a : a + rnd.randint(60, 500)])
            elif kind < 0.5:
                parts.append(rnd.choice(["x", "ab", "abc "]) * rnd.randint(50, 400))
            else:
                parts.append(" ".join(word() for _ in range(rnd.randint(1, 40))))
        rows.append((d, "".join(parts)))
    for d in range(n, n + 15):  # near copies
        t = list(rows[rnd.randrange(n)][1])
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = "#"
        rows.append((d, "".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed, 60)
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(4)
    core = bytes(rnd.choice(b"abc ") for _ in range(100))
    found = set()
    for _ in range(40):
        left, right = (bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 150))) for _ in range(2))
        raw = np.frombuffer(left + core + right, np.uint8)
        found.add(int(S.anchor_of_windows(S.gram_hashes(raw))[len(left)]) - len(left))
    assert len(found) == 1


def test_sorting_finds_equals():
    rnd = random.Random(8)
    texts = [bytes(rnd.choice(b"ab") for _ in range(100)) for _ in range(30)]
    texts += [t[:40] + bytes(rnd.choice(b"ab") for _ in range(60)) for t in texts[:10] for _ in range(4)]
    texts = [rnd.choice(texts) for _ in range(400)]
    segments = np.sort(np.array([rnd.randrange(6) for _ in texts]))
    got = S.equal_suffixes(b"".join(texts), np.arange(len(texts)) * 100, segments)
    want = [next(j for j in range(len(texts)) if texts[j] == t and segments[j] == s) for t, s in zip(texts, segments)]
    assert got.tolist() == want
    trie = S.BlindTrie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    assert [texts[x[0]] for x in trie.leaves()] == sorted(set(texts))


def test_long_texts_in_strides(spark, monkeypatch):
    rows = corpus(3, 25)
    want = brute(rows)
    monkeypatch.setattr(S, "STRIDE", 37)
    rows_found = {d: [tuple(map(tuple, a)) for a in S.anchors(t.encode())] for d, t in rows}
    assert any(len(x) > 2 for x in rows_found.values())
    assert {d: v[0] for d, v in want.items()} == {d: len(t.encode()) for d, t in rows}


def test_rows(spark):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    rows = [(1, t), (1, t), (2, "ab" + t), (3, None), (4, ""), (5, "x" * 99), (6, "y" * 250), (None, t), (7, t), (7, t[:150] + "!")]
    df = spark.createDataFrame([(d, x, 1, "s") for d, x in rows], "doc_id long, text string, n_bytes int, doc string")
    out = S.remove_repeats(df, keep_text=True).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[1]] == [0, 0] and by[2][0].kept == b"ab" and by[None][0].kept == b""
    assert by[3][0].n_bytes == 0 and by[4][0].kept == b"" and by[5][0].n_removed == 0
    assert (by[6][0].n_removed, by[6][0].n_spans) == (249, 1)
    assert sorted(r.kept for r in by[7]) == [b"", b"!"]
    assert S.remove_repeats(df.limit(0)).count() == 0
