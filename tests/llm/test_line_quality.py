import itertools
import random
import re

import numpy as np

from tracewell.llm import line_quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "é ", " ", "b ", "\n", "x#|", " ", "\t", "\x1c", "漢 "]) for _ in range(rnd.randint(0, 160)))
        assert Q.describe(text.encode())[0] == brute(text)
    same = "one two three four five six seven eight nine " * 5
    assert Q.describe(same.encode())[0] == brute(same)


def test_decoding_finds_the_best_sequence():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        field = Q.Field(rnd.normal(size=3), rnd.normal(size=(2, 2)))
        x = rnd.normal(size=(6, 3))

        def value(s):
            return sum(g for g, k in zip(x @ field.weights, s) if k) + sum(field.moves[a, b] for a, b in zip(s, s[1:]))

        assert tuple(field.decode(x)) == max(itertools.product((0, 1), repeat=6), key=value)


def test_rows_and_training(spark):
    good = "\n".join(f"This {w} line is an honest one {w} about rivers {w} and hills {w}." for w in ("red", "blue", "tall", "old", "new", "far"))
    bad = "\n".join(f"Buy### {w}$$$ now*** cheap%%% {w}&&& deal### {w}%%% today&&& {i}***" for i, w in enumerate("abcdefgh"))
    rows = [(i, good + f"\nLine {i} ends here quietly." if i % 2 else bad + f"\n{i}### {i}***") for i in range(60)]
    rows += [(100, None), (101, ""), (None, good), (102, good), (102, good)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, ""), (7, None, "")], "doc_id long, quality int, text string")
    got = Q.quality(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 60:
            assert r.kept == bool(r.doc_id % 2) and not r.base_failed
        if r.doc_id in (100, 101):
            assert r.base_failed and not r.kept and r.n_words == 0
    assert [r.kept for r in got if r.doc_id in (None, 102)] == [True] * 3
    assert Q.quality(df.limit(0), labels.limit(0)).count() == 0
    assert all(r.kept != r.base_failed for r in Q.quality(df, labels.limit(0)).collect())
    lines = Q.label_lines(df.where("doc_id = 102"), None)
    assert lines.count() == 12 and lines.where("content").count() == 12
