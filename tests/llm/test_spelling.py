import re
import zlib
from collections import Counter

from tracewell.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def brute(rows, least_n=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_n}
    out, by_length = {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    result = set()
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.add((w, form, root, n[w], count, n.get(form)))
    return result


def check(spark, rows, least_n=5):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    out = S.spelling_variants(df, least_n=least_n)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least_n)
    return got


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.doc_id % 40 == 0]
    assert len(check(spark, rows, 1)) > 500


def test_every_edit_of_words(spark):
    words = ["banana", "aaaaaa", "abababab", "ananas", "ététété", "zyxwvut", "aabbaabb"]
    rows, at = [], 0
    for w in words:
        variants = {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for d in (0, 1) for c in ("", "a", "b", "ÿ")}
        for v in sorted(variants):
            rows.append((at, " ".join([v] * (1 + 7 * (v == w)))))
            at += 1
    check(spark, rows, 1)


def test_chains_ties_and_odd_rows(spark):
    chain = [("aabbccddee", 700), ("aabbccddef", 130), ("aabbccddff", 26), ("aabbccdfff", 5), ("aabbccdfffg", 1)]
    rows = [(1, " ".join(" ".join([w] * n) for w, n in chain)), (2, None), (3, ""), (None, "Straßen Straßen strassen"), (4, "x" * 300_000)]
    rows += [(5, "letters " * 10 + "betters " * 10 + "setters"), (5, "letters"), (6, "AB×÷CD1efghijk")]
    got = {r[0]: r for r in check(spark, rows, 1)}
    assert got["aabbccdfffg"][2] == "aabbccddee"
    check(spark, [])
