import random

from tracewell.llm import decontaminate as D


def brute(item, text):
    """Least edits between item and any part of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def damaged(rnd, text, n):
    chars = list(text)
    for _ in range(n):
        i = rnd.randrange(len(chars)) if chars else 0
        chars[i : i + 1] = rnd.choice([[], [rnd.choice("abcé ")], [*chars[i : i + 1], rnd.choice("xyz")]])
    return "".join(chars)


def test_search_equals_brute_force():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    for _ in range(60):
        items = [D.plain(" ".join(word() for _ in range(rnd.randint(1, 16)))) for _ in range(4)]
        parts = [" ".join(word() for _ in range(8))]
        for _ in range(3):
            parts += [damaged(rnd, rnd.choice(items), rnd.randint(0, 8)), " ".join(word() for _ in range(rnd.randint(0, 9)))]
        text = D.plain(" ".join(parts))
        search = D.Searcher(tuple(items), 10)
        want = [(k, d) for k, t in enumerate(items) if (d := brute(t, text)) <= len(t) // 10]
        assert search.matches(text) == want


def test_rows(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards look on in silence."
    near = item.replace("wizards", "wizard").replace("quick", "quik")
    rows = [(1, f"Intro.\n{item} End."), (2, f"x {near.upper()} y"), (3, "nothing of it"), (3, "nothing of it"), (4, None), (5, ""), (None, item), (6, item[:40]), (7, "pad " * 20000 + item)]
    df = spark.createDataFrame([(d, t, 9, "q") for d, t in rows], "doc_id long, text string, item_id int, distance string")
    bench = spark.createDataFrame([(10, item, 1), (11, item, 1), (12, None, 1), (13, "  ", 1), (None, "another item of some length here", 1)], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, D.matches(df, bench).collect()), key=str)
    k = len(D.plain(item)) // 10
    want = [(d, i, e, k) for d, e in ((1, 0), (2, 2), (None, 0), (7, 0)) for i in (10, 11)]
    assert got == sorted(want, key=str)
    small = D.MatchRules(block_chars=50)
    assert sorted(map(tuple, D.matches(df, bench, small).collect()), key=str) == got
    for rules in (D.MatchRules(), small):
        kept = D.clean_documents(df, bench, rules)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == [3, 3, 4, 5, 6]
    assert D.matches(df.limit(0), bench).count() == 0 and D.matches(df, bench.limit(0)).count() == 0
    assert D.clean_documents(df, bench.limit(0)).count() == len(rows)
