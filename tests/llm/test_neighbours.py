import math

import numpy as np
import pytest

from tracewell.llm import neighbours as N


def brute(rows, every=20, k=20):
    """Exact neighbours: {query id: [(id, score)]}."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = {}
            for i, y in good:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float((x * y).sum()))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_quantile():
    assert N.chi_square(N.quantile(0.97)) == pytest.approx(0.97)
    draws = np.random.default_rng(0).chisquare(N.PROJECTED, 200_000)
    assert np.mean(draws <= N.quantile(0.9)) == pytest.approx(0.9, abs=0.005)


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    out = N.nearest(df, "vec_id % 20 = 0", sample=300, block_rows=50)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = found(out)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 20 * len(want)
    truth = {q: dict(v) for q, v in want.items()}
    assert all(s == pytest.approx(truth[q][i], abs=1e-12) for q in got for i, s in got[q] if i in truth[q])


def test_stopping_test_leaves_leaves_out():
    """Clustered vectors: most leaves are never verified, and the neighbours are still found."""
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((60, 32))
    x = np.repeat(centres, 80, 0) + 0.05 * rnd.standard_normal((4800, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = N.Space(32, float(np.linalg.norm(x, axis=1).max()))
    block = N.Block(np.arange(4800), x, space)
    seen, plain = [], N.products
    N.products = lambda rows, q: seen.append(len(rows)) or plain(rows, q)
    try:
        limit = N.quantile(N.CONFIDENCE)
        got = {i: set(ids.tolist()) for i, ids, _ in block.search(np.arange(0, 4800, 100), x[::100], np.full(48, -np.inf), 10, limit)}
    finally:
        N.products = plain
    exact = x[::100] @ x.T
    exact[np.arange(48), np.arange(0, 4800, 100)] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :10]
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(48)) >= 0.95 * 480
    assert sum(seen) < 0.6 * 48 * 4800


def test_ties_copies_and_odd_rows(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.standard_normal(4) * 10.0 ** rnd.integers(-2, 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(60)] + [(40, rows[40][1])] * 30
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 1.0, 1.0]), (2004, [math.nan, 1.0, 1.0, 1.0]), (2005, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (2020, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, cell int, rank int, score double")
    want = brute([(i, v) for i, v in rows if not v or len(v) == 4])
    got = found(N.nearest(df, "vec_id % 20 = 0", confidence=1 - 1e-9, sample=50, least_cells=4))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = found(N.search_embeddings(df.where("vec_id < 6")))
    assert [i for i, _ in few[0]] == [i for i, _ in brute(rows[:6])[0]] and len(few[0]) == 5
    assert N.search_embeddings(df.limit(0)).count() == 0
