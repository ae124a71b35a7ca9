import random

import numpy as np
import xxhash

from tracewell.llm import simhash as S


def brute(fps, threshold=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= threshold:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_by_definition():
    for text in ["", " \t\n", "One", "one two", "A b c d a b c", "É é é x", "x " * 200]:
        w = text.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert S.fingerprint(text.encode()) % 2**64 == want


def test_code_is_perfect():
    first, _, over = S._cosets(0)
    assert (np.diff(first) == 1).all() and not over.any()


def test_every_close_pair_meets():
    rnd = random.Random(5)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            y ^= 1 << b
        both = [set(S.anchors(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (x, y)]
        assert both[0] & both[1]


def test_links_and_components(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(140):  # a cluster above WIDE and chains
        f = rnd.choice(fps[:2] * 20 + fps)
        for b in rnd.sample(range(64), rnd.randint(1, 3)):
            f ^= 1 << b
        fps.append(f)
    signed = np.array(sorted(set(fps)), np.uint64).view(np.int64).tolist()
    links = S.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links.collect())
    got = {r.node: r.root for r in S.components(links).collect()}
    want = brute(signed)
    for a in signed:
        for b in signed:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (2, base), (2, base), (9, base.replace("w17 ", "zz ")), (1, "quite another text here"), (7, None), (8, "  "), (None, base)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    out = S.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    near = (S.fingerprint(base.encode()) ^ S.fingerprint(base.replace("w17 ", "zz ").encode())).bit_count() <= 3
    assert near
    assert got == sorted([(5, 2), (2, 2), (2, 2), (9, 2), (1, 1), (7, 7), (8, 7), (None, 2)], key=str)
    assert sorted(r.doc_id or -1 for r in S.one_per_component(df).collect()) == [-1, 1, 2, 7]
    assert S.near_duplicates(df.limit(0)).count() == 0
