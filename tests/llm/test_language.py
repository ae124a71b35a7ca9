import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import language as L

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "lang", "score", "text").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang and L.has_letter(r.text or "")]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    # The language of held-out rows has no influence.
    blind = docs.withColumn("lang", F.when(~L.held_out(F.col("doc_id")), F.col("lang")).otherwise("xx"))
    again = {(r.doc_id, r.lang_pred, r.score) for r in L.identify(blind).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in rows}


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(0)
    tf = rng.random((20, L.BUCKETS)).astype(np.float32)
    model = L.Centroids(["a", "b", "b"], np.ones(L.BUCKETS, np.float32), L.unit(rng.random((3, L.BUCKETS))).astype(np.float32), np.zeros(3))
    best, cosine = model.nearest(tf)
    for row, b, c in zip(tf, best, cosine):
        every = [float(row @ m) / float(np.linalg.norm(row)) for m in model.matrix]
        assert abs(max(every) - c) < 1e-5 and abs(every[b] - c) < 1e-5


def test_rows(spark):
    rows = [(i, f"the cat and the dog number {i} are in the house", "en") for i in range(30)]
    rows += [(i, f"der Hund und die Katze {i} sind in dem Haus", "de") for i in range(30, 60)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 ½ _", "de"), (None, "the house and the dog", None), (103, "x", None), (103, "x", None)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows + odd], "doc_id long, text string, lang string, score double, held_out boolean")
    got = L.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == g for d, _, g in rows)
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (100, 101, 102))
    assert by[None].lang_pred == "en" and not by[None].held_out
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None))).collect()} == {"und"}
