import re

import corpus_pipeline as C
import public_tokenizers
import sentencepiece

from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute as simhash_groups
from tracewell.llm import decontaminate as D
from tracewell.llm import line_quality as Q
from tracewell.llm import simhash as S

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    field = Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {d: t for d, t in texts.items() if Q.verdict((t or "").encode(), field, Q.QualityRules())[6]}
    first = C.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(left)
    fps = {d: S.fingerprint(t.encode()) for d, t in left.items()}
    group = simhash_groups(list(fps.values()))
    smallest = {}
    for d in sorted(left):
        smallest.setdefault(group[fps[d]], d)
    second = C.near_duplicates(spark, docs.where(docs.doc_id.isin(list(left))), SF)
    left = {d: t for d, t in left.items() if d in smallest.values()}
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(left)
    items = [D.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(D.Pattern(i, 10).distance(D.plain(t)) <= len(i) // 10 for i in items if set(i.split()) & set(D.plain(t).split()))}
    masked = {}
    for d, t in left.items():
        for s, _, e in reversed(secret_spans(t)[0]):
            t = t[:s] + "\0" * (e - s) + t[e:]
        masked[d] = re.sub("\0+", "[SECRET]", t)
    out = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert set(out) == set(left)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, t in masked.items():
        assert out[d].ids == lib.encode(t) and out[d].round_trip and out[d].n_pieces == len(out[d].ids)


def test_stages_keep_odd_rows_and_columns(spark):
    good = "One clear line about the hills and the rivers of this country, with birds over it.\nAnother tells of towns by the sea."
    rows = [(1, good, "x", 1), (1, good, "x", 1), (None, good + " More here.", "y", 2), (2, None, "z", 3), (3, "", "", None), (4, "short", "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_chars int")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "found", "n_chars"]
    got = docs.collect()
    assert sorted((r.doc_id is None, r.found) for r in got) == [(False, "x"), (True, "y")]
    assert all(r.n_chars == len(r.text) for r in got)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0
