import random

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tracewell.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "Hello", "tion", "er", "é", "漢字", "🎉", "\n", " ", "  ", " " * 17, "\t", "<s>", "<0x0A>", "123", "...", "x", "überall", "qu", "ing", "un", "re"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_bpe_equals_the_library(spark):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), P.load("piece_bpe_32k.model")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect() if r.text]
    texts = random_texts(1500, 1) + docs
    assert split(*own.encode(texts)) == [lib.encode(t) for t in texts]
    assert all(own.decode(lib.encode(t)) == t for t in texts)


def unigram():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = P.UNIGRAM
    for p in model.pieces:
        if p.score == -1e9:
            p.score = -40000.0
    return model.SerializeToString()


def test_unigram_equals_brute_force_and_the_library():
    proto = unigram()
    own, lib = P.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    words = [t for t in random_texts(400, 2) if t]
    for text, ids in zip(words, split(*own.encode(words))):
        assert ids == lib.encode(text), text
    for word in {w[:9] for t in words for w in P.WORD.findall(P.MARK + t.replace(" ", P.MARK))}:
        # Best score over all ways to cut the word.
        best = max(
            sum(own.score.get(x, own.floor if len(x) == 1 else float("-inf")) for x in cut)
            for cut in ([word[a:b] for a, b in zip([0, *at], [*at, len(word)])] for at in ([i for i in range(1, len(word)) if m >> i & 1] for m in range(0, 2 ** len(word), 2)))
        )
        ((_, ids),) = own.encode_words([word])
        got = sum(own.score[p] for i in ids if (p := next((p for p, k in own.id.items() if k == i), None))) + own.floor * sum(c not in own.score for c in word)
        assert abs(got - best) < 1e-6, word


def test_prefixes_are_shared_rightly():
    own = P.Pieces(open(PATH, "rb").read())
    words = [P.MARK + w for w in ["a", "an", "ant", "anti", "antibody", "ants", "b", "banana", "band", "bandana", "bandanas"]]
    for word, ids in own.encode_words(words):
        ((_, alone),) = P.Pieces(open(PATH, "rb").read()).encode_words([word])
        assert ids == alone


def test_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "a  b"), (2, None), (3, ""), (4, "one ▁ mark"), (5, "long " * 30000)]
    df = spark.createDataFrame([(d, t, [1], "x") for d, t in rows], "doc_id long, text string, ids array<int>, decoded string")
    out = P.piece_digest(df)
    assert out.columns == ["doc_id", "n_pieces", "ids_sha256", "round_trip"]
    got = sorted(((r.doc_id, r.n_pieces, r.round_trip) for r in out.collect()), key=str)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got == sorted([(d, len(lib.encode(t or "")), d != 4) for d, t in rows], key=str)
    assert P.piece_digest(df.limit(0)).count() == 0
    coded = P.decode(P.encode(df))
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(((r.doc_id, r.decoded) for r in coded.collect()), key=str) == sorted([(d, (t or "").replace("▁", " ")) for d, t in rows], key=str)
