import random

from tracewell.llm.token_counts import BLANK_RUN, TokenRules, count_pieces, count_spliced, load, token_counts

PARTS = ["the", " ", "  ", "\n", "<|endoftext|>", "<|end", "a" * 50, "'s", "'", "123", "é", "漢字", " \n ", "!?", "#" * 20, "\t", "ß", "🎉", " " * 40]


def test_spliced_count_equals_whole_encoding():
    tok, rnd = load("byte_bpe_50k.json"), random.Random(1)
    for _ in range(600):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 120)))
        whole = len(tok.encode(text, add_special_tokens=False))
        assert count_spliced(tok, text, rnd.choice([64, 100, 200]), rnd.choice([8, 40, 60]))[0] == whole


def test_counts_by_pieces_equal_whole_encoding():
    tok, rnd, n = load("byte_bpe_50k.json"), random.Random(4), 0
    for _ in range(3000):
        text = "".join(rnd.choice([*PARTS, " ", " ", "\x1c", "\u00a0", "\u2028"]) for _ in range(rnd.randint(0, 14)))
        if not BLANK_RUN.search(text):
            n += 1
            assert count_pieces("byte_bpe_50k.json", [text]) == [len(tok.encode(text, add_special_tokens=False))], repr(text)
    assert n > 300


def test_overlap_widens_over_one_long_word():
    tok, text = load("byte_bpe_50k.json"), "start " + "x" * 5000 + " end"
    n, chunks = count_spliced(tok, text, 300, 40)
    assert n == len(tok.encode(text, add_special_tokens=False)) and chunks > 5


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "a b", None), (2, None, None), (3, "", ""), (4, "word " * 9000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    tok = load("byte_bpe_50k.json")
    got = sorted(map(tuple, token_counts(df, TokenRules(chunk_chars=1000)).drop("n_chunks").collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0)).count() == 0
