import hashlib
import random
import re

from tracewell.llm import secrets as S

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort()
    return out, ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in out)


def corpus():
    rnd = random.Random(7)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    any64 = lambda n: "".join(rnd.choice(S.ALPHABET[:64]) for _ in range(n))
    parts = ["token = \"", "PassWord:", "api_key='", "secret=", "the thing ", "é漢🎉 ", "\n", " ", "international_configuration", "AKIA", "apikey :  "]
    texts = []
    for _ in range(150):
        t = ""
        for _ in range(rnd.randint(0, 12)):
            t += rnd.choice(parts + [hexa(rnd.randint(5, 40)), any64(rnd.randint(5, 30)), "ABCDEF0123456789" * rnd.randint(0, 2)])
        texts.append(t)
    return texts + ["ordinary words of a longer sentence about understanding configuration_settings_of_machines " * 3] * 40


def test_spans_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "token=abcdefghijklmnop"), (900, None), (901, ""), (900, None)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, base string, hex int")
    got = {(r.doc_id, r.base_sha256): r for r in S.scan(df).collect()}
    for d, t in rows:
        spans, text = brute(t or "")
        r = got[d, hashlib.sha256(text.encode()).hexdigest()]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("markov")) == text
    assert S.scan(df.limit(0)).count() == 0


def test_ratio_finds_random_strings_and_spares_words(spark):
    random_text = "see Zk3vQ9xT7bLw2RfY8pNc for it"
    plain = "the understanding_of_international_configuration of ---------------------------- lines"
    docs = [(i, f"we use token = \"{hashlib.md5(str(i).encode()).hexdigest()}\" for the understanding of configuration") for i in range(60)]
    model = S.train(spark.createDataFrame(docs, "doc_id long, text string"))
    df = spark.createDataFrame([(100, random_text), (101, plain)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.scan(df, model=model).collect()}
    assert got[100] == "markov:4:24" and got[101] == ""


def test_redaction(spark):
    rows = [(1, "a token=abcdefghijklmnop b", 5), (2, None, 0), (3, "clean é text", 1), (4, "x 0123456789abcdef0123 y deadbeefdeadbeef00 é", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = {r.doc_id: r.text for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns
    assert got == {1: "a [SECRET] b", 2: None, 3: "clean é text", 4: "x [SECRET] y [SECRET] é"}
