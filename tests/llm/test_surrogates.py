import re

from pyspark.sql import functions as F

from tracewell.llm import surrogates as P


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_entities int, kind string")
    out = P.pseudonymise(df)
    assert out.columns == ["doc_id", "text", "kind", "n_entities"]
    return {r.doc_id: r for r in out.collect()}


def test_types_formats_and_coreference(spark):
    rows = [
        (1, "Write to Bob.99@corp.example.com, call +1 (974) 555-3436 or 415-555-0199; host 97.51.17.173."),
        (2, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, bad 4111111111111112, ssn 078-05-1120."),
        (3, "bob.99@CORP.example.com again +1 974 555-3436."),
        (4, "Mrs. Anna Keller met Herr Weber and ANNA KELLER; Frau Keller left. Госпожа Елена Петрова и Иван Сидоров."),
        (5, "The version 1.2.3 of 2024-01-01 has 12,345 items; Anna came, a@b is none, 12345678 too."),
        (6, None), (7, ""), (None, "from 97.51.17.173"),
    ]
    got = run(spark, rows)
    mail, phone, other, host = re.fullmatch(r"Write to (\S+), call (.+) or (\S+); host (\S+)\.", got[1].text).groups()
    assert re.fullmatch(r"[a-z]{3}\.\d\d@mail\d+\.example\.(com|net|org)", mail) and mail != "bob.99@corp.example.com"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (974) 555-3436" and re.fullmatch(r"4\d\d-\d{3}-\d{4}", other)
    assert host.startswith("10.") and got[None].text == f"from {host}"
    assert got[3].text.startswith(mail) and re.sub(r"\D", "", got[3].text[len(mail):]) == re.sub(r"\D", "", phone)
    a, b, c, s = re.fullmatch(r"Card (.{19}) and (.{19}), bad (\d{16}), ssn (\d{3}-\d\d-\d{4})\.", got[2].text).groups()
    assert a.replace(" ", "") == b.replace("-", "") and luhn(a.replace(" ", "")) and not luhn(c) and s[0] == "9" and a[0] == "4"
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+) and (\w+) (\w+); Frau (\w+) left\. Госпожа (\w+) (\w+) и (\w+) (\w+)\.", got[4].text)
    anna, keller, weber, upper_anna, upper_keller, again, elena, petrova, ivan, sidorov = m.groups()
    assert anna != "Anna" and (upper_anna, upper_keller) == (anna.upper(), keller.upper()) and keller == again != weber and keller not in ("Keller", "Weber")
    assert elena.lower() in [n.lower() for n in P.GIVEN["f", "cyrillic"]] or elena.endswith("а")
    assert petrova.endswith("ова") and sidorov.endswith("ов") and all(re.fullmatch("[А-Яа-я]+", x) for x in (elena, petrova, ivan, sidorov))
    assert got[5].text == rows[4][1] and got[5].n_entities == 0
    assert (got[6].text, got[7].text) == (None, "")
    assert got == run(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.pseudonymise(none).count() == 0


def test_redraws_keep_replacements_apart(spark):
    # Far more given names than the list has: all known ones, and all of them are taken by real entities.
    names = [("given", n.lower()) for group in P.GIVEN.values() for n in group]
    hosts = [("ipv4", f"10.{a}.{b}.{c}") for a in range(4) for b in range(30) for c in range(1, 12)]
    phones = [("phone", f"1{k:03d}") for k in range(150)]
    entities = spark.createDataFrame(names + hosts + phones + names, "kind string, plain string")
    got = P.surrogates(entities).collect()
    assert len(got) == len(set(names + hosts + phones))
    assert len({(r.kind, r.surrogate) for r in got}) == len(got)
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.plain) for r in got}
    again = P.surrogates(entities.repartition(3)).collect()
    assert sorted(got) == sorted(again)
    other = P.surrogates(entities, P.SurrogateRules(key="another"))
    assert other.join(spark.createDataFrame(got), ["kind", "plain", "surrogate"]).count() < len(got) / 10


def test_replaced_text_has_no_entity_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.select(F.explode(F.regexp_extract_all("text", F.lit(P.PATTERN), F.lit(0))).alias("v")).distinct()
    after = P.pseudonymise(docs).select(F.explode(F.regexp_extract_all("text", F.lit(P.PATTERN), F.lit(0))).alias("v")).distinct()
    assert before.count() > 10 and before.join(after, "v").count() == 0 and after.count() == before.count()


def test_bare_mentions_titles_and_number_forms(spark):
    rows = [
        (1, "Mr Robert Smith came. Smith said that ROBERT, Smith's friend, and Mr. J. Smith left."),
        (2, "Frau Keller left. Keller said: Herr Prof. Dr. Weber-Lang and Dr. Novak agree; Lang nodded."),
        (3, "Call 01 23 45 67 89, +33 1 23 45 67 89, +41791234567 or +1 9745553436; card 3782 822463 10005."),
        (4, "Robert and Keller without any title; smith too. On 2024-01-01 12 34 56 things."),
        (5, "John Robert Miller wrote; Miller's letter. Señora Ana de la Cruz, Cruz."),
        (6, "Dr Smith, Robert@corp.example.com"),
    ]
    got = run(spark, rows)
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) said that (\w+), (\w+)'s friend, and Mr\. J\. (\w+) left\.", got[1].text)
    robert, smith, *rest = m.groups()
    assert rest == [smith, robert.upper(), smith, smith] and robert != "Robert" and smith != "Smith" and got[1].n_entities == 6
    m = re.fullmatch(r"Frau (\w+) left\. (\w+) said: Herr Prof\. Dr\. (\w+)-(\w+) and Dr\. (\w+) agree; (\w+) nodded\.", got[2].text)
    keller, bare, weber, lang, novak, again = m.groups()
    assert keller == bare and lang == again and not {keller, weber, lang, novak} & {"Keller", "Weber", "Lang", "Novak"}
    m = re.fullmatch(r"Call (0\d(?: \d\d){4}), (\+3\d \d(?: \d\d){4}), (\+4\d{10}) or (\+1 \d{10}); card (3\d{3} \d{6} \d{5})\.", got[3].text)
    assert got[3].n_entities == 5 and not set(m.groups()) & set(re.findall(r"\+?\d[\d ]+\d", rows[2][1])) and luhn(m[5].replace(" ", ""))
    assert got[4].text == rows[3][1] and got[4].n_entities == 0
    m = re.fullmatch(r"(\w+) (\w+) (\w+) wrote; (\w+)'s letter\. Señora (\w+) de la (\w+), (\w+)\.", got[5].text)
    assert m[2] == robert and m[3] == m[4] != "Miller" and m[6] == m[7] != "Cruz" and m[1] != "John" and m[5] != "Ana"
    assert got[6].text.startswith(f"Dr {smith}, ") and "Robert@" not in got[6].text
