"""Surrogates for personal data with DataFrame functions only.

Detected entities are e-mail addresses, phone, card and social security numbers, IPv4 addresses and names: chains of capitalised
words after a title or from a known given name on.  The words of a text's chains are replaced wherever they stand capitalised in
that text.  Each distinct entity of the whole table gets one replacement that a keyed hash draws:

* numbers keep their length, first digit, separators and - cards - whether the check digit is right; US social security numbers
  move to areas that are never issued, addresses to 10.0.0.0/8 first;
* e-mail addresses keep the shape of the local part and move to reserved domains;
* names keep gender, script and capitals.

Entities are compared without separators and case, so all spellings share one replacement (coreference).  A replacement that
another entity of the kind draws too, or that is itself an entity of the table, is drawn anew until none is left (distinctness);
each further draw comes from a larger space, and only a count reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import store

# Fixed word lists: titles, given names by gender, syllables of invented names by script.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "Mlle", "господин",
    "госпожа", "г-н", "г-жа", "κύριος", "κυρία", "Dr", "Dra", "Doctor", "Doctora", "Doktor", "Docteur", "Prof", "Professor",
    "Professorin", "Professeur", "Profesor", "Profesora", "Mx", "Sir", "Dame", "Lady", "Lord", "Rev", "Herrn", "Fräulein", "Don", "Doña",
    "доктор", "профессор", "проф", "д-р", "κύριε", "κυρίου", "κυρίας", "δρ", "καθηγητής", "καθηγήτρια",
)
GIVEN = {
    ("f", "latin"): ("Anna", "Maria", "Laura", "Julia", "Emma", "Sophie", "Claire", "Elena", "Lucia", "Carmen", "Sarah", "Emily", "Olivia", "Marie", "Ursula", "Alice"),
    ("m", "latin"): ("John", "James", "Peter", "Paul", "Thomas", "Michael", "David", "Daniel", "Martin", "Hans", "Karl", "Pierre", "Jean", "Luis", "Carlos", "Pedro"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Светлана"),
    ("m", "cyrillic"): ("Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης"),
}
SYLLABLES = {
    "latin": ("bar", "ce", "dan", "el", "fo", "gri", "ha", "jol", "ka", "lin", "mo", "nes", "or", "pel", "ri", "sol", "ta", "ul", "ven", "wi"),
    "cyrillic": ("ба", "вел", "гор", "да", "зин", "кар", "ле", "мо", "нов", "пет", "ра", "сол", "ти", "фед", "чер", "яр"),
    "greek": ("βα", "γε", "δη", "θε", "κα", "λι", "μα", "νι", "πα", "ρο", "σι", "τα", "φι", "χα"),
}
GIVEN_ENDS = {("f", "latin"): "a", ("m", "latin"): "on", ("f", "cyrillic"): "а", ("m", "cyrillic"): "ен", ("f", "greek"): "α", ("m", "greek"): "ος"}
SURNAME_ENDS = {("f", "latin"): "er", ("m", "latin"): "er", ("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("f", "greek"): "ου", ("m", "greek"): "ης"}
DOMAINS = ("example.com", "example.net", "example.org")

KINDS = ("email", "ipv4", "card", "ssn", "phone", "given", "surname")
_NAMES = f"(?iu:{'|'.join(n for names in GIVEN.values() for n in names)})"
#: Titles as listed, capitalised and in capitals.
_TITLES = rf"(?:{'|'.join(sorted({f for t in TITLES for f in (t, t[0].upper() + t[1:], t.upper())}, reverse=True))})(?![\p{{L}}\p{{M}}])"
_STARTS = "".join(sorted({f for t in TITLES for f in (t[0], t[0].upper())}))
#: A capitalised word, anywhere and as a part of a name; what stands between two parts.
_CAPITAL = r"(?<![\p{L}\p{M}])\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+"
_WORD = rf"(?!{_TITLES}){_CAPITAL}"
_NEXT = r"(?:-|\x20(?:\p{Lu}\.\x20?)*(?:(?:von|van|vom|zu|der|den|de|del|la|las|los|le|du|di|da|dos)\x20){0,3})"
_NUMBERS = (
    r"(?<![\p{L}\p{N}._%+-])(?=[\p{L}\p{N}])[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    r"(?=\d)(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    r"(?=\d)(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    r"(?=\d)(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
    r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?=[\d+(])(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)",
    r"(?=\+)(?<![\d+(])\+(?:\d{7,15}|\d{1,3}[ .-]\d{6,12})(?!\d)",
    r"(?=[\d+])(?<![\d+(])(?<!\d[.-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,2}|0\d)(?:[ .-]\d{2}){4}(?!\d)",
)
CHAINS = (
    rf"(?=[{_STARTS}])(?<![\p{{L}}\p{{M}}-]){_TITLES}\.?\x20(?:\p{{Lu}}\.\x20?)*(?:(?:von|van|de|del|la|le|du|di|da)\x20){{0,3}}{_WORD}(?:{_NEXT}{_WORD})*"
    rf"|(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}]){_NAMES}(?![\p{{L}}\p{{M}}])(?:{_NEXT}{_WORD})+"
)
PATTERN = "|".join((*_NUMBERS, CHAINS))
#: What can be replaced: the numbers and addresses, and capitalised words, of which only the words of chains are taken.
TOKENS = "|".join((*_NUMBERS, _CAPITAL))


@dataclass(frozen=True)
class SurrogateRules:
    key: str = "tracewell"
    rounds: int = 60


def kind_of(value: Column, given_names: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    given = F.lower(value).isin([n.lower() for names in GIVEN.values() for n in names]) | F.array_contains(given_names, F.lower(value))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d{4}[ -]?\d{4}") & (F.length(digits) >= 13), "card")
        .when(value.rlike(r"^[\d+(]"), "phone")
        .when(given, "given")
        .otherwise("surname")
    )


def plain_of(kind: Column, value: Column) -> Column:
    """The entity without separators and case."""
    return F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(value, r"\D", "")).otherwise(F.lower(value))


def _byte(digest: Column, i: Column | int) -> Column:
    """i-th byte (from 0) of a hex digest of 64 bytes, again from the start beyond its end."""
    return F.conv(F.substring(digest, 2 * (i % 64) + 1 if isinstance(i, Column) else F.lit(2 * (i % 64) + 1), F.lit(2)), 16, 10).cast("int")


def _each(text: Column, fn) -> Column:
    """``fn(character, index from 0)`` over a non-empty string, joined."""
    return F.array_join(F.transform(F.split(text, ""), fn), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check of a card number whose last digit stands at an undoubled place."""
    n = F.length(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda c, i: F.when((n - i) % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _invented(digest: Column, script: str, count: Column) -> Column:
    """``count`` syllables drawn from one script."""
    own = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(own, _byte(digest, i) % len(SYLLABLES[script]))), "")


def _name(kind: Column, plain: Column, digest: Column, attempt: Column) -> Column:
    """Given names: a known one first, then invented ones; surnames are invented.  Later draws have more syllables."""
    out, others = F.lit(None).cast("string"), F.when(F.lit(False), "")
    for (gender, script), names in GIVEN.items():
        if gender == "f":
            surname_gender = plain.rlike("(а|я|ου)$") if script != "latin" else F.lit(False)
        else:
            surname_gender = ~plain.rlike("(а|я|ου)$") if script != "latin" else F.lit(True)
        list_ = F.array(*[F.lit(n.lower()) for n in names])
        known = F.get(list_, _byte(digest, 0) % len(names))
        own = F.concat(_invented(digest, script, 2 + F.floor(attempt / 2).cast("int")), F.lit(GIVEN_ENDS[gender, script]))
        given = F.when(attempt == 0, known).otherwise(own)
        surname = F.concat(_invented(digest, script, 3 + F.floor(attempt / 2).cast("int")), F.lit(SURNAME_ENDS[gender, script]))
        out = F.when((kind == "given") & plain.isin([n.lower() for n in names]), given).when(
            (kind == "surname") & (_script(plain) == script) & surname_gender, surname
        ).otherwise(out)
        # Given names that are not listed have the gender of their ending.
        female = plain.rlike("(a|ah|ia|ette|elle|а|я|α|η)$")
        others = others.when((_script(plain) == script) & (female if gender == "f" else ~female), own)
    return F.when((kind == "given") & out.isNull(), others).otherwise(out)


def draw(kind: Column, plain: Column, attempt: Column, key: str) -> Column:
    """Replacement of an entity: a keyed function of kind, entity and number of the draw, in the form of ``plain``."""
    message = F.concat_ws("\0", kind, plain, attempt.cast("string"))
    digest = F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 256)), 512)
    digit = lambda i: (_byte(digest, i) % 10).cast("string")
    number = _each(plain, lambda c, i: F.when(i == 0, c).otherwise(digit(i)))
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    right = _luhn(plain) % 10 == 0
    card = F.concat(body, F.when(right, check).otherwise((check + 1 + _byte(digest, 63) % 9) % 10).cast("string"))
    ssn = _each(plain, lambda c, i: F.when(i == 0, F.lit("9")).otherwise(digit(i)))
    first = F.when(attempt < 4, F.lit(10)).otherwise(1 + _byte(digest, 9) % 223)
    address = F.concat_ws(".", first, *[_byte(digest, i) for i in (0, 1)], 1 + _byte(digest, 2) % 254)
    letter = lambda c, i: (
        F.when(c.rlike(r"\d"), digit(i)).when(c.rlike(r"\p{L}"), F.char(97 + _byte(digest, i) % 26)).otherwise(c)
    )
    more = F.when(attempt > 0, F.concat(F.lit("."), (_byte(digest, 60) * 256 + _byte(digest, 61)).cast("string"))).otherwise("")
    domain = F.get(F.array(*[F.lit(d) for d in DOMAINS]), _byte(digest, 62) % len(DOMAINS))
    mail = F.concat(_each(F.substring_index(plain, "@", 1), letter), more, F.lit("@mail"), (_byte(digest, 63) % 100).cast("string"), F.lit("."), domain)
    return (
        F.when(kind == "email", mail).when(kind == "ipv4", address).when(kind == "card", card).when(kind == "ssn", ssn)
        .when(kind == "phone", number).otherwise(_name(kind, plain, digest, attempt))
    )


def render(kind: Column, value: Column, surrogate: Column) -> Column:
    """The replacement in the format of one mention: its separators, its capitals."""
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"\D", ""))
    spaced = _each(value, lambda c, i: F.when(c.rlike(r"\d"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c))
    shouted = (value == F.upper(value)) & (value != F.lower(value))
    named = F.when(shouted, F.upper(surrogate)).when(kind == "email", surrogate).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("card", "ssn", "phone"), spaced).when(kind == "ipv4", surrogate).otherwise(named)


def surrogates(entities: DataFrame, rules: SurrogateRules = SurrogateRules()) -> DataFrame:
    """``kind, plain, surrogate`` for distinct ``entities(kind, plain)``: one to one per kind, and never another entity.

    In a round, of all entities with one draw the smallest keeps it, unless it is an entity or was kept before; the rest draw
    again.
    """
    real = store(entities.select("kind", "plain").distinct())
    pending, settled = real.withColumn("attempt", F.lit(0)), None
    for _ in range(rules.rounds):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("plain"), F.col("attempt"), rules.key))
        taken = [real.select("kind", F.col("plain").alias("surrogate"))] + ([settled.select("kind", "surrogate")] if settled is not None else [])
        free = drawn.join(reduce(DataFrame.unionByName, taken).distinct(), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("plain").alias("plain"))
        new = store(first.select("kind", "plain", "surrogate"))
        settled = new if settled is None else settled.unionByName(new)
        pending = store(
            pending.join(new.select("kind", "plain"), ["kind", "plain"], "left_anti").select("kind", "plain", (F.col("attempt") + 1).alias("attempt"))
        )
        if pending.isEmpty():
            return settled
    raise RuntimeError(f"entities without a free replacement after {rules.rounds} draws")


def pseudonymise(docs: DataFrame, rules: SurrogateRules = SurrogateRules()) -> DataFrame:
    """``docs`` with replacements in ``text`` and the column ``n_entities`` (in place of any of that name).

    Texts without an entity, also null ones, stay as they are with ``n_entities`` 0.  The result depends on the text alone, so
    repeated rows and rows with a null ``doc_id`` need no care; all other columns stay, whatever their names; an empty table gives
    no rows.  A name that stands in a text without any title or known given name is not found there.  A word that is a given name
    in any text is one in all, so it has one replacement.
    """
    plain = docs.drop("n_entities")
    names = plain.columns
    packed = plain.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    chains = (
        packed.where(F.col("text").rlike(PATTERN))
        .select("text", F.array_join(every("text", CHAINS), "\n").alias("chains"))
        .select("text", *(F.array_distinct(every("chains", p)).alias(c) for c, p in (("parts", _WORD), ("early", rf"{_WORD}(?=\x20)"))))
        .select("text", *(F.transform(c, F.lower).alias(c) for c in ("parts", "early")))
    )
    token = F.transform(every("text", TOKENS), lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    taken = lambda t: ~t["value"].rlike(rf"^{_CAPITAL}$") | F.array_contains("parts", F.lower(t["value"]))
    mentions = store(
        chains.select(F.md5("text").alias("tid"), F.filter(token, taken).alias("found"), "early").dropDuplicates(["tid"])
    )
    one = mentions.select("tid", "early", F.explode("found").alias("one")).select("tid", "early", "one.at", "one.value")
    one = one.withColumn("kind", kind_of(F.col("value"), F.col("early")))
    one = one.withColumn("plain", plain_of(F.col("kind"), F.col("value"))).withColumn("name", F.col("kind").isin("given", "surname"))
    one = one.withColumn("family", F.when(F.col("name"), "name").otherwise(F.col("kind")))
    real = store(one.groupBy("family", "plain").agg(F.min("kind").alias("kind")))
    given = real.join(surrogates(real, rules), ["kind", "plain"])
    shown = one.drop("kind").join(given, ["family", "plain"]).select(
        "tid", F.struct("at", F.lit(0).alias("old"), render(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")).alias("piece")
    )
    new = shown.groupBy("tid").agg(F.collect_list("piece").alias("new"))
    hit = packed.where(F.col("text").rlike(PATTERN)).withColumn("tid", F.md5("text")).join(new, "tid")
    # Of the old and new forms of one token the new one comes first and stays.
    old = F.transform(every("text", TOKENS), lambda v, i: F.struct(i.alias("at"), F.lit(1).alias("old"), v.alias("new")))
    hit = hit.withColumn("both", F.array_sort(F.concat("new", old)))
    keep = F.filter("both", lambda p, i: (i == 0) | (F.get(F.col("both"), i - 1)["at"] < p["at"]))
    woven = F.zip_with(
        F.split(F.col("text"), TOKENS, -1), F.transform(keep, lambda p: p["new"]), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))
    )
    changed = hit.select("row", F.array_join(woven, "").alias("text"), F.size("new").cast("long").alias("n_entities"))
    rest = packed.where(~F.coalesce(F.col("text").rlike(PATTERN), F.lit(False)))
    both = changed.unionByName(rest.select("row", "text", F.lit(0).cast("long").alias("n_entities")))
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], "n_entities")
