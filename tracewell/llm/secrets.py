"""Secret scans with DataFrame functions only.

Fixed patterns find assigned values, access keys and hex runs.  The method adds runs of token characters that a first-order
Markov model of random strings explains better than one of ordinary identifiers: the log-likelihood ratio of the run is the sum
over its neighbouring characters, and a run above ``min_ratio`` is a span of kind ``markov``.

Both models are counted from labelled samples: the values of fixed-pattern matches stand for random strings, all other runs of
token characters for ordinary ones, in the ``train_docs`` documents with the smallest hash (a bounded sample).  Counts are
smoothed: the random model half with the uniform one, so that without any match it is uniform, the ordinary one with the
frequencies of single characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import texts

# Fixed values of the rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Weight, in counts, of single characters in the ordinary model.
BACK_OFF = 5.0
RUN = "[A-Za-z0-9+/_=-]"


@dataclass(frozen=True)
class SecretRules:
    train_docs: int = 2000
    min_run: int = 16
    min_distinct: int = 8
    min_ratio: float = 10.0
    mask: str = "[SECRET]"


def located(text: Column, pattern: str, value: int = 0) -> Column:
    """``array<struct<s, e, v>>``: start, end (code points, end exclusive) and group ``value`` of each match, left to right.

    Matches lie between the pieces that ``split`` leaves, so their places are running lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = whole if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    gaps, sizes = F.transform(F.split(text, pattern, -1), F.length), F.transform(whole, F.length)
    parts = F.arrays_zip(gaps, sizes, inner).cast("array<struct<gap:int,size:int,v:string>>")
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    walked = F.aggregate(
        F.filter(parts, lambda p: p["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + p["gap"]).alias("s"), (acc["at"] + p["gap"] + p["size"]).alias("e"), p["v"].alias("v"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_matches(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays ``assign``, ``access`` and ``hex``."""
    text = F.col("text")
    found = docs.withColumns({"assign": located(text, ASSIGN, 2), "access": located(text, ACCESS), "hex": located(text, HEX)})
    return found.withColumn("assign", F.filter("assign", lambda m: F.length(m["v"]) >= MIN_ASSIGN))


def _whole(docs: DataFrame, *more: str) -> DataFrame:
    return texts(docs, *more).withColumn("text", F.coalesce("text", F.lit("")))


def _pairs(runs: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in the column ``run``, by class."""
    at = F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i")
    split = runs.where("length(run) > 1").select("random", "run", at)
    a, b = (F.instr(F.lit(ALPHABET), F.substring("run", F.col("i") + k, 1)) for k in (0, 1))
    return split.select("random", a.alias("a"), b.alias("b")).where("a > 0 and b > 0").groupBy("random", "a", "b").count()


def train(docs: DataFrame, rules: SecretRules = SecretRules()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row of the alphabet (65 x 65 values)."""
    own = texts(docs).where("doc_id is not null")
    ids = own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_docs)
    sample = _whole(own.join(F.broadcast(ids.distinct()), "doc_id", "left_semi"))
    values = base_matches(sample).select(F.explode(F.transform(F.concat("assign", "access", "hex"), lambda m: m["v"])).alias("run"), F.lit(True).alias("random"))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    runs = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(RUN + "{6,}"), F.lit(0))).alias("run"), F.lit(False).alias("random"))
    size = len(ALPHABET)
    letters = F.explode(F.sequence(F.lit(1), F.lit(size)))
    grid = docs.sparkSession.range(1).select(letters.alias("a")).select("a", letters.alias("b"))
    counts = _pairs(values.unionByName(runs)).groupBy("a", "b").agg(
        F.sum(F.when(F.col("random"), F.col("count"))).alias("r"), F.sum(F.when(~F.col("random"), F.col("count"))).alias("o")
    )
    full = grid.join(counts, ["a", "b"], "left").na.fill(0)
    sums = full.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    single = full.groupBy("b").agg(F.sum("o").alias("bs"))
    total = full.agg(F.sum("o").alias("all"))
    random = 0.5 * (F.col("r") + 1) / (F.col("rs") + size) + 0.5 / size
    letter = (F.col("bs") + 0.5) / (F.col("all") + 0.5 * size)
    ordinary = (F.col("o") + BACK_OFF * letter) / (F.col("os") + BACK_OFF)
    table = full.join(sums, "a").join(single, "b").crossJoin(F.broadcast(total)).select("a", "b", F.log(random / ordinary).alias("ratio")).orderBy("a", "b").collect()
    return [round(r.ratio, 4) for r in table]


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a run of alphabet characters: above zero speaks for a random string."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    letter = lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i, 1)) - 1
    pair = lambda acc, i: acc + F.get(weights, letter(i) * len(ALPHABET) + letter(i + 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(run) - 1), F.lit(0.0), pair)


def with_spans(docs: DataFrame, model: list[float], rules: SecretRules = SecretRules()) -> DataFrame:
    """``docs`` (``text`` not null) with ``base`` and ``found``: spans ``struct<s, k, e>`` by start, then kind."""
    found = base_matches(docs).withColumn("markov", located(F.col("text"), f"{RUN}{{{rules.min_run},}}"))
    found = found.withColumn(
        "markov",
        F.filter(
            "markov",
            lambda m: (F.size(F.array_distinct(F.split(m["v"], ""))) >= rules.min_distinct) & (ratio(m["v"], model) >= rules.min_ratio),
        ),
    )

    def of_kind(kind):
        return F.transform(kind, lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), m["e"].alias("e")))

    def spans(kinds):
        return F.array_sort(F.concat(*map(of_kind, kinds)))

    return found.withColumns({"base": spans(KINDS[:3]), "found": spans(KINDS)})


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"], s["e"])), ",")


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), model: list[float] | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov`` of each row of ``docs``; trains if no model is given.

    A null text counts as empty and has no span.  A run found by a fixed pattern may be a ``markov`` span too.  Repeated rows give
    repeated results, a null ``doc_id`` stays null, an empty table gives no rows, other columns are ignored.
    """
    found = with_spans(_whole(docs), model or train(docs, rules), rules)
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *sizes[:3], F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"), sizes[3])


def redact(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``rules.mask``; overlapping spans give one mask.

    Rows without a span, also those with a null text, stay as they are; the columns stay the same, whatever their names.
    """
    model = train(docs, rules)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    hull = F.aggregate(
        "found",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    found = with_spans(packed, model, rules).withColumn("hull", F.when(F.size("found") > 0, hull))
    starts = F.concat(F.array(F.lit(0)), F.transform("hull", lambda x: x["e"]))
    ends = F.concat(F.transform("hull", lambda x: x["s"]), F.array(F.length("text")))
    kept = F.zip_with(starts, ends, lambda s, e: F.substring(F.col("text"), s + 1, e - s))
    masked = F.when(F.col("hull").isNotNull(), F.array_join(kept, rules.mask)).otherwise(F.col("row")["text"])
    return found.select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
