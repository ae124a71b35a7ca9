"""Spelling variants: words one edit apart, found by pivotal grams.

Every word has its bigrams ordered from rare to common.  Its prefix is the three rarest (and all places of the third one's bigram):
one edit destroys two bigrams at most, so two words one edit apart share a prefix bigram.  Of the prefix, dynamic programming picks
two disjoint bigrams of least total frequency as pivots; one edit leaves at least one of them whole.  Of two close words, take the
one whose prefix ends earlier in the order: each of its pivots that the edit leaves whole is in the prefix of the other.  So pivots
are joined with prefixes only.

The position limit is used as an equality.  An edit right of a bigram leaves all that is left of it, so the bigram keeps its place
and the words agree up to its end; an edit left of it leaves the rest of the word.  With pivots at p < q three keys see every edit:
right of q, left of q, and on q itself, which lies right of p (or the mirror image, whichever has the longer third key).  Pairs that
meet under a key are verified by their edit distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, texts
from tracewell.session import store

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of (document, word) whose word loses a code point, as contracted.
DAMAGE = 199
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
#: Occurrences grow by RATIO with every form, so a chain of forms in 64-bit counts is shorter than 2 ** ROUNDS.
ROUNDS = 5
KEYS = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("word", pa.string()), ("pivot", pa.bool_()), ("key", pa.int64())])
#: Most prefix keys of a word that they carry with them.
CARRIED = 64
#: Of the hashes of beginnings and ends of words.
BASE, MODULUS = 1_000_003, 2**61 - 1


def damaged(run: Column, doc_id: Column) -> Column:
    """The run, without one code point where the checksum of ``<doc_id>:<run>`` is a multiple of DAMAGE (a null id: empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """``word, n``: runs of letters of all texts after the damage, long and frequent enough."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({LETTERS})"), 1))
    runs = texts(docs).select("doc_id", run.alias("run")).where(F.char_length("run") >= least_length)
    words = runs.select(damaged(F.col("run"), F.col("doc_id")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def pivots(places: list[tuple[int, str, int]]) -> tuple[int, int]:
    """Positions of the two disjoint bigrams of least total frequency among ``(frequency, gram, position)``.

    From left to right: the best single bigram that ends before the current one, then the best pair.  Ties go to the left.
    """
    at = sorted((i, f) for f, _, i in places)
    single: tuple[int, int] | None = None
    best: tuple[int, int, int] | None = None
    waiting = 0
    for i, f in at:
        while at[waiting][0] <= i - 2:
            j, g = at[waiting]
            single = min(single or (g, j), (g, j))
            waiting += 1
        if single and (best is None or single[0] + f < best[0]):
            best = single[0] + f, single[1], i
    assert best is not None
    return best[1], best[2]


def _running(codes: Iterable[int]) -> list[int]:
    """Polynomial hashes of every beginning of a sequence."""
    h, out = 0, [0]
    for c in codes:
        h = (h * BASE + c) % MODULUS
        out.append(h)
    return out


def gram_keys(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """Keys of the pivots and keys of the prefix: hashes of the word up to the end of a bigram (even), and from it on (odd).

    Work and size are in proportion to the word, however often it repeats a bigram; equal hashes of other strings only add pairs to
    verify.
    """
    order = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    prefix = [x for x in order if x[:2] <= order[2][:2]]
    p, q = pivots(prefix)
    codes = [ord(c) for c in word]
    starts, ends = _running(codes), _running(reversed(codes))
    left, right = (lambda i: 2 * starts[i + 2]), (lambda i: 2 * ends[len(word) - i] + 1)
    chosen = [left(q), right(q), left(p)] if p + 2 >= len(word) - q else [left(p), right(p), right(q)]
    return chosen, [side(i) for _, _, i in prefix for side in (left, right)]


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for every two rows of ``words(id, word, n)`` that differ by one code point, both ways round.

    A word has three letters or more.  The alphabet has 90 letters after lower-casing, so the table of bigram frequencies has 8,100
    rows at most.  Prefix keys carry their word, so a pair is verified where it meets; only a word that repeats a bigram can have more
    than CARRIED keys, and of such a word they carry the id alone and the pairs that meet fetch it.
    """

    def count(batch):
        n = Counter(g for word in batch.column("word").to_pylist() for g in map("".join, zip(word, word[1:])))
        yield record(pa.schema([("g", pa.string()), ("n", pa.int64())]), list(n), list(n.values()))

    grams = map_batches(words.select("word"), count, "g string, n long")
    frequency = {r.g: r.n for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}

    def run(batch):
        out: tuple[list, ...] = ([], [], [], [], [])
        for at, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            for pivot, keys in zip((True, False), gram_keys(word, frequency)):
                carried = word if len(keys) <= CARRIED else None
                for key in keys:
                    for column, value in zip(out, (at, len(word), carried, pivot, key)):
                        column.append(value)
        yield record(KEYS, *out)

    keys = map_batches(words.select("id", "word"), run, "id long, length int, word string, pivot boolean, key long")
    a = keys.where("pivot").select("key", F.col("id").alias("a"), F.col("length").alias("a_length"), F.col("word").alias("a_word"))
    b = keys.where("not pivot").select("key", "id", F.col("length").alias("b_length"), F.col("word").alias("b_word"))
    apart = (F.col("a") != F.col("id")) & (F.col("a_length") - F.col("b_length")).between(-1, 1)
    close = F.levenshtein("a_word", "b_word", 1) == 1
    met = a.join(b.where("b_word is not null"), "key").where(apart & close).select("a_word", "b_word")
    far = a.join(b.where("b_word is null").drop("b_word"), "key").where(apart).select("a_word", "id")
    found = met.unionByName(far.join(words.select("id", F.col("word").alias("b_word")), "id").where(close).select("a_word", "b_word"))
    both = F.explode(F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near")), F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"))))
    pairs = found.select(both.alias("p")).select("p.*").distinct()
    return pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").join(words.select("word", "n"), "word")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``forms(word, form)``: the last word of its chain, by doubling the steps ROUNDS times."""
    reach = store(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reach = store(reach.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return reach


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of the whole texts.

    ``form`` is the near word with most occurrences (ties: smallest in code-point order) if it has RATIO times those of the word,
    else null; ``root`` is where the forms lead to.  A null or empty text has no words; repeated rows count each; a null ``doc_id``
    is an empty string to the checksum; an empty table gives no rows.
    """
    words = store(vocabulary(docs, max(4, least_length), least_n).withColumn("id", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    table = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    holds = -F.col("best.m") >= RATIO * F.col("n")
    table = store(table.select("word", "n", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n")))
    chain = roots(table.where("form is not null").select("word", "form"))
    return table.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
