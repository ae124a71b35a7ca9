"""Language identification by nearest centroids.

A text is a vector of hashed byte three-grams (ASCII letters lowered, other ASCII characters blank), weighted by
log(1 + count) times inverse document frequency and scaled to length one.  Each language has several centroids, found by
spherical k-means over its training texts, and a text gets the language of the centroid with the largest cosine.  A text further
from that centroid than nearly all training texts of the language are (``reject_quantile``) is marked as rejected.

Training uses a bounded sample: per language the ``per_lang`` training documents with the smallest hash, spread over
``SALTS`` groups, and ``most_docs`` altogether.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, texts

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
SALTS = 50
UNKNOWN = "und"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class LanguageRules:
    per_lang: int = 600
    most_docs: int = 8000
    centroids: int = 4
    rounds: int = 12
    reject_quantile: float = 0.002
    folds: int = 3
    held_fold: int = 1


@dataclass(frozen=True)
class Centroids:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    matrix: np.ndarray
    floor: np.ndarray  # least cosine that is not rejected, of each centroid

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each row; ties go to the first."""
        cosine = unit(tf * self.idf) @ self.matrix.T
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def frequencies(text: bytes) -> np.ndarray:
    """log(1 + count) of the hashed three-grams of a whole text."""
    padded = b" " + text.translate(_TABLE) + b" "
    b = np.frombuffer(padded, np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    return np.log1p(np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)).astype(np.float32)


def held_out(doc_id: Column, rules: LanguageRules = LanguageRules()) -> Column:
    """Whether a document belongs to the fold that is never learned from; one without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % rules.folds == rules.held_fold, F.lit(False))


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from the mean outward: each further start is the row least like all before."""
    centre = unit(x.mean(0, keepdims=True))
    starts = [int((x @ centre[0]).argmax())]
    while len(starts) < min(k, len(x)):
        starts.append(int((x @ x[starts].T).max(1).argmin()))
    centres = x[starts]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def train(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> Centroids | None:
    """Fit on the training fold of ``docs(doc_id, text, lang)``; None if no document can be learned from."""
    usable = texts(docs, F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), rules)
    )
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    few = ids.withColumn("r", rank).where(F.col("r") <= -(-rules.per_lang // SALTS)).orderBy("r", "h").limit(rules.most_docs)
    chosen = usable.join(F.broadcast(few.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("tf", pa.binary())])

    def vectors(batch):
        text = batch.column("text").cast(pa.binary()).to_pylist()
        rows = [(i, g, frequencies(t).astype("<f2").tobytes()) for i, g, t in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), text) if has_letter(t.decode())]
        if rows:
            yield record(schema, *zip(*rows))

    sample = sorted(map(tuple, map_batches(chosen, vectors, "doc_id long, lang string, tf binary").collect()))
    if not sample:
        return None
    tf = np.frombuffer(b"".join(r[2] for r in sample), "<f2").reshape(len(sample), BUCKETS).astype(np.float32)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x, of = unit(tf * idf), np.array([r[1] for r in sample])
    langs, parts, floors = [], [], []
    for lang in sorted(set(of)):
        own = x[of == lang]
        centres = _clusters(own, rules.centroids, rules.rounds)
        langs += [str(lang)] * len(centres)
        parts.append(centres)
        floors += [float(np.quantile((own @ centres.T).max(1), rules.reject_quantile))] * len(centres)
    return Centroids(langs, idf, np.concatenate(parts).astype(np.float32), np.array(floors))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Centroids | None, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each row of ``docs``.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is every text if there is no model.  Repeated
    rows give repeated results, a null ``doc_id`` stays null and is not held out, an empty table gives no rows; other columns than
    ``doc_id`` and ``text`` are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            text = part.column("text").to_pylist()
            lang, score, rejected = [UNKNOWN] * len(text), [0.0] * len(text), [True] * len(text)
            known = [i for i, t in enumerate(text) if model and t and has_letter(t)]
            if known:
                best, cosine = model.nearest(np.stack([frequencies(text[i].encode()) for i in known]))
                for i, b, c in zip(known, best, cosine):
                    lang[i], score[i], rejected[i] = model.langs[b], float(c), bool(c < model.floor[b])
            yield record(schema, part.column("doc_id"), part.column("held_out"), lang, score, rejected)

    return map_batches(texts(docs, held_out(F.col("doc_id"), rules).alias("held_out")), run, SCHEMA)


def identify(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """Train on the training fold of ``docs``, then predict every row."""
    return predict(docs, train(docs, rules), rules)
