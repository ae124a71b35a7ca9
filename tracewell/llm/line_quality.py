"""Quality rules by line sequence labelling.

A linear-chain conditional random field with the states boilerplate (0) and content (1) labels the lines of a text; the best
sequence comes from Viterbi decoding.  A document is kept if it passes the fixed rules and its content lines hold at least
``min_content`` of the bytes of all its lines with a word.

The field is trained here from document labels: lines of good documents count as content unless they repeat an earlier line or
carry a boilerplate phrase, lines of bad ones as boilerplate.  Training uses a bounded sample (``train_docs`` documents of each
label, smallest hash first, cut into windows of ``window`` lines, ``train_windows`` of them at most).  Without labelled lines of
both kinds no field can be trained and every line counts as content.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, slices, texts

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
PHRASES = re.compile(
    rb"licen[sc]ed? under|all rights reserved|copyright|cookie|terms of (?:use|service)|privacy policy|subscribe|sign in|log in"
    rb"|lizenz|urheberrecht|licence|licencia|derechos reservados|tous droits",
    re.I,
)
FEATURES = (
    "bias", "symbols", "bars", "digits", "upper", "exclaim", "repeats_word", "repeats_line", "phrase", "stop", "long_word", "words",
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_lines long, n_content_lines long, content_share double"
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    min_content: float = 0.5
    train_docs: int = 600
    train_windows: int = 3000
    window: int = 64
    rounds: int = 150
    ridge: float = 1e-3


# ---- base counts -------------------------------------------------------------------------------------------------------------


def _paired(ids: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the distinct pairs (ids[i], ids[i + step])."""
    pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside an eight-word window that occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # Equal windows have equal hashes, so texts without equal hashes are done; the others are compared exactly.
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(factor) + h[step:]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        ids = _paired(ids, step)
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def describe(text: bytes) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features and bytes of the lines with a word."""
    seen: set[bytes] = set()
    words: list[bytes] = []
    rows, lengths, dup = [], [], 0
    for line in text.split(b"\n"):
        w = line.split()
        if not w:
            continue
        words += w
        n = len(line)
        repeated = line in seen
        dup += repeated
        seen.add(line)
        rows.append((
            n, len(w), sum(map(operator.eq, w, w[1:])), repeated, PHRASES.search(line) is not None,
            line.rstrip()[-1] in b".?!:;\"')", len(max(w, key=len)),
        ))
        lengths.append(n)
    continuation = int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    chars = len(text) - continuation - sum(text.count(b) for b in BLANKS)
    symbols = sum(text.count(s) for s in SYMBOLS)
    base = (len(words), chars, symbols, dup, repeated_words(words))
    return base, _features(text, rows), np.array(lengths, np.int64)


_CLASS = np.zeros((5, 256), np.uint8)
_CLASS[0, list(b"#*$%&<>")] = 1
_CLASS[1, list(b"|")] = 1
_CLASS[2, list(b"0123456789")] = 1
_CLASS[3, list(range(65, 91))] = 1
_CLASS[4, list(b"!")] = 1


def _features(text: bytes, rows: list[tuple]) -> np.ndarray:
    if not rows:
        return np.zeros((0, len(FEATURES)))
    raw = np.frombuffer(text + b"\n", np.uint8)
    stops = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    wordless = np.isin(raw, np.frombuffer(BLANKS, np.uint8))
    with_word = np.add.reduceat(~wordless, starts, dtype=np.int64) > 0
    counts = [np.add.reduceat(c[raw], starts, dtype=np.int64)[with_word] for c in _CLASS]
    t = np.array(rows, np.float64)
    n = t[:, 0]
    scale = np.minimum
    return np.column_stack([
        np.ones(len(n)), scale(1, 5 * counts[0] / n), scale(1, 20 * counts[1] / n), scale(1, 5 * counts[2] / n),
        scale(1, 2 * counts[3] / n), scale(1, 20 * counts[4] / n), scale(1, 2 * t[:, 2] / t[:, 1]), t[:, 3], t[:, 4], t[:, 5],
        scale(1, t[:, 6] / 40), scale(1, np.log1p(t[:, 1]) / 5),
    ])


# ---- the conditional random field --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Weights of content against boilerplate, and of each move from state to state."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Best state of each line; ties go to content."""
        if not len(features):
            return np.zeros(0, np.int64)
        gain = (features @ self.weights).tolist()
        (a, b), (c, d) = self.moves.tolist()
        zero, one, came = 0.0, gain[0], []
        for g in gain[1:]:
            to_zero, to_one = c + one >= a + zero, d + one >= b + zero
            came.append((to_zero, to_one))
            zero, one = (c + one if to_zero else a + zero), g + (d + one if to_one else b + zero)
        state = int(one >= zero)
        out = [state]
        for step in reversed(came):
            state = int(step[state])
            out.append(state)
        return np.array(out[::-1], np.int64)


def fit(features: np.ndarray, states: np.ndarray, filled: np.ndarray, rounds: int, ridge: float) -> Field:
    """Maximum likelihood by Adam steps on exact gradients (forward-backward over all windows at once).

    ``features`` is (windows, lines, inputs), ``states`` and ``filled`` (windows, lines); windows are filled from the left.
    """
    n, length, d = features.shape
    weights, moves = np.zeros(d), np.zeros((2, 2))
    lines = filled.sum()
    seen_w = np.einsum("ntd,nt->d", features, states * filled)
    both = filled[:, 1:] & filled[:, :-1]
    seen_m = np.array([[(both & (states[:, :-1] == i) & (states[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    m1, m2 = np.zeros(d + 4), np.zeros(d + 4)
    for step in range(1, rounds + 1):
        score = np.zeros((n, length, 2))
        score[:, :, 1] = features @ weights
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, length):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + score[:, t]
            alpha[:, t] = np.where(filled[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            x = score[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(x[:, 0, None] + moves[:, 0], x[:, 1, None] + moves[:, 1])
            beta[:, t] = np.where(filled[:, t + 1, None], new, 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        content = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * filled
        want_w = np.einsum("ntd,nt->d", features, content)
        x = alpha[:, :-1, :, None] + moves + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
        want_m = (np.exp(np.minimum(x, 0)) * both[:, :, None, None]).sum((0, 1))
        gradient = np.concatenate([(seen_w - want_w) / lines - ridge * weights, ((seen_m - want_m) / lines - ridge * moves).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        weights, moves = weights + move[:d], moves + move[d:].reshape(2, 2)
    return Field(weights, moves)


def train(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> Field | None:
    """The field fitted on a bounded sample of the documents that ``labels(doc_id, quality)`` names; None without both kinds."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("quality")
    )
    one = [known.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_docs) for q in (0, 1)]
    chosen = texts(docs).where("text is not null").join(F.broadcast(one[0].unionByName(one[1])), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("window", pa.int32()), ("quality", pa.int32()), ("inputs", pa.binary())])

    def windows(batch):
        ids, quality = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
        for i, q, text in zip(ids, quality, batch.column("text").cast(pa.binary()).to_pylist()):
            x = describe(text)[1].astype("<f4")
            parts = [x[at : at + rules.window].tobytes() for at in range(0, len(x), rules.window)]
            yield record(schema, [i] * len(parts), range(len(parts)), [q] * len(parts), parts)

    parts = map_batches(chosen, windows, "doc_id long, window int, quality int, inputs binary")
    sample = parts.orderBy(F.xxhash64("doc_id", "window"), "doc_id", "window", "inputs").limit(rules.train_windows).collect()
    if len({r.quality for r in sample}) < 2:
        return None
    d = len(FEATURES)
    features = np.zeros((len(sample), rules.window, d))
    states, filled = np.zeros((len(sample), rules.window), np.int64), np.zeros((len(sample), rules.window), bool)
    for k, r in enumerate(sample):
        x = np.frombuffer(r.inputs, "<f4").reshape(-1, d)
        features[k, : len(x)], filled[k, : len(x)] = x, True
        boilerplate = (x[:, FEATURES.index("repeats_line")] > 0) | (x[:, FEATURES.index("phrase")] > 0)
        states[k, : len(x)] = r.quality & ~boilerplate
    return fit(features, states, filled, rules.rounds, rules.ridge)


def verdict(text: bytes | None, field: Field | None, rules: QualityRules) -> tuple:
    """(base counts, base_failed, kept, lines, content lines, content share) of one text, flat."""
    base, features, sizes = describe(text or b"")
    states = field.decode(features) if field else np.ones(len(sizes), np.int64)
    share = float((states * sizes).sum() / sizes.sum()) if len(sizes) else 0.0
    failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_percent * base[0]
    return (*base, failed, not failed and share >= rules.min_content, len(sizes), int(states.sum()), share)


def assess(docs: DataFrame, field: Field | None, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts and verdict of each row of ``docs``.

    A null text counts as empty and fails the fixed rules.  Without a field every line is content.  Repeated rows give repeated
    results, a null ``doc_id`` stays null, an empty table gives no rows, other columns are ignored.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_content_lines", pa.int64()),
        ("content_share", pa.float64()),
    ])

    def run(batch):
        out = [verdict(t, field, rules) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield record(schema, batch.column("doc_id"), *zip(*out))

    return map_batches(texts(docs), run, SCHEMA)


def label_lines(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, line_no, line, content``: the lines with a word, in order, and whether they are content."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int64()), ("line", pa.string()), ("content", pa.bool_())])

    def run(batch):
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.encode().split()]
            features = describe((text or "").encode())[1]
            states = field.decode(features) if field else np.ones(len(lines), np.int64)
            yield record(schema, [i] * len(lines), [k for k, _ in lines], [x for _, x in lines], states.astype(bool))

    return map_batches(texts(docs), run, "doc_id long, line_no long, line string, content boolean")


def quality(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Train on ``labels``, then assess every row of ``docs``."""
    return assess(docs, train(docs, labels, rules), rules)


def good_documents(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    field = train(docs, labels, rules)

    def keep(batches):
        for batch in slices(batches):
            good = [verdict(t, field, rules)[6] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
