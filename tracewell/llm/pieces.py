"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (blanks become the word mark, one more in front) and cut into marked words, which no piece crosses.  The distinct
words of a batch are sorted, which lays them out as a depth-first walk of their trie: going from one word to the next, the forward
pass keeps everything up to their common prefix and only runs over the rest.  What it keeps for a prefix are the best score, the
last piece and the place in the automaton that lists the pieces ending there, and these depend on the prefix alone.

* Models of type unigram: the score is the sum of the piece scores; of equal ones the longest last piece wins.
* Models of type BPE: a sequence of pieces is what merging gives if and only if merging any two neighbours' text gives the two
  neighbours again.  So a step from piece to piece is allowed or not, allowed steps score 0, others minus infinity, and exactly
  one path is left.  (Merges on both sides of a border that none crosses do not depend on each other.)  Results equal the library's.

Characters without a piece are written as byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, texts

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNIGRAM, BPE = 1, 2
#: How far a missing character lies below the lowest score.
MISSING = 10.0
#: Bytes of text encoded at a time; their words are a far larger list.
SLICE = 4_000_000
#: Words whose pieces one worker remembers.
CACHE_WORDS = 300_000
#: Pairs of neighbours whose verdict one worker remembers.
CACHE_PAIRS = 500_000
_LOADED: dict[str, Pieces] = {}
NO_CHILDREN: dict[str, int] = {}


@dataclass(frozen=True)
class PieceRules:
    model: str = "piece_bpe_32k.model"


class Pieces:
    """Vocabulary of one model and the forward pass over sorted words."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that leave characters and blanks as they are, with a mark in front, are supported")
        self.bpe = model.trainer_spec.model_type == BPE
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []  # what each id decodes to
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            if p.type in (1, 4, 5):
                if re.search(f"[^{MARK}]{MARK}", p.piece):
                    raise ValueError(f"piece {p.piece!r} crosses words")
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.raw.append(p.piece.replace(MARK, " ").encode())
            elif p.type == 6:
                value = int(p.piece[3:-1], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            else:
                self.raw.append(" ⁇ ".encode() if p.type == 2 else b"")
                self.unknown = i if p.type == 2 else self.unknown
        self.floor = min(self.score.values(), default=0.0) - MISSING
        self.children: list[dict[str, int]] = []
        self.words: dict[str, bytes] = {}  # ids, four bytes each
        self.missed: set[str] = set()
        self.pairs: dict[int, bool] = {}

    def _automaton(self) -> None:
        """Trie of the pieces with links to the longest proper suffix that is in it, and the pieces that end at each node."""
        self.names = [""]  # pieces by number; 0: start of a word
        self.children = [NO_CHILDREN]
        self.piece = [0]  # number of the piece that a node spells, or 0
        for name in self.score:
            node = 0
            for c in name:
                after = self.children[node].get(c)
                if after is None:
                    if not self.children[node]:
                        self.children[node] = {}
                    after = self.children[node][c] = len(self.children)
                    self.children.append(NO_CHILDREN)
                    self.piece.append(0)
                node = after
            self.piece[node] = len(self.names)
            self.names.append(name)
        self.inside = {name[i : i + 2] for name in self.names for i in range(len(name) - 1)}
        self.number = {name: k for k, name in enumerate(self.names)}
        self.fail = [0] * len(self.children)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.children)
        todo = deque(self.children[0].values())
        while todo:
            node = todo.popleft()
            k = self.piece[node]
            self.ends[node] = (((k, len(self.names[k])),) if k else ()) + self.ends[self.fail[node]]
            for c, after in self.children[node].items():
                link = self.fail[node]
                while link and c not in self.children[link]:
                    link = self.fail[link]
                link = self.children[link].get(c, 0)
                self.fail[after] = link
                todo.append(after)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, last: int, piece: int) -> bool:
        """Whether merging keeps ``piece`` apart from ``last`` (0 at the start of a word) and makes it at all."""
        both = [self.names[k] for k in (last, piece) if k]
        known = self.merge("".join(both)) == both
        if len(self.pairs) < CACHE_PAIRS:
            self.pairs[last << 32 | piece] = known
        return known

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of distinct words, in sorted order."""
        if not self.children:  # decoding needs none
            self._automaton()
        before = ""
        score, last, nodes = [0.0], [0], [0]  # of each prefix of the word at hand
        forward = self._forward_bpe if self.bpe else self._forward_unigram
        for word in sorted(words):
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del score[keep + 1 :], last[keep + 1 :], nodes[keep + 1 :]
            forward(word[keep:], score, last, nodes)
            yield word, self._ids(last)
            before = word

    def _forward_bpe(self, rest: str, score: list[float], last: list[int], nodes: list[int]) -> None:
        """Extend the forward pass by the characters of ``rest``: the one piece that may follow what stands before it."""
        children, fail, ends, pairs, node = self.children, self.fail, self.ends, self.pairs, nodes[-1]
        for c in rest:
            after = children[node].get(c)
            while after is None and node:
                node = fail[node]
                after = children[node].get(c)
            node = after or 0
            nodes.append(node)
            for k, size in ends[node]:  # from the longest piece that ends here to the shortest
                known = pairs.get(last[-size] << 32 | k)
                if known or known is None and self._allowed(last[-size], k):
                    last.append(k)
                    break
            else:
                last.append(self._missing(c))

    def _forward_unigram(self, rest: str, score: list[float], last: list[int], nodes: list[int]) -> None:
        """Extend the forward pass by the characters of ``rest``: the piece with the best sum, the longest of equal ones."""
        children, fail, ends, node = self.children, self.fail, self.ends, nodes[-1]
        for c in rest:
            while node and c not in children[node]:
                node = fail[node]
            node = children[node].get(c, 0)
            nodes.append(node)
            best, found = float("-inf"), 0
            for k, size in ends[node]:
                total = score[-size] + self.score[self.names[k]]
                if total > best:
                    best, found = total, k
            if c not in self.score and score[-1] + self.floor > best:
                best, found = score[-1] + self.floor, self._missing(c)
            score.append(best)
            last.append(found)

    def _missing(self, c: str) -> int:
        """Number of a character without a piece."""
        if c not in self.number:
            self.number[c] = len(self.names)
            self.names.append(c)
        return self.number[c]

    def _ids(self, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(last) - 1
        while end:
            piece = self.names[last[end]]
            if piece in self.id:
                out.append(self.id[piece])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            else:
                out.append(self.unknown)
            end -= len(piece)
        return tuple(reversed(out))

    def _parts(self, word: str) -> list[str]:
        """``word`` cut wherever no piece holds the two characters side by side, so that no piece can cross."""
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def encode(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first index of each text and the end)."""
        if not self.children:
            self._automaton()
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in text]
        known, full = self.words, len(self.words) >= CACHE_WORDS
        fresh = {w: self._parts(w) for w in {w for ws in cut for w in ws if w not in known}}
        part = dict(self.encode_words(list({p for ps in fresh.values() for p in ps})))
        packed = {p: array("i", ids).tobytes() for p, ids in part.items()}
        new = {w: packed[ps[0]] if len(ps) == 1 else b"".join(map(packed.__getitem__, ps)) for w, ps in fresh.items()}
        known.update(new)
        sizes, parts = [0], []
        for ws in cut:
            parts.append(b"".join(map(known.__getitem__, ws)))
            sizes.append(len(parts[-1]) // 4)
        # Words that two batches in a row had to encode are worth keeping, the others go again.
        for w in new.keys() if full else new.keys() - self.missed:
            del known[w]
        self.missed = set(new)
        return np.frombuffer(b"".join(parts), np.int32), np.cumsum(sizes)

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids, without the mark in front."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def load(name: str) -> Pieces:
    """The model of this worker; ``name`` is a file of the public set or a path."""
    if name not in _LOADED:
        import os

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        with open(path, "rb") as file:
            _LOADED[name] = Pieces(file.read())
    return _LOADED[name]


def encode(docs: DataFrame, rules: PieceRules = PieceRules()) -> DataFrame:
    """``doc_id, text, ids`` (array of int) of each row of ``docs``.

    A null or empty text has no ids.  Repeated rows give repeated results, a null ``doc_id`` stays null, an empty table gives no
    rows, other columns are ignored.
    """
    names = ["doc_id", "text", "ids"]

    def run(batches):
        for batch in slices(batches, SLICE):
            ids, offsets = load(rules.model).encode([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], names=names)

    return texts(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, rules: PieceRules = PieceRules()) -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of ``ids`` (null ids: empty), in place of any column of that name."""
    left = encoded.drop("decoded")
    fields = left.select("*", F.lit("").alias("decoded")).schema

    def run(batches):
        for batch in slices(batches):
            model = load(rules.model)
            # One text at a time: lists of all ids of a batch would be far larger than the batch.
            text = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    return left.mapInArrow(run, fields)


def round_trip(docs: DataFrame, rules: PieceRules = PieceRules()) -> DataFrame:
    """``doc_id, ids, round_trip``: :func:`encode` and :func:`decode` in the same task, without moving text or ids in between.

    ``round_trip`` says whether the ids decode to the text (a null one: the empty text); it is false only for texts that hold the
    word mark itself, which decodes to a blank.  Odd rows are treated as in :func:`encode`.
    """
    names = ["doc_id", "ids", "round_trip"]

    def run(batches):
        model = load(rules.model)
        for batch in slices(batches, SLICE):
            text = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets = model.encode(text)
            same = [model.decode(ids[a:b].tolist()) == t for a, b, t in zip(offsets, offsets[1:], text)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same, pa.bool_())], names=names)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def piece_digest(docs: DataFrame, rules: PieceRules = PieceRules()) -> DataFrame:
    """``doc_id, n_pieces, ids_sha256, round_trip`` of each row; the digest is over the ids in decimal, joined by commas."""
    return round_trip(docs, rules).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "round_trip",
    )
