"""Token counts by overlap resynchronisation.

A text above ``chunk_chars`` characters is never given to the tokenizer whole.  It is cut into chunks that overlap; each chunk
is encoded with offsets and neighbours are spliced at a stable common boundary.  Why such a splice is exact: the pre-tokenizer
scans from left to right and has no look-behind, so once it stands at a boundary between two pre-tokens, all that follows depends
on the text behind that boundary only.  A boundary is taken if

* both encodings have a border between two pre-tokens there,
* the left encoding, right from its own start, has at least ``GUARD`` more characters and two more pre-tokens behind it, so
  that neither look-ahead nor a special string cut by the end of the chunk can have moved it.

If an overlap has none (one long word, a run of blanks), the overlap is widened to the left, twice as far each time, until one
shows or the right chunk begins where the left one does; then the two are encoded as one.

Shorter texts are counted by their blank-led pieces.  A single blank between two other characters always begins a pre-token, for
the same reason as above, so the pieces can be encoded apart; a worker encodes each distinct piece once and remembers its count.
Texts with runs of blanks, where that does not hold, are encoded whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import map_batches, record, texts

#: Longer than any special string of the supported vocabularies.
GUARD = 32
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"
#: Pieces whose counts one worker remembers; the first ones, which hold the frequent ones.
CACHE_PIECES = 600_000
BLANK_RUN = re.compile(r" \s|\s ")
_LOADED: dict = {}
_COUNTS: dict[str, dict[str, int]] = {}


@dataclass(frozen=True)
class TokenRules:
    tokenizer: str = "byte_bpe_50k.json"
    chunk_chars: int = 65_536
    overlap_chars: int = 512
    limit: int = 512


def load(name: str):
    """The tokenizer of this worker; ``name`` is a file of the public set or a path."""
    if name not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LOADED[name] = Tokenizer.from_file(path)
    return _LOADED[name]


def _borders(tok, text: str, start: int) -> list[tuple[int, int]]:
    """(position in the whole text, tokens before it) of each border between pre-tokens of one chunk; the end comes last."""
    enc = tok.encode(text, add_special_tokens=False)
    words, offsets = enc.word_ids, enc.offsets
    out, n = [], len(words)
    for i in range(1, n):
        # A special string has no word of its own; what follows it begins a new scan.
        if words[i] != words[i - 1] or words[i] is None:
            out.append((start + offsets[i][0], i))
    out.append((start + len(text), n))
    return out


def count_spliced(tok, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of ``text`` and the number of chunks encoded."""
    size, total, chunks = len(text), 0, 1
    start, end = 0, min(len(text), chunk)
    left = _borders(tok, text[start:end], start)
    base = 0  # tokens of the left chunk before ``start`` of what still counts
    while end < size:
        stop, back = min(size, end + chunk), overlap
        while True:
            begin = max(start, end - back)
            if begin == start:
                left, at = _borders(tok, text[start:stop], start), None
                chunks += 1
                break
            right = _borders(tok, text[begin:stop], begin)
            chunks += 1
            known = {p: i for p, i in right[:-1]}
            at = next(
                ((p, i, known[p]) for p, i in reversed(left[:-3]) if p in known and p <= end - GUARD and p > start and i > base),
                None,
            )
            if at:
                break
            back *= 2
        if at:
            _, i, j = at
            total += i - base
            start, left, base = at[0], right, j
        else:
            base = 0
        end = stop
        if not at:
            continue
    return total + left[-1][1] - base, chunks


def count_pieces(name: str, text: list[str]) -> list[int]:
    """Tokens of texts without runs of blanks, by blank-led pieces."""
    known = _COUNTS.setdefault(name, {})
    parts = [t.split(" ") for t in text]
    heads, tails = [p[0] for p in parts], [p[1:] for p in parts]
    new = list({w for tail in tails for w in tail if w not in known})
    tok = load(name)
    first = [len(e) for e in tok.encode_batch_fast(heads, add_special_tokens=False)]
    counts = dict(zip(new, map(len, tok.encode_batch_fast([" " + w for w in new], add_special_tokens=False))))
    if len(known) < CACHE_PIECES:
        known.update(counts)
        return [n + sum(map(known.__getitem__, tail)) for n, tail in zip(first, tails)]
    count = {**{w: known[w] for tail in tails for w in tail if w in known}, **counts}.__getitem__
    return [n + sum(map(count, tail)) for n, tail in zip(first, tails)]


def token_counts(docs: DataFrame, rules: TokenRules = TokenRules()) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks`` of each row of ``docs``.

    A null text counts as empty (0 tokens); a null ``doc_id`` stays null; repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int64())])

    def count(batch):
        tok = load(rules.tokenizer)
        text = [t or "" for t in batch.column("text").to_pylist()]
        n, chunks, plain = [0] * len(text), [1] * len(text), []
        for i, t in enumerate(text):
            if len(t) > rules.chunk_chars:
                n[i], chunks[i] = count_spliced(tok, t, rules.chunk_chars, rules.overlap_chars)
            elif BLANK_RUN.search(t):
                n[i] = len(tok.encode(t, add_special_tokens=False))
            else:
                plain.append(i)
        for i, k in zip(plain, count_pieces(rules.tokenizer, [text[i] for i in plain])):
            n[i] = k
        sizes = [len(t.encode()) for t in text]
        yield record(schema, batch.column("doc_id"), sizes, n, [x > rules.limit for x in n], chunks)

    return map_batches(texts(docs), count, SCHEMA)
