"""Byte-level BPE: texts to token ids by a rank table of a public tokenizer, and back.

A piece of text is encoded by backtracking instead of by merging: from each place the longest token
that matches is tried first, then its shorter prefixes, and a token is taken only if it may follow
the one before.  Two tokens may stand together exactly if the merges of their joined bytes give
these two again, and a sequence whose neighbours all may is what the merges of the whole give, so
the result is theirs.  A place that is found to be a dead end is not entered again, which makes the time
linear in the piece.  Matches come from an Aho-Corasick automaton over the tokens, bytes as Latin-1 characters;
which tokens may be neighbours is remembered, and so are short pieces.

The table is read once by the driver; a vocabulary has ``MOST_TOKENS`` tokens at most, which is checked,
so it may be sent to all executors.

Defined cases: a null text is like an empty one, which has no tokens; strings of special tokens in a text
are ordinary text; texts and pieces of any length are taken whole; ids that the vocabulary lacks, or null,
make a decoded text null; repeated rows are encoded alike and an empty table gives no rows; other
columns are carried along in ``doc``, whatever their names.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import let

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_TOKENS = 1_000_000
#: Texts that are Python strings at a time; pieces of up to LONGEST characters that a task remembers, some 80 MB, and pairs.
ROWS, PIECES, LONGEST, PAIRS = 250, 1 << 18, 64, 1 << 18


class Vocabulary(NamedTuple):
    """Tokens by id (None: no such id), and for each the two that its last merge joins, or itself twice if it has none."""

    tokens: list[bytes | None]
    left: np.ndarray
    right: np.ndarray
    pattern: str


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The parts of a piece after all merges (of a rank ``below``), the lowest rank first and the leftmost of equal ones."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        options = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best = min((x for x in options if x[0] is not None and (below is None or x[0] < below)), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def vocabulary(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """A vocabulary of tokens by rank, ranks being the ids."""
    size = max(ranks.values(), default=-1) + 1
    if size > MOST_TOKENS:
        raise ValueError(f"a vocabulary has {MOST_TOKENS} tokens at most")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has all single bytes")
    tokens: list[bytes | None] = [None] * size
    left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
    for token, rank in ranks.items():
        tokens[rank] = token
        parts = merged(token, ranks, rank)
        if len(parts) == 2:
            left[rank], right[rank] = (ranks[p] for p in parts)
        elif len(parts) > 2:
            raise ValueError(f"no merges of earlier tokens make {token!r}")
    return Vocabulary(tokens, left, right, pattern)


def of_file(path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """The vocabulary of a rank file: lines of a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


class Pieces(dict):
    """Pieces and their ids, and those of others when first asked for; ``trim`` forgets them when they are many."""

    def __init__(self, whole: dict[str, tuple[int, ...]], encode: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__(whole)
        self.whole, self.encode = whole, encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > PIECES + len(self.whole):
            self.clear()
            self.update(self.whole)


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


class Encoder:
    """What a task needs to encode texts."""

    def __init__(self, known: Vocabulary) -> None:
        tokens = {i: t for i, t in enumerate(known.tokens) if t is not None}
        ids = {t: i for i, t in tokens.items()}
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.left, self.right = known.left.tolist(), known.right.tolist()
        self.pair = {(self.left[i], self.right[i]): i for i in tokens if self.left[i] != i}
        self.size = [len(t or b"") for t in known.tokens]
        self.shorter = [-1] * len(known.tokens)
        self.automaton = ahocorasick.Automaton()
        for i, token in tokens.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), i)
                self.shorter[i] = next(ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids)
        self.automaton.make_automaton()
        self.split = regex.compile(known.pattern).findall
        self.fitting = lru_cache(PAIRS)(self._fitting)
        self.pieces = Pieces({t.decode(): (i,) for i, t in tokens.items() if _is_text(t)}, self.backtracked)

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes leave these two.

        Their last merges are undone, the latest first.  If what then meets at the boundary is a
        pair that merges earlier than what was undone, the merges would have crossed it.
        """
        pair, left, right, until = self.pair, self.left, self.right, len(self.left)
        while True:
            if pair.get((a, b), until) < until:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                until, a = a, right[a]  # at its own rank the merge on the left comes first
            else:
                until, b = b + 1, left[b]

    def _fitting(self, last: int, token: int) -> int:
        """The longest prefix of a token, the token included, that may follow ``last`` (-1: the beginning); -1 if none may."""
        while token >= 0 and last >= 0 and not self._neighbours(last, token):
            token = self.shorter[token]
        return token

    def backtracked(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece that is no token itself."""
        body = piece.encode()
        size, shorter, fitting = self.size, self.shorter, self.fitting
        longest = list(map(self.byte.__getitem__, body))
        for end, token in self.automaton.iter(piece if len(piece) == len(body) else body.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer
        at, n, found, dead = 0, len(body), [-1], set()
        token = longest[0]
        while at < n:
            token = fitting(found[-1], token)
            while token >= 0 and dead and at + size[token] in dead:
                token = fitting(found[-1], shorter[token])
            if token >= 0:
                found.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead.add(at)
                token = found.pop()
                at -= size[token]
                token = shorter[token]
        del found[0]
        return tuple(found)

    def encoded(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))), np.int32)


def encoded(docs: DataFrame, known: Vocabulary, text_col: str = "text", carried: Column | None = None) -> DataFrame:
    """(doc, ids) of each row: the token ids of its whole text; ``doc`` holds the row's columns, or what is ``carried`` instead."""
    rows = docs.select((F.struct("*") if carried is None else carried).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = [encoder.encoded(t.as_py()) for t in part.column("text")]
                encoder.pieces.trim()
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([part.column("doc"), lists], ["doc", "ids"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>")


def decoded(ids: Column, known: Vocabulary) -> Column:
    """The bytes of token ids: tokens as Latin-1 strings are looked up in a constant array and joined."""
    names = [None if t is None else t.decode("latin-1") for t in known.tokens]
    constant = F.from_json(F.lit(json.dumps(names)), "array<string>")
    joined = lambda parts: F.when(F.size(F.array_compact(parts)) == F.size(parts), F.encode(F.array_join(parts, ""), "ISO-8859-1"))
    return F.when(ids.isNotNull(), let(F.transform(ids, lambda i: F.get(constant, i)), joined))
