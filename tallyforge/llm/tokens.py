"""Token counts of whole texts in a public byte-level BPE vocabulary.

A text is split into the vocabulary's pieces for a whole batch at once, on an
array of code points; equal pieces are counted once and remembered, so the
merges of the vocabulary run for new pieces only. Counts equal those of the
library's own encoding of each text.

The vocabulary file's path is a parameter; it must lie at that path on every
executor (default: the installed public vocabularies).

Defined cases: a null text has a null count, an empty one 0.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the public rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
SLOTS = 1 << 20
#: Code points split at once: bounds the memory of a batch of long texts.
BLOCK = 4_000_000


def _cache() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_tallyforge_cache", types.ModuleType("_tallyforge_cache")).__dict__


class Counter:
    """Counts tokens of texts; one per worker and vocabulary."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # the class of every code point, by the pattern's own definitions
        points = np.arange(0x110000)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        text = "".join(map(chr, points.tolist()))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for k, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(cls, text):
                self.kind[points[m.start() : m.end()]] = k
        self.slot = np.zeros(SLOTS, np.uint64)
        self.known = np.zeros(SLOTS, np.int32)

    @classmethod
    def of(cls, path: str) -> Counter:
        cache = _cache()
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def pieces(self, cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the pieces of texts laid end to end (``ends`` of each, none of them empty)."""
        n = len(cp)
        kind = self.kind[cp]
        first = np.zeros(n, bool)  # first code point of a text
        first[0] = True
        first[ends[:-1]] = True
        last = np.zeros(n, bool)
        last[ends - 1] = True
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        start = change.copy()
        space = kind == SPACE
        blank = cp == 32
        # of a run of white space that goes before other text, the last one stands apart ...
        before_text = space & ~last
        before_text[:-1] &= ~space[1:]
        start |= before_text
        # ... and, if it is a blank, goes with that text
        joined = before_text & blank
        after = np.flatnonzero(joined) + 1
        start[after] = False
        # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it
        mark = np.flatnonzero((cp == 39) & start & ~last)
        if len(mark):
            mark = mark[kind[mark + 1] == LETTER]
            one, two = cp[mark + 1], cp[np.minimum(mark + 2, n - 1)]
            more = (mark + 2 < n) & ~last[mark + 1]
            short = np.isin(one, (115, 116, 109, 100))  # s t m d
            long = more & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & ~short
            for at, width in ((mark[short], 2), (mark[long], 3)):
                start[at + 1] = False
                rest = at + width
                rest = rest[(rest < n)]
                rest = rest[~first[rest]]
                rest = rest[(kind[rest] == LETTER)]
                start[rest] = True
        return np.flatnonzero(start)

    def _block(self, texts: list[str]) -> np.ndarray:
        """Counts of texts, none of them empty."""
        raw = "".join(texts)
        cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        at = self.pieces(cp, ends)
        stop = np.append(at[1:], len(cp))
        with np.errstate(over="ignore"):
            # hash of a piece: sum of mixed code points times powers of its place, by prefix sums
            place = np.arange(len(cp)) - np.repeat(at, stop - at)
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(place.max()), np.uint64(0x100000001B3)))), dtype=np.uint64)
            x = (cp.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0x9E3779B97F4A7C15)
            total = np.cumsum((x ^ (x >> np.uint64(29))) * power[place], dtype=np.uint64)
            h = total[stop - 1].copy()
            h[1:] -= total[at[1:] - 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (stop - at).astype(np.uint64)
            h ^= h >> np.uint64(29)
            h |= np.uint64(1)  # a slot without a piece holds 0
        slot = (h >> np.uint64(44)).astype(np.int64)
        counts = self.known[slot]
        miss = np.flatnonzero(self.slot[slot] != h)
        if len(miss):
            fresh, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            sample = miss[where]
            encode = self.encoding.encode_ordinary
            found = np.array([len(encode(raw[a:b])) for a, b in zip(at[sample].tolist(), stop[sample].tolist(), strict=True)], np.int32)
            counts[miss] = found[back]
            to = (fresh >> np.uint64(44)).astype(np.int64)
            self.slot[to], self.known[to] = fresh, found
            # of two new pieces of one slot the one written last stays; both lines write in the same order
        below = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        bound = np.searchsorted(at, ends)
        return below[bound] - below[np.concatenate(([0], bound[:-1]))]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones."""
        out = np.zeros(len(texts), np.int64)
        todo, size = [], 0
        for i, t in enumerate(texts):
            if t:
                todo.append(i)
                size += len(t)
            if todo and (size > BLOCK or i == len(texts) - 1):
                out[todo] = self._block([texts[j] for j in todo])
                todo, size = [], 0
        if todo:
            out[todo] = self._block([texts[j] for j in todo])
        return out


def with_tokens(df: DataFrame, keep: dict[str, Column], text: str, vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """The columns of ``keep`` and the token count of ``text``, in one pass without a shuffle."""
    names = list(keep)
    picked = df.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[: len(names)], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            counts = counter.count(texts)
            empty = np.array([t is None for t in texts], bool)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(counts, mask=empty)], names=[f.name for f in schema.fields])

    return picked.mapInArrow(run, schema)
