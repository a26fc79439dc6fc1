"""Near-duplicate records with small edits: a byte-position inverted index with count filtering.

Every distinct word of a record sets one byte at one position of a wide, mostly
empty byte row: the position is 24 bits of the word's hash, the byte another 8.
Insertions and reordering leave the other words' bytes where they are. Two
records of n_a and n_b words whose word sets have a Jaccard similarity of at
least t share t / (1 + t) * (n_a + n_b) words or more, so a record must find all
but ``n - ceil(t * n)`` of its bytes again in the other: the guaranteed minimum.

The inverted index (position, byte) -> records is used in steps, each exact:

1. A record needs to be looked up only by ``n - ceil(t * n) + 1`` of its bytes,
   the rarest: a partner that meets none of them misses too many.
2. A byte that is common in the corpus is looked up together with a second and,
   where it is very common, a third one from the correspondingly longer prefix,
   since a partner whose rarest shared byte is common must share those too.
3. Each posting carries 64 parity bits of the whole row. Two rows that differ in
   d bytes differ in at most d of these, which rules out nearly all pairs that
   share a phrase only.
4. For every pair that met in a list, the shared positional bytes of the two
   whole rows are tallied, and the pair is kept if they reach the guaranteed
   minimum.
5. The pairs left are verified on the words themselves.

A tally of all lists in full instead would add up 4 * 10^9 meetings for 300
thousand findings, and four times as many for twice the findings; the lists of
steps 1 and 2 have 8 million, and step 3 leaves 53 thousand pairs to be tallied.

Only the order of bytes and the length of the key depend on counts, so a pair is
found whatever they are. They come from a table of the 65,536 commonest words of
the whole corpus (a bound on the broadcast, not on what is searched: words that
are not in it rank as rare). A list longer than ``LONG_LIST`` is cut into chunks,
and every two chunks meet in a place of their own, so no task holds a long list.

Records are compared within a block (here: the same file name). Records of equal
block and text are one class, found once through one 64-bit fingerprint, so a
text that fills a third of the table costs one lookup. :func:`classes` gives the
classes with their members and links; only :func:`near_duplicates` writes out
every pair of copies, which is asked for there.

Defined cases: a record with a null text or block, or without a word, is in no
pair. Of several rows with one id the one loaded last counts, the greater
content among equals. Texts of any length are processed whole. An empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise, release

#: Bound on the broadcast table of common words.
COMMON_WORDS = 65_536
#: A word in more records than this is looked up with a second one; in more than
#: the next, with a third one.
COMMON, VERY_COMMON = 128, 16_384

_MUL = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3  # odd, so powers of it have inverses modulo 2**64


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(record number, 64-bit hash) of every run of a-z and 0-9 in the lower-cased texts, in order.

    Works on the bytes of the whole batch at once. Only two characters outside
    ASCII have an ASCII letter in their lower case, and texts with them are
    lowered one by one.
    """
    odd = pc.fill_null(pc.match_substring_regex(texts, "[İK]"), False)
    if pc.any(odd).as_py():
        texts = pa.array([t.lower() if t is not None and o else t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.string())
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    code = np.zeros(256, np.uint8)
    code[48:58] = np.arange(1, 11)
    code[97:123] = code[65:91] = np.arange(11, 37)
    c = code[data]
    inside = c > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    start[cuts] |= inside[cuts]  # a word at the end of one text and one at the start of the next
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # sum of code * base**(place in word): prefix sums of code * base**place, divided by base**start
    with np.errstate(over="ignore"):
        letters = np.flatnonzero(inside)
        first = np.cumsum(start)[letters] - 1
        place = letters - at[first]
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(place.max()), np.uint64(_BASE)))), dtype=np.uint64)
        total = np.cumsum((c[letters].astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)
        begin = np.searchsorted(letters, at)
        stop = np.append(begin[1:], len(letters)) - 1
        h = total[stop] - np.where(begin > 0, total[begin - 1], np.uint64(0))
        h = _mix(h * np.uint64(_MUL))
    return np.searchsorted(ends, at, side="right"), h


def distinct_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, each word once per record, sorted by record and hash."""
    rec, h = word_hashes(texts)
    order = np.lexsort((h, rec))
    rec, h = rec[order], h[order]
    keep = np.ones(len(rec), bool)
    keep[1:] = (rec[1:] != rec[:-1]) | (h[1:] != h[:-1])
    return rec[keep], h[keep]


def positional(h: np.ndarray) -> np.ndarray:
    """The position (24 bits) and byte (8 bits) of words, as one number."""
    return (h >> np.uint64(32)).astype(np.uint32)


def common_words(df: DataFrame, text: Column, above: int = COMMON, bound: int = COMMON_WORDS) -> dict[int, int]:
    """Positional bytes in more than ``above`` records, the ``bound`` commonest, with their counts.

    Counts are taken over all rows, in each batch first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, h = distinct_words(b.column(0))
            codes, n = np.unique(positional(h), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["code", "n"])

    counts = df.select(text).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") > above)
    return {r["code"]: r["n"] for r in counts.orderBy(F.desc("n"), "code").limit(bound).collect()}


def _keys(rec: np.ndarray, code: np.ndarray, count: np.ndarray, words: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(record, key) of every lookup of the records, all bytes of which are given; ``words`` per record."""
    order = np.lexsort((code, count, rec))
    rec, code, count = rec[order], code[order].astype(np.uint64), count[order]
    heads = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
    n = np.diff(np.r_[heads, len(rec)])
    w = words[rec[heads]]
    miss = w - np.ceil(t * w - 1e-9).astype(np.int64)  # bytes that a partner may lack
    # a partner may have as few as t * w words and then be sure of few shared bytes only
    low = np.maximum(np.ceil(t * np.ceil(t * w - 1e-9) - 1e-9).astype(np.int64) - (w - n), 1)
    spread = np.repeat(np.arange(len(heads)), n)
    head, miss, low, end = heads[spread], miss[spread], low[spread], (heads + n)[spread]
    depth = 1 + (count > COMMON) + (count > VERY_COMMON)
    out_rec, out_key = [], []
    with np.errstate(over="ignore"):
        last = np.flatnonzero(np.arange(len(rec)) - head <= miss)
        key, first = _mix(code[last] * np.uint64(_MUL)), last
        for level in (1, 2, 3):
            use = (depth[first] == level) | (low[first] <= level)
            out_rec.append(rec[first[use]])
            out_key.append(key[use])
            on = depth[first] > level
            key, last, first = key[on], last[on], first[on]
            if not len(key):
                break
            # on with every later byte of the prefix that one more shared byte allows
            stop = np.minimum(head[first] + miss[first] + 1 + level, end[first])
            many = np.maximum(stop - last - 1, 0)
            rep = np.repeat(np.arange(len(key)), many)
            nxt = last[rep] + 1 + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            key = _mix((key[rep] ^ code[nxt]) * np.uint64(_MUL) + np.uint64(level))
            last, first = nxt, first[rep]
    return np.concatenate(out_rec), np.concatenate(out_key)


def _postings(common: dict[int, int], t: float):  # noqa: ANN202
    codes = np.array(sorted(common), np.uint32)
    counts = np.array([common[c] for c in codes.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal records of this task give the same postings
        for b in batches:
            content = b.column(0).to_numpy()
            new = []
            for i, c in enumerate(content.tolist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            content, block = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            rec, h = distinct_words(b.column(2))
            code = positional(h)  # sorted by record and hash, so by record and code
            words = np.bincount(rec, minlength=len(content))
            fresh = np.ones(len(rec), bool)  # two words of a record on one byte are one entry
            fresh[1:] = (rec[1:] != rec[:-1]) | (code[1:] != code[:-1])
            rec, code = rec[fresh], code[fresh]
            if not len(rec):
                continue
            count = np.zeros(len(code), np.int64)
            if len(codes):
                i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                count = np.where(codes[i] == code, counts[i], 0)
            bits = np.zeros(len(content), np.uint64)
            heads = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
            with np.errstate(over="ignore"):
                bits[rec[heads]] = np.bitwise_xor.reduceat(np.uint64(1) << (_mix(code.astype(np.uint64) * np.uint64(_MUL)) & np.uint64(63)), heads)
                r, key = _keys(rec, code, count, words, t)
                key = _mix(key ^ (block[r] * np.uint64(_MUL)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(content[r]), pa.array(words[r].astype(np.int32)), pa.array(bits[r].view(np.int64))], names=["key", "content", "n", "bits"]
            )

    return run


#: Postings of a key beyond which its list is cut into chunks of about this many.
LONG_LIST = 2_000


def words_of(text: Column) -> Column:
    """The distinct words: longest runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def lists(posts: DataFrame) -> DataFrame:
    """(key, content, n, bits, size): the postings of every list of two contents or more, each once, stored.

    One shuffle by key; most lists have one content and end here.
    """
    once = posts.repartition("key").groupBy("key", "content").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    sized = once.withColumn("size", F.count("*").over(Window.partitionBy("key")))
    return materialise(sized.filter(F.col("size") > 1), "postings")


def met(posts: DataFrame, t: float) -> DataFrame:
    """(a, b, lists), a < b, once each: contents that meet in lists and may be similar by their sizes and parity bits."""
    chunks = F.ceil(F.col("size") / LONG_LIST).cast("int")
    own = F.when(chunks == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("content", F.lit(1)), chunks)).cast("int")
    # two chunks meet in the place of their numbers, the smaller first; a chunk goes to one place for each other chunk
    placed = posts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    place = F.when(chunks == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    placed = placed.select(place.alias("place"), "key", "own", "other", "content", "n", "bits")
    side = lambda x: placed.select("place", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "own", "other", "content", "n", "bits")])
    differing = F.floor((F.col("n_a") + F.col("n_b")) * ((1 - t) / (1 + t)) + 1e-9)
    likely = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * t - 1e-9) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= differing)
    here = (F.col("key_a") == F.col("key_b")) & (F.col("own_a") == F.col("other_b")) & (F.col("own_b") == F.col("other_a"))
    pairs = side("a").join(side("b"), "place").filter((F.col("content_a") < F.col("content_b")) & here & likely)
    return pairs.groupBy(F.col("content_a").alias("a"), F.col("content_b").alias("b")).agg(F.count("*").alias("lists"))


def byte_rows(rows: DataFrame) -> DataFrame:
    """(content, row, lost, w) of ``rows(content, text)``: the positional bytes, the words that share a byte with another, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, h = distinct_words(b.column(1))
            code = positional(h)
            words = np.bincount(rec, minlength=b.num_rows)
            fresh = np.ones(len(rec), bool)
            fresh[1:] = (rec[1:] != rec[:-1]) | (code[1:] != code[:-1])
            ends = np.cumsum(np.bincount(rec[fresh], minlength=b.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(code[fresh].view(np.int32)))
            lost = words - np.diff(np.r_[0, ends])
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(lost.astype(np.int32)), b.column(1)], names=["content", "row", "lost", "text"])

    tall = rows.select("content", "text").mapInArrow(run, "content bigint, row array<int>, lost int, text string")
    return tall.select("content", "row", "lost", words_of(F.col("text")).alias("w"))


def similar_contents(rows: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: contents of ``rows(content, blk, text)`` in one block with similarity >= ``t``.

    Between two contents there is one pair, however many records have them.
    """
    common = common_words(rows, F.col("text"))
    posts = rows.select("content", "blk", "text").mapInArrow(_postings(common, t), "key bigint, content bigint, n int, bits bigint")
    stored = lists(posts)
    pairs = materialise(met(stored, t), "candidate-pairs")
    release(stored)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    texts = byte_rows(rows.dropDuplicates(["content"]).join(ends, "content", "left_semi"))
    side = lambda x: texts.select(F.col("content").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("row", "lost", "w")])
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    tally = F.size(F.array_intersect("row_a", "row_b"))
    minimum = F.ceil((F.size("w_a") + F.size("w_b")) * (t / (1 + t)) - 1e-9) - F.least("lost_a", "lost_b")
    shared = F.size(F.array_intersect("w_a", "w_b"))
    return both.filter(tally >= minimum).filter(shared >= t * (F.size("w_a") + F.size("w_b") - shared) - 1e-9).select("a", "b")


def _members(df: DataFrame, key: str, text: Column, block: Column, loaded: Column) -> tuple[DataFrame, DataFrame]:
    """(id, content) of every record that counts, stored, and all rows (content, blk, text)."""
    rows = df.select(F.col(key).alias("id"), text.alias("text"), block.alias("block"), loaded.alias("loaded"))
    rows = rows.filter(F.col("id").isNotNull())
    usable = F.col("block").isNotNull() & F.lower("text").rlike("[a-z0-9]")
    rows = rows.withColumn("content", F.when(usable, F.xxhash64("block", "text")))
    members = rows.groupBy("id").agg(F.max(F.struct("loaded", "content")).alias("m")).select("id", F.col("m.content").alias("content")).filter(F.col("content").isNotNull())
    return materialise(members, "members"), rows.filter(F.col("content").isNotNull()).select("content", F.xxhash64("block").alias("blk"), "text")


def near_duplicates(df: DataFrame, key: str, text: Column, block: Column, loaded: Column, t: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs within a block whose word sets have a Jaccard similarity >= ``t``.

    Contents are told apart by a 64-bit fingerprint of block and text. Postings
    are 28 bytes and shuffled once; the texts of the likely pairs are fetched to
    verify. All pairs are given, also those of equal records, as the question
    is asked; :func:`classes` has one row per record instead.
    """
    members, rows = _members(df, key, text, block, loaded)
    found = similar_contents(rows, t)
    ma, mb = members.select(F.col("id").alias("ia"), F.col("content").alias("a")), members.select(F.col("id").alias("ib"), F.col("content").alias("b"))
    across = found.join(ma, "a").join(mb, "b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    within = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"))
    return across.unionByName(within)


def classes(df: DataFrame, key: str, text: Column, block: Column, loaded: Column, t: float = 0.8) -> DataFrame:
    """(id, class_id, copies, links): one row per record that counts.

    A class are the records of equal block and text, named by its least id;
    ``copies`` are its records, ``links`` the other classes similar to it. The
    pairs of :func:`near_duplicates` are those of every two linked classes and
    those within a class.
    """
    members, rows = _members(df, key, text, block, loaded)
    found = similar_contents(rows, t)
    named = members.groupBy(F.col("content").alias("c")).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    for end in ("a", "b"):  # contents that were loaded over count no longer
        found = found.join(named.select(F.col("c").alias(end)), end, "left_semi")
    links = found.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    known = named.join(links, "c", "left").select("c", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(known, F.col("content") == F.col("c")).select("id", "class_id", "copies", "links")
