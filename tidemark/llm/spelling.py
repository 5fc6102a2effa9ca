"""Spelling variants by two-dimensional range reporting.

Words are counted in one scan (summed in each task before the shuffle) and those that occur often
enough form the vocabulary. Two words are near when one inserted, deleted or replaced code point
parts them. For a word and an edit position, the words that fit are those of one length that begin
with the word's part before it and end with its part behind it: in forward order the former are an
interval, in reverse order the latter. With each word as the point (forward rank, reverse rank) they
are the points of a rectangle, which a wavelet tree reports without looking at any other.

The vocabulary is dealt by ranges of both orders into shards of some SHARD_WORDS words, each with a
wavelet tree of its own. An edit in the back half of a word is looked up in the shards that its
prefix's interval meets in forward order, one in the front half in those of its suffix's interval in
reverse order; where one of these is wide, the place that parts the halves moves. A shard with many
queries is copied for a share of them each, so no task holds more than a shard and a chunk of
queries, whatever part of the vocabulary shares a beginning or an end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, partitions
from tidemark.sources.storage import Scratch, stored

#: Words of a shard, and queries that one copy of a shard answers.
SHARD_WORDS, SHARD_QUERIES = 50_000, 400_000
#: A task's counts are passed on when it holds so many words; queries are answered in chunks of that many rows or bytes.
_HELD, _CHUNK, _CHUNK_BYTES = 400_000, 1 << 16, 1 << 24
#: Latin-1 codes of letters A-Z (lowered), a-z and U+00C0 to U+00FF; all others part words. Words are handled in Latin-1, whose byte order is that of code points.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 0x20 for b in range(256))
FORWARD, REVERSE = 0, 1


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters in the whole text, A-Z lowered, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def vocabulary(docs: DataFrame, *, min_length: int, min_count: int, typo_every: int = 0) -> DataFrame:
    """(word, n): words of at least min_length code points and min_count occurrences in all texts.

    With typo_every, a run loses one code point where that number divides the crc32 of
    "<doc_id>:<run>" (a null id is empty): a known share of spelling errors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= min_length]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = Counter(runs_of(text))
                if typo_every:
                    start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                    for run, times in list(found.items()):
                        h = zlib.crc32(_utf8(run), start)
                        if h % typo_every == 0:
                            at = h % len(run)
                            found[run] -= times
                            held[run[:at] + run[at + 1 :]] += times
                held.update(found)
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """A wavelet tree over a permutation of 0..n-1, level by level, that reports the points of many rectangles at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []  # bit, zeros before each place, zeros in all
        now = values.astype(np.int64)
        for bit in range(max(1, int(len(now) - 1).bit_length()) - 1, -1, -1):
            zero = (now >> bit & 1) == 0
            before = np.zeros(len(now) + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before, int(before[-1])))
            now = np.concatenate([now[zero], now[~zero]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every point with place in [a, b) and value in [c, d), for each rectangle."""
        which = np.flatnonzero((a < b) & (c < d))
        a, b, c, d, low = a[which], b[which], c[which], d[which], np.zeros(len(which), np.int64)
        for bit, before, zeros in self.levels:
            left, right = before[a], before[b]
            far = np.concatenate([np.zeros(len(a), np.int64), np.full(len(a), 1 << bit)])
            which, c, d, low = np.r_[which, which], np.r_[c, c], np.r_[d, d], np.r_[low, low] + far
            a, b = np.r_[left, zeros + a - left], np.r_[right, zeros + b - right]
            keep = (a < b) & (low < d) & (low + (1 << bit) > c)
            which, a, b, c, d, low = which[keep], a[keep], b[keep], c[keep], d[keep], low[keep]
        return which, low


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8)


def _order(m: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel(), kind="stable")


def _shared(m: np.ndarray) -> np.ndarray:
    """How many bytes each sorted row shares with the one before it."""
    same = m[1:] == m[:-1]
    return np.r_[0, np.where(same.all(1), m.shape[1], same.argmin(1))]


class _Side:
    """Words of one length among queries, in one order: the interval of those words that share a query's first bytes."""

    def __init__(self, m: np.ndarray, is_word: np.ndarray) -> None:
        self.order = _order(m)
        self.shared = _shared(m[self.order])
        self.rank = np.empty(len(m), np.int64)
        self.rank[self.order] = np.arange(len(m))
        self.words_before = np.r_[0, np.cumsum(is_word[self.order])]

    def intervals(self, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ranks, among the words, of those with the same first `depth` bytes."""
        first = self.shared < depth
        first[0] = True
        starts = np.flatnonzero(first)
        group = (np.cumsum(first) - 1)[self.rank[rows]]
        ends = np.r_[starts[1:], len(first)]
        return self.words_before[starts[group]], self.words_before[ends[group]]


def _reach(queries: np.ndarray, words: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The most first bytes that each query shares with another of the sorted words; `at` is its rank among them, held if it is one."""
    out = np.zeros(len(queries), np.int64)
    for beside in (at - 1, at + held):
        there = np.flatnonzero((beside >= 0) & (beside < len(words)))
        differ = queries[there] != words[beside[there]]
        out[there] = np.maximum(out[there], np.where(differ.any(1), differ.argmax(1), queries.shape[1]))
    return out


class Shard:
    """The words of one shard: a wavelet tree for each length, over forward and reverse ranks."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.of: dict[int, tuple[list[bytes], np.ndarray, WaveletTree, np.ndarray]] = {}
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            lengths.setdefault(len(w), []).append(i)
        for size, at in lengths.items():
            mine = sorted((words[i], counts[i]) for i in at)
            m = _matrix([w for w, _ in mine], size)
            backwards = _order(m[:, ::-1])
            rank = np.empty(len(mine), np.int64)
            rank[backwards] = np.arange(len(mine))
            self.of[size] = ([w for w, _ in mine], np.array([n for _, n in mine], np.int64), WaveletTree(rank), backwards)

    def near(self, target: int, queries: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) indices: words of length `target` that replacing or deleting one code point of a query
        at a place in [low, high) can give; deleting either of two equal neighbours counts for the first."""
        if target not in self.of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, _, tree, backwards = self.of[target]
        sizes = np.fromiter(map(len, queries), np.int64, len(queries))
        width, many = target + 1, len(words)
        m = np.concatenate([_matrix(words, width), _matrix(queries, width)])
        turned = np.concatenate([_matrix([w[::-1] for w in words], width), _matrix([w[::-1] for w in queries], width)])
        is_word = np.arange(len(m)) < many
        forward, reverse = _Side(m, is_word), _Side(turned, is_word)
        # the query itself may be among the words; it is in both of its intervals and replaces nothing
        itself, beyond = forward.intervals(width, many + np.arange(len(queries)))
        held = (beyond > itself).astype(np.int64)
        # places whose part before and part behind another word has too
        high = np.minimum(high, 1 + _reach(m[many:], m[:many], itself, held))
        low = np.maximum(low, sizes - 1 - _reach(turned[many:], turned[backwards], reverse.intervals(width, many + np.arange(len(queries)))[0], held))
        asked, given = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cut in (target, target + 1):  # replaced, deleted
            own = np.flatnonzero((sizes == cut) & (low < high))
            for at in range(low[own].min(initial=cut), high[own].max(initial=0)):
                rows = own[(low[own] <= at) & (at < high[own])]
                if cut > target and at:
                    rows = rows[m[many + rows, at] != m[many + rows, at - 1]]
                a, b = forward.intervals(at, many + rows)
                some = b - a > held[rows]
                rows, a, b = rows[some], a[some], b[some]
                if not len(rows):
                    continue
                c, d = reverse.intervals(cut - 1 - at, many + rows)
                which, value = tree.report(a, b, c, np.where(d - c > held[rows], d, c))
                q, w = rows[which], backwards[value]
                other = (held[q] == 0) | (w != itself[q])
                asked.append(q[other])
                given.append(w[other])
        return np.concatenate(asked), np.concatenate(given)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Dealing:
    """Where queries go: the number, and the first and last word as (length, word), of every shard of one order."""

    def __init__(self, names: list[int], firsts: list[tuple[int, bytes]], lasts: list[tuple[int, bytes]]) -> None:
        self.names, self.firsts, self.lasts = names, firsts, lasts

    def met(self, key: bytes, target: int, least: int) -> list[tuple[int, int]]:
        """(shard, depth): each shard that may hold words of length `target` with the key's first `depth` bytes, for a depth of `least` or more.

        A shard that the key itself falls in has the depth of the whole key.
        """
        home = max(0, bisect_right(self.firsts, (target, key)) - 1)
        out = [(self.names[home], len(key))]
        for step in (1, -1):
            shard = home + step
            while 0 <= shard < len(self.firsts):
                size, edge = self.firsts[shard] if step > 0 else self.lasts[shard]
                depth = _common(key, edge) if size == target else -1
                if depth < least:
                    break
                out.append((self.names[shard], depth))
                shard += step
        return out


def _dealt(forward: Dealing, reverse: Dealing, word: bytes, target: int) -> Iterator[tuple[int, int, int, int]]:
    """(order, shard, low, high): the shards where a word's edits to length `target` are looked up, each with the places of those edits."""
    n = len(word)
    half, turned = n // 2, word[::-1]
    front = forward.met(word, target, half)
    back = reverse.met(turned, target, n - half)
    if len(front) + len(back) > 2:  # wide: the parting place with the fewest lookups
        front, back = forward.met(word, target, 0), reverse.met(turned, target, 0)
        depths, turned_depths = sorted(d for _, d in front), sorted(d for _, d in back)
        half = min(range(n + 1), key=lambda p: (len(front) - bisect_right(depths, p - 1) if p < n else 0) + (len(back) - bisect_right(turned_depths, n - p - 1) if p else 0))
    for shard, depth in front:
        if depth >= half and half < n:
            yield FORWARD, shard, half, min(n, depth + 1)
    for shard, depth in back:
        if depth >= n - half and half:
            yield REVERSE, shard, max(0, n - 1 - depth), half


def near_words(words: DataFrame, *, shard_words: int = SHARD_WORDS, shard_queries: int = SHARD_QUERIES) -> DataFrame:
    """(word, near, near_n) for a vocabulary (word, n) of Latin-1 words: each word with every word one code point apart, in both directions."""
    spark = words.sparkSession
    work = Scratch(spark, "spelling")
    raw = F.encode("word", "ISO-8859-1")
    rows = work.stored(words.select("word", "n", F.length("word").alias("size"), raw.alias("raw")), "vocabulary")
    shards = max(1, -(-rows.count() // shard_words))
    tables, dealings = [], []
    for order, key in ((FORWARD, F.col("raw")), (REVERSE, F.encode(F.reverse("word"), "ISO-8859-1"))):
        dealt = rows.withColumn("key", key).repartitionByRange(shards, "size", "key").withColumn("part", F.spark_partition_id())
        table = work.stored(dealt, f"order-{order}")
        edges = table.groupBy("part").agg(F.min(F.struct("size", "key")).alias("first"), F.max(F.struct("size", "key")).alias("last")).orderBy("part").collect()  # a row for each shard
        tables.append((order, table))
        dealings.append(([e.part for e in edges], *[[(e[x].size, bytes(e[x].key)) for e in edges] for x in ("first", "last")]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, reverse = Dealing(*dealings[FORWARD]), Dealing(*dealings[REVERSE])
        shortest = forward.firsts[0][0] if forward.firsts else 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for raw_, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for target in (len(raw_), len(raw_) - 1) if len(raw_) > shortest else (len(raw_),):
                    for order, shard, low, high in _dealt(forward, reverse, raw_, target):
                        for column, value in zip(out, (order, shard, raw_, n, target, low, high), strict=True):
                            column.append(value)
            types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["order", "shard", "raw", "n", "target", "low", "high"])

    schema = "order int, shard int, raw binary, n long, target int, low int, high int"
    queries = work.stored(rows.select("raw", "n").mapInArrow(deal, schema), "queries")
    crowded = work.stored(queries.groupBy("order", "shard").agg(F.ceil(F.count("*") / F.lit(shard_queries)).cast("int").alias("copies")).where("copies > 1"), "crowded")  # some of the shards
    shared = lambda df: df.join(crowded, ["order", "shard"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    home = lambda copy: F.concat_ws("-", "order", "shard", copy).alias("home")
    asked = shared(queries).select(home(F.pmod(F.xxhash64("raw"), F.col("copies"))), F.lit(True).alias("query"), "raw", "n", "target", "low", "high")
    parts = asked
    for order, table in tables:
        each = shared(table.select(F.lit(order).alias("order"), F.col("part").alias("shard"), "raw", "n")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        parts = parts.unionByName(each.select(home("copy"), F.lit(False).alias("query"), "raw", "n", *[F.lit(0).alias(c) for c in ("target", "low", "high")]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by home, a shard's words before its queries; holds one shard and a chunk of queries."""
        home_now: str | None = None
        held: list[tuple[bytes, int]] = []
        shard: Shard | None = None
        waiting: list[pa.Table] = []
        rows_waiting = bytes_waiting = 0

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, rows_waiting, bytes_waiting
            asked_ = pa.concat_tables(waiting)
            waiting, rows_waiting, bytes_waiting = [], 0, 0
            target, low, high = (asked_.column(c).to_numpy() for c in ("target", "low", "high"))
            raw_, n = asked_.column("raw").to_pylist(), asked_.column("n").to_numpy()
            for size in np.unique(target):
                rows_ = np.flatnonzero(target == size)
                words_, counts = shard.of.get(int(size), ([], np.zeros(0, np.int64)))[:2]
                q, w = shard.near(int(size), [raw_[i] for i in rows_], low[rows_], high[rows_])
                if len(q):
                    ask = rows_[q]
                    one, other = [raw_[i].decode("latin-1") for i in ask], [words_[j].decode("latin-1") for j in w]
                    cut = np.fromiter((len(raw_[i]) > size for i in ask), bool, len(ask))  # the shorter word finds the longer one through it
                    turned = np.flatnonzero(cut)
                    yield pa.RecordBatch.from_arrays([pa.array(one + [other[i] for i in turned]), pa.array(other + [one[i] for i in turned]), pa.array(np.r_[counts[w], n[ask][turned]])], names=["word", "near", "near_n"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            homes = np.array(batch.column(0).to_pylist(), object)
            if not len(homes):
                continue
            starts = np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]])
            for a, b in zip(starts, [*starts[1:], len(homes)], strict=True):
                if homes[a] != home_now:
                    if waiting:
                        yield from answered()
                    home_now, held, shard = homes[a], [], None
                part = table.slice(a, b - a)
                own, ask = part.filter(pc.invert(part.column("query"))), part.filter(part.column("query"))
                held += zip(own.column("raw").to_pylist(), own.column("n").to_pylist(), strict=True)
                if ask.num_rows:
                    if shard is None:
                        shard, held = Shard([w for w, _ in held], [n for _, n in held]), []
                    waiting.append(ask)
                    rows_waiting += ask.num_rows
                    bytes_waiting += ask.nbytes
                    if rows_waiting >= _CHUNK or bytes_waiting >= _CHUNK_BYTES:
                        yield from answered()
        if waiting:
            yield from answered()

    extra = crowded.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).head().n
    together = parts.repartition(max(partitions(spark), 2 * shards + extra), "home").sortWithinPartitions("home", "query", "raw")
    found = stored(together.mapInArrow(answer, "word string, near string, near_n long"), "near-words")
    work.drop()
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): the last word that following forms leads to. A form has more occurrences than its word, so there is no circle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").limit(1).count() == 0:
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, *, min_length: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int = 0, shard_words: int = SHARD_WORDS, shard_queries: int = SHARD_QUERIES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least min_length code points and min_count occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of the whole texts with A-Z lowered. A
    word's form is its near word (one code point inserted, deleted or replaced) of most occurrences,
    ties to the first in code-point order, if those are at least `ratio` times its own, else null;
    root follows forms to the last. Null and empty texts have no words; repeated rows and texts count
    each time. A null doc_id counts as an empty one for typo_every. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in a circle")
    bounded_batches(docs.sparkSession)
    words = stored(vocabulary(docs, min_length=min_length, min_count=min_count, typo_every=typo_every), "words")
    near = near_words(words, shard_words=shard_words, shard_queries=shard_queries)
    best: Column = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    summed = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    far = -F.col("best.m") >= ratio * F.col("n")
    told = words.join(summed, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    told = stored(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
