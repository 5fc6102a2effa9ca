"""Passages that repeat across documents, by a sparse suffix array.

A suffix is retained where a document's minimiser lies: the smallest hash among `window` successive
word n-grams, so the same passage retains the same suffixes wherever it stands. Any passage of
min_words words holds a retained suffix that still covers `core` = min_words - window + 1 words of
it. Suffixes are ordered by their first `core` words (as a hash); neighbours of different documents
with the same core share it.

A suffix answers for the passages of min_words words whose first minimiser it is, wherever they
stand. Its match is extended left and right over all of them at once; where a neighbour has the same
extension, every one of these passages repeats. Where none has (a stretch begins or ends there, or
its halves belong to different partners), each passage is compared by itself, with d words left of
the suffix and the rest right of it. So what is reported is shared with one partner from end to end
of each passage, and ends are exact.

Whether a key has two owners is found by the least and the greatest owner, summed before any
shuffle, and a join brings that back; no key's rows meet in one task, however frequent it is.
Documents with the same words form one class; a class of several documents repeats as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, stored
from tidemark.sources.storage import Scratch

_STEP, _MIX, _HALF = np.uint64(0x9E3779B97F4A7C1F), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_BACK = np.uint64(pow(0x9E3779B97F4A7C1F, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, parted by ASCII white space; case and marks count."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def print_of(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if len(_POWERS.get(name, ())) <= n:
        with np.errstate(over="ignore"):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)])
    return _POWERS[name]


class Rolling:
    """Hashes of any stretch of a text's words, from sums of the words' hashes times powers of a fixed number."""

    def __init__(self, words: list[bytes]) -> None:
        import xxhash

        n = len(words)
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(one * _powers("back", _BACK, n)[:n])]
        self.up = _powers("step", _STEP, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = (self.sums[end] - self.sums[start]) * self.up[start]
            out = (out ^ (out >> _HALF)) * _MIX + (end - start).astype(np.uint64)
            out = (out ^ (out >> _HALF)) * _STEP
        return out ^ (out >> _HALF)


def retained(rolling: Rolling, n: int, min_words: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, last): the retained suffixes of n words, and the first and last start of the passages each answers for."""
    at = np.arange(n - gram + 1)
    grams = rolling.of(at, at + gram)
    starts = np.arange(n - min_words + 1)
    places = np.lib.stride_tricks.sliding_window_view(grams, window)[: len(starts)].argmin(1) + starts
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return places[first], first, np.r_[first[1:], len(starts)] - 1


def _shared(rows: DataFrame, key: str, also: str = "false") -> DataFrame:
    """The keys that rows of two classes have; partial sums leave a row for each key and task."""
    owner = F.xxhash64("fp")
    return rows.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"), F.max(F.expr(also)).alias("_also")).where("_lo <> _hi or _also").select(key)


def repeated_passages(docs: DataFrame, *, min_words: int = 50, gram: int = 16, window: int = 16) -> DataFrame:
    """doc_id, start_word, end_word, n_words: the words that lie in passages which repeat in another document.

    A passage is min_words words or more that a text shares with one other text from end to end;
    passages that touch or overlap are given as one stretch, which need not repeat as a whole. Only repeats across rows count, not those inside one text. Null and
    empty texts have none. Repeated rows and equal texts are repeats of each other. Other columns are
    not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    core = min_words - window + 1
    if core < gram:
        raise ValueError("min_words must be at least gram + window - 1")
    work = Scratch(spark, "passages")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([print_of(w) for w in words], pa.binary()), pa.array(list(map(len, words)), pa.int32())], names=["doc_id", "fp", "n_words"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each retained suffix: the core's hash, the hash of its full extension, and that extension's ends."""
        seen: set[bytes] = set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            prints: list[bytes] = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if len(words) < min_words or (fp := print_of(words)) in seen:
                    continue
                seen.add(fp)
                rolling = Rolling(words)
                at, first, last = retained(rolling, len(words), min_words, gram, window)
                for column, value in zip(columns, (rolling.of(at, at + core).view(np.int64), rolling.of(first, last + min_words).view(np.int64), first.astype(np.int32), (last - first).astype(np.int8)), strict=True):
                    column.append(value)
                prints += [fp] * len(at)
            if prints:
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in columns], pa.array(prints, pa.binary())], names=["h", "whole", "first", "more", "fp"])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each marked suffix: the hash of every passage it answers for."""
        for batch in batches:
            keys, starts, prints = [], [], []
            sure: list[np.ndarray] = []
            for text, fp, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = words_of(text)
                if print_of(words) != fp:  # another row with the same id
                    continue
                sizes = np.array([m["more"] + 1 for m in marks])
                at = np.repeat([m["first"] for m in marks], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keys.append(Rolling(words).of(at, at + min_words).view(np.int64))
                starts.append(at.astype(np.int32))
                sure.append(np.repeat([m["sure"] for m in marks], sizes))
                prints += [fp] * len(at)
            if prints:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(starts)), pa.array(prints, pa.binary()), pa.array(np.concatenate(sure))], names=["passage", "first", "fp", "sure"])

    rows = stored(source.mapInArrow(scan, "doc_id long, fp binary, n_words int"), "texts")
    classes = work.stored(rows.where(F.col("n_words") >= min_words).groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")), "classes")
    every = work.stored(source.select("text").mapInArrow(suffixes, "h long, whole long, first int, more tinyint, fp binary"), "suffixes")
    # keys are stored tables and results are dealt by other columns, so that a join may split a key of very many rows
    keys = work.stored(_shared(every, "h"), "keys")
    met = every.join(keys.hint("merge"), "h", "left_semi")
    hits = work.stored(met.groupBy("fp", "first").agg(*[F.first(c).alias(c) for c in ("h", "whole", "more")]), "hits")  # text and place tell the rest
    keys = work.stored(_shared(hits, "whole").withColumn("extends", F.lit(True)), "keys")
    told = work.stored(hits.join(keys.hint("merge"), "whole", "left").withColumn("extends", F.coalesce("extends", F.lit(False))), "extended")

    # those that no neighbour extends in full, and against them one of each extension that several classes have
    open_ = work.stored(told.where("not extends").select("h").distinct(), "keys")
    others = told.where("extends").join(open_, "h", "left_semi").groupBy("whole").agg(F.min(F.struct("fp", "first", "more")).alias("m")).select("m.*", F.lit(True).alias("sure"))
    marks = told.where("not extends").select("fp", "first", "more", F.lit(False).alias("sure")).unionByName(others).groupBy("fp").agg(F.collect_list(F.struct("first", "more", "sure")).alias("marks"))  # at most a document's own suffixes
    marked = work.stored(marks.join(classes.select("fp", "first_doc"), "fp"), "marks")
    named = source.join(marked.withColumnRenamed("first_doc", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")))
    ends = work.stored(named.select("text", "fp", "marks").mapInArrow(passages, "passage long, first int, fp binary, sure boolean"), "ends")
    keys = work.stored(_shared(ends, "passage", "sure"), "keys")
    single = ends.where("not sure").join(keys.hint("merge"), "passage", "left_semi")

    near = told.where("extends").select("fp", F.col("first").alias("a"), (F.col("first") + F.col("more") + min_words).alias("b"))
    alone = classes.where("copies = 1").select("fp")  # what has copies repeats as a whole
    reach = near.unionByName(single.select("fp", F.col("first").alias("a"), (F.col("first") + min_words).alias("b"))).join(alone, "fp", "left_semi").distinct()
    before = Window.partitionBy("fp").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("fp").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    opened = reach.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(upto))
    spans = opened.groupBy("fp", "nth").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word")).select("fp", "start_word", "end_word")
    whole = classes.where("copies > 1").select("fp", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"))
    found = stored(whole.unionByName(spans), "spans")
    work.drop()
    return rows.join(found, "fp").select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), F.col("n_words").cast("long").alias("n_words"))
