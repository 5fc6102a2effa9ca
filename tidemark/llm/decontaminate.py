"""Benchmark decontamination by an Aho-Corasick automaton over normalised words.

Benchmark texts (questions and answers) and documents are normalised alike: A-Z lowered, words are
runs of letters, digits and characters beyond ASCII. Every `window` consecutive words of an item are
one pattern; an item of fewer words is a pattern by itself. All patterns go into one automaton whose
symbols are word numbers, so a scan reads each document's words once, whatever the number of
patterns, and every match ends at a word. Matched words are mapped back to code points of the
original text.

The automaton is sent to the tasks while the benchmark has at most BLOCK_PATTERNS patterns with
their items. A larger benchmark is dealt to several automata of that size by a hash; the documents
are then scanned once for each, and what they hit is put together by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.sources.storage import Scratch, stored

#: Patterns, each with an item, that one automaton holds: some 250 MB in a task at ten words each.
BLOCK_PATTERNS = 250_000
#: Everything between words is blank; bytes of characters beyond ASCII stay.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_ORIGINAL_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of the whole text, in order."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKED).split() if text else []


def patterns_of(benchmark: DataFrame, window: int, item: str = "item_id") -> DataFrame:
    """(pattern, item): each distinct window of an item, as its words joined by blanks; an item without words has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = words_of(text)
                found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([name] * len(found), pa.string())], names=["pattern", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "pattern binary, item string").distinct()


class Automaton:
    """Aho-Corasick over word numbers; a word that no pattern holds is number 0 and breaks every match."""

    def __init__(self, patterns: list[bytes], items: list[str | None]) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []  # items of each distinct pattern
        self.sizes: list[int] = []
        places: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for pattern, name in zip(patterns, items, strict=True):
            at = places.setdefault(pattern, len(places))
            if at == len(self.items):
                words = pattern.split(b" ")
                self.items.append([])
                self.sizes.append(len(words))
                self.machine.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), at)
            if name is not None:
                self.items[at].append(name)
        if places:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of hit words (start, end), merged and in order, and the items that occur."""
        if not self.items:
            return [], set()
        found = list(self.machine.iter(tuple(map(self.numbers.get, words, repeat(0)))))
        names = set(chain.from_iterable(self.items[p] for p in {p for _, p in found}))
        return merged((end + 1 - self.sizes[p], end + 1) for end, p in found), names


def merged(stretches: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, stretches: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code points of the original text from the first to the last word of each stretch."""
    if not stretches:
        return []
    at = np.array([m.span() for m in _ORIGINAL_WORD.finditer(text)])
    return [{"start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in stretches]


def _scanned(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with its digest, what the patterns hit in it, and the hit words' stretches."""
    held = patterns.toArrow()  # one block
    share = docs.sparkSession.sparkContext.broadcast((held.column("pattern").to_pylist(), held.column("item").to_pylist()))
    built: list[Automaton] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Automaton(*share.value))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [(len(w), *built[0].scan(w)) for w in map(words_of, texts)]
            hits = pa.array([[{"a": a, "b": b} for a, b in s] for _, s, _ in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            spans = pa.array([original_spans(t, s) for t, (_, s, _) in zip(texts, rows, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            values = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sum(b - a for a, b in s) for _, s, _ in rows], pa.int64()), pa.array([sorted(n) for _, _, n in rows], pa.list_(pa.string())), spans, hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=["doc_id", "digest", "n_words", "n_hit", "items", "spans", "hits"])

    return docs.mapInArrow(scan, f"doc_id long, digest string, {RESULT}, hits array<struct<a: int, b: int>>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans of every row of docs: whole texts against all benchmark texts.

    A word is hit when it lies in any occurrence of a pattern. items are the distinct item_ids whose
    patterns occur, sorted as strings; spans are the hit stretches in code points of the original.
    Null and empty texts have no words. Repeated rows give equal rows. An item without an id marks
    words but is not named; rows that repeat an item_id are one item. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    patterns = stored(patterns_of(benchmark, window), "patterns")
    blocks = max(1, -(-patterns.count() // block_patterns))
    text = F.col("text").cast("string")
    several = F.md5(F.coalesce(text, F.lit("")).cast("binary")) if blocks > 1 else F.lit(None).cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), several.alias("digest"), text.alias("text"))
    if blocks == 1:
        return _scanned(source, patterns).drop("digest", "hits")

    # rows equal in id and text have equal hits, so they are put together by these two
    work = Scratch(spark, "contamination")
    parts = []
    for k in range(blocks):
        block = patterns.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k)
        found = _scanned(source, block)
        parts.append(work.stored(found if k == 0 else found.where("n_hit > 0"), f"block-{k}"))
    every = parts[0]
    hits = every.where("n_hit > 0")
    for part in parts[1:]:
        hits = hits.unionByName(part)
    once = hits.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.explode_outer("items").alias("item"), "hits", "spans")
    named = once.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.arrays_zip("hits", "spans")).alias("sets"))  # of one text

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for sets in batch.column(3).to_pylist():
                every_one = [x for s in sets for x in s]
                n_hit.append(sum(b - a for a, b in merged((x["hits"]["a"], x["hits"]["b"]) for x in every_one)))
                # stretches of words that touch are parted by their separators in the text
                joined = merged((x["hits"]["a"], x["hits"]["b"]) for x in every_one)
                start, end = {x["hits"]["a"]: x["spans"]["start"] for x in every_one}, {x["hits"]["b"]: x["spans"]["end"] for x in every_one}
                spans.append([{"start": start[a], "end": end[b]} for a, b in joined])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["_id", "_digest", "items", "n_hit", "spans"])

    whole = work.stored(named.mapInArrow(together, "_id long, _digest string, items array<string>, n_hit long, spans array<struct<start: int, end: int>>"), "whole")
    joined = every.select("doc_id", "digest", "n_words").join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    nothing = F.array().cast("array<string>"), F.array().cast("array<struct<start: int, end: int>>")
    out = joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing[0]).alias("items"), F.coalesce("spans", nothing[1]).alias("spans"))
    out = stored(out, "contamination")
    work.drop()
    return out
