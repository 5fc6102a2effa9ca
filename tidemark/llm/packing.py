"""Best-fit packing of token sequences by minimum bin slack.

Only lengths decide a packing, and there are at most `capacity` of them, so the corpus is reduced
to a histogram of lengths. For each bin the longest length left opens it and a subset-sum bitset
over the lengths still available finds the fullest feasible completion; that combination is
removed as often as the counts allow, which is what choosing it bin by bin would give. The pattern
list is bounded by the number of lengths, not by the corpus. Every piece then finds its slot by its
rank among pieces of its length, in a given order of documents or a pseudo-random one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, stored, text_or_empty
from tidemark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTS = 256
_SLICE = 4096
_CHUNK = 32


def pieces_of(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int | None = 1, with_ids: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most `capacity` ids: only longer documents are cut, the last piece may be shorter.

    Null text is empty. A document without ids (no end id, empty text) has no piece. Columns named in
    `order` are kept.
    """
    bounded_batches(docs.sparkSession)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                out: list[list] = [[] for _ in range(6)]
                rows: list[int] = []
                for row, (doc, raw) in enumerate(zip(part.column(0).to_pylist(), encoder(tokenizer_path, "word").encode(part.column(1).to_pylist()), strict=True)):
                    raw += end
                    for k, i in enumerate(range(0, len(raw), step)):
                        ids = raw[i : i + step]
                        rows.append(row)
                        for column, value in zip(out, (doc, k, i // 4, len(ids) // 4, zlib.crc32(ids), ids), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                kept = [part.column(2 + k).take(pa.array(rows, pa.int64())) for k in range(len(order))]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, types, strict=False)], *kept], names=[*names, *order])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *order)
    kept = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in order)
    return source.mapInArrow(cut, PIECES + (", ids binary" if with_ids else "") + kept)


def fullest(room: int, counts: list[tuple[int, int]]) -> dict[int, int]:
    """The fullest combination of (length, count) pairs, longest lengths first, with a sum of at most `room`."""
    full = 1 << room
    mask = (full << 1) - 1
    steps: list[tuple[int, int, int]] = []  # bitset of sums before the step, length, copies in it
    sums = 1
    for length, count in counts:
        if length > room:
            continue
        most, copies = min(count, room // length), 1
        while most > 0:
            take = min(copies, most)
            steps.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
            most, copies = most - take, copies * 2
        if sums & full:
            break
    left, chosen = sums.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + take
            left -= length * take
    return chosen


def minimum_slack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: copies}) patterns that use up the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    patterns: list[tuple[int, dict[int, int]]] = []
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        rest = [(n, left[n] - (n == longest)) for n in lengths if left[n] > (n == longest)]
        chosen = fullest(capacity - longest, rest) if longest < capacity else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[n] // k for n, k in chosen.items())
        patterns.append((bins, chosen))
        for n, k in chosen.items():
            left[n] -= bins * k
        lengths = [n for n in lengths if left[n]]
    return patterns


def pack(pieces: DataFrame, *, capacity: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """Give every piece a sequence_id and an offset; pieces of a sequence lie gapless from 0.

    `pieces` needs doc_id, piece, length and ids_crc32 and is read twice, so pass a stored table.
    Equal rows are separate pieces. An empty table gives an empty result. Pieces of one length are
    ranked in SALTS groups whose sizes are summed, so a length that a third of all pieces share
    never meets in one task. With `order`, columns of which the first is a number without nulls,
    pieces of one length are ranked by them, in groups that are ranges of the first.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, base = [], 0
    used: dict[int, int] = {}
    for bins, chosen in minimum_slack_patterns(histogram, capacity):
        offset = 0
        for length in sorted(chosen, reverse=True):
            copies, first = chosen[length], used.get(length, 0)
            used[length] = first + bins * copies
            slots.append(Row(length=length, first=first, last=first + bins * copies, copies=copies, base=base, place=offset))
            offset += length * copies
        base += bins
    by_length: dict[int, list[Row]] = {}
    for s in slots:
        by_length.setdefault(s.length, []).append(s)
    # slots of a length in chunks, so that a piece looks at the square root of their number
    schema = "length long, chunks array<struct<first: long, last: long, slots: array<struct<length: long, first: long, last: long, copies: long, base: long, place: long>>>>"
    chunks = lambda s: [Row(first=c[0].first, last=c[-1].last, slots=c) for c in (s[i : i + _CHUNK] for i in range(0, len(s), _CHUNK))]
    layout = spark.createDataFrame([(n, chunks(s)) for n, s in by_length.items()], schema)  # bounded by capacity

    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    if order:
        bounds = sorted(set(pieces.approxQuantile(order[0], [i / SALTS for i in range(1, SALTS)], 0.001)))
        salt = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b < F.col(order[0]))) if bounds else F.lit(0)
    salted = pieces.withColumn("_salt", salt)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*order, "doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_salt"])
    placed = ranked.join(F.broadcast(layout), "length").withColumn("_rank", F.col("_rank") + F.col("_before"))
    holds = lambda s: (s.first <= F.col("_rank")) & (F.col("_rank") < s.last)
    placed = placed.withColumn("_slot", F.filter(F.filter("chunks", holds)[0].slots, holds)[0]).withColumn("_in", F.col("_rank") - F.col("_slot.first"))
    return placed.select(
        *[c for c in pieces.columns if c not in order],
        (F.col("_slot.base") + F.floor(F.col("_in") / F.col("_slot.copies"))).cast("long").alias("sequence_id"),
        (F.col("_slot.place") + F.pmod(F.col("_in"), F.col("_slot.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int | None = 1, with_ids: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Tokenise, cut and pack whole documents, pieces of one length by the columns `order`; with_ids keeps each piece's uint32 ids."""
    pieces = stored(pieces_of(docs, tokenizer_path, capacity=capacity, end_id=end_id, with_ids=with_ids, order=order), "pieces")
    return pack(pieces, capacity=capacity, order=order)
