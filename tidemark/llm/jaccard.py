"""Exact Jaccard self-join of documents on word n-grams.

1. A scan gives each document's set of 64-bit shingle hashes, its 128-bit fingerprint (documents
   with equal sets form one class) and adds every hash to a fixed-size table of counts.
2. A second scan orders each set rare-first by those counts and emits the prefix that any partner
   must meet (prefix filter). Postings are sorted by token, rarest places first; one streaming pass
   drops those that fit no other of their list by length and position and gives every posting the
   leading one of its list.
3. Postings give candidate pairs under the length and positional filters. First each class meets
   the leading class of its lists (few pairs however large a group of copies is); linked pairs are
   merged into components. Then come all pairs of a list whose ends are still in different
   components, each a class outside the list's largest component with any other. A pair inside a
   component can add nothing to it.
4. Each candidate pair is tested once: the suffix filter bounds the overlap by the counts of hash
   ranges of both sets (some 16 hashes a range, halved alike), what remains is compared set against set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, partitions, stored, unused
from tidemark.operators.components import connected_components
from tidemark.sources.storage import Scratch

BUCKETS = 1 << 20
_CHUNK = 1 << 14
_RANGES, _IN_RANGE = 32, 16
_LONG = 64
BITS = 1 << 25
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHUT = np.uint64(32)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct uint64 hashes of the text's word shingles: A-Z lowered, words parted by ASCII white space.

    Fewer than `size` words count as one shingle; no words give none.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    many = one[: len(one) - width + 1] + np.uint64(width)
    with np.errstate(over="ignore"):
        for k in range(1, width):
            many = many * _STEP + one[k : len(one) - width + 1 + k]
        many = (many ^ (many >> _SHUT)) * _MIX
    return np.unique(many ^ (many >> _SHUT))


def fingerprint(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def short_key(fp: bytes) -> int:
    """The class key of postings, equal to the built-in xxhash64(fp). Two classes share one with a chance of 2 ** -64."""
    import xxhash

    return int.from_bytes(xxhash.xxh64(fp, seed=42).digest(), "big", signed=True)


def range_counts(hashes: np.ndarray) -> bytes:
    """Counts (255 at most) of the hashes in equal ranges: 32, doubled while a range would hold more than 16 on average."""
    ranges = _RANGES
    while len(hashes) > _IN_RANGE * ranges:
        ranges *= 2
    where = (hashes >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(where, minlength=ranges), 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many hashes two sets do not share, from their range counts; the finer ranges are joined to the coarser ones."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        if (b == 255).any():  # a cut count says nothing of a sum
            return 0
        b = b.reshape(len(a), -1).sum(1)
        b = np.where(a == 255, np.minimum(b, 255), b)
    return int(np.abs(a - b).sum())


def _binary(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.binary())


def bit_set(keys: DataFrame) -> np.ndarray:
    """A table of BITS bits, whatever the corpus holds, in which the hashes in column `bit` are set.

    It only spares rows a shuffle: a row whose bit is set is then joined exactly.
    """
    at = F.col("bit").bitwiseAND(BITS - 1)
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit & {63} as int))")).alias("m")).toArrow()  # BITS / 64 rows at most
    out = np.zeros(BITS >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def is_set(bits: np.ndarray, hashes: pa.Array) -> np.ndarray:
    at = hashes.to_numpy() & (BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def scan_sets(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, fp, ranges) for every document, and counts of all shingle hashes in BUCKETS buckets."""
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(BUCKETS, np.int64), [], 0
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "n", "fp", "ranges", "chunk", "counts"]
        for batch in batches:
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            rows = len(found)
            ranges = list(map(range_counts, found))
            values = [batch.column(0), [len(h) for h in found], [fingerprint(h) for h in found], ranges, [None] * rows, [None] * rows]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)
            waiting += found
            held += sum(map(len, found))
            if held > BUCKETS:
                counts += np.bincount((np.concatenate(waiting) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                waiting, held = [], 0
        if waiting:
            counts += np.bincount((np.concatenate(waiting) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        if counts.any():
            import zstandard

            press = zstandard.ZstdCompressor(level=1)
            chunks = range(BUCKETS // _CHUNK)
            parts = [press.compress(counts[c * _CHUNK : (c + 1) * _CHUNK].tobytes()) for c in chunks]
            nothing = [None] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([nothing, nothing, nothing, nothing, list(chunks), parts], types, strict=True)], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(unpress.decompress(data), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _binary([c.tobytes() for c in total.values()])], names=["chunk", "counts"])

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, n int, fp binary, ranges binary, chunk int, counts binary"), "sets")
    merged = rows.where("chunk is not null").select("chunk", "counts").repartition(min(64, partitions(spark)), "chunk").mapInArrow(summed, "chunk int, counts binary")
    counts = np.zeros(BUCKETS, np.int64)
    for row in merged.collect():  # BUCKETS numbers, whatever the corpus holds
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.int64)
    return rows.where("chunk is null").select("doc_id", "n", "fp", "ranges"), counts


LISTED = "token long, key long, n int, pos int, lead_key long, lead_n int, lead_pos int"


def with_leads(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, n, pos) sorted by token, pos, n, key: each once, with the first of its token, where another row of the token may link with it.

    The filters are tried on all pairs of a list of up to 64 rows; of a longer one every row stays.
    No more than a batch and 64 rows are held, however long a list is.
    """

    def fits(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
        need = -(-num * (n1 + n2) // (num + den))
        return (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= need)

    def out(rows: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
        whole = [0, 1, 4]
        values = [*rows, *heads]
        return pa.RecordBatch.from_arrays([pa.array(v if i in whole else v.astype(np.int32)) for i, v in enumerate(values)], names=["token", "key", "n", "pos", "lead_key", "lead_n", "lead_pos"])

    held = np.empty((4, 0), np.int64)  # a list that may go on
    long: np.ndarray | None = None  # first row of a long list of which rows went out
    last: np.ndarray | None = None

    def settled(rows: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, long
        token = rows[0]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        end = len(token)
        if more:  # the last list may go on
            end = starts[-1]
            held = rows[:, end:]
            if sizes[-1] > _LONG:
                long, held, end = held[:, 0], held[:, :0], len(token)
        keep = np.zeros(len(token), bool)
        keep[np.repeat(sizes > _LONG, sizes)] = True
        left = np.repeat(starts + sizes, sizes) - np.arange(len(token))  # rows of the list from each on
        small = np.flatnonzero(~keep)
        for d in range(1, _LONG):
            small = small[left[small] > d]
            if not len(small):
                break
            good = small[fits(rows[2, small], rows[3, small], rows[2, small + d], rows[3, small + d])]
            keep[good] = keep[good + d] = True
        keep[end:] = False
        heads = rows[1:, np.repeat(starts, sizes)]
        yield out(rows[:, keep], heads[:, keep])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.array([c.to_numpy().astype(np.int64) for c in batch.columns])
        fresh = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]
        fresh[0] = last is None or bool((rows[:, 0] != last).any())
        last = rows[:, -1]
        rows = rows[:, fresh]
        if long is not None:
            same = rows[0] == long[0]
            yield out(rows[:, same], np.repeat(long[1:, None], int(same.sum()), axis=1))
            rows = rows[:, ~same]
            if rows.shape[1]:
                long = None
        rows = np.concatenate([held, rows], axis=1)
        if rows.shape[1]:
            held = held[:, :0]
            yield from settled(rows, True)
    if held.shape[1]:
        yield from settled(held, False)


def prefix_postings(work: Scratch, docs: DataFrame, counts: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """The rare-first prefix of each class as (token, key, n, pos) with the leading row of its token's list, where it may link with another class of the list."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))  # fixed size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rank = ranks.value
        for batch in batches:
            tokens, places, prints, sizes = [], [], [], []
            for text in batch.column(0).to_pylist():
                h = shingles(text, size)
                n = len(h)
                if not n or (fp := fingerprint(h)) in seen:
                    continue
                seen.add(fp)
                keep = n - -(-num * n // den) + 1
                r = rank[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                if keep < n:  # all that could be among the first, ties included, then in full order
                    few = np.flatnonzero(r <= np.partition(r, keep - 1)[keep - 1])
                    h, r = h[few], r[few]
                tokens.append(h[np.lexsort((h, r))][:keep].view(np.int64))
                places.append(np.arange(keep, dtype=np.int32))
                prints.append(np.full(keep, short_key(fp)))
                sizes.append(np.full(keep, n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(prints)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "key", "n", "pos"])

    source = docs.select(F.col("text").cast("string").alias("text"))
    rows = source.mapInArrow(prefixes, "token long, key long, n int, pos int").repartition(partitions(spark), "token").sortWithinPartitions("token", "pos", "n", "key")
    return work.stored(rows.mapInArrow(lambda b: with_leads(b, num, den), LISTED), "postings")


def _overlap(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Least common size of linked sets: ceil(num (n1 + n2) / (num + den))."""
    return F.ceil(num * (n1 + n2) / F.lit(float(num + den)) - F.lit(1e-9))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length and positional filters: from the first common token on, both sets must hold enough tokens."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= _overlap(na, nb, num, den))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.key", "b.key").alias("ka"), F.greatest("a.key", "b.key").alias("kb")).distinct()


def verified(work: Scratch, pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class fingerprints whose sets are linked, of candidates (ka, kb)."""

    def ranges_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, na, nb, ra, rb = batch.columns
            total = na.to_numpy().astype(np.int64) + nb.to_numpy()
            need = -(-num * total // (num + den))
            differ = np.fromiter(map(least_difference, ra.to_pylist(), rb.to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([ka, kb], names=["ka", "kb"]).filter(pa.array(differ <= total - 2 * need))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(1).filter(pa.array(is_set(bits.value, batch.column(0))))
            found = {fingerprint(h): h for h in (shingles(t, size) for t in texts.to_pylist())}
            fresh = [fp for fp in found if fp not in seen]
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays([_binary(fresh), _binary([found[fp].tobytes() for fp in fresh])], names=["fp", "hashes"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = lambda end: classes.select(F.col("key").alias(f"k{end}"), F.col("n").alias(f"n{end}"), F.col("ranges").alias(f"r{end}"))
    few = work.stored(pairs.join(one("a"), "ka").join(one("b"), "kb").select("ka", "kb", "na", "nb", "ra", "rb").mapInArrow(ranges_fit, "ka long, kb long"), "near")
    named = lambda end: classes.select(F.col("key").alias(f"k{end}"), F.col("fp").alias(end))
    near = work.stored(few.join(named("a"), "ka").join(named("b"), "kb").select("a", "b"), "near")
    ends = near.select(F.col("a").alias("fp")).union(near.select(F.col("b").alias("fp"))).distinct()
    needed = work.stored(ends.join(classes.select("fp", "first_doc"), "fp"), "ends")
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(needed.select(F.xxhash64("first_doc").alias("bit"))))  # fixed size
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("bit"), F.col("text").cast("string").alias("text"))
    # a class may come once for each task, and one that was not asked for too; the joins pass over that
    hashed = work.stored(texts.mapInArrow(sets, "fp binary, hashes binary"), "needed")
    both = near.join(hashed.select(F.col("fp").alias("a"), F.col("hashes").alias("ha")), "a").join(hashed.select(F.col("fp").alias("b"), F.col("hashes").alias("hb")), "b")
    return work.stored(both.select("a", "b", "ha", "hb").mapInArrow(linked, "a binary, b binary"), "links")


def near_duplicate_classes(docs: DataFrame, *, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc rows: doc_id, n, fp) and (fp, component_id, keeper): the smallest doc_id of each class's component.

    keeper is the fingerprint of the class that holds that document. Classes of a single document
    without links are left out of the second table. Null ids count as larger than any other.
    """
    bounded_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "jaccard")
    rows, counts = scan_sets(docs, size)
    classes = work.stored(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("ranges").alias("ranges")).withColumn("key", F.xxhash64("fp")), "classes")
    postings = prefix_postings(work, docs, counts, size, num, den)

    # first: each class of a list with its leading class
    ends = lambda k, n, pos: F.struct(F.col(k).alias("key"), F.col(n).alias("n"), F.col(pos).alias("pos"))
    led = postings.select(ends("key", "n", "pos").alias("b"), ends("lead_key", "lead_n", "lead_pos").alias("a")).where("a.key <> b.key")
    tried = work.stored(_pairs(led.where(_may_link("a", "b", num, den))), "pairs")
    links = verified(work, tried, classes, docs, size, num, den)

    # then all that is left: pairs of a list in different components, of which one end is outside the
    # list's largest component; the shorter set meets the longer one inside its index prefix
    labels = connected_components(links).select(F.xxhash64("id").alias("key"), F.xxhash64("component").alias("component"))
    named = work.stored(postings.select("token", "key", "n", "pos").join(labels, "key", "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("component")), "named")
    parts = named.repartition("token").groupBy("token", "component").agg(F.count("*").alias("c"))
    largest = work.stored(parts.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("m.component").alias("largest")), "open")
    open_ = work.stored(named.join(largest, "token").select("token", "key", "n", "pos", "component", (F.col("component") == F.col("largest")).alias("in_largest")), "open")
    index = lambda x: F.col(f"{x}.pos") < F.col(f"{x}.n") - F.ceil(2 * num * F.col(f"{x}.n") / F.lit(float(num + den)) - F.lit(1e-9)) + 1
    order = lambda x: F.struct(F.col(f"{x}.n"), F.col(f"{x}.key"))
    shorter = F.when(order("a") < order("b"), index("a")).otherwise(index("b"))
    apart = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & (F.col("b.in_largest") | (order("a") < order("b")))
    rest = open_.where("not in_largest").alias("a").join(open_.alias("b"), apart & shorter & _may_link("a", "b", num, den))
    pairs = work.stored(_pairs(rest).join(tried, ["ka", "kb"], "left_anti"), "pairs")
    labels = work.stored(connected_components(links.union(verified(work, pairs, classes, docs, size, num, den))), "labels")

    # each class with the smallest document of its component; doc_id null sorts last
    order = F.struct(F.col("first_doc").isNull().alias("no"), F.col("first_doc").alias("id"), F.col("fp").alias("fp"))
    joined = classes.join(labels.select(F.col("id").alias("fp"), "component"), "fp", "left").where("component is not null or copies > 1").withColumn("component", F.coalesce("component", "fp"))
    joined = work.stored(joined.select("fp", "component", order.alias("o")), "joined")
    least = work.stored(joined.groupBy("component").agg(F.min("o").alias("least")), "least")
    found = stored(joined.join(least, "component").select("fp", F.col("least.id").alias("component_id"), F.col("least.fp").alias("keeper")), "class-components")
    work.drop()
    return rows, found


def jaccard_components(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when den * common >= num * union.

    Documents without words (null or empty text) link with nothing. Repeated rows are documents of
    their own; a null id is larger than any other. Other columns are not read.
    """
    rows, classes = near_duplicate_classes(docs, size=size, num=num, den=den)
    out = rows.join(classes, "fp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, one of each group of linked ones: the smallest id, and one of rows that repeat it.

    Documents without words stay. Columns are those of docs.
    """
    rows, classes = near_duplicate_classes(docs, size=size, num=num, den=den)
    go = rows.join(classes, "fp").groupBy("doc_id", "fp").agg(F.first("keeper").alias("keeper"), F.first("component_id").alias("component_id"), F.count("*").alias("copies"))
    # an id goes unless one of its texts is its component's keeper; ids with several rows are settled by text below
    stays = (F.col("fp") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    marks = stored(go.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), stays.alias("_stays"), F.col("copies").alias("_copies")), "decisions")

    # only rows that a mark may name are joined; all others stay where they are
    share = docs.sparkSession.sparkContext.broadcast
    bits, again = (share(bit_set(m.select(F.xxhash64("_id").alias("bit")))) for m in (marks, marks.where("_copies > 1")))  # fixed size

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = batch.filter(pa.array(~is_set(bits.value, batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays(free.columns[:-1], names=names)

    def print_of(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for batch in batches:
            rest = batch.filter(pa.array(is_set(bits.value, batch.column(batch.num_columns - 1))))
            prints = [fingerprint(shingles(t, size)) for t in rest.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], _binary(prints)], names=[*names, unused("_print", names)])

    from pyspark.sql import types as T

    names, print_ = docs.columns, unused("_print", docs.columns)
    hashed = docs.select("*", F.xxhash64(F.col("doc_id").cast("long")).alias(unused("_bit", names)))
    schema = T.StructType([*docs.schema.fields, T.StructField(print_, T.BinaryType())])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(print_) == F.col("_fp"))
    joined = hashed.mapInArrow(lambda b: print_of(b, bits), schema).join(marks, same, "left")
    single = joined.where("_fp is null or (_stays and _copies = 1)").select(*docs.columns)
    joined = hashed.mapInArrow(lambda b: print_of(b, again), schema).join(marks.where("_stays and _copies > 1"), same)
    repeated = joined.dropDuplicates(["doc_id", print_]).select(*docs.columns)
    return hashed.mapInArrow(unmarked, docs.schema).unionByName(single).unionByName(repeated)
