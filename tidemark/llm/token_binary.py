"""Token-id files: one zstandard frame for each document, under one shared trained dictionary.

Layout of a written corpus, all through Spark's writer so that any shared store will do:

- ``dictionary``: one row (dict_hash, dict_bytes), the dictionary trained on serialised id arrays;
- ``blocks``: rows (part, block, ...) in ascending doc_id order. ``payload`` holds the header
  (magic, dictionary hash) and then one frame for each document; the arrays ``doc_ids``,
  ``offsets``, ``sizes`` and ``counts`` are its offset index, so one short document is read by
  slicing its frame alone, and the index is read without the payloads;
- ``parts``: rows (part, part_start), the number of ids before each part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, new_path, partitions, text_or_empty
from tidemark.llm.tokens import encoder

MAGIC = b"TMTOK001"
HEADER = len(MAGIC) + 32
BLOCK_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType()),
])
DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_SLICE = 4096


def serialise(ids: bytes) -> bytes:
    """uint32 ids as a width byte and 2-byte or 4-byte little-endian numbers."""
    wide = np.frombuffer(ids, dtype="<u4")
    if wide.size and int(wide.max()) > 0xFFFF:
        return b"\x04" + ids
    return b"\x02" + wide.astype("<u2").tobytes()


def deserialise(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\x04" else np.frombuffer(data, dtype="<u2", offset=1).astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample_docs: int, sample_bytes: int, dict_bytes: int) -> DataFrame:
    """(dict_hash, dict_bytes) trained in one task on at most sample_docs distinct documents, the ones with the smallest hash of id and text.

    The hashes are picked first and alone; only the picked documents' texts are then sent to that task.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        samples: list[bytes] = []
        left = sample_bytes
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if left > 0:
                    samples.append(serialise(encoder(tokenizer_path, "byte").encode([text])[0]))
                    left -= len(samples[-1])
        try:
            data = zstandard.train_dictionary(dict_bytes, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little to train on: the ids themselves serve as content
            data = b"".join(samples)[:dict_bytes]
        yield pa.RecordBatch.from_pydict({"dict_hash": [hashlib.sha256(data).hexdigest()], "dict_bytes": [data]})

    hashed = docs.select(F.xxhash64("doc_id", "text").alias("_h"), "text")
    least = hashed.select("_h").distinct().orderBy("_h").limit(sample_docs)
    picked = hashed.join(F.broadcast(least), "_h", "left_semi").groupBy("_h").agg(F.first("text").alias("text")).coalesce(1).sortWithinPartitions("_h").select("text")  # sample_docs numbers
    return picked.mapInArrow(train, "dict_hash string, dict_bytes binary")


def write_token_corpus(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    end_id: int | None = 2,
    sample_docs: int = 1000,
    sample_bytes: int = 8 << 20,
    dict_bytes: int = 64 << 10,
    level: int = 3,
    block_bytes: int = 1 << 20,
) -> str:
    """Tokenise whole texts and write them in ascending doc_id order; returns path.

    A null text is an empty one, a document then holds its end id alone. Null ids come first.
    Repeated ids are kept, ordered by a hash of their text, by which an id of many rows is also dealt
    to several tasks. Other columns are not read. An empty
    table writes an empty corpus. The dictionary alone comes from a bounded sample (sample_docs,
    sample_bytes); every document is encoded.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    train_dictionary(source, tokenizer_path, sample_docs, sample_bytes, dict_bytes).write.parquet(f"{path}/dictionary")
    shared = spark.read.parquet(f"{path}/dictionary").head()
    data = bytes(shared.dict_bytes) if shared else b""
    digest = hashlib.sha256(data).digest()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept = zstandard.ZstdCompressionDict(data) if data else None
        press = zstandard.ZstdCompressor(level=level, dict_data=kept)
        block, start = 0, 0
        ids, offsets, sizes, counts, frames, size = [], [], [], [], [MAGIC, digest], HEADER

        def row() -> pa.RecordBatch:
            values = [part, block, start, sum(counts), ids, offsets, sizes, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW, strict=True)], names=BLOCK_SCHEMA.names)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(at, _SLICE)
                for doc, raw in zip(piece.column(0).to_pylist(), encoder(tokenizer_path, "byte").encode(piece.column(1).to_pylist()), strict=True):
                    frame = press.compress(serialise(raw + end))
                    ids.append(doc)
                    offsets.append(size)
                    sizes.append(len(frame))
                    counts.append((len(raw) + len(end)) // 4)
                    frames.append(frame)
                    size += len(frame)
                    if size >= block_bytes:
                        yield row()
                        block, start = block + 1, start + sum(counts)
                        ids, offsets, sizes, counts, frames, size = [], [], [], [], [MAGIC, digest], HEADER
        if ids:
            yield row()

    ordered = source.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    sums = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written part
    sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start")).write.parquet(f"{path}/parts")
    return path


_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts"), "part")


def _frames(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(doc_id, start, n_tokens, ids) of each document in block rows (part_start, local_start, doc_ids, offsets, sizes, counts, payload)."""
    import zstandard

    digest = hashlib.sha256(data).digest()
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    for batch in batches:
        for part_start, local, docs, offsets, sizes, counts, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if payload[: len(MAGIC)] != MAGIC or payload[len(MAGIC) : HEADER] != digest:
                raise ValueError("the block was written under another dictionary")
            start = part_start + local
            for doc, offset, size, count in zip(docs, offsets, sizes, counts, strict=True):
                yield doc, start, count, deserialise(unpress.decompress(payload[offset : offset + size]))
                start += count


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    bounded_batches(spark)
    shared = spark.read.parquet(f"{path}/dictionary").head()
    columns = ["part_start", "local_start", "doc_ids", "offsets", "sizes", "counts", "payload"]
    return _blocks(spark, path).select(*columns), bytes(shared.dict_bytes) if shared else b""


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded ids in the files."""
    blocks, data = _read(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, start, len(ids) // 4, zlib.crc32(ids)) for doc, start, _, ids in _frames(iter([batch]), data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(digest, DIGEST_SCHEMA)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids of the named documents: the offset index picks blocks and frames, other frames stay compressed."""
    blocks, data = _read(spark, path)
    wanted = sorted({int(x) for x in doc_ids})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        names = set(wanted)
        for batch in batches:
            out: list[tuple[int, int, np.ndarray]] = []
            for part_start, local, docs, offsets, sizes, counts, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = part_start + local
                for doc, offset, size, count in zip(docs, offsets, sizes, counts, strict=True):
                    if doc in names:
                        out.append((doc, start, np.frombuffer(deserialise(unpress.decompress(payload[offset : offset + size])), dtype="<u4").astype("int64")))
                    start += count
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    hit = F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in wanted])) if wanted else F.lit(False)
    return blocks.where(hit).mapInArrow(pick, "doc_id long, start long, ids array<long>")


def encode_documents(docs: DataFrame, tokenizer_path: str, **options: object) -> DataFrame:
    """Write a corpus to a new shared folder and return the digest of every document read back from it."""
    path = new_path(docs.sparkSession, "tokens")
    return read_digests(docs.sparkSession, write_token_corpus(docs, tokenizer_path, path, **options))
