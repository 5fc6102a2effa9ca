"""Token files and packing: exact round trips against the tokenizers library."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_binary
from tidemark.llm.registry import op3_token_binary, op5_best_fit_packing
from tidemark.llm.tokens import default_path, encoder

BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")


TOKENIZERS = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def library_ids(path: str, text: str | None, end: int) -> bytes:
    ids = TOKENIZERS[path].encode(text or "", add_special_tokens=False).ids + [end]
    return np.asarray(ids, "<u4").tobytes()


STRANGE = ["", " ", "\n", "a  b", "a   b", "x y", "don't we'll I'M", "1234567 12,345.67", "...,,,;;", "_a_b_ __init__", "Σίσυφος ΑΣ", "é é", "İstanbul ǅ", "a‍b", "tab\tand\nnew\r\nline", "<|endoftext|> in text", "日本語テスト 中文", "\U0001f600\U0001f600", "word, word. word", "U.S.A. e.g. 3.14", "a,b.c", "end ", " start", "\0null", "mixed　wide", "ﬁ ligature", "x" * 5000, "ab. " * 900]


@pytest.mark.parametrize(("mode", "path"), [("byte", BYTE), ("word", WORD)])
def test_pieces_give_the_librarys_ids(mode: str, path: str) -> None:
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = "ab eé.,;'_-\n\t 19日 ΣA"
    texts = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    got = encoder(path, mode).encode(texts)
    wrong = [t for t, a, b in zip(texts, got, want, strict=True) if a != b]
    assert not wrong, wrong[:5]


def token_digests(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    out = [(d, len(ids) // 4, zlib.crc32(ids)) for d, t in rows for ids in [library_ids(BYTE, t, 2)]]
    return sorted(out, key=str)


def test_token_files_of_edge_cases(edge_docs: DataFrame) -> None:
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = token_binary.encode_documents(edge_docs, BYTE, end_id=2, block_bytes=2000).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == token_digests(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_token_files_of_the_whole_table(spark: SparkSession, small: str) -> None:
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for d, t in rows:
        ids = library_ids(BYTE, t, 2)
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(tuple(r) for r in op3_token_binary(spark, small).collect()) == want


def test_one_document_is_read_alone(spark: SparkSession, small: str, tmp_path) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = token_binary.write_token_corpus(docs, BYTE, f"file://{tmp_path}/corpus", end_id=2)
    wanted = [r.doc_id for r in docs.select("doc_id").orderBy(F.desc("doc_id")).limit(3).collect()]
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(wanted)).collect()}
    got = {r.doc_id: r.ids for r in token_binary.read_documents(spark, path, wanted).collect()}
    assert got == {d: np.frombuffer(library_ids(BYTE, t, 2), "<u4").tolist() for d, t in texts.items()}
    other = spark.createDataFrame([("0" * 64, bytearray(b"another dictionary"))], "dict_hash string, dict_bytes binary")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_binary.read_digests(spark, path).collect()


def test_token_files_of_an_empty_table(no_docs: DataFrame) -> None:
    assert token_binary.encode_documents(no_docs, BYTE, end_id=2).collect() == []


def packed_rows_hold(rows: list, capacity: int, least_bins: int | None = None) -> None:
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    if least_bins is not None:
        assert len(bins) <= least_bins


def test_packing_of_the_whole_table(spark: SparkSession, small: str) -> None:
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = op5_best_fit_packing(spark, small).collect()
    pieces: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    total = 0
    for doc, text in docs.items():
        ids = library_ids(WORD, text, 1)
        want = [(k, i // 4, len(ids[i : i + 16384]) // 4, zlib.crc32(ids[i : i + 16384])) for k, i in enumerate(range(0, len(ids), 16384))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc]) == want
        total += len(ids) // 4
    packed_rows_hold(rows, 4096, -(-total // 4096) + 1)


def test_packing_of_edge_cases(edge_docs: DataFrame, no_docs: DataFrame) -> None:
    rows = packing.pack_documents(edge_docs, WORD, capacity=64, end_id=1).collect()
    packed_rows_hold(rows, 64)
    want = sorted(str((d, len(library_ids(WORD, t, 1)) // 4)) for d, t in ((r.doc_id, r.text) for r in edge_docs.collect()))
    got: dict[tuple, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    sums: dict[object, int] = {}
    for d, t in ((r.doc_id, r.text) for r in edge_docs.collect()):
        sums[d] = sums.get(d, 0) + len(library_ids(WORD, t, 1)) // 4
    assert got == sums, want
    assert packing.pack_documents(no_docs, WORD).collect() == []


def test_fullest_combination_is_exact() -> None:
    rng = random.Random(9)
    for _ in range(200):
        counts = [(n, rng.randrange(1, 4)) for n in sorted(rng.sample(range(1, 40), rng.randrange(1, 6)), reverse=True)]
        room = rng.randrange(1, 90)
        sums = {sum(n * k for (n, _), k in zip(counts, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for _, c in counts])}
        chosen = packing.fullest(room, counts)
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= dict(counts)[n] for n, k in chosen.items())


def test_patterns_use_up_the_histogram() -> None:
    rng = random.Random(4)
    histogram = {rng.randrange(1, 4097): rng.randrange(1, 50) for _ in range(300)}
    patterns = packing.minimum_slack_patterns(histogram, 4096)
    used: dict[int, int] = {}
    for bins, chosen in patterns:
        assert sum(n * k for n, k in chosen.items()) <= 4096
        for n, k in chosen.items():
            used[n] = used.get(n, 0) + bins * k
    assert used == histogram
    least = max(sum(n * c for n, c in histogram.items()) / 4096, sum(c for n, c in histogram.items() if n > 2048))
    assert sum(b for b, _ in patterns) <= 1.03 * least + 1


def test_packed_ids_are_kept(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: bytes(r.ids) for r in packing.pack_documents(docs, WORD, with_ids=True).collect()}
    assert rows == {1: library_ids(WORD, "a few words", 1), 2: library_ids(WORD, None, 1)}


@pytest.mark.parametrize(("mode", "name"), [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_control_and_space_characters_give_the_librarys_ids(mode: str, name: str) -> None:
    """Words and marks beside every control, space and format character."""
    import unicodedata

    from tidemark.llm.tokens import default_path, encoder

    rng = random.Random(5)
    odd = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) in ("Cc", "Zs", "Zl", "Zp", "Cf")]
    parts = ["end", "next", "it's", "Σας", "12", "a_b", ".", ",", "...", "_", "'", "-", " ", "  ", "\n", "\t", "\r\n", "é", "日本"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.15 else rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    texts += [f"end.{c} next,{c}'x" for c in odd]
    e = encoder(default_path(name), mode)
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_capitals_that_lower_to_several_characters_give_the_librarys_ids() -> None:
    rng = random.Random(6)
    several = [chr(c) for c in range(0x110000) if len(chr(c).lower()) > 1]
    assert several
    parts = [*several, "I", "i", "\u0307", "Σ", "ß", "E", "n", ",", ".", ", ", ". ", "-", "_", " ", "\n", "!", "word", "1"]
    texts = ["DEN\u0130ZL\u0130, ve", "\u0130, a", "\u0130.", *["".join(rng.choice(several if rng.random() < 0.2 else parts) for _ in range(rng.randrange(1, 12))) for _ in range(8000)]]
    found = encoder(default_path("word_bpe_49k.json"), "word")
    assert found.encode(texts) == [found.whole(t) for t in texts]
