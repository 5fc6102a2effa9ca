"""The conversation trie against a plain dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie as trie
from tidemark.llm.registry import ORACLES, op12_conversation_trie
from tests.llm.oracle import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def code(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + f"{len(text):08x}"


def brute(rows: list[tuple]) -> list[tuple]:
    """Nodes by comparing every prefix of every conversation."""
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", code(role or "", text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x, key=lambda y: y[:4])] for c, x in own.items()}
    nodes: dict[tuple, list[int]] = defaultdict(list)
    whole = {}
    for c, mine in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(c - 100 * int(c / 100))
        whole[c] = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children: dict[tuple, list[tuple]] = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)

    def below(n: tuple) -> tuple[int, int]:
        leaves, saved = (0 if children[n] else 1), (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
        for x in children[n]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(m for m in members if len(whole[m]) == len(n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), *below(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df: DataFrame) -> list[tuple]:
    assert df.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    return sorted(map(tuple, df.collect()), key=str)


def conversations(seed: int, n: int) -> list[tuple]:
    """Conversations of few distinct turns, so that many share beginnings, with hot ones and gaps."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows += [(c, t, "user", f"hot {t}") for t in range(4)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant"]), "ab"[rng.randrange(2)] * rng.randrange(3)) for t in range(rng.randrange(7))]
    rng.shuffle(rows)
    return rows


def test_odd_rows(spark: SparkSession) -> None:
    rows = [
        (None, 0, "user", "no conversation"), (1, None, None, None), (1, 0, "user", "é\U0001f600x"), (1, 0, "user", "é\U0001f600x"), (1, 0, "assistant", "tie"),
        (2, 5, "user", ""), (100, 0, "user", "é\U0001f600x"), (100, 1, "user", "1:x"), (101, 0, "user", "base"), (-7, 0, "user", "minus"), (-100, 0, "user", "minus"), (-101, 3, "user1", ":x"), (-101, 4, "user", "1:x"),
        (0, 0, "user", "first of the hundred"), (0, 1, "assistant", None), (7, 0, "user", "x" * 300_000), *[(300, t, "user", f"turn {t}") for t in range(700)], *[(301, t, "user", f"turn {t}") for t in range(650)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("path", "key", "n", "depth", "h", "base", "block", "lcp")})
    assert found(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_many_runs_and_ranges_give_the_same_nodes(spark: SparkSession, seed: int) -> None:
    rows = conversations(seed, 260)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(trie.prefix_trie(df)) == want
    assert found(trie.prefix_trie(df, run_bytes=700, range_bytes=1500, id_block=16)) == want


def test_loser_tree_merges_runs_and_knows_shared_turns() -> None:
    rng = random.Random(4)
    paths = sorted({b"".join(bytes([rng.randrange(2)]) * trie.TURN for _ in range(rng.randrange(9))) for _ in range(300)})
    runs = [[] for _ in range(5)]
    for p in paths:
        runs[rng.randrange(5)].append(p)
    rows = [[trie.Row(p, 1, 0, "", trie.shared_turns(a, p)) for a, p in zip([b"", *r], r, strict=False)] for r in runs]
    merged = list(trie.LoserTree(rows))
    assert [r.path for r in merged] == paths
    assert [r.lcp for r in merged[1:]] == [trie.shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)]


def test_whole_table(spark: SparkSession, small: str) -> None:
    rows = list(map(tuple, spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert found(op12_conversation_trie(spark, small)) == brute(rows)


def test_query_equals_sql(spark: SparkSession, small: str) -> None:
    same_as_sql(op12_conversation_trie(spark, small), ORACLES["op12_conversation_trie"], small)
