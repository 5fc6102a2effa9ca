"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation becomes a path: for each turn the md5 of role and text and the text's length, 20
bytes. Conversations with the same path are put together first, their ids in blocks of numbers (the
digest of very many ids streams over their blocks), so neither a path nor a first turn that very
many share meets in one task.

1. Every task sorts its paths into runs of bounded size; each row of a run carries the number of
   turns it shares with the row before it (LCP). Runs are written to the shared folder.
2. Rows are dealt by ranges of the path. In each range a loser tree merges what the runs hold of it.
   It compares LCPs with the row written last: the head that shares more comes first, and only equal
   LCPs have turns compared, from there on; shared turns are never compared again.
3. The merged rows feed a stack of the open path. A row that shares fewer turns closes the nodes
   beyond them; a closed node is finished, its sums go to its parent, its row is given out.

Nodes on the first and last path of a range may go on in the next one. What a range holds of them is
given out as it stands, and put together at the end: two paths for each range, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, partitions
from tidemark.sources.storage import Scratch, stored

#: Bytes of a turn in a path: md5 of role and text, then the text's code points, big-endian.
TURN = 20
#: Bytes of paths and ids in a run, and in a range that one task merges.
RUN_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
#: Numbers that a block of ids spans; ids of one path and block are one row.
ID_BLOCK = 1 << 14
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A finished node of a range, or (parts) what a range holds of a node that may go on in another.
FOUND = NODE + ", key binary, parent_key binary, part boolean"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """40 hex digits of a turn; roles and texts that differ anywhere differ here."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(F.md5(whole), F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, codes): each conversation's turn codes by turn number, null first; equal numbers by role, then by code."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_code(role, text).alias("code")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.code).alias("codes"))


def rebuilt(conversations: DataFrame, *, hundred: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path) of conversations whose first h turns are those of conversation c - c % hundred, h being crc32(c) % heads."""
    own = stored(ordered_turns(conversations), "turns")
    lead = own.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("base"), F.slice("codes", 1, heads - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    with_h = own.select("conv_id", "codes", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % hundred).alias("base")).join(lead, "base", "left")
    start = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.filter("codes", lambda c, i: i >= F.col("h"))
    return with_h.select("conv_id", F.unhex(F.concat(F.array_join(start, ""), F.array_join(rest, ""))).alias("path"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which `known` need no look."""
    low, high = known * TURN, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high // TURN
    while high - low > TURN:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = low + (high - low) // (2 * TURN) * TURN
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low // TURN


@dataclass(slots=True)
class Row:
    """A path, how many conversations have it, the smallest of their ids, the digest of all, and the turns it shares with the row before."""

    path: bytes
    n: int
    first: int
    ends: str
    lcp: int = 0


class LoserTree:
    """Merges sorted runs whose rows carry LCPs; rows come out with the LCP to the row that came out before."""

    def __init__(self, runs: list[list[Row]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads: list[Row | None] = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        for head in self.heads:
            if head is not None:
                head.lcp = 0  # nothing has come out yet
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = self._match(left, right)
        return won

    def _match(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's LCP becomes that with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if a.lcp != b.lcp:  # both follow the last row: who shares more with it comes first
            return (i, j) if a.lcp > b.lcp else (j, i)
        lcp = shared_turns(a.path, b.path, a.lcp)
        at = lcp * TURN
        first = a.path[at : at + TURN] <= b.path[at : at + TURN]
        (b if first else a).lcp = lcp
        return (i, j) if first else (j, i)

    def __iter__(self) -> Iterator[Row]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)  # its LCP is with the row just given out
            node = (self.winner + self.size) // 2
            while node:
                self.winner, self.losers[node] = self._match(self.winner, self.losers[node])
                node //= 2


@dataclass(slots=True)
class Node:
    """A node on the open path: sums over what is finished below it, and rows that wait for its smallest member."""

    on_first: bool
    n_convs: int = 0
    conv_id: int | None = None
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None
    waiting: list[tuple] = field(default_factory=list)


class OpenPath:
    """A stack of the nodes of the path that is being read; gives out finished nodes and, of the first and last path, parts."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.path = b""
        self.out: list[tuple] = []

    def _key(self, depth: int) -> bytes:
        return hashlib.md5(self.path[: depth * TURN]).digest() + depth.to_bytes(4, "big")

    def _chars(self, depth: int) -> int:
        return int.from_bytes(self.path[depth * TURN - 4 : depth * TURN], "big") if depth else 0

    def _close(self, part: bool) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if part:
            key = self._key(depth)
            self.out += [(conv, down, None, *sums, None, key, False) for conv, down, *sums in node.waiting]
            # a part's smallest member's parent is not known yet: that column takes the last text's length
            self.out.append((node.conv_id, depth, self._chars(depth), node.n_convs, node.n_children, node.n_leaves, node.saved, node.ends, key, self._key(depth - 1) if depth else None, True))
        else:
            self.out += [(conv, down, node.conv_id, *sums, None, None, False) for conv, down, *sums in node.waiting]
            leaves, saved = node.n_leaves or 1, node.saved + (node.n_convs - 1) * self._chars(depth)
            up.waiting.append((node.conv_id, depth, node.n_convs, node.n_children, leaves, saved, node.ends or NOTHING))
            up.n_children, up.n_leaves, up.saved = up.n_children + 1, up.n_leaves + leaves, up.saved + saved
        if up is not None:
            up.n_convs += node.n_convs
            up.conv_id = node.conv_id if up.conv_id is None else min(up.conv_id, node.conv_id)

    def add(self, row: Row) -> None:
        first = not self.stack
        while len(self.stack) > row.lcp + 1:
            self._close(self.stack[-1].on_first)
        self.path = row.path
        while len(self.stack) < len(row.path) // TURN + 1:
            self.stack.append(Node(first))
        top = self.stack[-1]
        top.ends = row.ends
        top.n_convs += row.n
        top.conv_id = row.first if top.conv_id is None else min(top.conv_id, row.first)

    def finish(self) -> None:
        while self.stack:
            self._close(True)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_FOUND_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
_FOUND_NAMES = [x.split(" ")[0] for x in FOUND.split(", ")]


def _batch(rows: list[tuple], n: int = len(_FOUND_NAMES)) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * n
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES[:n], strict=True)], names=_FOUND_NAMES[:n])


def _runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """The task's rows as sorted runs with LCPs; `run` and `nth` say where a row stands."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0
    types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def out() -> Iterator[pa.RecordBatch]:
        rows = sorted(held)
        lcps = [0, *[shared_turns(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            k = len(part)
            columns = [*zip(*part, strict=True), lcps[at : at + k], [(task << 24) + number] * k, range(at, at + k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "n", "first", "ends", "lcp", "run", "nth"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append(row)
            size += len(row[0]) + 100
            if size > run_bytes:
                yield from out()
                held, size, number = [], 0, number + 1
    if held:
        yield from out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and parts of one range, from the rows that its runs hold of it."""
    runs: dict[int, list[tuple[int, Row]]] = {}
    for batch in batches:
        for path, n, first, ends, lcp, run, nth in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            runs.setdefault(run, []).append((nth, Row(path, n, first, ends, lcp)))
    if not runs:
        return
    tree = OpenPath()
    for row in LoserTree([[r for _, r in sorted(rows, key=lambda x: x[0])] for rows in runs.values()]):
        tree.add(row)
        if len(tree.out) > 10_000:
            yield _batch(tree.taken())
    tree.finish()
    yield _batch(tree.taken())


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes (with their keys) from parts: those of one key are summed, then children into parents from the deepest up."""
    nodes: dict[bytes, list] = {}
    for batch in batches:
        for conv, depth, chars, n_convs, children, leaves, saved, sha, key, up, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x = nodes.setdefault(key, [conv, depth, chars, 0, 0, 0, 0, None, up])
            x[0] = min(x[0], conv)
            for i, value in zip((3, 4, 5, 6), (n_convs, children, leaves, saved), strict=True):
                x[i] += value
            x[7] = sha or x[7]
    out = []
    for key, (conv, depth, chars, n_convs, children, leaves, saved, sha, up) in sorted(nodes.items(), key=lambda x: -x[1][1]):
        leaves, saved = leaves or 1, saved + (n_convs - 1) * chars
        parent = nodes.get(up)
        if parent:
            parent[4], parent[5], parent[6] = parent[4] + 1, parent[5] + leaves, parent[6] + saved
        # all deeper nodes have been added, so this one's sums are whole
        out.append((conv, depth, parent[0] if parent else None, n_convs, nodes[key][4], leaves, saved, sha or NOTHING, key))
    yield _batch(out, 9)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends) from (path, block, ids) sorted by path and block: one digest goes on from block to block, none is held."""
    now, sha = None, None
    done: list[tuple] = []
    for batch in batches:
        for path, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if path == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((now, sha.hexdigest()))
            now, sha = path, hashlib.sha256(ids.encode())
    if now is not None:
        done.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["path", "ends"])


def distinct_paths(work: Scratch, paths: DataFrame, id_block: int) -> DataFrame:
    """(path, n, first, ends): each path once, with the number, the smallest and the digest of its conversations' ids."""
    block = F.floor(F.col("conv_id") / F.lit(float(id_block))).cast("long")  # in the order of the ids
    ids = F.array_join(F.transform("c", lambda x: x.cast("string")), ",")
    grouped = paths.groupBy("path", block.alias("block")).agg(F.array_sort(F.collect_set("conv_id")).alias("c"))  # at most id_block ids
    blocks = work.stored(grouped.select("path", "block", ids.alias("ids"), F.size("c").cast("long").alias("n"), F.col("c")[0].alias("first")), "blocks")
    each = blocks.groupBy("path").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.sha2("ids", 256)).alias("ends"))
    each = work.stored(each, "distinct")
    several = blocks.join(each.where("blocks > 1").select("path"), "path", "left_semi").select("path", "block", "ids")
    told = several.repartition(partitions(paths.sparkSession), "path").sortWithinPartitions("path", "block").mapInArrow(_digests, "path binary, ends string")
    return each.join(told.withColumnRenamed("ends", "_ends"), "path", "left").select("path", "n", "first", F.coalesce("_ends", "ends").alias("ends"))


def trie_nodes(paths: DataFrame, *, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, id_block: int = ID_BLOCK) -> DataFrame:
    """The trie's nodes from (conv_id, path), one row for each conversation; no conversation gives no node."""
    spark = paths.sparkSession
    bounded_batches(spark)
    work = Scratch(spark, "trie")
    rows = distinct_paths(work, paths, id_block)
    runs = work.stored(rows.mapInArrow(lambda b: _runs(b, run_bytes), "path binary, n long, first long, ends string, lcp int, run long, nth long"), "runs")
    held = runs.agg(F.coalesce(F.sum(F.length("path") + 100), F.lit(0)).alias("b")).head().b
    ranges = max(partitions(spark), -(-held // range_bytes))
    found = work.stored(runs.repartitionByRange(ranges, "path").mapInArrow(_merged, FOUND), "found")
    parts = found.where("part").coalesce(1).mapInArrow(_joined_parts, NODE + ", key binary")  # two paths a range
    whole = work.stored(parts, "whole")
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    inner = found.where("not part").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    out = stored(inner.select(*names).unionByName(whole.select(*names)).withColumn("depth", F.col("depth").cast("long")), "nodes")
    work.drop()
    return out


def prefix_trie(conversations: DataFrame, *, hundred: int = 100, heads: int = 6, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, id_block: int = ID_BLOCK) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations, from (conv_id, turn, role, text).

    A node is a distinct sequence of first turns; its row has its smallest member, its depth, its
    parent's smallest member (root: null), numbers of members, children and leaves below, the
    characters that sharing its subtree saves, and the SHA-256 of the ids that end in it. Turns come
    by number, null first; turns of one number by role, then by a digest of role and text, so the
    order is fixed and repeated rows are turns of their own. Null role or text is empty. Rows without
    a conv_id belong to no conversation. Other columns are not read.
    """
    return trie_nodes(rebuilt(conversations, hundred=hundred, heads=heads), run_bytes=run_bytes, range_bytes=range_bytes, id_block=id_block)
