"""Identity linking: groups of any size against all pairs tried one by one, in one task and in rounds."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.operators.identity import CERTAIN, EMAIL, MEMBERS, PHONE
from tidemark.plans import catalog

SCHEMA = "identity_record_id string, source_customer_id string, first_name string, last_name string, email string, phone string, address string, postcode string"


def people(seed: int, n: int, shared: int) -> list[tuple]:
    """n records of strangers and families; `shared` of them have one telephone, others share e-mail addresses of three or so."""
    rng = random.Random(seed)
    firsts, lasts = ["olivia", "noah", "henry", "xu", "bartholomew"], ["nguyen", "smith", "oo", "featherstonehaugh"]
    out = []
    for i in range(n):
        phone = "0412345678" if rng.random() < shared / n else rng.choice(["", f"04{i:08d}", f"04{i % 7:08d}"])
        email = rng.choice(["", f"{i}@example.com", f"family{i % (n // 3 + 1)}@example.com"])
        out.append((f"IDR_{i:05d}", f"S{i}", rng.choice(firsts), rng.choice(lasts), email, phone, rng.choice(["1 high street", "99 mill road", ""]), rng.choice(["2000", "2100", ""])))
    return out


def all_pairs(fields: dict[str, list[str]], probable: list[tuple[float, str, str]]) -> dict[str, str]:
    """The cluster (its first record) of each record, when every pair of every group is tried in order."""
    cluster = {x: {x} for x in fields}
    known: dict[tuple, str | None] = {}

    def attempt(a: str, b: str) -> None:
        left, right = cluster[a], cluster[b]
        if left is not right:
            first = tuple(sorted(left)[:MEMBERS]), tuple(sorted(right)[:MEMBERS])
            if first not in known:
                known[first] = identity._refusal(*[[fields[x] for x in side] for side in first])
            if known[first] is None:
                for x in left | right:
                    cluster[x] = left
                left |= right

    for place in (EMAIL, PHONE):
        for value in sorted({f[place] for f in fields.values()} - {""}):
            for a, b in combinations(sorted(x for x in fields if fields[x][place] == value), 2):
                attempt(a, b)
    for _, a, b in sorted(probable, key=lambda e: (-e[0], e[1], e[2])):
        attempt(a, b)
    return {x: min(c) for x, c in cluster.items()}


def plain_fields(rows: list[tuple]) -> dict[str, list[str]]:
    return {r[0]: [r[2], r[3], r[4], r[5], r[6], r[7]] for r in rows}


def clusters(rows: list[tuple]) -> dict[str, str]:
    return {r[0]: r[6] for r in rows if r[6] is not None}


@pytest.mark.parametrize("size", [2, 10, 33, 40, 41, 150])
def test_groups_link_as_all_their_pairs_do(size: int) -> None:
    for seed in range(4):
        fields = plain_fields(people(seed, size + 20, size))
        ids = sorted(fields)
        rng = random.Random(seed)
        probable = [(rng.choice([0.91, 0.95, 0.97]), *sorted(rng.sample(ids, 2))) for _ in range(20)]
        rows = identity.link_component(fields, probable)
        assert clusters(rows) == all_pairs(fields, probable)
        sizes = {r[0]: r[7] for r in rows if r[6] is not None}
        assert all(sizes[x] == list(clusters(rows).values()).count(c) for x, c in clusters(rows).items())


def test_a_group_of_five_thousand_with_a_gated_lead_is_linked_whole() -> None:
    # the first three share an e-mail address and disagree with all others, of whom the first has the telephone too
    fields = {f"IDR_{i:05d}": ["bob", "oo", "odd@x.org", "0400000000" if i == 0 else "", "9 far lane", "9999"] for i in range(3)}
    fields |= {f"IDR_{i:05d}": ["olivia", "nguyen", f"o{i}@example.com", "0400000000", "1 high street", "2000"] for i in range(3, 5003)}
    found = clusters(identity.link_component(fields, []))
    assert {found[x] for x in sorted(fields)[:3]} == {"IDR_00000"}
    assert {found[x] for x in sorted(fields)[3:]} == {"IDR_00003"}, "a refused lead kept the others apart"


def test_rounds_decide_as_one_task_does(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(identity, "MEMBERS", 3)  # clusters are judged by three records, so that few rounds try every case
    alike = lambda i, phone: (f"IDR_{i:05d}", ["olivia", "nguyen", f"o{i}@example.com", phone, "1 high st", "2000"])
    odd = lambda i, phone: (f"IDR_{i:05d}", ["bob", "oo", "odd@x.org", phone, "9 far lane", "9999"])
    fields = dict([odd(0, "0400000000"), odd(1, "0411111111"), *[alike(i, "0400000000") for i in range(2, 8)], alike(8, "0411111111"), odd(9, ""), alike(10, "")])
    probable = [(0.97, "IDR_00004", "IDR_00010"), (0.91, "IDR_00001", "IDR_00010"), (0.92, "IDR_00003", "IDR_00008")]
    want = identity.link_component(fields, probable)
    n = spark.createDataFrame([(x, *f) for x, f in fields.items()], ", ".join(f"{c} string" for c in (identity.RECORD, *identity.FIELDS.values())))
    got = identity.link_in_rounds(n.select(F.col(identity.RECORD).alias("id")), spark.createDataFrame(probable, "score double, a string, b string"), n)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[4] is False for r in want) and any(r[7] is not None and r[7] > 3 for r in want) and any(str(r[2]).startswith("Prob") for r in want), "no refusal, large cluster or probable pair was tried"


def test_large_blocks_are_compared_where_asked(spark: SparkSession) -> None:
    rows = [(f"IDR_{i:05d}", f"S{i}", "olivia", "nguyen", f"olivia{'x' * (i % 2)}.n@example.com" if i < 6 else None, f"+61 4{i % 3:08d}", "1 High St", "2000") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    few = identity.candidate_pairs(identity.add_normalised_fields(df), 5).count()
    assert few < identity.candidate_pairs(identity.add_normalised_fields(df), None).count() == 36
    assert identity.resolve(df, largest=None)[0].select("golden_customer_id").distinct().count() == 1


def test_bounds_drop_no_pair_that_would_pass(spark: SparkSession, small: str) -> None:
    n = identity.add_normalised_fields(catalog.tables(spark, small).records).cache()
    passing = lambda pairs: sorted(map(tuple, identity.pair_verdict(identity.pair_components(pairs, n)).where("rejection_reason is null").select("a", "b").collect()))
    assert passing(identity.promising_pairs(n)) == passing(identity.candidate_pairs(n))
    assert identity.promising_pairs(n).count() < identity.candidate_pairs(n).count() / 2
    texts = spark.createDataFrame([("smith", "smythe"), ("", "a"), ("aab", "aba"), ("x" * 90, "x" * 10), ("naïve", "native")], "a string, b string")
    sets = texts.withColumns({"sa": identity.numbered_characters(F.col("a")), "sb": identity.numbered_characters(F.col("b"))})
    bounds = sets.select("a", "b", identity.similarity_bound(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("bound"))
    assert all(identity.ratio(r.a, r.b) <= r.bound + 1e-12 and identity.ratio_bound(r.a, r.b) <= r.bound + 1e-12 for r in bounds.collect())
    assert all(identity.ratio(x, y) <= identity.ratio_bound(x, y) + 1e-12 for x in ("smith", "aab", "") for y in ("htims", "aba", "q"))


def test_no_records(spark: SparkSession) -> None:
    resolution, audit = identity.resolve(spark.createDataFrame([], SCHEMA))
    assert resolution.count() == 0 and audit.count() == 0
    alone = identity.resolve(spark.createDataFrame([("IDR_1", "S1", None, None, None, None, None, None), ("IDR_2", "S2", None, None, None, None, None, None)], SCHEMA))[0]
    assert alone.select("golden_customer_id").distinct().count() == 2 and alone.where("records_linked = 1").count() == 2
