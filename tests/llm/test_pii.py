"""Pseudonyms: formats, links between documents, permutations, and texts left alone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.registry import op1_private_data

KEY = "test-key"


def changed(spark: SparkSession, *texts: str | None, key: str = KEY) -> list[tuple[str | None, int]]:
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n_private) for r in pii.pseudonymise(docs, key=key).orderBy("doc_id").collect()]


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_every_format_is_kept(spark: SparkSession) -> None:
    texts = ["card 4539 1488 0343 6467 end", "born 1984-02-29 here", "on 12/31/1999 ok", "am 31.12.1999 ok", "mail jane.doe+x@example.co.uk now", "ssn 123-45-6789.", "call +1 (555) 123-4567 or 555-987-6543", "host 192.168.10.254 up"]
    got = changed(spark, *texts)
    shape = lambda x: re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", x.split("@")[0]))
    for (new, n), old in zip(got, texts, strict=True):
        assert new != old and n == (2 if old.startswith("call") else 1)
        assert shape(new) == shape(old) or old.startswith("host")
    assert luhn(got[0][0])
    dt.date.fromisoformat(got[1][0].split()[1])
    assert dt.datetime.strptime(got[2][0].split()[1], "%m/%d/%Y")
    assert dt.datetime.strptime(got[3][0].split()[1], "%d.%m.%Y")
    assert got[4][0].endswith("@example.co.uk now")
    area, group, serial = re.search(r"(\d{3})-(\d{2})-(\d{4})", got[5][0]).groups()
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    assert all(int(x) < 256 for x in got[7][0].split()[1].split("."))


def test_equal_values_stay_linked_and_keys_differ(spark: SparkSession) -> None:
    a, b = changed(spark, "x 1984-02-29 y a.b@c.org", "first a.b@c.org then 1984-02-29")
    assert a[0].split()[1] == b[0].split()[3] and a[0].split()[3] == b[0].split()[1]
    assert changed(spark, "x 1984-02-29 y a.b@c.org", key="another")[0] != a
    assert changed(spark, "x 1984-02-29 y a.b@c.org")[0] == a


def test_values_that_fail_their_check_stay(spark: SparkSession) -> None:
    texts = ["at 1984-02-30 none", "ip 300.1.1.1", "ssn 666-12-1234", "ssn 000-12-1234", "plain words only", "version 1.2.3", "year 2024", None, "", "a@b"]
    assert changed(spark, *texts) == [(t, 0) for t in texts]


def test_number_that_fails_luhn_still_fails(spark: SparkSession) -> None:
    (new, n), = changed(spark, "4539 1488 0343 6468")
    assert n == 1 and not luhn(new)


def test_numbers_without_a_check_stay(spark: SparkSession) -> None:
    texts = ["order 9807915762804490 sent", "at 1700000000001 ms", "1 2 3 4 5 6 7 8 9 10 11", "4539148803436468 123"]
    assert changed(spark, *texts) == [(t, 0) for t in texts]


def test_numbers_are_found_beside_other_digits(spark: SparkSession) -> None:
    card, other = "4539148803436467", "378282246310005"
    ((alone, _), (second, _)) = changed(spark, card, other)
    rows = {f"{card} 123": (f"{alone} 123", 1), f"123 {card}": (f"123 {alone}", 1), "12 34 4539 1488 0343 6467 12": None, f"{card} {other}-99 {card}": (f"{alone} {second}-99 {alone}", 3)}
    for (new, n), (old, want) in zip(changed(spark, *rows), rows.items(), strict=True):
        assert (new, n) == want if want else n == 1 and new != old and luhn(new[6:25]) and new[:6] + new[25:] == "12 34  12"
    texts = ["1234567 555-123-4567", "12345678901 123-45-6789", f"{card[:-1]}8 192.168.1.1", f"{card[:-1]}8 2024-01-02"]
    for (new, n), old in zip(changed(spark, *texts), texts, strict=True):
        assert n == 1 and new.split()[0] == old.split()[0] and new.split()[1] != old.split()[1]


def test_digit_permutation_is_one_to_one(spark: SparkSession) -> None:
    for size in (2, 3, 4):
        rows = spark.range(10**size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("d")).select("d", pii.permute_digits(KEY, "t", F.col("d")).alias("p"))
        got = [r.p for r in rows.collect()]
        assert len(set(got)) == 10**size and all(re.fullmatch(rf"\d{{{size}}}", p) for p in got)


def test_dates_are_permuted_one_to_one(spark: SparkSession) -> None:
    days = spark.range(5000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = days.select(F.date_format("d", "yyyy-MM-dd").alias("text"), F.lit(1).alias("doc_id"))
    got = [r.text for r in pii.pseudonymise(rows, key=KEY).collect()]
    assert len(set(got)) == 5000
    assert all("1800-01-01" <= str(dt.date.fromisoformat(x)) <= "2199-12-31" for x in got)


def test_edge_cases_and_columns(edge_docs: DataFrame, no_docs: DataFrame) -> None:
    out = pii.pseudonymise(edge_docs, key=KEY)
    assert sorted(out.columns) == sorted(edge_docs.columns) and dict(out.dtypes)["n_private"] == "bigint"
    pairs = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    assert pairs(out) == pairs(edge_docs)
    assert pii.pseudonymise(no_docs, key=KEY).count() == 0


def test_whole_table_changes_only_private_values(spark: SparkSession, small: str) -> None:
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op1_private_data(spark, small).collect():
        old, new = (before[r.doc_id] or "").split(), (r.text or "").split()
        assert (r.text is None) == (before[r.doc_id] is None) and len(old) == len(new)
        assert (r.text != before[r.doc_id]) == (r.n_private > 0)
        assert all(re.search("[0-9@]", a) and re.search("[0-9@]", b) for a, b in zip(old, new, strict=True) if a != b)


def test_slashed_dates_and_other_formats_stay_one_to_one(spark: SparkSession) -> None:
    import datetime as dt

    days = [dt.date(1998, 1, 1) + dt.timedelta(i) for i in range(1461)]
    values = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    values += [f"+44 20 7946 {n:04d}" for n in range(300)] + [f"06 12 34 {n // 100:02d} {n % 100:02d}" for n in range(300)] + [f"10.2.{n}.4" for n in range(256)]
    for n in range(300):
        body = f"3704{n:014d}"
        values.append(f"DE{98 - int(body + '131400') % 97:02d}{body}")
    rows = spark.createDataFrame([(v,) for v in values], "text string")
    got = pii.pseudonymise(rows.withColumn("was", rows.text), key="k").collect()
    assert len({r.text for r in got}) == len(values) == len(set(values)) and sum(r.n_private for r in got) >= len(values) - 5
    assert all(int(r.text[4:] + "1314" + r.text[2:4]) % 97 == 1 for r in got if r.text.startswith("DE"))
    assert all(int(r.text[:2]) > 12 for r in got if r.was[2:3] == "/" and int(r.was[:2]) > 12)


def test_versions_and_failed_checks_stay(spark: SparkSession) -> None:
    texts = ["see version 10.2.3.4 of it", "DE89370400440532013001", "isbn 9783161484100", "32/13/2001", "+44 12"]
    got = pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), key="k").collect()
    assert [r.text for r in got] == texts and {r.n_private for r in got} == {0}
