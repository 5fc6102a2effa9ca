"""Identity resolution of customer records and the golden customer layer."""

from __future__ import annotations

import difflib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.scalars import cents, clean_text, flag, normalise_address, normalise_email, normalise_phone, normalise_postcode
from tidemark.functions.windows import first_by
from tidemark.operators.components import connected_components
from tidemark.sources.formats import checked_join
from tidemark.sources.storage import Scratch, stored

RECORD = "identity_record_id"
# Weights of the compared fields, and the thresholds of linking.
WEIGHTS = {"email": 0.32, "phone": 0.28, "last": 0.14, "address": 0.11, "first": 0.10, "postcode": 0.05}
PROBABLE, CERTAIN, CLUSTER_MEAN, LARGEST_BLOCK, MEMBERS = 0.90, 0.96, 0.78, 120, 12
#: Records and probable pairs of a component that one task links; the rounds for larger ones decide alike.
GATHERED = 2_000
#: Longer strings are bounded by their lengths alone.
COUNTED_CHARACTERS = 64
EMAIL, PHONE = 2, 3  # places in FIELDS
FIELDS = {"first": "norm_first_name", "last": "norm_last_name", "email": "norm_email", "phone": "norm_phone", "address": "norm_address", "postcode": "norm_postcode"}


def add_normalised_fields(records: DataFrame) -> DataFrame:
    """Normal forms of name, email, phone, address and postcode; missing values become empty."""
    out = records.withColumns({
        "norm_first_name": clean_text(F.col("first_name")),
        "norm_last_name": clean_text(F.col("last_name")),
        "norm_email": normalise_email(F.col("email")),
        "norm_phone": normalise_phone(F.col("phone")),
        "norm_address": normalise_address(F.col("address")),
        "norm_postcode": normalise_postcode(F.col("postcode")),
    })
    return out.withColumn("norm_full_name", F.trim(F.concat_ws(" ", "norm_first_name", "norm_last_name")))


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """Matching-block similarity: 0 if either is empty, 1 if equal."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=200_000)
def ratio_bound(a: str, b: str) -> float:
    """No less than the matching-block similarity: characters that both hold, in any order."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching-block similarity, which no built-in function computes; a pair of strings that was just seen is not compared again."""
    return pa.array(map(ratio, a.to_pylist(), b.to_pylist()), pa.float64())


def numbered_characters(text: Column) -> Column:
    """Each character with its number among equal ones, so that the intersection of two such sets counts what both strings hold; null for long strings."""
    sorted_ = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(F.length(text) <= COUNTED_CHARACTERS, F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c)).cast("string"))))


def similarity_bound(a: Column, b: Column, a_set: Column, b_set: Column) -> Column:
    """No less than the matching-block similarity, in built-in functions: shared characters, or lengths, over the mean length."""
    both = F.coalesce(F.size(F.array_intersect(a_set, b_set)), F.least(F.length(a), F.length(b)))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2 * both / (F.length(a) + F.length(b)))


def block_keys(n: DataFrame) -> DataFrame:
    """(key, identity_record_id) for five blocking rules; a rule needs all its parts."""
    c = F.col
    local, domain = F.substring_index(c("norm_email"), "@", 1), F.regexp_extract("norm_email", "@(.*)$", 1)
    house = F.regexp_extract("norm_address", r"^(\d+)", 1)
    rule = lambda name, *parts: F.when(F.forall(F.array(*parts), lambda p: p != ""), F.concat_ws("|", F.lit(name), *parts))
    keys = F.array(
        rule("NP", c("norm_postcode"), F.substring("norm_first_name", 1, 1), F.substring("norm_last_name", 1, 3)),
        rule("LP", c("norm_postcode"), F.substring("norm_last_name", 1, 4)),
        rule("EM", F.substring(local, 1, 4), domain),
        F.when(F.length("norm_phone") >= 8, F.concat(F.lit("PH|"), F.substring("norm_phone", -8, 8))),
        rule("AD", house, c("norm_postcode"), F.substring("norm_last_name", 1, 1)),
    )
    return n.select(RECORD, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def dropped_blocks(n: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """(rule, blocks, records) of the blocks that are too large to compare."""
    sizes = block_keys(n).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest)
    return sizes.groupBy(F.substring("key", 1, 2).alias("rule")).agg(F.count("*").alias("blocks"), F.sum("n").alias("records"))


def _blocked(n: DataFrame, largest: int | None, *columns: str) -> DataFrame:
    """(a, b): records of one block as structs of the id and the columns, a before b; a pair may come from several blocks."""
    keys = block_keys(n)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.lit(largest is None) | (F.col("n") <= (largest or 0)))).select("key")
    kept = keys.join(sizes, "key").join(n.select(RECORD, *columns), RECORD)
    side = lambda s: kept.select("key", F.struct(F.col(RECORD).alias("id"), *columns).alias(s))
    return side("a").join(side("b"), "key").where("a.id < b.id").select("a", "b")


def candidate_pairs(n: DataFrame, largest: int | None = LARGEST_BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of records in one block of 2 to `largest` members; larger blocks say too little to compare.

    None compares every block, whatever its size.
    """
    return _blocked(n, largest).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def promising_pairs(n: DataFrame, largest: int | None = LARGEST_BLOCK) -> DataFrame:
    """Of the candidate pairs those that can reach the score of a probable match, by bounds in built-in functions.

    Each record's characters are counted once; a pair that falls short is dropped where its block is
    joined, before pairs are made distinct and before any string is compared.
    """
    sets = {f"set_{f}": numbered_characters(F.col(c)) for f, c in FIELDS.items() if f != "postcode"}
    pairs = _blocked(n.withColumns(sets), largest, *FIELDS.values(), *sets)
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        a, b = F.col(f"a.{FIELDS[f]}"), F.col(f"b.{FIELDS[f]}")
        both = (a != "") & (b != "")
        bound = (a == b).cast("double") if f == "postcode" else similarity_bound(a, b, F.col(f"a.set_{f}"), F.col(f"b.set_{f}"))
        if f == "phone":
            bound = F.when(_same_tail(a, b), F.greatest(bound, F.lit(0.96))).otherwise(bound)
        total, weight = total + F.when(both, w * bound).otherwise(0.0), weight + F.when(both, w).otherwise(0.0)
    return pairs.where(F.coalesce(F.try_divide(total, weight), F.lit(0.0)) >= PROBABLE - 1e-9).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def exact_links(n: DataFrame) -> DataFrame:
    """(a, b) of each record with one email or phone and the first record of that group: what holds a group together, whatever its size."""
    out = None
    for column in ("norm_email", "norm_phone"):
        has = n.where(F.col(column) != "").select(F.col(column).alias("v"), RECORD)
        lead = has.groupBy("v").agg(F.min(RECORD).alias("a"), F.count("*").alias("size")).where("size > 1")
        part = has.join(lead, "v").where(F.col("a") < F.col(RECORD)).select("a", F.col(RECORD).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def _same_tail(a: Column, b: Column) -> Column:
    return (F.length(a) >= 8) & (F.length(b) >= 8) & (F.substring(a, -8, 8) == F.substring(b, -8, 8)) & (a != b)


def pair_components(pairs: DataFrame, n: DataFrame) -> DataFrame:
    """Similarities of each field and the weighted score over fields that both records have."""
    side = lambda s: n.select(F.col(RECORD).alias(s), *[F.col(c).alias(f"{s}_{f}") for f, c in FIELDS.items()])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    sims = {f"{f}_similarity": similarity(f"a_{f}", f"b_{f}") for f in ("first", "last", "email", "address", "phone")}
    j = j.withColumns(sims).withColumn("postcode_similarity", ((F.col("a_postcode") != "") & (F.col("a_postcode") == F.col("b_postcode"))).cast("double"))
    j = j.withColumn("phone_similarity", F.when(_same_tail(F.col("a_phone"), F.col("b_phone")), 0.96).otherwise(F.col("phone_similarity")))
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        both = (F.col(f"a_{f}") != "") & (F.col(f"b_{f}") != "")
        total, weight = total + F.when(both, w * F.col(f"{f}_similarity")).otherwise(0.0), weight + F.when(both, w).otherwise(0.0)
    j = j.withColumn("score", F.coalesce(F.try_divide(total, weight), F.lit(0.0)))
    return j.select(*pairs.columns, "score", *[f"{f}_similarity" for f in FIELDS])


def conflict(s) -> Column:  # noqa: ANN001
    """Names disagree without contact evidence, or both contacts disagree without a name match."""
    email, phone, first, last = (s(f"{f}_similarity") for f in ("email", "phone", "first", "last"))
    name = (first >= 0.82) & (last >= 0.85)
    return ((first < 0.30) & (last < 0.30) & (email < 0.97) & (phone < 0.97)) | ((email > 0) & (email < 0.35) & (phone > 0) & (phone < 0.35) & ~name)


def pair_verdict(scored: DataFrame) -> DataFrame:
    """Adds signals, conflict and the first failed rule (null where the pair passes)."""
    c = F.col
    email, phone = c("email_similarity") >= 0.97, c("phone_similarity") >= 0.97
    name = (c("first_similarity") >= 0.82) & (c("last_similarity") >= 0.85)
    place = (c("address_similarity") >= 0.88) & (c("postcode_similarity") >= 1.0)
    signals = email.cast("int") + phone.cast("int") + name.cast("int") + place.cast("int")
    out = scored.withColumns({"signals": signals, "material_conflict": conflict(c)})
    reason = (
        F.when(c("score") < PROBABLE, "Below probabilistic threshold")
        .when(c("material_conflict"), "Material identity conflict")
        .when(c("signals") < 2, "Insufficient corroborating signals")
        .when(~(email | phone | name), "No person-level identity signal")
        .when(name & place & ~email & ~phone & ((c("first_similarity") < 0.94) | (c("last_similarity") < 0.94)), "Name/address evidence not strong enough")
    )
    return out.withColumn("rejection_reason", reason)


Fields = list[str]


def _field(f: str, p: str, q: str, measure=ratio) -> float:  # noqa: ANN001
    if f == "postcode":
        return float(p == q and p != "")
    if f == "phone" and p != q and len(p) >= 8 and len(q) >= 8 and p[-8:] == q[-8:]:
        return 0.96
    return measure(p, q)


def _score(fx: Fields, fy: Fields, measure=ratio) -> float:  # noqa: ANN001
    """Weighted score of two records' fields; by ratio_bound no less than that."""
    total, weight = 0.0, 0.0
    for f, p, q in zip(FIELDS, fx, fy, strict=True):
        if p and q:
            total, weight = total + WEIGHTS[f] * _field(f, p, q, measure), weight + WEIGHTS[f]
    return total / weight if weight else 0.0


def _conflicts(fx: Fields, fy: Fields) -> bool:
    """What conflict() says, of two records' fields; names are looked at only where the contacts leave it open."""
    email, phone = (_field(f, fx[i], fy[i]) for f, i in (("email", EMAIL), ("phone", PHONE)))
    unlike = 0 < email < 0.35 and 0 < phone < 0.35
    if (email >= 0.97 or phone >= 0.97) and not unlike:
        return False
    first, last = ratio(fx[0], fy[0]), ratio(fx[1], fy[1])
    return (first < 0.3 and last < 0.3 and email < 0.97 and phone < 0.97) or (unlike and not (first >= 0.82 and last >= 0.85))


def _refusal(left: list[Fields], right: list[Fields]) -> str | None:
    """Why two clusters may not be joined, from the fields of the first members of each."""
    pairs = [(x, y) for x in left for y in right]
    if sum(_conflicts(x, y) for x, y in pairs) / len(pairs) > 0.25:
        return "Cluster conflict rate too high"
    if len(pairs) > 1:
        for measure in (ratio_bound, ratio):  # most refusals need no string compared
            scores = [_score(x, y, measure) for x, y in pairs]
            if sum(scores) / len(scores) < CLUSTER_MEAN - 1e-9 * (measure is ratio_bound) and max(scores) < CERTAIN:
                return "Insufficient cluster-wide consistency"
    return None


@F.arrow_udf(T.StringType())
def refusal(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([_refusal(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.string())


class _Cluster:
    """Members, the first of them in order, and a number that changes when those change."""

    def __init__(self, record: str, state: int) -> None:
        self.members, self.lead, self.state = [record], [record], state


class _Linker:
    """Greedy gated linking inside one component, in order: each email group, each phone group, then probable pairs by score.

    In a group of one email or phone every pair is tried in order. What two clusters gave is kept
    until the first members of one change, and a cluster that was tried in vain against all others
    of its group is not tried again, so a group costs its size times its clusters, not its pairs.
    """

    def __init__(self, fields: dict[str, Fields]) -> None:
        self.fields = fields
        self.cluster = {x: _Cluster(x, i) for i, x in enumerate(sorted(fields))}
        self.states = len(fields)
        self.known: dict[tuple[int, int], str | None] = {}
        self.decided: list[tuple] = []
        self.best: dict[str, tuple[float, str]] = {}

    def attempt(self, a: str, b: str, method: str, confidence: float) -> bool:
        """Whether the clusters of a and b became one."""
        left, right = self.cluster[a], self.cluster[b]
        if left is right:
            return False
        key = (left.state, right.state)
        if key not in self.known:
            self.known[key] = _refusal([self.fields[x] for x in left.lead], [self.fields[x] for x in right.lead])
            if self.known[key] is not None:
                self.decided.append((a, b, method, confidence, False, self.known[key], None, None))
        if self.known[key] is not None:
            return False
        self.decided.append((a, b, method, confidence, True, None, None, None))
        into, other = (left, right) if len(left.members) >= len(right.members) else (right, left)
        for x in other.members:
            self.cluster[x] = into
        into.members += other.members
        before = into.lead[:]
        for x in other.lead:
            insort(into.lead, x)
        del into.lead[MEMBERS:]
        if into.lead != before:
            into.state, self.states = self.states, self.states + 1
        for x in (a, b):
            self.best[x] = max(self.best.get(x, (0.0, "")), (confidence, method))
        return True

    def exact(self, field: int, method: str) -> None:
        groups: dict[str, list[str]] = {}
        for x in sorted(self.fields):
            if self.fields[x][field]:
                groups.setdefault(self.fields[x][field], []).append(x)
        for _, group in sorted(groups.items()):
            merges, vain = 0, {}
            for i, a in enumerate(group):
                if vain.get(id(self.cluster[a])) == merges:
                    continue
                start = merges
                for b in group[i + 1 :]:
                    merges += self.attempt(a, b, method, 0.99)
                if merges == start:
                    vain[id(self.cluster[a])] = merges

    def rows(self) -> Iterator[tuple]:
        yield from self.decided
        for x, c in self.cluster.items():
            confidence, method = self.best.get(x, (None, None))
            yield (x, c.lead[0], method, confidence, None, None, c.lead[0], len(c.members))


def link_component(fields: dict[str, Fields], probable: list[tuple[float, str, str]]) -> list[tuple]:
    """Rows of LINKS: each edge that was decided, then each record with its cluster."""
    linker = _Linker(fields)
    linker.exact(EMAIL, "Exact Email")
    linker.exact(PHONE, "Exact Phone")
    for score, a, b in sorted(probable, key=lambda e: (-e[0], e[1], e[2])):
        linker.attempt(a, b, "Probabilistic High Confidence" if score >= CERTAIN else "Probabilistic", score)
    return list(linker.rows())


LINKS = "a string, b string, match_method string, confidence double, accepted boolean, rejection_reason string, cluster string, size long"
_LINK_TYPES = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
_LINK_NAMES = [x.split(" ")[0] for x in LINKS.split(", ")]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that lie behind one another as rows (component, a, b, score, f); records have no b. One is held at a time."""
    now: str | None = None
    fields: dict[str, Fields] = {}
    probable: list[tuple[float, str, str]] = []
    out: list[tuple] = []

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_LINK_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINK_TYPES, strict=True)], names=_LINK_NAMES)

    for batch in batches:
        for component, a, b, score, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if component != now and fields:
                out += link_component(fields, probable)
                fields, probable = {}, []
            now = component
            if b is None:
                fields[a] = f
            else:
                probable.append((score, a, b))
        if len(out) > 10_000:
            yield given(out)
            out = []
    if fields:
        out += link_component(fields, probable)
    yield given(out)


def _leads(members: DataFrame) -> DataFrame:
    """(cluster, f, first, last, size, state): each cluster's first members, with a hash of them. Found in parts by a hash, so no cluster meets in one task."""
    part = Window.partitionBy("cluster", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = members.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= MEMBERS).drop("_r")
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("_r") <= MEMBERS)
    lead = few.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("id", "f"))).alias("m"))
    return lead.select("cluster", F.col("m.f").alias("f"), F.col("m.id")[0].alias("first"), F.element_at("m.id", -1).alias("last"), F.size("m").alias("size"), F.xxhash64("m.id").alias("state"))


def exact_in_rounds(scratch: Scratch, members: DataFrame, place: int) -> tuple[DataFrame, list[DataFrame]]:
    """What _Linker.exact gives, for groups of any size: members (id, f, cluster) after it, and tables of decided edges.

    A group is worked on once no earlier group that shares a cluster with it is left, so groups at
    work are apart. In each, one record a is matched with all later ones at once: up to the first
    accepted one that changes the first members of a's cluster, outcomes cannot depend on each other.
    """
    groups = members.select("id", F.col("f")[place].alias("v")).where("v <> ''")
    groups = scratch.stored(groups.join(groups.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "v"), "groups")
    state = scratch.stored(groups.groupBy("v").agg(F.min("id").alias("a")).select("v", "a", F.col("a").alias("pos"), F.lit(False).alias("moved")), "state")
    vain = scratch.stored(groups.select("v", F.col("id").alias("cluster")).limit(0), "vain")
    decided = []
    while state.limit(1).count():
        of = members.select("id", "cluster")
        live = scratch.stored(groups.join(state, "v").join(of, "id"), "live")
        firsts = live.groupBy("cluster").agg(F.min("v").alias("_v"))
        waiting = scratch.stored(live.join(firsts, "cluster").where("v <> _v").select("v").distinct(), "waiting")
        work = live.join(waiting, "v", "left_anti")
        own = work.where("id = a").select("v", F.col("cluster").alias("c"))
        tried = scratch.stored(work.join(own, "v").where("id > pos and cluster <> c").select("v", "a", "id", "c", F.col("cluster").alias("d")), "tried")
        ends = tried.select(F.col("c").alias("cluster")).union(tried.select("d")).distinct()
        lead = scratch.stored(_leads(members.join(ends, "cluster", "left_semi")), "leads")
        side = lambda s, t=lead: t.select(F.col("cluster").alias(s), F.struct("f", "first", "last", "size", "state").alias(f"_{s}"))
        gated = tried.select("c", "d").distinct().join(side("c"), "c").join(side("d"), "d")
        changes = (F.col("_c.size") < MEMBERS) | (F.col("_d.first") < F.col("_c.last"))
        gated = scratch.stored(gated.select("c", "d", F.col("_c.state").alias("state_a"), F.col("_d.state").alias("state_b"), refusal("_c.f", "_d.f").alias("why"), changes.alias("changes")), "gated")
        told = scratch.stored(tried.join(gated, ["c", "d"]), "told")
        stops = told.where("why is null and changes").groupBy("v").agg(F.min("id").alias("stop"))
        now = scratch.stored(told.join(stops, "v", "left").where("stop is null or id <= stop"), "now")
        once = now.groupBy("v", "a", "c", "d").agg(F.min("id").alias("b"), *[F.first(x).alias(x) for x in ("why", "state_a", "state_b")])
        decided.append(scratch.stored(once.select("v", "a", "b", "why", "state_a", "state_b"), "decided"))

        joined = now.where("why is null").select("v", "c", "d").distinct()
        new = joined.groupBy("c").agg(F.least("c", F.min("d")).alias("new"))
        renamed = new.select(F.col("c").alias("cluster"), "new").union(joined.join(new, "c").select(F.col("d").alias("cluster"), "new")).distinct()
        members = scratch.stored(members.join(renamed, "cluster", "left").select("id", "f", F.coalesce("new", "cluster").alias("cluster")), "members")

        # the next record of each group at work, or the same one behind the stop
        merged = scratch.stored(joined.select("v").distinct().withColumn("merges", F.lit(True)), "merged")
        after = state.join(waiting, "v", "left_anti").join(stops, "v", "left").join(merged, "v", "left").withColumn("moved", F.col("moved") | F.coalesce("merges", F.lit(False)))
        after = scratch.stored(after.select("v", "a", "stop", "moved", "merges").join(own, "v"), "after")
        kept = vain.join(after.where("merges").select("v"), "v", "left_anti")
        vain = scratch.stored(kept.unionByName(after.where("stop is null and not moved").select("v", F.col("c").alias("cluster"))), "vain")
        ahead = groups.join(after.where("stop is null").select("v", "a"), "v").where("id > a").join(members.select("id", "cluster"), "id").join(vain, ["v", "cluster"], "left_anti")
        following = ahead.groupBy("v").agg(F.min("id").alias("a")).select("v", "a", F.col("a").alias("pos"), F.lit(False).alias("moved"))
        again = after.where("stop is not null").select("v", "a", F.col("stop").alias("pos"), "moved")
        state = scratch.stored(state.join(waiting, "v", "left_semi").unionByName(following).unionByName(again), "state")
    return members, decided


def link_in_rounds(records: DataFrame, probable: DataFrame, n: DataFrame) -> DataFrame:
    """What link_component gives, for the components that hold the records (id), of any size, as rounds of joins; no component, group or cluster is gathered.

    A probable pair is decided when its outcome can no longer depend on an undecided one: it is the
    first left of one of its clusters (the partner), and all earlier ones of the other (the hub) are
    decided before it in this round without changing the hub's first members or bringing it other
    pairs. The first pair of all is always decided, and a star of any size needs a dozen rounds.
    """
    scratch = Scratch(n.sparkSession, "links")
    text = F.array(*[F.col(c) for c in FIELDS.values()])
    members = scratch.stored(records.join(n.select(F.col(RECORD).alias("id"), text.alias("f")), "id").select("id", "f", F.col("id").alias("cluster")), "members")
    decided = []
    columns = ["phase", "v", "a", "b", "match_method", "confidence", "why", "state_a", "state_b"]
    for phase, (place, method) in enumerate(((EMAIL, "Exact Email"), (PHONE, "Exact Phone"))):
        members, parts = exact_in_rounds(scratch, members, place)
        decided += [p.withColumns({"phase": F.lit(phase), "match_method": F.lit(method), "confidence": F.lit(0.99)}).select(*columns) for p in parts]
    left = probable
    while True:
        of = lambda s, m=members: m.select(F.col("id").alias(s), F.col("cluster").alias(f"c{s}"))
        pending = left.select("a", "b", "score").join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
        pending = scratch.stored(pending.withColumn("key", F.struct((-F.col("score")).alias("s"), "a", "b")), "pending")
        if pending.limit(1).count() == 0:
            break
        both = pending.select("key", F.col("ca").alias("c"), F.col("cb").alias("d")).union(pending.select("key", "cb", "ca"))
        first = scratch.stored(both.groupBy("c").agg(F.min("key").alias("first"), F.count("*").alias("degree")), "first")
        near = both.join(first.select(F.col("c").alias("d"), F.col("first").alias("d_first"), F.col("degree").alias("d_degree")), "d")
        # up to the first edge whose partner still waits for another
        waits = near.groupBy("c").agg(F.min(F.when(F.col("d_first") != F.col("key"), F.col("key"))).alias("waits"))
        open_edges = near.join(waits, "c").where("waits is null or key < waits")
        lead = scratch.stored(_leads(members), "lead")
        side = lambda s, t=lead: t.select(F.col("cluster").alias(f"c{s}"), F.col("f").alias(f"f{s}"), F.col("state").alias(f"state_{s}"))
        gated = pending.join(open_edges.select("key").distinct(), "key").join(side("a"), "ca").join(side("b"), "cb").withColumn("why", refusal("fa", "fb")).drop("fa", "fb")
        gated = scratch.stored(gated, "gated")
        ends = open_edges.join(gated.select("key", F.col("why").isNull().alias("accepted")), "key").join(lead.select(F.col("cluster").alias("c"), (F.col("size") == MEMBERS).alias("full"), "last"), "c")
        harmless = F.col("full") & (F.col("d") > F.col("last")) & (F.col("d_degree") == 1)
        ends = scratch.stored(ends.withColumn("stops", F.col("accepted") & ~harmless), "ends")
        stop = ends.groupBy("c").agg(F.min(F.when(F.col("stops"), F.col("key"))).alias("stop"))
        ready = scratch.stored(ends.join(stop, "c").where("stop is null or key <= stop").select("key", "c", "d", "d_degree", "accepted"), "ready")
        now = gated.join(ready.select("key").distinct(), "key")
        named = F.when(F.col("score") >= CERTAIN, "Probabilistic High Confidence").otherwise("Probabilistic")
        told = now.withColumns({"phase": F.lit(2), "v": F.lit(""), "match_method": named, "confidence": F.col("score")})
        decided.append(scratch.stored(told.select(*columns), "decided"))
        # one hub an edge: the cluster that may have more edges in this round is the one whose partner has no other
        hubs = ready.where("accepted").groupBy("key").agg(F.min_by(F.struct("c", "d"), F.struct("d_degree", "c")).alias("e")).select("e.*")
        named = hubs.groupBy("c").agg(F.least("c", F.min("d")).alias("new"))
        renamed = named.select(F.col("c").alias("cluster"), "new").union(hubs.join(named, "c").select(F.col("d").alias("cluster"), "new"))
        members = scratch.stored(members.join(renamed, "cluster", "left").select("id", "f", F.coalesce("new", "cluster").alias("cluster")), "members")
        left = pending.join(ready.select("key").distinct(), "key", "left_anti")
    every = None
    for part in decided:
        every = part if every is None else every.unionByName(part)
    whole = members.select("id", "cluster").join(members.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    none = lambda kind: F.lit(None).cast(kind)
    if every is None:
        out = whole.select(F.col("id").alias("a"), F.col("cluster").alias("b"), none("string").alias("match_method"), none("double").alias("confidence"), none("boolean").alias("accepted"), none("string").alias("rejection_reason"), "cluster", "size")
    else:
        # a refusal counts once for each state of two clusters
        order = F.struct("phase", "v", (-F.col("confidence")).alias("s"), "a", "b")
        once = every.where("why is not null").groupBy("state_a", "state_b").agg(F.min_by(F.struct(*columns), order).alias("e")).select("e.*")
        links = every.where("why is null").unionByName(once).select("a", "b", "match_method", "confidence", F.col("why").isNull().alias("accepted"), F.col("why").alias("rejection_reason"), none("string").alias("cluster"), none("long").alias("size"))
        best = every.where("why is null").select(F.explode(F.array("a", "b")).alias("id"), F.struct("confidence", "match_method").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
        out = links.unionByName(whole.join(best, "id", "left").select(F.col("id").alias("a"), F.col("cluster").alias("b"), "m.match_method", "m.confidence", none("boolean").alias("accepted"), none("string").alias("rejection_reason"), "cluster", "size"))
    out = stored(out, "links")
    scratch.drop()
    return out


def resolve(records: DataFrame, *, largest: int | None = LARGEST_BLOCK, gathered: int = GATHERED) -> tuple[DataFrame, DataFrame]:
    """(resolution, edge audit). Components of candidate edges are linked independently, each in the fixed order.

    In every group of one email or phone, of any size, all pairs are tried in order; then probable
    pairs by score. The audit has each accepted edge, and each refused pair of clusters once for each
    state of their first members. A record without candidates stands alone. Missing fields are never
    evidence; linking reads no ground-truth column. Blocks of more than `largest` records give no
    probable pairs; None compares all. A component of at most `gathered` records and pairs is one
    task's work; larger ones are linked in rounds of joins, with the same result.
    """
    n = stored(add_normalised_fields(records), "normalised")
    probable = pair_verdict(pair_components(promising_pairs(n, largest), n)).where("rejection_reason is null").select("a", "b", "score")
    probable = stored(probable, "probable")
    label = connected_components(probable.select("a", "b").unionByName(exact_links(n)))
    pairs = probable.join(label.select(F.col("id").alias("a"), "component"), "a")
    sizes = label.select("component").unionByName(pairs.select("component")).groupBy("component").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > gathered).select("component"), "large")
    text = F.array(*[F.col(c) for c in FIELDS.values()])
    nothing = F.lit(None)
    rows = label.join(n.select(F.col(RECORD).alias("id"), text.alias("f")), "id").select("component", F.col("id").alias("a"), nothing.cast("string").alias("b"), nothing.cast("double").alias("score"), "f")
    rows = rows.unionByName(pairs.select("component", "a", "b", "score", nothing.cast("array<string>").alias("f"))).join(large, "component", "left_anti")
    linked = stored(rows.repartition("component").sortWithinPartitions("component").mapInArrow(_linked, LINKS), "links")
    if large.limit(1).count():
        linked = linked.unionByName(link_in_rounds(label.join(large, "component", "left_semi").select("id"), pairs.join(large, "component", "left_semi"), n))
    audit = linked.where("accepted is not null").select("a", "b", "match_method", "confidence", "accepted", "rejection_reason")
    member = linked.where("cluster is not null").select(F.col("a").alias(RECORD), "cluster", "size", "match_method", "confidence")
    out = records.join(member, RECORD, "left").withColumns({"cluster": F.coalesce("cluster", RECORD), "records_linked": F.coalesce("size", F.lit(1))})
    alone = F.col("records_linked") == 1
    ranked = out.withColumns({
        "match_confidence": F.when(alone, 1.0).otherwise(F.coalesce("confidence", F.lit(0.90))),
        "match_method": F.when(alone, "Standalone").otherwise(F.coalesce("match_method", F.lit("Cluster Link"))),
        "identity_resolution_status": F.when(alone, "Standalone").otherwise("Resolved"),
        "golden_customer_id": F.concat(F.lit("GOLDEN_"), F.substring("cluster", 5, 20)),
    })
    return ranked.withColumn("ambiguous_match_flag", F.col("match_confidence") < 0.90).drop("cluster", "size", "confidence"), audit


def address_key_resolution(records: DataFrame) -> DataFrame:
    """The plain rule that linking is measured against: one golden customer for each normalised address and postcode.

    A record without either stands alone.
    """
    n = add_normalised_fields(records)
    whole = (F.col("norm_address") != "") & (F.col("norm_postcode") != "")
    keyed = n.withColumn("golden_customer_id", F.when(whole, F.concat_ws("|", "norm_address", "norm_postcode")).otherwise(F.col(RECORD)))
    many = F.col("_records") > 1
    sizes = keyed.groupBy("golden_customer_id").agg(F.count("*").alias("_records"))
    out = keyed.join(sizes, "golden_customer_id").withColumns({"match_method": F.when(many, "Address Key").otherwise("Standalone"), "match_confidence": F.when(many, 0.9).otherwise(1.0)})
    return out.select(*records.columns, "golden_customer_id", "match_method", "match_confidence")


def evaluate(resolution: DataFrame, truth: str = "true_person_id", found: str = "golden_customer_id") -> DataFrame:
    """Pairwise precision, recall, F1, false-merge and missed-link rates from cluster sizes, without making pairs."""
    pairs = lambda n: n * (n - 1) / 2
    both = resolution.groupBy(truth, found).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("tp"))
    pred = resolution.groupBy(found).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("predicted"), F.count("*").alias("golden_customers"))
    true = resolution.groupBy(truth).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("actual"), F.count("*").alias("true_customers"))
    r = both.crossJoin(pred).crossJoin(true)  # one row each
    r = r.withColumns({"precision": F.coalesce(F.try_divide("tp", "predicted"), F.lit(1.0)), "recall": F.coalesce(F.try_divide("tp", "actual"), F.lit(1.0)), "false_merge_rate": F.coalesce(F.try_divide(F.col("predicted") - F.col("tp"), F.col("predicted")), F.lit(0.0)), "missed_link_rate": F.coalesce(F.try_divide(F.col("actual") - F.col("tp"), F.col("actual")), F.lit(0.0))})
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def golden_transactions(tx: DataFrame, lookup: DataFrame) -> DataFrame:
    """Transactions with their golden customer by source id; an unresolved one, or a source id that the lookup repeats, fails the job."""
    j = checked_join(tx, lookup.select("source_customer_id", F.col("golden_customer_id").alias("_g")), ["source_customer_id"])
    found = F.when(F.col("_g").isNull(), F.raise_error(F.lit("a transaction has no golden customer"))).otherwise(F.col("_g"))
    return j.withColumn("golden_customer_id", found).drop("_g")


def golden_master(resolution: DataFrame) -> DataFrame:
    """A representative record for each golden customer (primary role, most complete, smallest source id) with its sources."""
    fields = ["first_name", "last_name", "email", "phone", "address", "postcode"]
    complete = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    role = F.when(F.col("source_role") == "Primary", 1).when(F.col("source_role") == "Fragment", 2).otherwise(9)
    rep = first_by(resolution, ["golden_customer_id"], [role.asc(), complete.desc(), F.col("source_customer_id").asc()]).select("golden_customer_id", *fields, F.col("source_customer_id").alias("representative_source_customer_id"), F.col("source_system").alias("representative_source_system"))
    agg = resolution.groupBy("golden_customer_id").agg(F.countDistinct("source_customer_id").alias("source_records_linked"), F.concat_ws(" | ", F.array_sort(F.collect_set("source_system"))).alias("source_systems"))
    return rep.join(agg, "golden_customer_id")


def reconciliation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, orders and money before and after resolution, with their differences."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        m = {"transactions": F.count("*").cast("double"), "orders": F.countDistinct("order_id").cast("double"), "units": F.sum("units").cast("double"), "net_sales": cents(F.sum("net_sales")), "cost": cents(F.sum("cost")), "gross_margin": cents(F.sum("gross_margin"))}
        one = df.agg(*[v.alias(k) for k, v in m.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias(name)) for k in m])).alias("x")).select("x.*")

    return sums(before, "before_value").join(sums(after, "after_value"), "metric").withColumn("difference", cents(F.col("after_value") - F.col("before_value")))
