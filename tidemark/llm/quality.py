"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each document gives a vector of transformed text statistics. For each language and source a
minimum-covariance-determinant estimate is fitted: from several robust starts, concentration steps
(centre and covariance of the share of rows that lie closest, again and again) go on until the
determinant settles. A group's estimate is drawn towards its language's, and that towards the one of
all documents, by a weight of PRIOR_ROWS rows, so small groups need no rule of their own. A document
is rejected when its squared Mahalanobis distance from its group's estimate exceeds the chi-square
quantile of a stated tail.

All groups of all three levels are fitted by the same few jobs. A step is one pass: moments are
summed by group and narrow bins of distance, and the closest bins are taken until they hold the
share. No group is gathered, whatever its size; models are small tables whose joins Spark plans by
their size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, text_or_empty
from tidemark.sources.storage import Scratch

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Statistic vector: name and the least standard deviation it may be given (its measuring noise).
DIMENSIONS = {"x_word_length": 0.06, "x_symbols": 0.03, "x_dup_lines": 0.08, "x_repeats": 0.05}
#: Rows that a parent's estimate counts for in a group's own: five for each dimension.
PRIOR_ROWS = 5 * len(DIMENSIONS)
#: Bins of distance for each doubling; one step's share is exact to a bin of 1.1 percent.
BINS = 64
STARTS = ("scale", "sign", "tanh")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row, from whole texts.

    A null text has no words. n_repeat_words counts the words that lie in a 3-word window found
    twice or more in the text.
    """
    text = text_or_empty()
    words = docs.withColumns({"_text": text, "_words": words_of(text)})
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.element_at("_words", i + 1), F.element_at("_words", i + 2), F.element_at("_words", i + 3)))).otherwise(F.array().cast("array<bigint>"))
    # positions of each window, sorted so that equal windows are neighbours
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = words.withColumns({"_lines": lines, "_at": ordered})
    last = F.size("_at") - 1
    repeated = F.filter("_at", lambda x, k: ((k > 0) & (F.get("_at", k - 1).h == x.h)) | ((k < last) & (F.get("_at", k + 1).h == x.h)))
    covered = F.sort_array(F.transform(repeated, lambda x: x.i))
    # windows of three words starting at sorted places: each adds the words its predecessor leaves out
    count = F.aggregate(covered, F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("p"), (a.n + F.least(F.lit(3), i - a.p)).alias("n")), lambda a: a.n)
    n_words, symbols = F.size("_words").cast("long"), F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))
    rows = rows.withColumns({
        "n_words": n_words,
        "word_chars": F.length(F.regexp_replace("_text", "[\\x20\\x09-\\x0D]", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(count, F.lit(0)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_text", "_words", "_lines", "_at")


def statistic_vector(rows: DataFrame) -> DataFrame:
    """Transformed statistics, each close to normal and free of the text's length."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns({
        "x_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x_symbols": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))))),
        "x_dup_lines": F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4))),  # a line or two of a short text say little
        "x_repeats": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / words))),
    })


def chi_square_tail(x: float, freedom: int) -> float:
    """P(chi-square of an even number of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_quantile(tail: float, freedom: int) -> float:
    """The x that a chi-square value exceeds with probability `tail`."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, freedom) > tail else (low, mid)
    return high


def consistency(support: float, freedom: int = len(DIMENSIONS)) -> float:
    """What the covariance of the closest share of normal rows is multiplied by to be that of all."""
    return support / (1 - chi_square_tail(chi_square_quantile(1 - support, freedom), freedom + 2))


def _floor(i: int, j: int) -> float:
    return list(DIMENSIONS.values())[i] ** 2 if i == j else 0.0


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _with_cholesky(models: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l00.. of each model's covariance c00.. and the logarithm of its determinant."""
    for i, j in _pairs():
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        models = models.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(_floor(i, i) / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return models.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(len(DIMENSIONS))), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2 from the columns m0.. and l00.. joined to each row."""
    names, out = list(DIMENSIONS), rows
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"_s{k}")
        out = out.withColumn(f"_s{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(len(names))), F.lit(0.0))
    return out.withColumn("d2", total).drop(*[f"_s{i}" for i in range(len(names))])


def _starts(rows: DataFrame, accuracy: int, work: Scratch) -> DataFrame:
    """Three starting models of each group `grp` (columns grp, start, n, m0.., c00..): median centres, with shapes from
    median deviations, from the signs of the standardised rows, and from their hyperbolic tangents."""
    names, p = list(DIMENSIONS), len(DIMENSIONS)
    medians = work.stored(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, accuracy).alias(f"m{i}") for i, x in enumerate(names)], F.count("*").alias("n")), "medians")
    away = rows.join(medians, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, accuracy).alias(f"a{i}") for i, x in enumerate(names)])
    scales = work.stored(medians.join(away, "grp").select("grp", "n", *[f"m{i}" for i in range(p)], *[F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), F.lit(2.0)) + _floor(i, i)).alias(f"a{i}") for i in range(p)]), "scales")
    z = rows.join(scales, "grp").withColumns({f"z{i}": (F.col(x) - F.col(f"m{i}")) / F.col(f"a{i}") for i, x in enumerate(names)})
    z = z.withColumn("r", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))), F.lit(1e-9)))
    sign = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("r") * F.col("r"))).alias(f"g{i}{j}") for i, j in _pairs()]
    tanh = [F.coalesce(F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")), F.lit(0.0)).alias(f"t{i}{j}") for i, j in _pairs()]
    shapes = scales.join(z.groupBy("grp").agg(*sign, *tanh), "grp")
    of = {
        "scale": lambda i, j: F.lit(1.0 if i == j else 0.0),
        "sign": lambda i, j: p * F.col(f"g{i}{j}"),
        "tanh": lambda i, j: F.col(f"t{i}{j}"),
    }
    model = lambda s: F.struct(F.lit(s).alias("start"), *[(of[s](i, j) * F.col(f"a{i}") * F.col(f"a{j}") + _floor(i, j)).alias(f"c{i}{j}") for i, j in _pairs()])
    return shapes.select("grp", "n", *[f"m{i}" for i in range(p)], F.explode(F.array(*[model(s) for s in STARTS])).alias("s")).select("grp", "n", *[f"m{i}" for i in range(p)], "s.*")


def _step(rows: DataFrame, models: DataFrame, support: float) -> DataFrame:
    """One concentration step of every model: centre and covariance (plus the floor) of the share of its group's rows that lie closest."""
    names, p = list(DIMENSIONS), len(DIMENSIONS)
    near = _distance(rows.join(models.select("grp", "start", "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in _pairs()]), "grp"))
    bin_ = F.floor(BINS * F.log2(F.col("d2") + 1e-9)).cast("int")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i, j in _pairs()]
    bins = near.groupBy("grp", "start", "n", bin_.alias("bin")).agg(F.count("*").alias("k"), *sums)
    before = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins, not rows
    taken = bins.withColumn("_before", F.coalesce(F.sum("k").over(before), F.lit(0))).where(F.col("_before") < F.ceil(support * F.col("n")))
    total = taken.groupBy("grp", "start", "n").agg(F.sum("k").alias("h"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _pairs()])
    centre = {f"m{i}": F.col(f"s{i}") / F.col("h") for i in range(p)}
    spread = {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("h") - F.col(f"m{i}") * F.col(f"m{j}") + _floor(i, j) for i, j in _pairs()}
    return _with_cholesky(total.withColumns(centre).withColumns(spread).select("grp", "start", "n", *centre, *spread))


def mcd_models(rows: DataFrame, *, support: float = 0.75, first_steps: int = 2, most_steps: int = 30, accuracy: int = 10_000) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group `grp`: m0.., c00.., l00.., logdet and its number of rows n.

    Every start takes `first_steps` steps, then the one of least determinant goes on until a step
    lowers it no further (settled groups rest). The covariance is that of the closest share plus the
    floor; it has no consistency factor yet.
    """
    work = Scratch(rows.sparkSession, "mcd")
    columns = ["grp", "start", "n", *[f"m{i}" for i in range(len(DIMENSIONS))], *[f"c{i}{j}" for i, j in _pairs()], *[f"l{i}{j}" for i, j in _pairs()], "logdet"]
    model = work.stored(_with_cholesky(_starts(rows, accuracy, work)).select(*columns), "start")
    for _ in range(first_steps):
        model = work.stored(_step(rows, model, support).select(*columns), "step")
    best = model.groupBy("grp").agg(F.min(F.struct("logdet", *[c for c in columns if c not in ("grp", "logdet")])).alias("b")).select("grp", "b.*").select(*columns)
    model, done = work.stored(best, "best"), None
    for _ in range(most_steps):
        now = _step(rows, model, support)
        old = model.select("grp", F.struct(*columns[1:]).alias("_old"))
        better = F.col("_new.logdet") < F.col("_old.logdet") - 1e-9
        moved = work.stored(now.select("grp", F.struct(*columns[1:]).alias("_new")).join(old, "grp").select("grp", better.alias("_better"), F.when(better, F.col("_new")).otherwise(F.col("_old")).alias("m")), "step")
        settled = moved.where("not _better").select("grp", "m.*")
        done = settled if done is None else done.unionByName(settled)
        model = moved.where("_better").select("grp", "m.*")
        if model.limit(1).count() == 0:
            break
    out = stored(done.unionByName(model).drop("start"), "mcd-models")
    work.drop()
    return out


def _drawn(own: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Models drawn towards their parents': n rows' worth of their own and PRIOR_ROWS of the parent's centre and covariance."""
    names = [*[f"m{i}" for i in range(len(DIMENSIONS))], *[f"c{i}{j}" for i, j in _pairs()]]
    both = own.join(parent.select(F.col("grp").alias(on), *[F.col(c).alias(f"_{c}") for c in names]), on)
    return both.select(*[c for c in own.columns if c not in names], *[((F.col("n") * F.col(c) + PRIOR_ROWS * F.col(f"_{c}")) / (F.col("n") + PRIOR_ROWS)).alias(c) for c in names])


def quality_verdicts(docs: DataFrame, *, tail: float = 1e-15, support: float = 0.75, with_text: bool = True) -> DataFrame:
    """Every row with its base statistics, base_failed, d2 and kept; no row is dropped.

    Groups are (lang, source), null values being values of their own. The estimates come from rows
    that pass the base rules; if none does, nothing is kept. A row is kept if it passes them and its
    distance is one that a share `tail` of normal rows exceeds at most; the tail is far out because
    statistics of sound texts are heavier than normal. Equal rows get equal
    verdicts. Columns of the same names as the added ones are replaced; without with_text the texts
    are left out, and the table that the steps read holds none.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", *DIMENSIONS, "d2", "kept"]
    key = lambda *cols: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]))
    kept = [c for c in docs.columns if c not in own and (with_text or c != "text")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), "text", key("lang", "source").alias("_g2"), key("lang").alias("_g1"))  # no name of the input meets one of ours
    table = stored(statistic_vector(base_statistics(whole)).drop("text"), "quality")
    sound = table.where(~F.col("base_failed")).select("_g2", "_g1", *DIMENSIONS)
    level = lambda kind, name: F.concat(F.lit(kind), name)
    groups = F.explode(F.array(level("2", F.col("_g2")), level("1", F.col("_g1")), F.lit("0")))
    fitted = mcd_models(sound.select(groups.alias("grp"), *DIMENSIONS), support=support)

    factor, names = consistency(support), [f"c{i}{j}" for i, j in _pairs()]
    widened = fitted.withColumns({f"c{i}{j}": factor * (F.col(f"c{i}{j}") - _floor(i, j)) + _floor(i, j) for i, j in _pairs()}).select("grp", "n", *[f"m{i}" for i in range(len(DIMENSIONS))], *names)
    part = lambda kind: widened.where(F.substring("grp", 1, 1) == kind)
    langs = _drawn(part("1").withColumn("_up", F.lit("0")), part("0"), "_up").drop("_up")
    parents = sound.select(level("2", F.col("_g2")).alias("grp"), level("1", F.col("_g1")).alias("_up")).distinct()
    final = _with_cholesky(_drawn(part("2").join(parents, "grp"), langs, "_up")).select(F.substring("grp", F.lit(2), F.length("grp")).alias("_g2"), *[f"m{i}" for i in range(len(DIMENSIONS))], *[f"l{i}{j}" for i, j in _pairs()])
    judged = _distance(table.join(stored(final, "quality-models"), "_g2", "left"))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square_quantile(tail, len(DIMENSIONS)), F.lit(False))
    return judged.withColumn("kept", verdict).select("_doc.*", *own)
