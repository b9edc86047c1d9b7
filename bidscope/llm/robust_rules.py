"""Quality rules: robust outliers by minimum-covariance-determinant estimates per language and source.

DataFrame functions only. Texts are read once; the estimates then work on a few numbers per document.
All sums that leave a task are sums of whole numbers, so results do not depend on the order of tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidscope.operators.skew import evaluate_once
from bidscope.session import stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

UNIT = 100  # vectors are kept as whole numbers of 1 / UNIT
NAMES = ("x_length", "x_symbols", "x_lines", "x_repeats")
# Smallest spread taken for each coordinate, in units. Word length varies in every group, so only rounding
# counts. The others are constant for most documents, which must not turn one stray sign or repeated line into
# an outlier; yet each can reject by itself what the plain rules let pass.
SMALLEST_SPREAD = (1.0, 25.0, 35.0, 6.0)

SUBSET = 0.75  # share of a group whose covariance has the smallest determinant
FALLING = 1e-6  # a step counts as long as the determinant's logarithm falls by more than this
MIN_GROUP = 200  # smaller groups are pooled by language, then all together
MAX_DISTANCE = 18.467  # squared distance: chi-square (4) quantile at 0.999
# Chi-square (4) quantiles at 0.75 and 0.975, and what makes covariances of such subsets consistent.
REWEIGHT, SUBSET_FACTOR, REWEIGHT_FACTOR = 11.143, 1.488, 1.064

MAX_BROADCAST_GROUPS = 10_000


def text_statistics(docs: DataFrame, *others: str) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text (null: empty),
    beside ``doc_id, lang, source`` and the columns ``others``.

    A repeated word stands in a three-word window found twice or more. Windows are hashed to 64 bits and
    sorted with their places inside the row, so the work is n log n in a text's words and needs no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda x: F.length(F.translate(x, SPACES, "")) > 0
    rows = evaluate_once(
        docs.select("doc_id", "lang", "source", *others, text.alias("text")),
        words=F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""),
        lines=F.filter(F.split("text", "\n"), has_word),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        *others,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    rows = evaluate_once(rows, windows=F.transform(starts, window)).drop("words")
    # Most texts repeat no window, which a set of the hashes tells without sorting.
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = evaluate_once(rows, windows=F.when(repeats, F.sort_array(placed)).otherwise(none))
    equal = lambda x, i: F.coalesce(
        (F.get("windows", i - 1)["h"] == x["h"]) | (F.get("windows", i + 1)["h"] == x["h"]),
        F.get("windows", i - 1)["h"] == x["h"],
        F.get("windows", i + 1)["h"] == x["h"],
        F.lit(False),
    )
    rows = evaluate_once(rows, at=F.sort_array(F.transform(F.filter("windows", equal), lambda x: x["i"]))).drop("windows")
    new = F.transform("at", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("at", i - 1))))
    count = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", count).drop("at")


def vectors(rows: DataFrame) -> DataFrame:
    """Transformed statistics as whole numbers: log word length, log rates of symbols and repeated lines
    per 100 words, and the share of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    exact = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), F.col("n_repeat_words") / n)
    return rows.withColumns({name: F.round(UNIT * x).cast("long") for name, x in zip(NAMES, exact)})


def _pooled_groups(rows: DataFrame) -> DataFrame:
    """The group each (language, source) is estimated in: its own, its language's small ones, or the rest."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    pooled = F.sum(F.when(F.col("_n") < MIN_GROUP, F.col("_n")).otherwise(0)).over(Window.partitionBy("_lang"))
    own = F.to_json(F.array("_lang", "_source"))
    group = (
        F.when(F.col("_n") >= MIN_GROUP, own).when(pooled >= MIN_GROUP, F.to_json(F.array("_lang"))).otherwise("[]")
    )
    return sizes.select("_lang", "_source", group.alias("_group"))


def _beside(rows: DataFrame, few: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(few) if small else few, keys, "left")


def _quartiles(points: DataFrame) -> DataFrame:
    """Median and spread of every coordinate per group, from counts of equal values."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(x).alias("_x")) for j, x in enumerate(NAMES)]))
    counts = points.select("_group", "_w", each.alias("_e")).groupBy("_group", "_e._j", "_e._x").agg(F.sum("_w").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group", "_j").orderBy("_x"))
    whole = F.sum("_n").over(Window.partitionBy("_group", "_j"))
    ranked = counts.withColumns({"_upto": upto, "_all": whole})
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_x")))
    found = ranked.groupBy("_group", "_j").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    one = lambda c, j: F.max(F.when(F.col("_j") == j, F.col(c))).cast("double")
    d = len(NAMES)
    spread = [F.greatest((one("c", j) - one("a", j)) / 1.349, F.lit(SMALLEST_SPREAD[j])) for j in range(d)]
    return found.groupBy("_group").agg(
        *[one("b", j).alias(f"_m{j}") for j in range(d)],
        *[(spread[j] if j == k else F.lit(0.0)).alias(f"_l{j}{k}") for j in range(d) for k in range(j + 1)],
    )


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor beside the row."""
    z: list[Column] = []
    for j, name in enumerate(NAMES):
        rest = reduce(lambda a, k: a - F.col(f"_l{j}{k}") * z[k], range(j), F.col(name) - F.col(f"_m{j}"))
        z.append(rest / F.col(f"_l{j}{j}"))
    return reduce(add, [x * x for x in z])


def _estimate(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Mean, Cholesky factor of the covariance and ``_det``, its determinant's logarithm, from exact sums.

    A coordinate whose spread is below the smallest one takes that; others are as measured.
    """
    d, n = len(NAMES), F.col("_n").cast("double")
    mean = [F.col(f"_s{j}").cast("double") / n for j in range(d)]
    out = sums.select(*keys, "_n", *[m.alias(f"_m{j}") for j, m in enumerate(mean)], *[F.col(f"_q{j}{k}") for j in range(d) for k in range(j + 1)])
    for j in range(d):
        for k in range(j + 1):
            cov = factor * (F.col(f"_q{j}{k}").cast("double") / n - F.col(f"_m{j}") * F.col(f"_m{k}"))
            cov = F.greatest(cov, F.lit(SMALLEST_SPREAD[j] ** 2)) if j == k else cov
            rest = reduce(lambda a, i: a - F.col(f"_l{j}{i}") * F.col(f"_l{k}{i}"), range(k), cov)
            # Rounding, or coordinates that depend on each other, must not leave a direction without spread.
            out = out.withColumn(f"_l{j}{k}", F.sqrt(F.greatest(rest, F.lit(1.0))) if j == k else rest / F.col(f"_l{k}{k}"))
    return _with_determinant(out.drop("_n", *[f"_q{j}{k}" for j in range(d) for k in range(j + 1)]))


def _with_determinant(estimate: DataFrame) -> DataFrame:
    return estimate.withColumn("_det", reduce(add, [2 * F.log(F.col(f"_l{j}{j}")) for j in range(len(NAMES))]))


def _moments() -> list[Column]:
    """Exact sums over points, each as often as its rows."""
    d, exact, n = len(NAMES), "decimal(38,0)", F.col("_w")
    first = [F.sum((n * F.col(NAMES[j])).cast(exact)).cast(exact).alias(f"_s{j}") for j in range(d)]
    second = [F.sum((n * F.col(NAMES[j]) * F.col(NAMES[k])).cast(exact)).cast(exact).alias(f"_q{j}{k}") for j in range(d) for k in range(j + 1)]
    return [F.sum(n).alias("_n"), *first, *second]


def _concentrate(points: DataFrame, small: bool, estimate: DataFrame, share: float = SUBSET) -> DataFrame:
    """One step: the closest share of every group, by each of its estimates, gives the next estimate.

    Points are counted and summed by narrow bands of distance; the bands up to the wanted share are added
    up, so ties at the edge go in together and no group is ever sorted or held in one place.
    """
    keys = ["_group", "_start"]
    band = F.floor(32 * F.log1p(_distance())).cast("long")
    near = points.join(F.broadcast(estimate) if small else estimate, "_group")
    bands = near.groupBy(*keys, band.alias("_band")).agg(*_moments())
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(before), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    kept = bands.withColumns({"_below": below, "_all": whole}).filter(F.col("_below") < share * F.col("_all"))
    names = [c for c in bands.columns if c not in (*keys, "_band")]
    sums = kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return _estimate(sums, SUBSET_FACTOR, *keys)


def _smallest(points: DataFrame, small: bool) -> DataFrame:
    """Per group the estimate with the smallest determinant that steps from three starts lead to: medians with
    quartile spreads, the half closest by these, and all rows. Each start goes on while its determinant falls;
    only those that still fall are worked on, and only their number reaches the driver."""
    named = lambda rows, k: rows.withColumn("_start", F.lit(k))
    middle = named(_with_determinant(_quartiles(points)), 0)
    half = _concentrate(points, small, middle, 0.5).withColumn("_start", F.lit(1))
    whole = named(_estimate(points.groupBy("_group").agg(*_moments()), SUBSET_FACTOR, "_group"), 2)
    falling = stage(middle.unionByName(half).unionByName(whole), "quality-starts")
    ended = None
    # The starts themselves are no estimates of a subset, so the first step counts in any case.
    falling = stage(_concentrate(points, small, falling), "quality-step")
    while not falling.isEmpty():
        after = _concentrate(points, small, falling)
        old = falling.select("_group", "_start", F.struct(*falling.columns).alias("_old"), F.col("_det").alias("_was"))
        both = stage(after.join(old, ["_group", "_start"]), "quality-step")
        rests = both.filter(F.col("_det") >= F.col("_was") - FALLING).select("_old.*")
        ended = rests if ended is None else ended.unionByName(rests)
        falling = both.filter(F.col("_det") < F.col("_was") - FALLING).drop("_old", "_was")
    if ended is None:
        return falling.drop("_start", "_det")
    columns = [c for c in ended.columns if c != "_group"]
    best = ended.groupBy("_group").agg(F.min(F.struct("_det", "_start", F.struct(*columns).alias("_of"))).alias("_best"))
    return best.select("_group", "_best._of.*").drop("_start", "_det")


def quality_rules(docs: DataFrame, *others: str) -> DataFrame:
    """Statistics and verdict per document: ``base_failed`` by the plain rules, ``kept`` unless that or an outlier.

    Documents that pass the plain rules are judged within their language and source (small groups are
    pooled); null languages and sources form groups of their own. A null or empty text has no words and
    fails the plain rules. Repeated rows count as often as they stand there and get equal verdicts. Columns
    but those named in ``others`` are left out. An empty table gives an empty result.
    """
    rows = vectors(text_statistics(docs, *others))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    null = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = rows.select("*", failed.alias("base_failed"), null("lang").alias("_lang"), null("source").alias("_source"))
    rows = stage(rows, "quality-statistics")
    passed = rows.filter(~F.col("base_failed"))
    small = rows.select("_lang", "_source").distinct().count() <= MAX_BROADCAST_GROUPS
    groups = stage(_pooled_groups(passed), "quality-groups")
    passed = _beside(passed, groups, ["_lang", "_source"], small)
    points = stage(passed.groupBy("_group", *NAMES).agg(F.count(F.lit(1)).alias("_w")), "quality-points")
    estimate = stage(_smallest(points, small), "quality-estimate")
    near = _beside(points, estimate, ["_group"], small).filter(_distance() <= REWEIGHT)
    estimate = _estimate(near.groupBy("_group").agg(*_moments()), REWEIGHT_FACTOR, "_group")
    judged = _beside(_beside(rows, groups, ["_lang", "_source"], small), stage(estimate, "quality-estimate"), ["_group"], small)
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= MAX_DISTANCE, F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *others, *counts, "base_failed", kept.alias("kept"), F.round(distance, 3).alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, that the rules keep. Each row travels with its statistics, so that no text is
    shuffled or looked up again."""
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    judged = quality_rules(docs.select("doc_id", "lang", "source", "text", row.alias("_row")), "_row")
    return judged.filter("kept").select("_row.*")
