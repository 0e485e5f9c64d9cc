"""Questions about labels: forward returns, transitions, segments, and how well a labelling separates the future."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.functions.frames import order, past, finite, whole
from tidegauge.operators.features import numbered
from tidegauge.operators.regimes import fuzzy_name
from tidegauge.schema import REGIMES, UNKNOWN

# --- forward returns ---------------------------------------------------------------------------------------------


def forward_return(horizon: int, method: str = "simple") -> Column:
    """Return from this close to the one ``horizon`` bars on; null in the last bars."""
    later = F.try_divide(F.lead("close", horizon).over(order()), F.col("close"))
    return finite(later - 1) if method == "simple" else finite(F.when(later > 0, F.log(later)))


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), method: str = "simple") -> DataFrame:
    """fwd_{h}d_return and fwd_{h}d_cumulative (the price ratio)."""
    made = {f"fwd_{h}d_return": forward_return(h, method) for h in horizons}
    return df.withColumns(made | {f"fwd_{h}d_cumulative": F.try_divide(F.lead("close", h).over(order()), F.col("close")) for h in horizons})


def long_returns(df: DataFrame, horizons: tuple[int, ...], *keep: str) -> DataFrame:
    """One row per bar and horizon with a known forward return ``r``."""
    made = df.withColumns({f"_f{h}": forward_return(h) for h in horizons})
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("r")) for h in horizons])).alias("x")
    return made.select("symbol", "ts", *keep, pairs).select("symbol", "ts", *keep, "x.horizon", "x.r").where("r is not null")


def sortino(r: Column) -> Column:
    """Mean per root mean square of the negative returns; without any, infinity for a positive mean and 0 otherwise."""
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    mean = F.avg(r)
    return F.when(down > 0, mean / down).when(mean > 0, F.lit(float("inf"))).otherwise(0.0)


def distribution(r: Column) -> list[Column]:
    """Statistics of a group of returns; skewness and kurtosis are bias-corrected."""
    n, g1, g2 = F.count(r).cast("double"), F.skewness(r), F.kurtosis(r)
    return [
        F.count(r).alias("count"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"),
        F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        *[F.percentile(r, F.lit(p / 100)).alias(f"p{p}") for p in (5, 25, 75, 95)],
        (100 * F.avg((r > 0).cast("double"))).alias("positive_pct"), F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"), sortino(r).alias("sortino"),
    ]


def forward_stats(df: DataFrame, horizons: tuple[int, ...] = (5, 10), regime: str = "regime") -> DataFrame:
    """Per horizon and known regime, and over all bars as regime 'Overall': the distribution of forward returns."""
    long = long_returns(df, horizons, regime).select("horizon", "r", F.col(regime).alias("regime"))
    got = long.groupingSets([["horizon", "regime"], ["horizon"]], "horizon", "regime").agg(*distribution(F.col("r")), F.grouping("regime").alias("_all"))
    got = got.where((F.col("_all") == 1) | (F.col("regime") != UNKNOWN))
    return got.withColumn("regime", F.when(F.col("_all") == 1, "Overall").otherwise(F.col("regime"))).drop("_all")


def conditional_forward(df: DataFrame, condition: Column, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Forward returns of the bars that meet a condition (looking ahead over all bars)."""
    return long_returns(df.withColumn("_met", condition), horizons, "_met").where("_met").groupBy("horizon").agg(*distribution(F.col("r")))


def fuzzy_forward(df: DataFrame, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Membership-weighted mean, deviation and ratio of forward returns per regime."""
    long = long_returns(df, horizons, *[fuzzy_name(r) for r in REGIMES])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(fuzzy_name(r)).alias("w")) for r in REGIMES])).alias("x")
    w, r = F.col("w"), F.col("r")
    total = F.sum(w)
    got = long.select("horizon", "r", pairs).select("horizon", "r", "x.*").where("w is not null").groupBy("horizon", "regime").agg(total.alias("weight"), F.try_divide(F.sum(w * r), total).alias("mean"), F.try_divide(F.sum(w * r * r), total).alias("second"))
    got = got.withColumn("std", F.sqrt(F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return got.withColumn("sharpe", F.try_divide(F.col("mean"), F.col("std"))).drop("second")


def best_and_worst(stats: DataFrame) -> DataFrame:
    """Per horizon the regimes of the highest and lowest mean; ties go to the first in alphabetical order."""
    known = stats.where(F.col("regime") != "Overall")
    return known.groupBy("horizon").agg(
        F.min_by("regime", F.struct(-F.col("mean"), F.col("regime"))).alias("best_regime"), F.max("mean").alias("best_mean"),
        F.min_by("regime", F.struct(F.col("mean"), F.col("regime"))).alias("worst_regime"), F.min("mean").alias("worst_mean"),
    )


def forward_summary(stats: DataFrame, horizon: int = 5) -> DataFrame:
    """One horizon's table: known regimes by falling mean (ties by label) with place, spread, ratio and win rate."""
    known = stats.where((F.col("regime") != "Overall") & (F.col("horizon") == horizon))
    place = F.row_number().over(W.partitionBy("horizon").orderBy(F.desc("mean"), "regime"))
    return known.select(place.alias("place"), "regime", "count", "mean", "median", "std", "sharpe", F.col("positive_pct").alias("win_rate_pct"), "min", "max")


def regime_statistics(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Per symbol and label: bars and their share, returns, volatility and trend strength."""
    made = df.groupBy("symbol", F.col(regime).alias("regime")).agg(
        F.count("*").alias("n"), F.avg("log_return").alias("mean_return"), F.stddev_samp("log_return").alias("std_return"), F.avg("volatility").alias("avg_volatility"), F.avg("trend_strength").alias("avg_trend_strength")
    )
    return made.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("symbol")))


# --- transitions -------------------------------------------------------------------------------------------------


def label_pairs(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Neighbouring labels of a symbol. Missing labels are bridged; a pair with Unknown in it does not count."""
    kept = df.where(F.col(regime).isNotNull()).select("symbol", "ts", F.col(regime).alias("from_regime"))
    return kept.withColumn("to_regime", F.lead("from_regime").over(order())).where(f"to_regime is not null and from_regime <> '{UNKNOWN}' and to_regime <> '{UNKNOWN}'")


def transition_matrix(df: DataFrame, regime: str = "regime") -> DataFrame:
    """(from_regime, to_regime, n, p) for every pair of labels that occur; rows without a successor have p = 0."""
    pairs = label_pairs(df, regime)
    counts = pairs.groupBy("from_regime", "to_regime").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("from_regime", "to_regime")).alias("x")).distinct()
    # at most as many labels as there are regimes: the grid of pairs is bounded by their square
    grid = labels.select(F.col("x").alias("from_regime")).join(F.broadcast(labels.select(F.col("x").alias("to_regime"))), how="cross")
    full = grid.join(F.broadcast(counts), ["from_regime", "to_regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("from_regime"))
    return full.withColumn("p", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def persistence(matrix: DataFrame) -> DataFrame:
    """Self-transition probability and expected stay (infinite at 1) per regime."""
    stay = matrix.where("from_regime = to_regime").select(F.col("from_regime").alias("regime"), F.col("p").alias("persistence"))
    return stay.withColumn("expected_duration", F.when(F.col("persistence") >= 1, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), 1 - F.col("persistence"))))


def n_step(matrix: DataFrame, steps: int) -> DataFrame:
    """Probabilities after several steps, by repeated joins of the edge list."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    base = matrix.select("from_regime", "to_regime", "p")
    out = base
    for _ in range(steps - 1):
        right = base.select(F.col("from_regime").alias("mid"), F.col("to_regime").alias("end"), F.col("p").alias("q"))
        out = out.join(right, F.col("to_regime") == F.col("mid")).groupBy("from_regime", F.col("end").alias("to_regime")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out


def cycles(matrix: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Two- and three-cycles of distinct regimes whose edges all exceed the threshold, each once, from its first label."""
    e = matrix.where((F.col("p") > threshold) & (F.col("from_regime") != F.col("to_regime"))).select("from_regime", "to_regime", "p")
    a, b, c = (e.select(F.col("from_regime").alias(f"{x}0"), F.col("to_regime").alias(f"{x}1"), F.col("p").alias(f"{x}p")) for x in "abc")
    two = a.join(b, (F.col("a1") == F.col("b0")) & (F.col("b1") == F.col("a0"))).where("a0 < a1")
    two = two.select(F.concat_ws(" -> ", "a0", "a1", "a0").alias("cycle"), F.lit(2).alias("length"), (F.col("ap") * F.col("bp")).alias("strength"))
    three = a.join(b, F.col("a1") == F.col("b0")).join(c, (F.col("b1") == F.col("c0")) & (F.col("c1") == F.col("a0"))).where("a0 < a1 and a0 < b1 and a1 <> b1")
    three = three.select(F.concat_ws(" -> ", "a0", "a1", "b1", "a0").alias("cycle"), F.lit(3).alias("length"), (F.col("ap") * F.col("bp") * F.col("cp")).alias("strength"))
    return two.unionByName(three)


def row_entropy(matrix: DataFrame) -> DataFrame:
    """Entropy of each regime's successors, in bits."""
    return matrix.groupBy("from_regime").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("entropy"))


def dense(matrix: DataFrame) -> tuple[list[str], np.ndarray]:
    """Labels and the matrix as an array: at most one row per regime."""
    rows = matrix.collect()
    labels = sorted({r["from_regime"] for r in rows})
    place = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)))
    for r in rows:
        out[place[r["from_regime"]], place[r["to_regime"]]] = r["p"]
    return labels, out


def stationary(matrix: DataFrame, rounds: int = 100_000, tolerance: float = 1e-14) -> DataFrame:
    """Long-run share of each regime, by power iteration from equal shares."""
    labels, p = dense(matrix)
    x = np.full(len(labels), 1 / max(1, len(labels)))
    for _ in range(rounds):
        y = x @ p
        done = np.abs(y - x).max(initial=0.0) < tolerance
        x = y
        if done:
            break
    total = x.sum()
    return matrix.sparkSession.createDataFrame([(a, float(v / total) if total > 0 else 0.0) for a, v in zip(labels, x, strict=True)], "regime string, share double")


def first_passage(matrix: DataFrame) -> DataFrame:
    """Mean number of steps from each regime to each other one; null where it cannot be reached for sure, 0 to itself."""
    labels, p = dense(matrix)
    rows = []
    for j, target in enumerate(labels):
        rest = [i for i in range(len(labels)) if i != j]
        try:
            steps = np.linalg.solve(np.eye(len(rest)) - p[np.ix_(rest, rest)], np.ones(len(rest)))
        except np.linalg.LinAlgError:
            steps = np.full(len(rest), np.nan)
        found = dict(zip(rest, steps.tolist(), strict=True)) | {j: 0.0}
        rows += [(labels[i], target, v if np.isfinite(v) else None) for i, v in sorted(found.items())]
    return matrix.sparkSession.createDataFrame(rows, "from_regime string, to_regime string, steps double")


def transition_changes(df: DataFrame, regime: str = "regime") -> DataFrame:
    """How often each change between different regimes happens, and its share of all changes."""
    counts = label_pairs(df, regime).where("from_regime <> to_regime").groupBy("from_regime", "to_regime").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def likely_transitions(matrix: DataFrame, least: float = 0.1, most: int = 10) -> DataFrame:
    """The ``most`` likeliest changes between different regimes of more than ``least`` probability, likeliest first."""
    return matrix.where((F.col("from_regime") != F.col("to_regime")) & (F.col("p") > least)).orderBy(F.desc("p"), "from_regime", "to_regime").limit(most).select("from_regime", "to_regime", "p")


def common_transitions(df: DataFrame, regime: str = "regime", most: int = 10) -> DataFrame:
    """The ``most`` commonest changes that happened, with their share of all changes in per cent, commonest first."""
    changes = transition_changes(df, regime).orderBy(F.desc("n"), "from_regime", "to_regime").limit(most)
    return changes.select("from_regime", "to_regime", "n", (100 * F.col("share")).alias("percentage"))


def transition_summary(df: DataFrame, regime: str = "regime") -> DataFrame:
    """One row: changes that happened, how many different ones, per bar, different changes the matrix knows, and the mean
    entropy of a regime's successors (natural logarithm). Without any change the counts are 0 and the entropy null."""
    cells = transition_matrix(df, regime)
    p, other = F.col("p"), F.col("from_regime") != F.col("to_regime")
    rows = cells.groupBy("from_regime").agg(
        F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("changes"), F.count_if(other & (p > 0)).alias("kinds"), F.count_if(p > 0).alias("cells")
    )
    found = rows.agg(
        F.coalesce(F.sum("changes"), F.lit(0)).alias("total_count"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("unique_transitions"),
        (F.coalesce(F.sum("cells"), F.lit(0)) - F.count(F.lit(1))).alias("n_transitions"), F.avg("entropy").alias("overall_entropy"),
    )
    bars = df.agg(F.count("*").alias("bars"))
    return found.join(F.broadcast(bars), how="cross").withColumn("transitions_per_period", F.coalesce(F.try_divide("total_count", "bars"), F.lit(0.0)))  # one row by one row


# --- segments ----------------------------------------------------------------------------------------------------


def with_segments(df: DataFrame, regime: str = "regime", gap: str = "close") -> DataFrame:
    """seg, the number of the run of equal known labels a bar is in; null elsewhere.

    ``gap`` says what an Unknown or missing label does: 'close' ends the run, 'bridge' does not.
    """
    df = numbered(df)
    known = F.coalesce(F.col(regime) != UNKNOWN, F.lit(False))
    label = F.when(known, F.col(regime))
    if gap == "close":
        new = known & ~label.eqNullSafe(F.lag(label).over(order()))
    else:
        new = known & ~label.eqNullSafe(F.last(label, True).over(order().rowsBetween(W.unboundedPreceding, -1)))
    return df.withColumn("seg", F.when(known, F.sum(F.when(new, 1).otherwise(0)).over(past())))


def segments(df: DataFrame, regime: str = "regime", least: int = 1, gap: str = "close") -> DataFrame:
    """One row per run of at least ``least`` bars: place, length, prices, returns, volatility."""
    marked = with_segments(df, regime, gap).where("seg is not null")
    first, last = F.min_by("close", "rn"), F.max_by("close", "rn")
    made = marked.groupBy("symbol", "seg").agg(
        F.min(regime).alias("regime"), F.min("rn").alias("start_rn"), F.max("rn").alias("end_rn"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"),
        first.alias("start_price"), last.alias("end_price"), F.try_divide(last - first, first).alias("price_change"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("log_return").alias("log_return"), F.avg("log_return").alias("mean_return"), F.stddev_samp("log_return").alias("return_std"),
        F.try_divide(F.avg("log_return"), F.stddev_samp("log_return")).alias("sharpe"), F.avg("volatility").alias("avg_volatility"), F.avg("trend_strength").alias("avg_trend_strength"), F.sum("volume").alias("volume"),
    )
    return made.where(F.col("length") >= least)


def segment_statistics(found: DataFrame) -> DataFrame:
    """Per regime: number, lengths, bars, mean price change, win rate and volatility of its segments."""
    return found.groupBy("regime").agg(
        F.count("*").alias("count"), F.avg("length").alias("avg_length"), F.median("length").alias("median_length"), F.max("length").alias("max_length"), F.sum("length").alias("total_days"),
        F.avg("price_change").alias("avg_return"), (100 * F.avg((F.col("price_change") > 0).cast("double"))).alias("win_rate_pct"), F.avg("avg_volatility").alias("avg_volatility"),
    )


def top_segments(found: DataFrame, k: int = 5) -> DataFrame:
    """The k best, worst and longest segments, ties by symbol and start."""
    def pick(kind: str, *order: Column) -> DataFrame:
        ranked = found.orderBy(*order, "symbol", "start_rn").limit(k)
        return ranked.select(F.lit(kind).alias("kind"), "symbol", "regime", "start_ts", "length", "price_change")

    best, worst = pick("best", F.desc("price_change")), pick("worst", F.asc("price_change"))
    return best.unionByName(worst).unionByName(pick("longest", F.desc("length")))


def segment_transitions(found: DataFrame) -> DataFrame:
    """Neighbouring segments: how often each pair of regimes follows, and the change of return between them."""
    w = W.partitionBy("symbol").orderBy("start_rn")
    pairs = found.withColumns({"to_regime": F.lead("regime").over(w), "next": F.lead("price_change").over(w)}).where("to_regime is not null")
    return pairs.groupBy(F.col("regime").alias("from_regime"), "to_regime").agg(F.count("*").alias("n"), F.avg(F.col("next") - F.col("price_change")).alias("avg_return_change"), F.avg("length").alias("avg_length_before"))


# --- evaluation --------------------------------------------------------------------------------------------------


def stability(df: DataFrame, label: str) -> DataFrame:
    """Share of neighbouring labels that are equal, missing ones left out."""
    kept = df.where(F.col(label).isNotNull()).select("symbol", "ts", F.col(label).alias("x")).withColumn("b", F.lag("x").over(order()))
    return kept.groupBy("symbol").agg(F.avg((F.col("x") == F.col("b")).cast("double")).alias("stability"))


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    """Shannon entropy of the labels in bits."""
    counts = df.where(F.col(label).isNotNull()).groupBy("symbol", label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("symbol"))
    return counts.withColumn("p", p).groupBy("symbol").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def information_ratio(df: DataFrame, label: str, horizon: int, least: int = 10) -> DataFrame:
    """Mean of |mean / deviation| of the forward returns over labels, weighted by support; labels below ``least`` or without spread are left out."""
    long = long_returns(df, (horizon,), label).where(F.col(label).isNotNull())
    by = long.groupBy("symbol", label).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).where((F.col("n") >= least) & (F.col("s") > 0))
    return by.groupBy("symbol").agg((F.sum(F.col("n") * F.abs(F.col("m") / F.col("s"))) / F.sum("n")).alias("information_ratio"))


def compare_classifiers(df: DataFrame, baseline: str, candidate: str, horizon: int, least: int = 10) -> DataFrame:
    """Stability, entropy, number of labels and information ratio of two labellings, per symbol."""

    def row(name: str, label: str) -> DataFrame:
        n = df.where(F.col(label).isNotNull()).groupBy("symbol").agg(F.countDistinct(label).alias("n_labels"))
        joined = stability(df, label).join(label_entropy(df, label), "symbol").join(n, "symbol").join(information_ratio(df, label, horizon, least), "symbol", "left")
        return joined.select(F.lit(name).alias("classifier"), "symbol", "stability", "entropy", "n_labels", "information_ratio")

    return row("baseline", baseline).unionByName(row("candidate", candidate))


def cpcv_paths(folds: int, tests: int) -> list[tuple[int, ...]]:
    """All sets of test folds in lexicographic order."""
    if not 0 < tests < folds:
        raise ValueError("test folds must be fewer than folds, and at least one")
    return list(combinations(range(folds), tests))


def cpcv_path_count(folds: int, tests: int) -> int:
    return comb(folds, tests)


def cpcv_folds(spark: SparkSession, n: int, folds: int = 6, tests: int = 2, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """(path_id, rn, role) of combinatorial purged cross-validation over rows 0..n-1; purged and embargoed rows have no role.

    Every path meets every row once by definition; the paths are few and known beforehand, so they are broadcast.
    """
    if n < folds:
        raise ValueError("fewer rows than folds")
    size = n // folds
    ends = [(i * size, (i + 1) * size if i < folds - 1 else n) for i in range(folds)]
    paths = [(p, [{"a": ends[f][0], "b": ends[f][1]} for f in test]) for p, test in enumerate(cpcv_paths(folds, tests))]
    table = spark.createDataFrame(paths, "path_id int, tests array<struct<a:long,b:long>>")
    rows = spark.range(n).withColumnRenamed("id", "rn").join(F.broadcast(table), how="cross")
    test = F.exists("tests", lambda x: (F.col("rn") >= x["a"]) & (F.col("rn") < x["b"]))
    shut = F.exists("tests", lambda x: ((F.col("rn") >= x["a"] - horizon) & (F.col("rn") < x["b"])) | ((F.col("rn") >= x["b"]) & (F.col("rn") < x["b"] + embargo)))
    return rows.select("path_id", "rn", F.when(test, "test").when(~shut, "train").alias("role")).where("role is not null")


def fold_masks(df: DataFrame, folds: int = 6, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """Adds fold (from 0) and shut, the set of folds, as bits, that keep a bar out of training when they are tested.

    A symbol's bars are cut into equal folds, the last of which takes the rest. A tested fold shuts out itself, the
    ``horizon`` bars before it, whose labels look into it, and the ``embargo`` bars behind it. Symbols of fewer bars
    than folds are left out.
    """
    if not 1 < folds < 63 or horizon < 0 or embargo < 0:
        raise ValueError("there must be 2 to 62 folds, and horizon and embargo must not be negative")
    size, at = F.expr(f"_n div {folds}"), F.col("rn") - 1
    df = numbered(df).withColumn("_n", F.count(F.lit(1)).over(whole())).where(F.col("_n") >= folds)
    shut = F.lit(0).cast("long")
    for f in range(folds):
        end = size * (f + 1) if f < folds - 1 else F.col("_n")
        shut = shut.bitwiseOR(F.when((at >= size * f - horizon) & (at < end + embargo), 1 << f).otherwise(0))
    return df.withColumns({"fold": F.least(F.floor(at / size), F.lit(folds - 1)).cast("int"), "shut": shut}).drop("_n")


def _roles(df: DataFrame, folds: int, tests: int) -> DataFrame:
    """Every row once per path, as path_id and role, unless the path purges it; the paths are few and known beforehand."""
    masks = [sum(1 << f for f in path) for path in cpcv_paths(folds, tests)]
    each = df.select("*", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("path_id", "_tested"))
    test, shut = F.getbit("_tested", F.col("fold")) == 1, F.col("shut").bitwiseAND(F.col("_tested")) != 0
    return each.withColumn("role", F.when(test, "test").when(~shut, "train")).where("role is not null").drop("_tested")


def cpcv_roles(df: DataFrame, folds: int = 6, tests: int = 2, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """(symbol, ts, rn, path_id, role) of combinatorial purged cross-validation; purged and embargoed bars have no role."""
    return _roles(fold_masks(df, folds, horizon, embargo).select("symbol", "ts", "rn", "fold", "shut"), folds, tests).drop("fold", "shut")


def path_sharpes(df: DataFrame, returns: dict[str, Column], folds: int = 6, tests: int = 2, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """(symbol, path, trial, is_sharpe, oos_sharpe) of every trial (name -> its return of a bar) on every path.

    Bars are summed up once, by fold and by the folds that shut them out; the paths then only add such sums, so no bar
    is repeated per path. A side without two returns, or without spread, has 0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("trial"), r.cast("double").alias("r")) for n, r in returns.items()])).alias("x")
    long = fold_masks(df, folds, horizon, embargo).select("symbol", "fold", "shut", each).select("symbol", "fold", "shut", "x.*").where("r is not null")
    sums = long.groupBy("symbol", "trial", "fold", "shut").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    sides = []
    for role, out in (("train", "is_sharpe"), ("test", "oos_sharpe")):
        n, s, q = (F.sum(F.when(F.col("role") == role, F.col(c))) for c in "nsq")
        spread = F.try_divide(q - s * s / n, n - 1)
        sides.append(F.coalesce(F.when(spread > 1e-12 * q / n, s / n / F.sqrt(spread)), F.lit(0.0)).alias(out))
    return _roles(sums, folds, tests).groupBy("symbol", F.col("path_id").alias("path"), "trial").agg(*sides)


def backtest_overfitting(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of paths on which the best trial in sample ranks below the median out of sample, from (path, trial, is_sharpe,
    oos_sharpe), and per ``keys`` if there are any.

    Ranks count from 0, so the median of n is (n - 1) / 2; equal values rank by trial.
    """
    w = W.partitionBy(*keys, "path")
    ranked = trials.withColumns({"place": F.row_number().over(w.orderBy("oos_sharpe", "trial")) - 1, "best": F.row_number().over(w.orderBy(F.desc("is_sharpe"), "trial")), "n": F.count(F.lit(1)).over(w)})
    return ranked.where("best = 1").groupBy(*keys).agg(F.avg((F.col("place") < (F.col("n") - 1) / 2).cast("double")).alias("pbo"), F.count("*").alias("paths"))


def correlations(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, first, second, n, r): the correlation of every two columns, first before second in the list, over the rows
    that have both; one aggregate. Pairs without spread have a null."""
    if len(set(columns)) < len(columns):
        raise ValueError("a column is named twice")
    pairs = list(combinations(columns, 2))

    def paired(a: str, b: str, i: int) -> list[Column]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        spread = F.sqrt(F.var_pop(F.when(both, F.col(a)))) * F.sqrt(F.var_pop(F.when(both, F.col(b))))
        return [F.try_divide(F.covar_pop(a, b), spread).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]

    sums = df.groupBy(*keys).agg(*[x for i, (a, b) in enumerate(pairs) for x in paired(a, b, i)])
    listed = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n{i}").alias("n"), finite(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])
    return sums.select(*keys, F.explode(listed).alias("x")).select(*keys, "x.*")
