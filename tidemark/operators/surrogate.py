"""Model-guided screening of candidate pools: encoding, ensembles, validation, acquisition.

Fits are MLlib jobs over the training table; everything else is column expressions and
grouped aggregates over pools of any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.registry import Registry
from tidemark.functions.stats import normal_cdf
from tidemark.operators.candidates import Parameter, get, uniform
from tidemark.operators.ranks import exact_quantiles, largest_group, ranked, top_k
from tidemark.operators.sequence import TARGET_ROWS, running
from tidemark.session import durable

# Fewest observations and rank correlation for a model to choose candidates.
MIN_TRAINING, MIN_RANK_CORRELATION = 8, 0.2


# --- encoding --------------------------------------------------------------------------


def encoded_columns(space: Sequence[Parameter], values: str = "values") -> dict[str, Column]:
    """Domain-scaled ranges, one column for a boolean, one-hot for a category."""
    out: dict[str, Column] = {}
    for p in sorted(space, key=lambda x: x.name):
        v = get(p, values)
        if p.ranged:
            out[p.name] = (v - float(p.low)) / float(p.high - p.low)
        elif p.kind == "boolean":
            low, high = (float(c) for c in p.choices)
            out[p.name] = (v - low) / (high - low)
        else:
            for c in p.choices:
                out[f"{p.name}={c:g}"] = F.when(v == float(c), 1.0).otherwise(0.0)
    return out


def encode(candidates: DataFrame, space: Sequence[Parameter]) -> tuple[DataFrame, list[str]]:
    cols = encoded_columns(space)
    names = [f"x{i}" for i in range(len(cols))]
    return candidates.select("*", *[c.alias(n) for n, c in zip(names, cols.values(), strict=True)]), names


def standard_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Subtract the mean, divide by the population sd (1 where nothing varies)."""
    stats = df.agg(*[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names])
    joined = df.withColumn("_k", F.lit(0)).join(stats.withColumn("_k", F.lit(0)), "_k")
    scaled = [((F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") == 0, 1.0).otherwise(F.col(f"_s_{n}"))).alias(n) for n in names]
    return joined.select(*[c for c in df.columns if c not in names], *scaled)


def vector_of(names: Sequence[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


# --- training set ----------------------------------------------------------------------


def training_set(evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, excluded rows with the reason)."""
    reason = (
        F.when(F.col("status") == "evaluation_failed", "evaluation failed")
        .when(F.col("status") != "evaluated", F.concat(F.lit("status "), F.col("status")))
        .when(F.col("fitness").isNull(), "no value")
        .when(F.isnan("fitness") | (F.abs("fitness") == float("inf")), "value is not finite")
    )
    marked = evaluations.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def dataset_hash(rows: DataFrame, keys: Sequence[str], parts: Sequence[Column], order: str) -> DataFrame:
    """Order-independent hash of a dataset.

    Rows are hashed one by one and their digests summed as whole numbers, in four parts of 60
    bits; the count and the sums give the dataset's digest. Nothing is listed.
    """
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    part = lambda i: F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(i)).cast("string") for i in range(4)]
    return rows.select(*keys, digest.alias("h")).groupBy(*keys).agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("dataset_hash")
    )


# --- error and rank metrics ------------------------------------------------------------


def error_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R2 (NULL when the actual values are constant)."""
    a, p = F.col(actual), F.col(predicted)
    total = F.var_pop(a) * F.count(a)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.when(F.var_pop(a) > 0, 1 - F.sum((a - p) * (a - p)) / total).alias("r2"), F.avg(p - a).alias("bias"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks with ties averaged: the mean row number of each distinct value."""
    group = [*keys, value]
    placed = ranked(df.select(*group), list(keys), [F.col(value).asc()], "_rn")
    return df.join(placed.groupBy(*group).agg(F.avg("_rn").alias(name)), group)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation; NULL below two rows or when either side does not vary."""
    slim = durable(df.select(*keys, a, b))
    both = average_ranks(average_ranks(slim, keys, a, "_ra"), keys, b, "_rb")
    x, y = F.col("_ra"), F.col("_rb")
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    ok = (F.count(F.lit(1)) >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return both.groupBy(*keys).agg(F.when(ok, cov / F.sqrt(F.var_pop(x) * F.var_pop(y))).alias("spearman"))


def kendall(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Kendall tau-b without forming pairs.

    Two rows differ first at one bit of their rank in ``a``. For each bit, the block of rows
    that agree above it splits in halves, and a running count along ``b`` gives the upper
    rows that lie below each lower row: the discordant pairs. All bits go through one pass
    (n log n rows), with the running count cut in equal chunks because ranks are dense.
    """
    keys = list(keys)
    slim = durable(df.select(*keys, a, b))
    ranks = average_ranks(average_ranks(slim, keys, a, "_x"), keys, b, "_y")
    cells = durable(
        ranks.groupBy(*keys, (F.col("_x") * 2).cast("long").alias("_ix"), (F.col("_y") * 2).cast("long").alias("_iy")).agg(
            F.count(F.lit(1)).cast("double").alias("c")
        )
    )
    pairs_of = lambda cols, name: cells.groupBy(*keys, *cols).agg(F.sum("c").alias("m")).groupBy(*keys).agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(name)
    )
    bits = int(cells.agg(F.max("_ix").alias("m")).first()["m"] or 1).bit_length()
    width = None if largest_group(cells, keys) <= TARGET_ROWS else float(2 * TARGET_ROWS)
    staged = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).select(
        *keys, "_level", "_iy", "c",
        F.expr("shiftright(_ix, _level + 1)").alias("_block"),
        F.expr("shiftright(_ix, _level) & 1").alias("_half"),
    ).withColumn("_up", F.when(F.col("_half") == 1, F.col("c")).otherwise(0.0))
    # Lower rows come first among equals, so equal values are not counted.
    seen = running(staged, [*keys, "_level", "_block"], ["_iy", "_half"], {"_below": ("sum", "_up")}, width, exclusive=True)
    found = F.when(F.col("_half") == 0, F.col("c") * F.coalesce("_below", F.lit(0.0))).otherwise(0.0)
    discordant = seen.groupBy(*keys).agg(F.sum(found).alias("disc"))
    out = pairs_of([], "pairs").join(pairs_of(["_ix"], "tx"), keys).join(pairs_of(["_iy"], "ty"), keys)
    out = out.join(pairs_of(["_ix", "_iy"], "txy"), keys).join(discordant, keys)
    concordant = F.col("pairs") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("disc")
    bottom = F.sqrt((F.col("pairs") - F.col("tx")) * (F.col("pairs") - F.col("ty")))
    return out.select(*keys, F.when(bottom > 0, (concordant - F.col("disc")) / bottom).alias("kendall"))


def top_k_recall(df: DataFrame, keys: Sequence[str], key: str, actual: str, predicted: str, k: int) -> DataFrame:
    """Share of the true top ``k`` that the prediction also ranks in its top ``k``."""
    keys = list(keys)
    real = top_k(df, keys, [F.col(actual).desc(), F.col(key)], k).select(*keys, key)
    guess = top_k(df, keys, [F.col(predicted).desc(), F.col(key)], k).select(*keys, key)
    hits = real.join(guess, [*keys, key]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(hits, keys, "left").select(
        *keys, F.when(F.col("_n") >= k, F.coalesce("_h", F.lit(0)) / F.lit(float(k))).alias("top_k_recall")
    )


def all_metrics(df: DataFrame, keys: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """Every error and rank metric of ``actual`` against ``predicted`` in one row per group."""
    keys = list(keys)
    return (
        error_metrics(df, keys).join(spearman(df, keys, "actual", "predicted"), keys)
        .join(kendall(df, keys, "actual", "predicted"), keys).join(top_k_recall(df, keys, key, "actual", "predicted", k), keys)
    )


def uncertainty_diagnostics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of sigma with the absolute error, mean sigma, MAE, one-sigma coverage."""
    errs = df.withColumn("_e", F.abs(F.col("actual") - F.col("predicted")))
    facts = errs.groupBy(*keys).agg(
        F.avg("sigma").alias("mean_uncertainty"), F.avg("_e").alias("mae"), F.avg(F.when(F.col("_e") <= F.col("sigma"), 1.0).otherwise(0.0)).alias("coverage_68")
    )
    rank = spearman(errs, keys, "sigma", "_e").withColumnRenamed("spearman", "error_correlation")
    return facts.join(rank, list(keys))


def trust_verdict(n: Column, rank_correlation: Column, recall: Column | None = None, min_recall: float | None = None) -> Column:
    """First failing reason, or ``trusted``."""
    out = F.when(n < MIN_TRAINING, "bootstrapping").when(rank_correlation.isNull(), "no rank correlation").when(
        rank_correlation < MIN_RANK_CORRELATION, "rank correlation too low"
    )
    if min_recall is not None and recall is not None:
        out = out.when(recall.isNull() | (recall < min_recall), "top-k recall too low")
    return out.otherwise("trusted")


# --- models ----------------------------------------------------------------------------

REGRESSORS = Registry("regressor")
REGRESSORS.add(
    "forest", lambda seed=0: RandomForestRegressor(featuresCol="features", labelCol="fitness", numTrees=12, maxDepth=6, seed=seed),
    "bagged regression trees; spread over trees as uncertainty", "cannot extrapolate", "uncertainty",
)
REGRESSORS.add(
    "boosting", lambda seed=0: GBTRegressor(featuresCol="features", labelCol="fitness", maxIter=10, maxDepth=4, seed=seed),
    "gradient boosted regression trees", "no uncertainty of its own",
)


def fit(train: DataFrame, names: Sequence[str], family: str = "forest", seed: int = 0) -> object:
    ready = VectorAssembler(inputCols=list(names), outputCol="features").transform(train)
    return REGRESSORS.get(family).build(seed).fit(ready)


def predict(model: object, pool: DataFrame, names: Sequence[str], spread: bool = True) -> DataFrame:
    """Adds ``predicted`` and, for a forest, ``sigma`` (population sd over trees)."""
    ready = VectorAssembler(inputCols=list(names), outputCol="features").transform(pool)
    out = model.transform(ready).withColumnRenamed("prediction", "predicted")
    if spread and isinstance(getattr(model, "trees", None), list) and model.__class__.__name__.startswith("RandomForest"):
        for i, tree in enumerate(model.trees):
            out = tree.setPredictionCol(f"_t{i}").transform(out)
        trees = F.array(*[F.col(f"_t{i}") for i in range(len(model.trees))])
        n = float(len(model.trees))
        mean = F.aggregate(trees, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(trees, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        out = out.withColumn("sigma", F.sqrt(var)).drop(*[f"_t{i}" for i in range(len(model.trees))])
    return out.drop("features")


def cross_validated(train: DataFrame, names: Sequence[str], key: str, folds: int = 3, family: str = "forest") -> DataFrame:
    """Out-of-fold predictions; folds are hashed from the id."""
    rows = durable(train.withColumn("_fold", F.floor(uniform(0, key) * folds).cast("int")))
    parts = []
    for f in range(folds):
        model = fit(rows.where(F.col("_fold") != f), names, family)
        parts.append(predict(model, rows.where(F.col("_fold") == f), names).drop("_fold"))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("fitness", "actual")


def prefix_validated(train: DataFrame, names: Sequence[str], order: str, cuts: int = 3, family: str = "forest") -> DataFrame:
    """Rolling origin: fit on what came before each cut, score the next block."""
    rows = durable(train)
    wanted = {f"_e{i}": i / (cuts + 1) for i in range(1, cuts + 1)}
    edges = list(exact_quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], order, wanted).select(*wanted).first())
    bounds = [*edges, None]
    parts = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        model = fit(rows.where(F.col(order) <= start), names, family)
        block = rows.where(F.col(order) > start)
        parts.append(predict(model, block if end is None else block.where(F.col(order) <= end), names))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("fitness", "actual")


def compare_families(train: DataFrame, names: Sequence[str], key: str, families: Sequence[str] = ("forest", "boosting")) -> DataFrame:
    """Cross-validated metrics of every model family."""
    parts = []
    for family in families:
        scored = cross_validated(train, names, key, family=family)
        parts.append(scored.select(F.lit(family).alias("family"), key, "actual", "predicted"))
    rows = durable(reduce(DataFrame.unionByName, parts))
    return error_metrics(rows, ["family"]).join(spearman(rows, ["family"], "actual", "predicted"), "family")


# --- acquisition -----------------------------------------------------------------------


def _pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def _greedy(mean: Column, sigma: Column, incumbent: Column, kappa: float, xi: float) -> Column:
    return mean


def _ucb(mean: Column, sigma: Column, incumbent: Column, kappa: float, xi: float) -> Column:
    return mean + kappa * sigma


def _ei(mean: Column, sigma: Column, incumbent: Column, kappa: float, xi: float) -> Column:
    gain = mean - incumbent - xi
    z = F.when(sigma > 1e-12, gain / sigma).otherwise(F.lit(0.0))
    return F.when(sigma > 1e-12, gain * normal_cdf(z) + sigma * _pdf(z)).otherwise(F.greatest(gain, F.lit(0.0)))


def _pi(mean: Column, sigma: Column, incumbent: Column, kappa: float, xi: float) -> Column:
    gain = mean - incumbent - xi
    z = F.when(sigma > 1e-12, gain / sigma).otherwise(F.lit(0.0))
    return F.when(sigma > 1e-12, normal_cdf(z)).otherwise(F.when(gain > 0, 1.0).otherwise(0.0))


ACQUISITIONS = Registry("acquisition")
ACQUISITIONS.add("greedy_mean", _greedy, "predicted mean", "pure exploitation")
ACQUISITIONS.add("upper_confidence_bound", _ucb, "mean + kappa sigma", "needs a spread", "sigma")
ACQUISITIONS.add("expected_improvement", _ei, "E[max(0, f - incumbent - xi)]", "assumes a normal spread", "sigma", "gaussian", "incumbent")
ACQUISITIONS.add("probability_of_improvement", _pi, "P[f > incumbent + xi]", "assumes a normal spread", "sigma", "gaussian", "incumbent")


def acquisition(
    name: str, mean: Column, sigma: Column | None = None, incumbent: Column | None = None, kappa: float = 2.0, xi: float = 0.0
) -> Column:
    entry = ACQUISITIONS.get(name)
    if "sigma" in entry.flags and sigma is None:
        raise ValueError(f"{name} needs a predictive spread")
    if "incumbent" in entry.flags and incumbent is None:
        raise ValueError(f"{name} needs an incumbent")
    return entry.build(mean, sigma, incumbent, kappa, xi)


def score_candidates(
    pool: DataFrame, name: str, incumbent: float | None, kappa: float = 2.0, xi: float = 0.0, feasibility: Column | None = None
) -> DataFrame:
    """Acquisition value of every candidate with the reason as text."""
    best = None if incumbent is None else F.lit(float(incumbent))
    value = acquisition(name, F.col("predicted"), F.col("sigma"), best, kappa, xi)
    if feasibility is not None:
        value = value * feasibility
    head = F.format_string("predicted %.4f, uncertainty %.4f", F.col("predicted"), F.col("sigma"))
    tail = {
        "greedy_mean": "; chosen on prediction alone", "upper_confidence_bound": f"; optimistic bound at kappa={kappa:g}",
    }.get(name, f"; weighed against best so far {0.0 if incumbent is None else incumbent:.4f} with xi={xi:g}")
    return pool.withColumn("acquisition", value).withColumn("reason", F.concat(head, F.lit(tail)))


def scalarised(predictions: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """Weighted sum of standardised per-objective predictions; spread adds in quadrature.

    ``predictions`` is ``key, objective_id, predicted, sigma``; ``weights`` is
    ``objective_id, weight``.
    """
    stats = predictions.groupBy("objective_id").agg(F.avg("predicted").alias("_m"), F.stddev_pop("predicted").alias("_s"))
    scale = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    w, z = F.col("weight"), (F.col("predicted") - F.col("_m")) / scale
    s = w * F.col("sigma") / scale
    return predictions.join(stats, "objective_id").join(weights.where("weight > 0"), "objective_id").groupBy(key).agg(
        F.sum(w * z).alias("predicted"), F.when(F.count("sigma") == F.count(F.lit(1)), F.sqrt(F.sum(s * s))).alias("sigma")
    )


def simplex_weights(rows: DataFrame, key: str, objectives: Sequence[str], seed: int) -> DataFrame:
    """Uniform weights on the simplex per row: normalised exponential draws."""
    draws = [-F.log(F.greatest(uniform(seed, key, F.lit(o)), F.lit(1e-15))) for o in objectives]
    total = reduce(lambda a, b: a + b, draws)
    return rows.select(key, *[(x / total).alias(o) for o, x in zip(objectives, draws, strict=True)])


