"""Risk models on Spark ML: preprocessing, families, calibration, selection, attribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators.metrics import P, Y, auc_metrics, brier, ece
from ..operators.ordering import SLICES, slice_of, unpivot
from ..session import scratch, scratch_path, shared_folder, written_table
from . import trees

RARE = "OTHER"


def level_counts(df: DataFrame, cols: Sequence[str], min_share: float = 0.01) -> DataFrame:
    """Levels per categorical column with their share and whether they are kept."""
    long = unpivot(df, cols, names=("feature", "level")).fillna({"level": "UNKNOWN"})
    counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    share = F.col("n") / F.col("_total")
    return counts.join(totals, "feature").select(
        "feature", "level", "n", share.alias("share"), (share >= min_share).alias("kept"))


def kept_levels(df: DataFrame, cols: Sequence[str], min_share: float = 0.01
                ) -> dict[str, list[str]]:
    """Frequent levels per column; at most 1 / min_share of them can exist."""
    rows = level_counts(df, cols, min_share).filter("kept").collect()
    return {c: sorted(r["level"] for r in rows if r["feature"] == c) for c in cols}


def merge_rare(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    return df.withColumns({
        c: F.when(filled(c).isin(keep), filled(c)).otherwise(RARE) for c, keep in levels.items()})


def preprocessor(cats: Sequence[str], nums: Sequence[str]) -> list:
    """One-hot categories (unknown ones ignored) and median-imputed numbers."""
    stages = [Imputer(strategy="median", inputCols=list(nums),
                      outputCols=[f"{c}_num" for c in nums])]
    if cats:
        stages += [
            StringIndexer(inputCols=list(cats), outputCols=[f"{c}_ix" for c in cats],
                          handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=[f"{c}_ix" for c in cats],
                          outputCols=[f"{c}_hot" for c in cats], dropLast=True),
        ]
    parts = [f"{c}_num" for c in nums] + [f"{c}_hot" for c in cats]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def as_numbers(df: DataFrame, nums: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in nums})


def class_ratio(df: DataFrame) -> DataFrame:
    """Negatives per positive, the weight of a positive row."""
    pos, neg = F.count_if(F.col(Y) == 1), F.count_if(F.col(Y) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"),
                  F.coalesce(F.try_divide(neg, pos), F.lit(1.0)).alias("ratio"))


BOOSTED = ["gradient_boosting", "boosting_subsampled", "boosting_small_steps"]
BASELINES = ["logistic", "decision_tree", "naive_bayes", "random_forest"]
#: Families of trees, among the classifiers and the regressors.
TREES = [*BOOSTED, "decision_tree", "random_forest"]


def estimator(family: str, rounds: int | None = None, depth: int | None = None, seed: int = 42,
              early_stop: bool = False, step: float | None = None):
    """Classifier of a family, of its own size (`config.FAMILY_SIZES`) unless another is given.

    The boosted families: all rows and features for each tree; a share of both; a share of the
    features alone. All but naive Bayes weigh rows by `weight`. With `early_stop` a boosted one ends
    when the error on the rows marked `validation` no longer falls.
    """
    size = C.FAMILY_SIZES.get(family, {})
    rounds = rounds or size.get("rounds", C.BOOST_ROUNDS)
    depth = depth or size.get("depth", C.BOOST_DEPTH)
    base = {"labelCol": Y, "featuresCol": "features"}
    weighted = {**base, "weightCol": "weight"}
    boosted = {"maxIter": rounds, "maxDepth": depth, "seed": seed, "stepSize": step or size.get("step", 0.1), **weighted}
    if early_stop:
        boosted |= {"validationIndicatorCol": "validation", "validationTol": 1e-3}
    return {
        "gradient_boosting": lambda: GBTClassifier(**boosted),
        "boosting_subsampled": lambda: GBTClassifier(
            subsamplingRate=0.8, featureSubsetStrategy="0.8", **boosted),
        "boosting_small_steps": lambda: GBTClassifier(featureSubsetStrategy="0.8", **boosted),
        "logistic": lambda: LogisticRegression(maxIter=50, regParam=1e-4, **weighted),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=seed, **weighted),
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **base),
        "random_forest": lambda: RandomForestClassifier(
            numTrees=rounds, maxDepth=depth, seed=seed, **weighted),
    }[family]()


#: Rows that one task of a fit reads, at most and, while cores are free, at least: a round of
#: boosting is a few jobs, and each costs its tasks' start.
ROWS_A_TASK, LEAST_ROWS = 100_000, 20_000


def fit_parts(spark: SparkSession, n_rows: int) -> int:
    return max(1 + n_rows // ROWS_A_TASK, min(spark.sparkContext.defaultParallelism, 1 + n_rows // LEAST_ROWS))


def even_parts(df: DataFrame, n_rows: int) -> DataFrame:
    """`df` dealt evenly over as many tasks as a fit of `n_rows` rows takes.

    The parts of a table read back follow the bytes and row groups of its files: a model table of
    millions of narrow rows came as one or two. Rows are dealt in turn, so copies make no part
    large, and stand in a fixed order, so a part that is made again is the same.
    """
    parts = fit_parts(df.sparkSession, n_rows)
    if parts == 1:
        return df.coalesce(1)
    return df.repartition(parts).sortWithinPartitions(F.xxhash64(*df.columns))


def fit_family(train: DataFrame, family: str, cats: Sequence[str], nums: Sequence[str],
               validation: DataFrame | None = None, **kw) -> PipelineModel:
    """Fit preprocessing and model; positives weigh as much as negatives where weights are used.

    The preprocessing is fitted on `train` alone. A boosted family with `validation` rows stops
    early on them.
    """
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # Boosting cuts the lineage of its predictions there; without it hundreds of rounds grow one.
        context.setCheckpointDir(shared_folder(train.sparkSession))
    known = class_ratio(train).first()
    weigh = lambda df: as_numbers(df, nums).withColumn(
        "weight", F.when(F.col(Y) == 1, float(known["ratio"])).otherwise(1.0))
    rows = weigh(train)
    ready = Pipeline(stages=preprocessor(cats, nums)).fit(rows)
    early = validation is not None and family in BOOSTED
    if early:
        rows = rows.withColumn("validation", F.lit(False)).unionByName(
            weigh(validation).withColumn("validation", F.lit(True)))
    read = [*cats, *nums, Y, "weight", *(["validation"] if early else [])]
    model = fit_rows(estimator(family, early_stop=early, **kw), rows.select(*read), known["n_pos"] + known["n_neg"], ready.transform)
    return PipelineModel(stages=[*ready.stages, model])


def fit_rows(est, rows: DataFrame, n_rows: int, encode=None):
    """The estimator fitted on `n_rows` rows, which `encode` gives their features.

    Trees of more than one task's least rows are grown on compact rows (`trees`): Spark ML's own keep
    four bytes for every entry of a vector, of each fit.
    """
    encode = encode or (lambda df: df)

    def fitted():
        if n_rows > LEAST_ROWS and trees.fits_here(est, encoded := encode(rows)):
            # Beyond that the rows are not dealt anew for the sake of the sample: it costs a shuffle of all.
            few = n_rows <= trees.ALONE_ROWS
            return trees.fit_trees(est, encoded, dealt=encode(even_parts(rows, n_rows)) if few else None)
        return detached(est.fit(encode(even_parts(rows, n_rows))))

    model = fitted()
    if n_rows > 10 * ROWS_A_TASK:
        # Spark removes the shuffle files of a fit once the JVM has collected what refers to them; fits
        # in a row would pile them up until it happens to.
        rows.sparkSession._jvm.System.gc()
    return model


def detached(model):
    """`model` without the training summary, which holds on to the session it was fitted in."""
    if not getattr(model, "hasSummary", False):
        return model
    with scratch():
        path = scratch_path(SparkSession.active(), "model-detached")
        model.save(path)
        return type(model).load(path)


def score(model: PipelineModel, df: DataFrame, nums: Sequence[str], name: str = P) -> DataFrame:
    out = model.transform(as_numbers(df, nums))
    return out.withColumn(name, vector_to_array("probability")[1]).select(
        *[c for c in df.columns if c != name], name)


def score_majority(train: DataFrame, df: DataFrame, name: str = P) -> DataFrame:
    """The prior as everyone's score."""
    return df.withColumn(name, F.lit(float(train.agg(F.avg(Y)).first()[0])))


def fit_isotonic(df: DataFrame, p: str = P):
    """Isotonic calibration, fitted on one weighted row per distinct score."""
    groups = df.groupBy(F.col(p).alias("score")).agg(
        F.avg(Y).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    rates = groups.agg(F.min("label"), F.max("label")).first()
    if rates[0] == rates[1]:
        raise ValueError("calibration needs both classes")
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight",
                              predictionCol="calibrated").fit(groups)


def calibrate(model, df: DataFrame, p: str = P) -> DataFrame:
    out = model.transform(df.withColumn("score", F.col(p)))
    clipped = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("calibrated", clipped).drop("score")


def calibration_report(df: DataFrame, scores: Sequence[str], split: str = "split") -> DataFrame:
    """Brier score and calibration error of several scores per split."""
    long = unpivot(df, scores, [split, Y], ("kind", P), "double")
    by = [split, "kind"]
    return long.groupBy(*by).agg(brier().alias("brier")).join(ece(long, by), by)


def attribution_terms(df: DataFrame, coefficients: dict[str, float], keys: Sequence[str]
                      ) -> DataFrame:
    """Exact contributions of a linear model: coefficient times distance from the mean."""
    cols = list(coefficients)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    terms = F.array(*[
        F.struct(F.lit(c).alias("encoded"),
                 (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("contribution"))
        for c, w in coefficients.items()])
    return df.select(*keys, F.inline(terms))


def raw_feature(encoded: Column, raw: Sequence[str]) -> Column:
    """Raw feature of an encoded column; the longest matching name wins."""
    out = F
    for name in sorted(raw, key=len, reverse=True):
        out = out.when((encoded == name) | encoded.startswith(f"{name}_"), name)
    return out.otherwise("_other")


def attribution_by_feature(terms: DataFrame, raw: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return terms.groupBy(*keys, raw_feature(F.col("encoded"), raw).alias("feature")).agg(
        F.sum("contribution").alias("contribution"))


def top_contributions(by_feature: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest contributions of each row (a row has at most a few dozen)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "feature")
    return by_feature.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(
        F.col("rank") <= k)


def top_of_terms(terms: DataFrame, raw: Sequence[str], keys: Sequence[str], k: int = 5,
                 base: float | None = None) -> DataFrame:
    """`top_contributions` of `attribution_by_feature`, with `waterfall` from `base` if one is given.

    The sums of a row's features stand side by side, so a row is one group and its largest are
    chosen in it: neither its terms nor its features are sorted.
    """
    features = [*dict.fromkeys(raw), "_other"]
    own = lambda f: F.col("_f") == f
    sums = terms.withColumn("_f", raw_feature(F.col("encoded"), raw)).groupBy(*keys).agg(
        *[F.sum(F.when(own(f), F.col("contribution"))).alias(f"_s{i}") for i, f in enumerate(features)],
        *[F.max(F.when(own(f), True)).alias(f"_h{i}") for i, f in enumerate(features)])
    return top_of_sums(sums, features, keys, k, base)


def top_of_sums(sums: DataFrame, features: Sequence[str], keys: Sequence[str], k: int = 5,
                base: float | None = None) -> DataFrame:
    """`top_of_terms` of the sums `_s0`, `_s1`... of a row's features, present where `_h0`, `_h1`... are."""
    size = lambda c: F.when(c.isNull(), 2).when(F.isnan(c), 0).otherwise(1)
    cells = F.array_compact(F.array(*[
        F.when(F.col(f"_h{i}"), F.struct(size(F.col(f"_s{i}")).alias("o"), (-F.abs(F.col(f"_s{i}"))).alias("a"),
                                         F.lit(f).alias("feature"), F.col(f"_s{i}").alias("contribution")))
        for i, f in enumerate(features)]))
    top = sums.select(*keys, F.slice(F.array_sort(cells), 1, k).alias("_top"))
    each = top.select(*keys, "_top", F.posexplode("_top").alias("_i", "_c")) if base is not None else top.select(
        *keys, F.posexplode("_top").alias("_i", "_c"))
    columns = [*keys, F.col("_c.feature").alias("feature"), F.col("_c.contribution").alias("contribution"),
               (F.col("_i") + 1).cast("bigint").alias("rank")]
    if base is not None:
        total = F.aggregate(F.slice("_top", 1, F.col("_i") + 1), F.lit(0.0), lambda t, c: t + F.coalesce(c["contribution"], F.lit(0.0)))
        # Unknown contributions come last, so with the first one all are unknown.
        columns.append(F.when(F.col("_top")[0]["contribution"].isNotNull(), F.lit(base) + total).alias("running"))
    return each.select(*columns)


def attribution_ranking(by_feature: DataFrame) -> DataFrame:
    return by_feature.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"))


def waterfall(top: DataFrame, keys: Sequence[str], base: float) -> DataFrame:
    """Running total of a row's contributions from the base value."""
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running", F.lit(base) + F.sum("contribution").over(w))


def split_importance(model: PipelineModel, scored: DataFrame, raw: Sequence[str]) -> DataFrame:
    """Tree importances per encoded column, summed to raw features."""
    attrs = model.transform(scored).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, "?"), float(v)) for i, v in enumerate(weights) if v > 0]
    spark = scored.sparkSession
    return spark.createDataFrame(rows, "encoded string, importance double").groupBy(
        raw_feature(F.col("encoded"), raw).alias("feature")).agg(
            F.sum("importance").alias("importance"))


def ensemble_spread(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    cols = [F.col(c) for c in scores]
    mean = sum(cols[1:], cols[0]) / len(cols)
    return df.withColumns({"spread": F.greatest(*cols) - F.least(*cols), "mean_score": mean})


REGRESSORS = ["linear", "ridge", "lasso", "decision_tree", "random_forest", "gradient_boosting"]


def regressor(family: str, target: str = "adr", seed: int = 42):
    base = {"labelCol": target, "featuresCol": "features"}
    return {
        "gradient_boosting": lambda: GBTRegressor(
            maxIter=C.ADR_ROUNDS, maxDepth=C.BOOST_DEPTH, seed=seed, **base),
        "linear": lambda: LinearRegression(**base),
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0, **base),
        "lasso": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0, **base),
        "random_forest": lambda: RandomForestRegressor(
            numTrees=C.ADR_ROUNDS, maxDepth=C.BOOST_DEPTH, seed=seed, **base),
        "decision_tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=seed, **base),
    }[family]()


class RateRows(NamedTuple):
    """The training rows of a rate forecast, their number, and the encoding fitted on them."""

    rows: DataFrame
    ready: PipelineModel
    n_rows: int


def rate_rows(train: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> RateRows:
    rows = as_numbers(train, nums).filter(F.col("adr").isNotNull())
    ready = Pipeline(stages=preprocessor(cats, nums)).fit(rows)
    return RateRows(rows.select(*dict.fromkeys([*cats, *nums, "adr"])), ready, rows.count())


def fit_rate(known: RateRows, family: str) -> PipelineModel:
    return PipelineModel(stages=[*known.ready.stages, fit_rows(regressor(family), known.rows, known.n_rows, known.ready.transform)])


def fit_adr(train: DataFrame, family: str, cats, nums) -> PipelineModel:
    return fit_rate(rate_rows(train, cats, nums), family)


def _rate() -> Column:
    """Forecast rate: null if not finite, not below 0, two decimals."""
    p = F.nanvl("prediction", F.lit(None).cast("double"))
    finite = F.when(F.abs(p) < float("inf"), p)
    return F.when(finite.isNotNull(), F.round(F.greatest(finite, F.lit(0.0)), 2))


def score_adr(model: PipelineModel, df: DataFrame, nums) -> DataFrame:
    """`df` with `predicted_adr`: null if not finite, not below 0, two decimals."""
    out = model.transform(as_numbers(df, nums))
    return out.withColumn("predicted_adr", _rate()).select(*df.columns, "predicted_adr")


def score_rates(known: RateRows, fitted: dict[str, PipelineModel], df: DataFrame, nums) -> DataFrame:
    """`df` with the forecast of each model of `fit_rate` under its name; rows are encoded once."""
    out = known.ready.transform(as_numbers(df, nums))
    for name, model in fitted.items():
        out = model.stages[-1].transform(out).withColumn(name, _rate()).drop("prediction")
    return out.select(*df.columns, *fitted)


def adr_residuals(df: DataFrame) -> DataFrame:
    e = F.col("adr") - F.col("predicted_adr")
    return df.withColumns({"residual": F.round(e, 2), "abs_residual": F.round(F.abs(e), 2)})


#: Replicates that a task draws at once, and groups of rows drawn before they are summed.
_CHUNK, _DRAWN = 250, 1024
#: Rows of a group that are drawn one by one; a larger group takes a generator of its own.
_SINGLE_ROWS = 16
#: Poisson(1) at most so much, and its value for each 16 random bits; 255 where these do not decide it.
_AT_MOST_ONE = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
_BY_BITS = np.searchsorted(_AT_MOST_ONE, np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)
_BY_BITS[(_AT_MOST_ONE[:8] * (1 << 16)).astype(int)] = 255
_BY_BITS[-1] = 255
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's mixing of 64-bit numbers, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def poisson_draws(seed: int, chunk: int, replicates: int, keys: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
    """Poisson counts (groups x replicates) of one chunk of replicates for groups of equal rows.

    A row of a bootstrap sample is drawn Poisson(1) times, so a group of n rows Poisson(n) times.
    The draws are a function of the group's own value: a repeated task draws the same counts. Rows
    have a SplitMix64 sequence each, 16 bits of which give a count, and 64 more where they leave it open.
    """
    keys, sizes = np.asarray(keys, np.int64), np.asarray(sizes, np.int64)
    few = (sizes > 0) & (sizes <= _SINGLE_ROWS)
    out = np.zeros((len(keys), replicates), np.int64)
    for i in np.flatnonzero(sizes > _SINGLE_ROWS):
        out[i] = np.random.default_rng([seed, int(keys[i]) & 0x7FFFFFFFFFFFFFFF, chunk]).poisson(sizes[i], replicates)
    if not few.any():
        return out
    first = np.cumsum(sizes[few]) - sizes[few]
    number = (np.arange(sizes[few].sum()) - np.repeat(first, sizes[few])).astype(np.uint64)
    own = _mixed(np.array([seed, chunk], np.int64).view(np.uint64) * _ODD + np.array([1, 2], np.uint64)).sum(dtype=np.uint64)
    start = _mixed(_mixed(np.repeat(keys[few].view(np.uint64), sizes[few]) + own) + number * _ODD)
    bits = _mixed(start[:, None] + np.arange(1, 2 + replicates // 4, dtype=np.uint64) * _STEP)
    drawn = np.take(_BY_BITS, bits.view(np.uint16), mode="clip")
    row, at = np.divmod(np.flatnonzero(drawn == 255), drawn.shape[1])
    more = _mixed((bits[row, at // 4] ^ _ODD) + at.astype(np.uint64) * _STEP) >> np.uint64(11)
    drawn[row, at] = np.searchsorted(_AT_MOST_ONE, (bits.view(np.uint16)[row, at] + more / 2.0 ** 53) / (1 << 16), "right")
    drawn = drawn[:, :replicates]
    out[few] = drawn if len(drawn) == few.sum() else np.add.reduceat(drawn, first, axis=0, dtype=np.int64)
    return out


#: Groups of rows in a slice of scores, about; a task sums a slice over all replicates.
_SLICE_GROUPS = 5000


def _lists(rows: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return rows[name].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def bootstrap_aucs(df: DataFrame, scores: Sequence[str], replicates: int = C.BOOTSTRAP_REPLICATES,
                   seed: int = 42, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Both AUCs and F1 at `threshold` of several scores per replicate, on shared draws.

    Rows are first counted per distinct (scores, label), so the cost follows the number of
    distinct scores, not of rows. Draws are arrays over a chunk of replicates: a slice of scores
    makes them where it sums them, once for the totals of the slices above each slice and once for
    the metrics, so they are neither stored nor shuffled. A replicate with one class has no AUC.
    """
    groups = df.groupBy(*scores, Y).agg(F.count(F.lit(1)).alias("n"))
    groups = written_table(groups.withColumn("key", F.xxhash64(*scores, Y)), "bootstrap-groups")
    slices = min(SLICES, 1 + groups.count() // _SLICE_GROUPS)
    long = unpivot(groups, scores, [Y, "n", "key"], ("model", "score"), "double")
    # Few bytes are much work here, so parts are not left to be merged by their size.
    long = long.withColumns({
        "slice": slice_of(1 - F.col("score"), slices),
        "score": F.coalesce("score", F.lit(float("-inf")))}).repartition(1 + slices * len(scores) // 2, "model", "slice")
    chunks = [(c, min(_CHUNK, replicates - c * _CHUNK)) for c in range(1 + (replicates - 1) // _CHUNK)]

    def summed(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk: distinct scores from the highest on, and the drawn negatives and positives of each."""
        found, at = np.unique(-rows["score"].to_numpy(), return_inverse=True)
        label, key, n = (rows[c].to_numpy() for c in (Y, "key", "n"))
        known = np.flatnonzero((label == 0) | (label == 1))
        cell = 2 * at[known] + (label[known] == 1)
        order = np.argsort(cell, kind="stable")
        cell, key, n = cell[order], key[known][order], n[known][order]
        for chunk, wide in chunks:
            of_cell = np.zeros((2 * len(found), wide), np.int64)
            for i in range(0, len(key), _DRAWN):
                own = cell[i:i + _DRAWN]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                drawn = poisson_draws(seed, chunk, wide, key[i:i + _DRAWN], n[i:i + _DRAWN])
                of_cell[own[first]] += np.add.reduceat(drawn, first, axis=0)
            yield -found, of_cell[0::2], of_cell[1::2]

    def total(rows: pa.Table) -> pa.Table:
        sums = [(neg.sum(axis=0), pos.sum(axis=0)) for _, neg, pos in summed(rows)]
        return pa.table({
            "model": pa.array([rows["model"][0].as_py()] * len(sums), pa.string()),
            "chunk": pa.array([c for c, _ in chunks], pa.int32()),
            "slice": pa.array([rows["slice"][0].as_py()] * len(sums), pa.int32()),
            "neg": pa.array([s[0] for s in sums], pa.list_(pa.int64())),
            "pos": pa.array([s[1] for s in sums], pa.list_(pa.int64()))})

    def above(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slice")
        out = {c: rows[c] for c in ("model", "chunk", "slice")}
        for c in ("neg", "pos"):
            each = _lists(rows, c)
            ends = np.arange(len(each) + 1, dtype=np.int32) * each.shape[1]
            out[c] = pa.ListArray.from_arrays(pa.array(ends), pa.array((each.cumsum(axis=0) - each).ravel()))
        return pa.table(out)

    def parts(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        offsets, out = offsets.sort_by("chunk"), []
        for i, (score, neg, pos) in enumerate(summed(rows)):
            before = offsets.slice(i, 1)
            cum_neg, cum_pos = (_lists(before, c) + x.cumsum(axis=0) for c, x in (("neg", neg), ("pos", pos)))
            hit = score >= threshold
            out.append({
                "lost": (pos * (cum_neg - neg / 2)).sum(axis=0),
                "steps": (pos * cum_pos / np.maximum(cum_pos + cum_neg, 1)).sum(axis=0),
                "pos": pos.sum(axis=0), "neg": neg.sum(axis=0),
                "tp": pos[hit].sum(axis=0), "fp": neg[hit].sum(axis=0)})
        return pa.table({
            "model": pa.array([rows["model"][0].as_py()] * replicates, pa.string()),
            "replicate": pa.array(np.arange(replicates, dtype=np.int32)),
            **{c: np.concatenate([o[c] for o in out]) for c in out[0]}})

    key = "model string, chunk int, slice int, neg array<bigint>, pos array<bigint>"
    by = ["model", "slice"]
    totals = long.groupBy(*by).applyInArrow(total, key)
    offsets = totals.groupBy("model", "chunk").applyInArrow(above, key)
    pieces = long.groupBy(*by).cogroup(offsets.groupBy(*by)).applyInArrow(
        parts, "model string, replicate int, lost double, steps double, pos bigint, neg bigint, tp bigint, fp bigint")
    names = ["lost", "steps", "pos", "neg", "tp", "fp"]
    sums = pieces.groupBy("model", "replicate").agg(*[F.sum(c).alias(c) for c in names])
    both = F.col("pos").cast("double") * F.col("neg")
    # F1 is 0 where nothing is hit and nothing was to be hit.
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))
    # Written, as a comparison of two models reads them twice.
    return written_table(sums.select(
        "model", "replicate",
        F.when(both > 0, 1 - F.try_divide(F.col("lost"), both)).alias("roc_auc"),
        F.when(both > 0, F.try_divide("steps", "pos")).alias("pr_auc"),
        F.when(F.col("pos") + F.col("neg") > 0, f1).alias("f1")), "bootstrap-replicates")


def bootstrap_ci(aucs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals (one row per replicate and model: small)."""
    long = unpivot(aucs, ["roc_auc", "pr_auc", "f1"], ["model"], ("metric", "value"), "double")
    return long.groupBy("model", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.percentile("value", alpha / 2).alias("ci_low"),
        F.percentile("value", 1 - alpha / 2).alias("ci_high"))


def paired_delta(aucs: DataFrame, champion: str, alpha: float = 0.05) -> DataFrame:
    """Champion minus challenger per metric: mean, interval and two-sided p-value."""
    long = unpivot(aucs, ["roc_auc", "pr_auc", "f1"], ["model", "replicate"], ("metric", "value"),
                   "double")
    best = long.filter(F.col("model") == champion).select(
        "replicate", "metric", F.col("value").alias("best"))
    delta = F.col("best") - F.col("value")
    pairs = long.filter(F.col("model") != champion).join(best, ["replicate", "metric"]).select(
        "model", "metric", delta.alias("delta"))
    tails = F.least(F.avg((F.col("delta") <= 0).cast("double")),
                    F.avg((F.col("delta") >= 0).cast("double")))
    return pairs.groupBy("model", "metric").agg(
        F.avg("delta").alias("delta"), F.percentile("delta", alpha / 2).alias("ci_low"),
        F.percentile("delta", 1 - alpha / 2).alias("ci_high"),
        F.least(F.lit(1.0), 2 * tails).alias("p_value"),
    ).withColumn("significant", F.col("p_value") < alpha)


def ablation_region(country: Column, top: Sequence[str]) -> Column:
    """Country encoding of the ablation study: the most frequent ones, the rest as one."""
    return F.when(country.isin(list(top)), country).otherwise("Other")


def flip_counts(model: PipelineModel, df: DataFrame, changes: dict[str, Column], nums, t: float
                ) -> DataFrame:
    """How many rows change sides when one feature is changed (one scored copy per change)."""
    before = score(model, df, nums, "before")
    parts = None
    for name, value in changes.items():
        after = score(model, before.withColumn(name, value), nums, "after")
        hit = lambda c: F.col(c) >= t
        one = after.agg(
            F.lit(name).alias("feature"), F.count(F.lit(1)).alias("n"),
            F.count_if(hit("before") != hit("after")).alias("flipped"),
            F.count_if(hit("before") & ~hit("after")).alias("flipped_down"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("flipped_pct", 100 * F.try_divide("flipped", "n"))

