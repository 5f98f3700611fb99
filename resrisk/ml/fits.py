"""Many fits at once: feature matrices written once per fold, concurrent fits, staged scores, refits."""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators.metrics import P, Y, auc_metrics, log_loss, threshold_metrics
from ..session import path_exists, scratch, scratch_path, shared_folder, written_table
from .models import TREES, as_numbers, class_ratio, estimator, even_parts, fit_rows, preprocessor

#: Fits that the driver submits at once; each is a sequence of small jobs.
FITS_AT_ONCE = 8
#: Bytes that fits at work may hold together, and those a row of a fit: of vectors, and of trees (`trees`).
HELD_BYTES, VECTOR_BYTES, TREE_BYTES = 2 << 30, 400, 50


def at_once(n_rows: int, row_bytes: int = VECTOR_BYTES) -> int:
    """How many fits of `n_rows` rows run at once: each holds its rows in memory or, beyond it, on disk."""
    return max(1, min(FITS_AT_ONCE, HELD_BYTES // max(1, n_rows * row_bytes)))


def by_family(tasks: Sequence[tuple[str, Callable]], n_rows: int) -> list:
    """Results of (family, task) in their order: first the trees, then what holds more bytes a row."""
    out: list = [None] * len(tasks)
    for trees, row_bytes in ((True, TREE_BYTES), (False, VECTOR_BYTES)):
        own = [i for i, (family, _) in enumerate(tasks) if (family in TREES) == trees]
        for i, found in zip(own, together([tasks[i][1] for i in own], at_once(n_rows, row_bytes))):
            out[i] = found
    return out


def together(tasks: Sequence[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent tasks that submit Spark jobs, in their order."""
    if at_once <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        # Each thread sees the caller's scope of written tables and its local properties.
        target = inheritable_thread_target(SparkSession.active())
        running = [pool.submit(contextvars.copy_context().run, target(t)) for t in tasks]
        return [r.result() for r in running]


class Matrix(NamedTuple):
    """The rows of a split after preprocessing, and the preprocessing that was fitted on `train`."""

    train: DataFrame
    test: DataFrame
    ready: PipelineModel
    n_train: int
    n_test: int
    #: The training rows as they were written, not dealt anew.
    as_written: DataFrame


def feature_matrix(train: DataFrame, test: DataFrame, cats: Sequence[str], nums: Sequence[str],
                   keep: Sequence[str] = (), weighted: bool = True) -> Matrix:
    """Preprocessing fitted once on `train`, and both parts written as (keep, target, weight, features).

    Every fit on the split reads this table; none repeats the preprocessing. `weighted` gives
    positives and negatives the same total weight.
    """
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        # Boosting cuts the lineage of its predictions there.
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    ratio = float(class_ratio(train).first()["ratio"]) if weighted else 1.0
    ready = Pipeline(stages=preprocessor(cats, nums)).fit(as_numbers(train, nums))
    mark = lambda df, name: as_numbers(df, nums).withColumn("part", F.lit(name))
    both = ready.transform(mark(train, "train").unionByName(mark(test, "test")))
    weight = F.when(F.col(Y) == 1, ratio).otherwise(1.0)
    table = written_table(both.select(*keep, Y, weight.alias("weight"), "part", "features"), "fold-matrix")
    sizes = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = lambda name: table.filter(F.col("part") == name).drop("part")
    part = lambda name: even_parts(own(name), sizes.get(name, 0))
    return Matrix(part("train"), part("test"), ready, sizes.get("train", 0), sizes.get("test", 0), own("train"))


def fit_on(matrix: Matrix, family: str, **size):
    """A model of the family on the matrix's training rows."""
    return fit_rows(estimator(family, **size), matrix.as_written, matrix.n_train)


def scored(model, rows: DataFrame, name: str = P) -> DataFrame:
    """`rows` (with `features`) and the probability of the positive class."""
    out = model.transform(rows)
    return out.withColumn(name, vector_to_array("probability")[1]).select(*[c for c in rows.columns if c != name], name)


class Trees:
    """The trees of a fitted boosted model as arrays, for scores by round and contributions by feature.

    They are read from the model's saved form: a table of nodes. A leaf leads to itself.
    """

    def __init__(self, model) -> None:
        spark = SparkSession.active()
        with scratch():
            path = scratch_path(spark, "model-trees")
            model.save(path)
            nodes = spark.read.parquet(f"{path}/data").select(
                "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
                F.col("nodeData.split.featureIndex").alias("feature"),
                F.col("nodeData.split.leftCategoriesOrThreshold").alias("left"),
                F.col("nodeData.split.numCategories").alias("categories")).toPandas()
        nodes = nodes.sort_values(["treeID", "id"]).reset_index(drop=True)
        if (nodes["categories"] > 2).any():
            raise ValueError("splits on more than two categories")
        first = nodes.groupby("treeID")["id"].transform("size").groupby(nodes["treeID"]).first().cumsum().shift(fill_value=0)
        base = nodes["treeID"].map(first).to_numpy()
        own, leaf = np.arange(len(nodes)), (nodes["leftChild"] < 0).to_numpy()
        left, right = (np.where(leaf, own, base + nodes[c].to_numpy()) for c in ("leftChild", "rightChild"))
        of_left = [list(x) for x in nodes["left"]]
        # Two categories: those of the left side are 0, or 1 (then the children change places).
        two, has_one = (nodes["categories"] == 2).to_numpy(), np.array([x == [1.0] for x in of_left])
        self.left, self.right = np.where(two & has_one, right, left), np.where(two & has_one, left, right)
        self.threshold = np.array([0.5 if t else (x[0] if x else 0.0) for x, t in zip(of_left, two)])
        self.feature = np.maximum(nodes["feature"].to_numpy(), 0)
        weights = np.array(model.treeWeights)
        self.value = nodes["prediction"].to_numpy() * weights[nodes["treeID"].to_numpy()]
        self.roots, self.leaf = first.to_numpy(), leaf
        self.depth = 1 + int(model.getMaxDepth())

    @property
    def base(self) -> float:
        """The margin before any split."""
        return float(self.value[self.roots].sum())

    def _steps(self, x: np.ndarray, root: int):
        """Nodes that the rows are at, level by level."""
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.depth):
            goes = x[rows, self.feature[at]] <= self.threshold[at]
            after = np.where(goes, self.left[at], self.right[at])
            yield at, after
            if (after == at).all():
                return
            at = after

    def margins(self, x: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
        """Rows x rounds: the sum of the first so many trees."""
        out, total = np.zeros((len(x), len(rounds))), np.zeros(len(x))
        for i, root in enumerate(self.roots, 1):
            for _, at in self._steps(x, root):
                pass
            total += self.value[at]
            for j, r in enumerate(rounds):
                if i == min(r, len(self.roots)):
                    out[:, j] = total
        return out

    def splitting_on(self, entries: Sequence[int]) -> list[int]:
        """The trees with a split on any of the entries."""
        split = np.flatnonzero(~self.leaf & np.isin(self.feature, list(entries)))
        return sorted(set((np.searchsorted(self.roots, split, side="right") - 1).tolist()))

    def each(self, x: np.ndarray, trees: Sequence[int]) -> dict[int, np.ndarray]:
        """What each of some trees adds to the rows' margins."""
        out = {}
        for t in trees:
            for _, at in self._steps(x, self.roots[t]):
                pass
            out[t] = self.value[at]
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: the changes of the node value along each row's paths, by split feature.

        With `base` they add up to the margin.
        """
        out, rows = np.zeros(x.shape), np.arange(len(x))
        for root in self.roots:
            for at, after in self._steps(x, root):
                np.add.at(out, (rows, self.feature[at]), self.value[after] - self.value[at])
        return out


def staged_scores(model, rows: DataFrame, rounds: Sequence[int], name: str = P) -> DataFrame:
    """One row per row and round of `rounds`: the probability that the first so many trees give.

    One fit of the largest size holds all smaller ones: its first trees are those of a fit with
    fewer rounds. More rounds than the model has give its last ones.
    """
    trees, stages = Trees(model), list(rounds)

    @F.pandas_udf("array<double>")
    def probabilities(features: pd.Series) -> pd.Series:
        x = np.vstack(features) if len(features) else np.zeros((0, 1))
        return pd.Series(list(1 / (1 + np.exp(-2 * trees.margins(x, stages)))))

    kept = [c for c in rows.columns if c not in ("features", "rounds", name)]
    staged = rows.withColumn("_p", probabilities(vector_to_array("features")))
    number = F.element_at(F.array(*[F.lit(int(r)) for r in stages]), F.col("_i") + 1)
    return staged.select(*kept, F.posexplode("_p").alias("_i", name)).select(*kept, number.alias("rounds"), name)


def rank_families(cells: DataFrame) -> DataFrame:
    """Families by mean PR-AUC, then mean ROC-AUC, then name, from (family, fold, roc_auc, pr_auc).

    Folds without both metrics do not count. `wins`: the folds in which a family is best;
    `gap_to_best`: to the first; `gap_to_next`: to the one after it. Few rows: one per family.
    """
    valid = cells.filter(F.col("pr_auc").isNotNull() & F.col("roc_auc").isNotNull())
    best = Window.partitionBy("fold").orderBy(F.desc("pr_auc"), F.desc("roc_auc"), "family")
    valid = valid.withColumn("won", F.row_number().over(best) == 1)
    means = valid.groupBy("family").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("pr_auc").alias("pr_auc"),
        F.avg("roc_auc").alias("roc_auc"), F.count_if("won").alias("wins"))
    order = Window.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), "family")
    return means.withColumns({
        "rank": F.row_number().over(order),
        "gap_to_best": F.first("pr_auc").over(order) - F.col("pr_auc"),
        "gap_to_next": F.col("pr_auc") - F.lead("pr_auc").over(order)})


def fallback_choice(spark: SparkSession, reason: str) -> DataFrame:
    """The family taken where nothing could be compared."""
    return spark.createDataFrame(
        [(C.FALLBACK_FAMILY, 0, None, None, 0, 1, None, None, reason)],
        "family string, folds bigint, pr_auc double, roc_auc double, wins bigint, rank int, "
        "gap_to_best double, gap_to_next double, fallback_reason string")


def fold_cells(matrices: dict[str, Matrix], families: Sequence[str], sizes: dict[str, dict]) -> list[tuple]:
    """(family, fold, n_train, n_test, roc_auc, pr_auc) of every family on every fold's matrix."""
    def cell(fold: str, family: str) -> tuple:
        m = matrices[fold]
        found = auc_metrics(scored(fit_on(m, family, **sizes.get(family, {})), m.test)).first()
        return family, fold, m.n_train, m.n_test, found["roc_auc"], found["pr_auc"]

    most = max((m.n_train for m in matrices.values()), default=0)
    return by_family([(k, lambda f=f, k=k: cell(f, k)) for k in families for f in matrices], most)


CELLS = "family string, fold string, n_train bigint, n_test bigint, roc_auc double, pr_auc double"


def select_champion(df: DataFrame, folds, parts, families: Sequence[str], cats: Sequence[str], nums: Sequence[str],
                    sizes: dict[str, dict] | None = None) -> DataFrame:
    """Families ranked over rolling folds, each fitted on every fold's matrix; all unweighted alike.

    Without a fold, or without one that has both classes, the choice is `config.FALLBACK_FAMILY`,
    with the reason. The driver holds one row per fold and family.
    """
    spark = df.sparkSession
    if not folds:
        return fallback_choice(spark, "too few rows for a rolling fold")
    with scratch():
        made = together([lambda f=f: feature_matrix(*parts(f), cats, nums, weighted=False) for f in folds])
        matrices = {f.name: m for f, m in zip(folds, made)}
        rows = fold_cells(matrices, families, sizes or {})
    ranked = rank_families(spark.createDataFrame(rows, CELLS))
    if not any(r[4] is not None and r[5] is not None for r in rows):
        return fallback_choice(spark, "no family has valid metrics on a fold")
    return ranked.withColumn("fallback_reason", F.lit(None).cast("string"))


def round_curve(matrix: Matrix, depth: int, rounds: Sequence[int], parts: Sequence[str] = ("test",), **size) -> list[tuple]:
    """(depth, rounds, part, roc_auc, pr_auc, log_loss) read off one fit of the most rounds."""
    model = fit_on(matrix, "gradient_boosting", rounds=max(rounds), depth=depth, **size)
    out = []
    for part in parts:
        long = staged_scores(model, getattr(matrix, part), rounds)
        loss = long.groupBy("rounds").agg(log_loss().alias("log_loss"))
        for r in auc_metrics(long, ["rounds"]).join(loss, "rounds").collect():
            out.append((depth, r["rounds"], part, r["roc_auc"], r["pr_auc"], r["log_loss"]))
    return out


def cell_metrics(matrix: Matrix, family: str, threshold: float = C.DEFAULT_THRESHOLD, **size) -> dict[str, float]:
    """What one refit is judged by, on the matrix's test rows."""
    found = threshold_metrics(scored(fit_on(matrix, family, **size), matrix.test), threshold).first()
    return {"n_train": float(matrix.n_train), "n_test": float(matrix.n_test), **{
        m: found[m] for m in ("roc_auc", "pr_auc", "f1")}}


REFITS = "cell string, name string, value double"


def refit_cells(spark: SparkSession, cells: dict[str, Callable[[], dict[str, float]]], folder: str,
                at_once: int = FITS_AT_ONCE) -> DataFrame:
    """(cell, name, value) of every cell: a variant, seed or fraction whose model is fitted anew.

    Each cell's metrics are written to the folder as soon as they are known, and cells found there
    are not fitted again: a run that was killed goes on where it ended. Few rows: a handful a cell.
    """
    done = spark.read.schema(REFITS).option("recursiveFileLookup", True).parquet(f"{folder}/*") if path_exists(
        spark, folder) else spark.createDataFrame([], REFITS)
    known = {r["cell"] for r in done.select("cell").distinct().collect()}

    def run(name: str) -> None:
        rows = [(name, k, None if v is None else float(v)) for k, v in cells[name]().items()]
        spark.createDataFrame(rows, REFITS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cell-{name}")

    together([lambda n=n: run(n) for n in cells if n not in known], at_once)
    out = spark.read.schema(REFITS).option("recursiveFileLookup", True).parquet(f"{folder}/*")
    return out.filter(F.col("cell").isin(list(cells)))


def wide_cells(rows: DataFrame) -> DataFrame:
    """One row per cell with a column for each metric."""
    names = ["n_train", "n_test", "roc_auc", "pr_auc", "f1"]
    return rows.groupBy("cell").pivot("name", names).agg(F.first("value"))


def deltas_to(rows: DataFrame, baseline: str) -> DataFrame:
    """Wide cells with each metric's difference to the baseline cell."""
    wide = wide_cells(rows)
    base = wide.filter(F.col("cell") == baseline)
    names = ["roc_auc", "pr_auc", "f1"]
    return wide.withColumns({f"{m}_delta": F.col(m) - base.select(m).scalar() for m in names})


CURVE = "depth int, rounds int, part string, roc_auc double, pr_auc double, log_loss double"
