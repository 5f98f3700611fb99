"""Tree families of Spark ML grown on compact rows: a few bytes a row instead of four for each entry.

Spark ML keeps every entry of a feature vector as a number of its own, of each fit. Here the one-hot
entries of a column are one code, and columns of few bins share one; so a fit holds about 20 to 40
bytes a row, and a level of a tree takes one count for each shared code. What is fitted is the
estimator's own: its impurity, bins, rounds, depth, step, shares of rows and features, and end by
validation. The fitted model is Spark ML's class.
"""

from __future__ import annotations

import json
import math
import pickle
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor,
    RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, scratch_path

#: Fitted classes by estimator; the trees of an ensemble have a class of their own.
MODELS = {
    GBTClassifier: GBTClassificationModel, GBTRegressor: GBTRegressionModel,
    RandomForestClassifier: RandomForestClassificationModel, RandomForestRegressor: RandomForestRegressionModel,
    DecisionTreeClassifier: DecisionTreeClassificationModel, DecisionTreeRegressor: DecisionTreeRegressionModel,
}
_GIVES_CLASS = (RandomForestClassifier, DecisionTreeClassifier)
_BOOSTS, _FORESTS = (GBTClassifier, GBTRegressor), (RandomForestClassifier, RandomForestRegressor)

#: Most cells of a shared code, rows of a block, rows of a task, and trees of a forest grown at once.
CELLS, BLOCK_ROWS, TASK_ROWS, TREES_AT_ONCE = 1024, 100_000, 1_000_000, 10
#: Up to so many rows one task boosts all rounds: it holds about 50 bytes a row. A round is a job for
#: each level otherwise, and each of its tasks costs some 30 ms before it counts.
ALONE_ROWS = 4_000_000
#: Partial sums beyond this number meet in tasks, not in the driver.
_DRIVER_PARTS = 64


# --- Bins ----------------------------------------------------------------------------------------


def cut_points(values: np.ndarray, weights: np.ndarray, most: int, total: float) -> np.ndarray:
    """Spark ML's candidate thresholds of one entry: at most `most`, between values of like weight.

    `total` is the weight expected of a sample of this size; what its values lack of it are zeros,
    as there.
    """
    some = values != 0
    found, at = np.unique(values[some], return_inverse=True)
    sums = np.bincount(at, weights=weights[some], minlength=len(found))
    zeros = total - sums.sum()
    if zeros > np.finfo(float).eps * len(values) * 100:
        i = int(np.searchsorted(found, 0.0))
        found, sums = np.insert(found, i, 0.0), np.insert(sums, i, zeros)
    between = (found[1:] + found[:-1]) / 2
    if len(between) <= most:
        return between
    stride, target, count, out = total / (most + 1), total / (most + 1), sums[0], []
    for i in range(1, len(found)):
        before, count = count, count + sums[i]
        if abs(before - target) < abs(count - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


class Column(NamedTuple):
    """A number with its thresholds, or the one-hot entries of a category (code 0: none of them)."""

    entries: tuple[int, ...]
    cuts: np.ndarray | None

    @property
    def size(self) -> int:
        return 1 + (len(self.entries) if self.cuts is None else len(self.cuts))

    def codes(self, x: np.ndarray) -> np.ndarray:
        if self.cuts is not None:
            return np.searchsorted(self.cuts, x[:, self.entries[0]], "left")
        own = x[:, self.entries] != 0
        if (own.sum(axis=1) > 1).any():
            raise ValueError("a row has several one-hot entries of one category")
        return own @ np.arange(1, 1 + len(self.entries))


class Layout:
    """Columns, the shared codes they are packed into, and the order of the candidate splits."""

    def __init__(self, columns: Sequence[Column], n_entries: int) -> None:
        self.columns, self.n_entries = list(columns), n_entries
        # The largest first, each into the first code with room.
        self.packs: list[list[int]] = []
        sizes: list[int] = []
        for c in sorted(range(len(self.columns)), key=lambda c: -self.columns[c].size):
            wide = self.columns[c].size
            home = next((p for p, s in enumerate(sizes) if s * wide <= CELLS), None)
            if home is None:
                self.packs.append([])
                sizes.append(1)
                home = len(sizes) - 1
            self.packs[home].append(c)
            sizes[home] *= wide
        self.sizes = sizes
        self.at = np.concatenate([[0], np.cumsum([c.size for c in self.columns])]).astype(int)
        # A candidate: its entry, column, and last bin of the left side (or the code that is 1).
        found = [(e, c, b) for c, col in enumerate(self.columns)
                 for e, b in ([(col.entries[0], b) for b in range(len(col.cuts))] if col.cuts is not None
                              else [(e, 1 + i) for i, e in enumerate(col.entries)])]
        found.sort()
        self.entry, self.column, self.bin = (np.array(x, int) for x in (zip(*found) if found else ((), (), ())))
        self.hot = np.array([self.columns[c].cuts is None for c in self.column], bool)
        self.bin_at = self.at[self.column] + self.bin if len(found) else np.zeros(0, int)

    def pack(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for members in self.packs:
            code = np.zeros(len(x), np.int64)
            for c in members:
                code = code * self.columns[c].size + self.columns[c].codes(x)
            out.append(code.astype(np.uint16))
        return out

    def where(self, c: int) -> tuple[int, tuple[int, ...], int]:
        """The pack of a column, the sizes of the pack's columns, and its place among them."""
        p = next(p for p, members in enumerate(self.packs) if c in members)
        return p, tuple(self.columns[m].size for m in self.packs[p]), self.packs[p].index(c)

    def goes_left(self, c: int, left: np.ndarray) -> tuple[int, np.ndarray]:
        """A pack, and which of its codes go left if those of column `c` do that `left` marks."""
        p, shape, axis = self.where(c)
        return p, np.broadcast_to(np.expand_dims(left, [i for i in range(len(shape)) if i != axis]), shape).ravel().copy()

    def spread(self, sums: list[np.ndarray]) -> np.ndarray:
        """Nodes x bins of all columns, from nodes x cells of each pack."""
        out = np.zeros((len(sums[0]), self.at[-1]))
        for members, cells in zip(self.packs, sums):
            # The columns before one are summed as rows, those after it in their place.
            rest = cells.reshape(len(cells), 1, -1)
            for c in members:
                rest = rest.reshape(len(cells), self.columns[c].size, -1)
                out[:, self.at[c]:self.at[c + 1]] = rest.sum(axis=2)
                rest = rest.sum(axis=1)
        return out


def _kinds(df: DataFrame, features: str) -> tuple[list[str], set[int]] | None:
    """Names of the entries and which are binary; None where an entry is of another kind."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if not attrs or set(attrs) - {"numeric", "binary"}:
        return None
    names = {a["idx"]: a.get("name", "") for kind in attrs.values() for a in kind}
    return [names[i] for i in range(len(names))], {a["idx"] for a in attrs.get("binary", [])}


def _spark_sample(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that Spark ML's fit seeks its bins in, if it reads rows in these parts."""
    spark = rows.sparkSession
    drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.javaRDD().sample(False, share, drawn)
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark)


def make_layout(rows: DataFrame, features: str, bins: int, n: int, weight: float, seed: int, dealt: DataFrame | None = None) -> Layout:
    """Bins sought in as many rows as Spark ML seeks them in: all up to 10,000 (or `bins` squared), else so many at random.

    That is part of the method: all rows are put in these bins and counted. With `dealt`, the rows in
    the parts that Spark ML would read, the sample is the one that it would draw.
    """
    names, binary = _kinds(rows, features)
    wanted = max(bins * bins, 10_000)
    share = min(1.0, wanted / n) if n else 1.0
    rows = rows.select(features, "_w")
    if share < 1.0:
        rows = rows.sample(False, share, seed) if dealt is None else _spark_sample(dealt.select(features, "_w"), share, seed)
    table = rows.select(vector_to_array(features).alias("x"), F.col("_w").alias("w")).toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(names))
    w = table["w"].combine_chunks().to_numpy()
    columns, hot = [], {}
    for i, name in enumerate(names):
        if i not in binary:
            columns.append(Column((i,), cut_points(x[:, i], w, min(bins, n) - 1, share * weight)))
        else:
            hot.setdefault(name.split("_hot_")[0] if "_hot_" in name else (i,), []).append(i)
    # A code has 16 bits.
    columns += [Column(tuple(e[k:k + CELLS - 1]), None) for e in hot.values() for k in range(0, len(e), CELLS - 1)]
    return Layout(columns, len(names))


# --- Rows ----------------------------------------------------------------------------------------


class Block(NamedTuple):
    """Rows in codes: those of the training first, then those of the validation."""

    number: int
    packs: list[np.ndarray]
    y: np.ndarray
    w: np.ndarray | float
    n: int

    def weight(self) -> np.ndarray:
        return np.broadcast_to(np.asarray(self.w, float), self.y.shape)


def _blocks(batches: Iterable[pa.RecordBatch], layout: Layout, whole: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Codes of some rows as pickled blocks, one a row."""
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        late = np.concatenate([h[3] for h in held])
        order = np.argsort(late, kind="stable")
        w = np.concatenate([h[2] for h in held])[order]
        parts = [np.concatenate(p)[order] for p in zip(*[h[0] for h in held])]
        y = np.concatenate([h[1] for h in held])[order]
        one = float(w[0]) if (w == w[0]).all() else w
        made = Block(0, parts, y, one, int((~late).sum()))
        held.clear()
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(tuple(made), 5)], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, layout.n_entries)
        y = batch["y"].to_numpy(zero_copy_only=False)
        held.append((layout.pack(x), y.astype(np.uint8) if whole else y.astype(float),
                     batch["w"].to_numpy(zero_copy_only=False), batch["late"].to_numpy(zero_copy_only=False)))
        if sum(len(h[1]) for h in held) >= most:
            yield block()
    if held:
        yield block()


def _plain(rdd: RDD) -> RDD:
    """One element a batch, as `zip` needs it."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _parts(spark: SparkSession, n: int, least: int) -> int:
    return max(1 + n // TASK_ROWS, min(spark.sparkContext.defaultParallelism, 1 + n // least))


def packed(rows: DataFrame, features: str, layout: Layout, whole: bool, n: int, parts: int) -> RDD:
    """The rows' blocks, dealt in turn over so many tasks; the vectors are not kept."""
    most = min(BLOCK_ROWS, 1 + n // parts)
    made = rows.select(vector_to_array(features).alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w"),
                       F.col("_late").alias("late")).mapInArrow(
        lambda batches: _blocks(batches, layout, whole, most), "block binary")
    numbered = made.rdd.map(lambda r: bytes(r[0])).zipWithIndex().map(lambda b: (b[1], b[0]))
    dealt = numbered.partitionBy(parts, lambda i: i)
    # In a fixed order: a part that is made again is the same.
    read = lambda found: (Block(i, *pickle.loads(b)[1:]) for i, b in sorted(found))
    return _plain(dealt.mapPartitions(read, preservesPartitioning=True))


# --- Growing -------------------------------------------------------------------------------------


class Split(NamedTuple):
    """Where a node sends its rows: the codes of a pack that go left, and the children."""

    pack: int
    left: np.ndarray
    children: tuple[int, int]


class Tree:
    """Nodes of one tree while it grows; node 0 is the root."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.split: dict[int, Split] = {}
        self.shown: dict[int, tuple] = {}
        self.gain: dict[int, float] = {}
        self.stats: list[tuple[float, float, int]] = [(0.0, 0.0, 0)]

    def value(self, node: int) -> float:
        w, s, _ = self.stats[node]
        return s / w if w else 0.0

    def grown(self) -> Tree:
        """The tree without what only its own rows are walked by."""
        self.split = {node: s._replace(left=np.zeros(0, bool)) for node, s in self.split.items()}
        return self


def _ends(packs: Sequence[np.ndarray], split: dict[int, Split], rows: np.ndarray) -> dict[int, np.ndarray]:
    """Rows by the node they end in."""
    out, todo = {}, [(0, rows)]
    while todo:
        node, own = todo.pop()
        s = split.get(node)
        if s is None:
            out[node] = own
            continue
        goes = s.left.take(packs[s.pack].take(own))
        # Rows are taken by place: a mask of no order costs several times as much.
        todo += [(child, own.take(np.flatnonzero(side))) for child, side in zip(s.children, (goes, ~goes))]
    return out


def _added(packs: Sequence[np.ndarray], split: dict[int, Split], values: dict[int, float], n: int) -> np.ndarray:
    out = np.zeros(n)
    for node, own in _ends(packs, split, np.arange(n)).items():
        out[own] = values[node]
    return out


class Target(NamedTuple):
    """What trees are fitted to: `loss` "log" or "square" of boosting on a margin, or None for the label itself."""

    loss: str | None

    def __call__(self, y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
        if self.loss == "log":
            sign = 2.0 * y - 1
            return sign if margin is None else 4 * sign / (1 + np.exp(2 * sign * margin))
        if self.loss == "square" and margin is not None:
            return 2 * (y - margin)
        return y.astype(float)

    def error(self, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
        return 2 * np.logaddexp(0, -2 * (2.0 * y - 1) * margin) if self.loss == "log" else (y - margin) ** 2


class Draw(NamedTuple):
    """How often a tree counts a row: once, or by chance (a share of the rows, or with replacement)."""

    seed: int
    share: float
    again: bool

    def times(self, tree: int, block: int, n: int) -> np.ndarray | None:
        if self.share == 1.0 and not self.again:
            return None
        rng = np.random.default_rng([self.seed & 0x7FFFFFFFFFFFFFFF, tree, block])
        return rng.poisson(self.share, n).astype(np.uint8) if self.again else (rng.random(n, np.float32) < self.share).view(np.uint8)


class Sums:
    """Weight and sum of the target by node and bin, and drawn rows by node, of one tree."""

    def __init__(self, layout: Layout, n_nodes: int) -> None:
        self.layout, self.n_nodes = layout, n_nodes
        self.cells = [[np.zeros((n_nodes, size)) for size in layout.sizes] for _ in range(2)]
        self.rows = np.zeros(n_nodes, np.int64)

    def add(self, block: Block, own: Sequence[np.ndarray], y_of: Callable[[np.ndarray], np.ndarray], count: np.ndarray | None) -> None:
        """The rows of each node; `count`: how often each row of the block was drawn, if more than once."""
        at, n = np.concatenate(own), self.n_nodes
        place = np.repeat(np.arange(n), [len(o) for o in own])
        times = None if count is None else count.take(at).astype(float)
        y, w = y_of(at), times
        if not (isinstance(block.w, float) and block.w == 1.0):
            w = block.weight().take(at) if times is None else block.weight().take(at) * times
        self.rows += np.bincount(place, weights=times, minlength=n).astype(np.int64)
        wy = y if w is None else y * w
        for p, size in enumerate(self.layout.sizes):
            code = block.packs[p].take(at) + place * size
            for cells, each in zip(self.cells, (w, wy)):
                cells[p] += np.bincount(code, weights=each, minlength=n * size).reshape(n, size)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([self.layout.spread(c) for c in self.cells]), self.rows


def _counted(blocks: Iterable[tuple], layout: Layout, trees: Sequence[tuple], target: Target, draw: Draw) -> list:
    """The sums of each (number, splits, nodes) over (block, margin) rows."""
    sums = [Sums(layout, len(nodes)) for _, _, nodes in trees]
    for block, margin in blocks:
        y_of = lambda at, b=block, m=margin: target(b.y.take(at), None if m is None else m.take(at))
        for own, (number, split, nodes) in zip(sums, trees):
            times = draw.times(number, block.number, block.n)
            known = np.arange(block.n) if times is None else np.flatnonzero(times)
            ends = _ends(block.packs, split, known)
            own.add(block, [ends.get(node, known[:0]) for node in nodes], y_of, times if draw.again else None)
    return [s.found() for s in sums]


def _added_up(a: list, b: list) -> list:
    return [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b)]


def _total(rdd: RDD, count: Callable[[Iterable], list]) -> list:
    each = rdd.mapPartitions(lambda it: [count(it)])
    if rdd.getNumPartitions() > _DRIVER_PARTS:
        return each.treeReduce(_added_up)
    parts = each.collect()
    out = parts[0]
    for p in parts[1:]:
        out = _added_up(out, p)
    return out


class Best(NamedTuple):
    candidate: int
    gain: float
    swapped: bool
    left: tuple[float, float]
    right: tuple[float, float]


def _best(hist: np.ndarray, layout: Layout, least: float, by_sum: bool, allowed: Callable[[], np.ndarray | None]
          ) -> list[Best | None]:
    """The best split of each node of (2 x nodes x bins); None where no split lessens the impurity.

    Of equally good ones the first: splits that part the same rows differ by rounding alone. Of two
    categories the one of the lower mean goes left, for classes that with fewer positives.
    """
    if not len(layout.entry):
        return [None] * hist.shape[1]
    first = slice(layout.at[0], layout.at[1])
    total_w, total_s = hist[:, :, first].sum(axis=2)
    run = np.zeros_like(hist)
    for c in range(len(layout.columns)):
        own = slice(layout.at[c], layout.at[c + 1])
        run[:, :, own] = hist[:, :, own].cumsum(axis=2)
    picked = np.where(layout.hot, hist[:, :, layout.bin_at], run[:, :, layout.bin_at])
    lw, ls = picked
    rw, rs = total_w[:, None] - lw, total_s[:, None] - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        after = ls * ls / lw + rs * rs / rw
        good = (lw >= least / 2) & (rw >= least / 2)
        score = np.where(good, after - (total_s * total_s / total_w)[:, None], -np.inf)
    out = []
    for i in range(len(score)):
        own, order = score[i], allowed()
        if order is not None:
            own = np.where(order[layout.entry] < len(order), own, -np.inf)
        top = int(own.argmax())
        slack = 1e-13 * after[i, top]
        if not np.isfinite(own[top]) or own[top] <= 10 * slack:
            out.append(None)
            continue
        ties = np.flatnonzero(own >= own[top] * (1 - 1e-10) - slack)
        best = int(ties[0] if order is None else ties[np.argmin(order[layout.entry[ties]])])
        a, b = (lw[i, best], ls[i, best]), (rw[i, best], rs[i, best])
        # A picked hot bin is the category 1.
        mean = lambda x: x[1] if by_sum else x[1] / x[0]
        swapped = bool(layout.hot[best]) and mean(a) >= mean(b)
        left, right = (b, a) if swapped else (a, b)
        out.append(Best(best, float(own[best] / total_w[i]), swapped, tuple(map(float, left)), tuple(map(float, right))))
    return out


class Size(NamedTuple):
    """Bounds of a tree: depth, least weight of a side, entries that a node looks at, and what draws them."""

    depth: int
    least: float
    share: int
    seed: int
    by_sum: bool


def _grow(counted: Callable[[list[tuple]], list], layout: Layout, numbers: Sequence[int], size: Size) -> list[Tree]:
    """Trees of some numbers, a level of all of them for each call of `counted`: the sums of (number, splits, nodes).

    Of two siblings the lighter one is counted; the other is what the parent has besides. A node looks
    at a share of the entries, drawn from the seed, the tree and the node.
    """
    depth, least, share, seed, by_sum = size
    trees = [Tree(i) for i in numbers]
    wanted = [[0] for _ in trees]
    of_parent: list[dict[int, tuple]] = [{} for _ in trees]
    for level in range(depth):
        asked = [(t.number, t.split, nodes) for t, nodes in zip(trees, wanted)]
        if not any(wanted):
            break
        found = counted(asked)
        for i, (tree, nodes, (hist, rows)) in enumerate(zip(trees, wanted, found)):
            known = {node: (hist[:, k], int(rows[k])) for k, node in enumerate(nodes)}
            for node, (parent, sibling) in of_parent[i].items():
                known[node] = (parent[0] - known[sibling][0], parent[1] - known[sibling][1])
            wanted[i], of_parent[i] = [], {}
            if level == 0 and known:
                first = known[0][0][:, layout.at[0]:layout.at[1]].sum(axis=1) if layout.columns else np.zeros(2)
                tree.stats[0] = (float(first[0]), float(first[1]), known[0][1])
            order = sorted(known)
            for node in order:
                tree.stats[node] = (*tree.stats[node][:2], known[node][1])
            draws = iter(order)

            def allowed(draws=draws, tree=tree) -> np.ndarray | None:
                node = next(draws)
                if share >= layout.n_entries:
                    return None
                rng = np.random.default_rng([seed & 0x7FFFFFFFFFFFFFFF, tree.number, node])
                out = np.full(layout.n_entries, layout.n_entries)
                out[rng.permutation(layout.n_entries)[:share]] = np.arange(share)
                return out

            splits = _best(np.stack([known[node][0] for node in order], axis=1), layout, least, by_sum, allowed) if order else []
            for node, best in zip(order, splits):
                if best is None:
                    continue
                c, b = int(layout.column[best.candidate]), int(layout.bin[best.candidate])
                column, entry = layout.columns[c], int(layout.entry[best.candidate])
                if column.cuts is not None:
                    left, shown = np.arange(column.size) <= b, (entry, [float(column.cuts[b])], -1)
                else:
                    left, shown = (np.arange(column.size) == b) != best.swapped, (entry, [0.0 if best.swapped else 1.0], 2)
                children = (len(tree.stats), len(tree.stats) + 1)
                tree.stats += [(*best.left, 0), (*best.right, 0)]
                tree.split[node] = Split(*layout.goes_left(c, left), children)
                tree.shown[node], tree.gain[node] = shown, best.gain
                light, other = children if best.left[0] <= best.right[0] else children[::-1]
                wanted[i].append(light)
                of_parent[i][other] = (known[node], light)
    return trees


# --- Families ------------------------------------------------------------------------------------


def _share(strategy: str, n: int, classes: bool, trees: int) -> int:
    """How many entries a node looks at."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "onethird": math.ceil(n / 3), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * n)


class Boosting(NamedTuple):
    """Rounds and step of boosting, and the least gain on the validation rows (None: all rounds are made)."""

    rounds: int
    step: float
    tolerance: float | None

    def rate(self, m: int) -> float:
        return self.step if m else 1.0


def _boost(trees: Iterator[Tree], plan: Boosting, error: Callable[[], float]) -> list[Tree]:
    """Spark ML's rounds: with validation up to the one after which the error falls by less than the tolerance."""
    out, best, kept = [], None, 1
    for m, tree in enumerate(trees):
        out.append(tree)
        if plan.tolerance is None:
            continue
        after = error()
        if best is None:
            best = after
        elif best - after < plan.tolerance * max(after, 0.01):
            break
        elif after < best:
            best, kept = after, m + 1
    return out if plan.tolerance is None else out[:kept]


def _weighed_error(block: Block, margin: np.ndarray, target: Target) -> np.ndarray:
    """The validation rows' weighted error and weight."""
    w = block.weight()[block.n:]
    return np.array([(w * target.error(block.y[block.n:], margin[block.n:])).sum(), w.sum()])


def _boosted_alone(blocks: Iterable[Block], layout: Layout, plan: Boosting, target: Target, draw: Draw, size: Size) -> list[Tree]:
    """All rounds in one task, which holds the rows; a level goes on from where the rows were."""
    held = list(blocks)
    margins: list[np.ndarray | None] = [None] * len(held)

    def grown() -> Iterator[Tree]:
        for m in range(plan.rounds):
            ys = [target(b.y, margin) for b, margin in zip(held, margins)]
            drawn = [draw.times(m, b.number, b.n) for b in held]
            ends = [{0: np.arange(len(b.y))} for b in held]

            def go_on(split: dict[int, Split]) -> None:
                for b, at in zip(held, ends):
                    for node in [node for node in at if node in split]:
                        s, own = split[node], at.pop(node)
                        goes = s.left.take(b.packs[s.pack].take(own))
                        for child, side in zip(s.children, (goes, ~goes)):
                            at[child] = own.take(np.flatnonzero(side))

            def counted(asked: list[tuple]) -> list:
                (_, split, nodes), = asked
                go_on(split)
                sums = Sums(layout, len(nodes))
                for b, at, y, times in zip(held, ends, ys, drawn):
                    # Rows stand in order, and those of the validation come last.
                    own = [at[node][:np.searchsorted(at[node], b.n)] for node in nodes]
                    if times is not None:
                        own = [o.take(np.flatnonzero(times.take(o))) for o in own]
                    sums.add(b, own, y.take, None)
                return [sums.found()]

            tree = _grow(counted, layout, [m], size)[0]
            go_on(tree.split)
            values = {node: plan.rate(m) * tree.value(node) for node in range(len(tree.stats))}
            for i, (b, at) in enumerate(zip(held, ends)):
                margin = np.zeros(len(b.y)) if margins[i] is None else margins[i]
                for node, own in at.items():
                    margin[own] += values[node]
                margins[i] = margin
            yield tree.grown()

    def error() -> float:
        wrong, weight = sum((_weighed_error(b, m, target) for b, m in zip(held, margins)), np.zeros(2))
        return wrong / weight if weight else 0.0

    return _boost(grown(), plan, error)


def _boosted(blocks: RDD, layout: Layout, plan: Boosting, target: Target, draw: Draw, size: Size) -> list[Tree]:
    """A job for each level of a round; margins are kept by the tasks that hold the rows."""
    margins: list[RDD] = []

    def grown() -> Iterator[Tree]:
        for m in range(plan.rounds):
            rows = blocks.zip(margins[-1]) if margins else blocks.map(lambda b: (b, None))
            tree = _grow(lambda asked: _total(rows, lambda it: _counted(it, layout, asked, target, draw)), layout, [m], size)[0]
            split, values = tree.split, {node: plan.rate(m) * tree.value(node) for node in range(len(tree.stats))}

            def moved(row: tuple[Block, np.ndarray | None], split=split, values=values) -> np.ndarray:
                block, margin = row
                added = _added(block.packs, split, values, len(block.y))
                return added if margin is None else margin + added

            now = _plain(rows.map(moved, preservesPartitioning=True)).persist(StorageLevel.MEMORY_AND_DISK)
            if m % 10 == 9:
                # Cuts the lineage, which hundreds of rounds would grow.
                now.checkpoint()
            margins.append(now)
            if len(margins) > 2:
                # The margins before the last ones are made by now: the next trees read the last ones alone.
                margins.pop(0).unpersist()
            yield tree.grown()

    def error() -> float:
        wrong, weight = _total(blocks.zip(margins[-1]), lambda it: [(sum((_weighed_error(b, m, target) for b, m in it), np.zeros(2)), 0)])[0][0]
        return wrong / weight if weight else 0.0

    try:
        return _boost(grown(), plan, error)
    finally:
        for r in margins:
            r.unpersist()


def _forest(blocks: RDD, layout: Layout, n_trees: int, draw: Draw, size: Size) -> list[Tree]:
    rows, target, out = blocks.map(lambda b: (b, None)), Target(None), []
    for i in range(0, n_trees, TREES_AT_ONCE):
        made = _grow(lambda asked: _total(rows, lambda it: _counted(it, layout, asked, target, draw)), layout,
                     range(i, min(n_trees, i + TREES_AT_ONCE)), size)
        out += [t.grown() for t in made]
    return out


def fits_here(est, rows: DataFrame) -> bool:
    """Whether the estimator is one of trees, and the entries numbers and one-hot categories."""
    return type(est) in MODELS and _kinds(rows, est.getFeaturesCol()) is not None


def fit_trees(est, rows: DataFrame, least: int = BLOCK_ROWS, alone: int = ALONE_ROWS, dealt: DataFrame | None = None):
    """The fitted model of a tree estimator, as `est.fit(rows)` gives it.

    Rows and entries that a family draws by chance are others than Spark ML's; so are the rows that
    bins are sought in beyond 10,000, unless `dealt` has the rows in the parts that it would read.
    """
    spark, features = rows.sparkSession, est.getFeaturesCol()
    classes = type(est) in (GBTClassifier, *_GIVES_CLASS)
    weight = F.col(est.getWeightCol()).cast("double") if est.isDefined("weightCol") else F.lit(1.0)
    marked = type(est) in _BOOSTS and est.isDefined("validationIndicatorCol")
    late = F.col(est.getValidationIndicatorCol()) if marked else F.lit(False)
    named = lambda df: df.select(
        features, F.col(est.getLabelCol()).cast("double").alias("_y"), weight.alias("_w"), late.alias("_late"))
    rows = named(rows)
    train = rows.filter(~F.col("_late"))
    known = train.agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.min(F.when(F.col("_w") > 0, F.col("_w"))).alias("least"),
                      F.min("_y").alias("low"), F.max("_y").alias("high")).first()
    if not known["n"]:
        raise ValueError("no rows to fit")
    if classes and not {known["low"], known["high"]} <= {0.0, 1.0}:
        raise ValueError("labels other than 0 and 1")
    seed, depth = est.getSeed(), est.getMaxDepth()
    layout = make_layout(train, features, est.getMaxBins(), known["n"], known["w"], seed,
                         None if dealt is None else named(dealt).filter(~F.col("_late")))
    n_trees = est.getNumTrees() if type(est) in _FORESTS else 1
    strategy = est.getFeatureSubsetStrategy() if type(est) in (*_BOOSTS, *_FORESTS) else "all"
    share = _share(strategy, layout.n_entries, classes and type(est) not in _BOOSTS, n_trees)
    size = Size(depth, known["least"] or 0.0, share, seed, type(est) in _GIVES_CLASS)
    pack = lambda parts: packed(rows, features, layout, classes, known["n"], parts)
    plan = target = None
    if type(est) in _BOOSTS:
        plan = Boosting(est.getMaxIter(), est.getStepSize(), est.getValidationTol() if marked else None)
        target = Target("log" if classes else "square")
        draw = Draw(seed, est.getSubsamplingRate(), False)
        if known["n"] <= alone:
            trees = pack(1).mapPartitions(lambda it: _boosted_alone(it, layout, plan, target, draw, size)).collect()
            return as_model(spark, est, trees, [plan.rate(m) for m in range(len(trees))], layout.n_entries)
    blocks = pack(_parts(spark, known["n"], least)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if plan:
            trees = _boosted(blocks, layout, plan, target, draw, size)
            rates = [plan.rate(m) for m in range(len(trees))]
        else:
            # One tree alone knows every row once.
            share_of_rows = est.getSubsamplingRate() if type(est) in _FORESTS else 1.0
            trees = _forest(blocks, layout, n_trees, Draw(seed, share_of_rows, n_trees > 1), size)
            rates = [1.0] * n_trees
    finally:
        blocks.unpersist()
    return as_model(spark, est, trees, rates, layout.n_entries)


# --- Models --------------------------------------------------------------------------------------

_NODE = ("struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
         "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def _nodes(tree: Tree, gives_class: bool) -> Iterator[tuple]:
    """A tree's nodes in Spark ML's saved form, numbered from the root down, left before right.

    As there, leaves of one parent that give the same are one. Impurities are not kept (-1), and rows
    not of nodes that were not split further: a model that is loaded needs gains and weights alone.
    """
    def value(node: int) -> float:
        w, s, _ = tree.stats[node]
        return float(s > w - s) if gives_class else tree.value(node)

    split: dict[int, Split] = {}
    for node in sorted(tree.split, reverse=True):
        left, right = tree.split[node].children
        if left in split or right in split or value(left) != value(right):
            split[node] = tree.split[node]
    after, todo = {}, [0]
    while todo:
        node = todo.pop()
        after[node] = len(after)
        if node in split:
            todo += split[node].children[::-1]
    for node, i in after.items():
        w, s, n = tree.stats[node]
        # What a sibling leaves of its parent may miss 0 by rounding.
        stats = [x if x > 1e-9 * w else 0.0 for x in (w - s, s)] if gives_class else [w, s, 0.0]
        # Gini impurity of two classes is twice the variance.
        gain = tree.gain[node] * (1 + gives_class) if node in split else -1.0
        left, right = [after[c] for c in split[node].children] if node in split else [-1, -1]
        shown = tree.shown[node] if node in split else (-1, [], -1)
        yield i, value(node), -1.0, [float(x) for x in stats], int(n), float(gain), left, right, shown


def as_model(spark: SparkSession, est, trees: Sequence[Tree], rates: Sequence[float], n_entries: int):
    """Spark ML's model of some trees, made from its saved form."""
    kind = MODELS[type(est)]
    gives_class, alone = type(est) in _GIVES_CLASS, not hasattr(kind, "treeWeights")
    about = lambda e, model: {
        "class": f"org.apache.spark.ml.{model.__module__.split('.')[-1]}.{model.__name__}", "timestamp": int(time.time() * 1000),
        "sparkVersion": spark.version, "uid": e.uid, "paramMap": {p.name: v for p, v in e._paramMap.items()},
        "defaultParamMap": {p.name: v for p, v in e._defaultParamMap.items()}}
    extra = {"numFeatures": n_entries, **({"numClasses": 2} if gives_class else {}), **({} if alone else {"numTrees": len(trees)})}
    part = DecisionTreeClassifier if gives_class else DecisionTreeRegressor
    with scratch():
        path = scratch_path(spark, "model-grown")
        spark.createDataFrame([(json.dumps({**about(est, kind), **extra}),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        rows = [(t, node) for t, tree in enumerate(trees) for node in _nodes(tree, gives_class)]
        data = spark.createDataFrame(rows, f"treeID int, nodeData {_NODE}").coalesce(1)
        (data.select("nodeData.*") if alone else data).write.parquet(f"{path}/data")
        if not alone:
            each = [(t, json.dumps(about(part(maxDepth=est.getMaxDepth()), MODELS[part])), float(r)) for t, r in enumerate(rates)]
            spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        return kind.load(path)
