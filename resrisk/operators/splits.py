"""Chronological splits and folds.

Each is a set of position ranges.  ``CutKeys`` finds the order keys at the range ends, after
which membership is a comparison on the row itself: no shuffle of the table, no position column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .metrics import Y
from .ordering import CutKeys, bucket_starts


@dataclass(frozen=True)
class Fold:
    """Rows [0, train_end) to train on, rows [test_start, test_end) to evaluate."""

    name: str
    train_end: int
    test_start: int
    test_end: int


def rolling_folds(n: int) -> list[Fold]:
    size = max(int(n * C.ROLLING_VAL_RATIO), C.ROLLING_MIN_VAL)
    ends = [(f, int(n * f)) for f in C.ROLLING_CUTOFFS]
    return [Fold(f"{f:.2f}", e, e, e + size) for f, e in ends
            if e >= C.ROLLING_MIN_TRAIN and e + size <= n]


def wide_folds(n: int) -> list[Fold]:
    size = max(int(n * 0.10), 2000)
    ends = [(f, int(n * f)) for f in C.WIDE_CUTOFFS]
    return [Fold(f"{f:.2f}", e, e, min(n, e + size)) for f, e in ends
            if e >= 5000 and min(n, e + size) - e >= 1000]


def expanding_folds(n: int, k: int = 5) -> list[Fold]:
    """k contiguous test blocks of n // (k + 1) rows, each after all its training rows."""
    size = n // (k + 1)
    starts = [n - (k - i) * size for i in range(k)]
    return [Fold(str(i + 1), s, s, s + size) for i, s in enumerate(starts)]


def cutoff_folds(n: int) -> list[Fold]:
    cuts = [int(n * f) for f in C.PMS_CUTOFFS]
    return [Fold(str(i + 1), a, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if a > 5 and b > a]


def learning_folds(n: int, min_rows: int = 100) -> list[Fold]:
    """Growing prefixes of the first 90 %, each tested on the last 10 %."""
    base = int(n * C.TRAIN_RATIO) + int(n * C.VAL_RATIO)
    sizes = [(f, int(base * f)) for f in C.LEARNING_FRACTIONS]
    return [Fold(f"{f:.1f}", s, base, n) for f, s in sizes if s >= min_rows]


def fold_cuts(df: DataFrame, day: str, keys: Sequence[str],
              folds: Callable[[int], list[Fold]]) -> tuple[CutKeys, list[Fold]]:
    ends = lambda n: [p for f in folds(n) for p in (f.train_end, f.test_start, f.test_end)]
    cuts = CutKeys(df, day, keys, ends)
    return cuts, folds(cuts.n)


def fold_parts(df: DataFrame, cuts: CutKeys, fold: Fold) -> tuple[DataFrame, DataFrame]:
    return (df.filter(cuts.before(fold.train_end)),
            df.filter(cuts.within(fold.test_start, fold.test_end)))


def fold_summary(df: DataFrame, day: str, keys: Sequence[str],
                 folds: Callable[[int], list[Fold]], two_classes: bool = False) -> DataFrame:
    """Sizes, dates and target rates of all folds in one conditional aggregate."""
    cuts, found = fold_cuts(df, day, keys, folds)
    facts = []
    for f in found:
        train, test = cuts.before(f.train_end), cuts.within(f.test_start, f.test_end)
        rate = lambda part: F.avg(F.when(part, F.col(Y)))
        facts.append(F.struct(
            F.lit(f.name).alias("fold"), F.count_if(train).alias("n_train"),
            F.count_if(test).alias("n_test"), rate(train).alias("train_rate"),
            rate(test).alias("test_rate"), F.max(F.when(train, F.col(day))).alias("train_end"),
            F.min(F.when(test, F.col(day))).alias("test_start"),
            F.max(F.when(test, F.col(day))).alias("test_end")).alias(f"f{f.name}"))
    if not facts:
        raise ValueError(f"too few rows for any fold: {cuts.n}")
    names = [F.col(f"`f{f.name}`") for f in found]
    out = df.agg(*facts).select(F.inline(F.array(*names)))
    if two_classes:
        mixed = lambda c: (F.col(c) > 0) & (F.col(c) < 1)
        out = out.filter(mixed("train_rate") & mixed("test_rate"))
    return out


def split_ends(n: int, train_ratio: float, val_ratio: float) -> tuple[int, int]:
    train_end = int(n * train_ratio)
    return train_end, train_end + int(n * val_ratio)


def time_split(df: DataFrame, day: str, keys: Sequence[str], train_ratio: float = C.TRAIN_RATIO,
               val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """Add ``split``: train, then val, then test in order of arrival."""
    cuts = CutKeys(df, day, keys, lambda n: split_ends(n, train_ratio, val_ratio))
    train_end, val_end = split_ends(cuts.n, train_ratio, val_ratio)
    if train_end == 0 or val_end <= train_end or val_end >= cuts.n:
        raise ValueError(f"a split would be empty: n={cuts.n}, ends {train_end}, {val_end}")
    label = F.when(cuts.before(train_end), "train").when(cuts.before(val_end), "val")
    return df.withColumn("split", label.otherwise("test"))


def time_rows(df: DataFrame, day: str, keys: Sequence[str], split: str,
              train_ratio: float = C.TRAIN_RATIO, val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """The rows of one split of `time_split`, by a filter on the day that reaches the scan."""
    cuts = CutKeys(df, day, keys, lambda n: split_ends(n, train_ratio, val_ratio))
    train_end, val_end = split_ends(cuts.n, train_ratio, val_ratio)
    start, end = {"train": (0, train_end), "val": (train_end, val_end), "test": (val_end, cuts.n)}[split]
    return df.filter(cuts.within(start, end)).withColumn("split", F.lit(split))


def split_summary(df: DataFrame, day: str, n_features: int = len(C.FEATURES)) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"),
        F.max(day).alias("last_day"), F.avg(Y).alias("target_rate"),
        F.lit(n_features).cast("bigint").alias("n_features"))


def time_buckets(df: DataFrame, day: str, keys: Sequence[str], k: int, name: str = "bucket"
                 ) -> DataFrame:
    """Add the 1-based number of one of k near-equal contiguous time buckets."""
    cuts = CutKeys(df, day, keys, lambda n: bucket_starts(n, k))
    return df.withColumn(name, cuts.label(bucket_starts(cuts.n, k)))


def head_by_order(df: DataFrame, day: str, keys: Sequence[str], n: int) -> DataFrame:
    """First n rows of an order as a filter, for n too large for a top-n heap."""
    return df.filter(CutKeys(df, day, keys, lambda _: [n]).before(n))


def subtrain_val(df: DataFrame, day: str, keys: Sequence[str], share: float = 0.20) -> DataFrame:
    """Mark the last part of train + val as the window for choosing thresholds."""
    base = lambda n: sum(int(n * r) for r in (C.TRAIN_RATIO, C.VAL_RATIO))
    start = lambda n: base(n) - int(base(n) * share)
    cuts = CutKeys(df, day, keys, lambda n: [start(n), base(n)])
    part = F.when(cuts.before(start(cuts.n)), "subtrain").when(
        cuts.before(base(cuts.n)), "subval").otherwise("test")
    return df.withColumn("part", part)


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random order key: a digest of the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def digest_share(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


#: Rows of a slice of a shuffled order that are ordered to find a cut in it.
SLICE_ROWS = 100_000


def _any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _finer(wanted: dict[tuple[str, str], list[int]], counts: Sequence[tuple[str, str, int]]
           ) -> tuple[dict[tuple[str, str], list[int]], int]:
    """The finer slices that hold the wanted places, with the places inside them, and the largest size.

    ``counts`` has (class, slice, rows) in order; each slice lies inside a wanted one.
    """
    found: dict[tuple[str, str], list[int]] = {}
    largest, seen, last = 0, 0, None
    for c, s, n in counts:
        outer = (c, s[:-3])
        seen = seen if outer == last else 0
        last = outer
        spots = [i - seen for i in wanted.get(outer, []) if seen <= i < seen + n]
        if spots:
            found[(c, s)], largest = spots, max(largest, n)
        seen += n
    return found, largest


def stratified_folds(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42,
                     label: str = Y) -> DataFrame:
    """k folds with the class ratio of the whole, in seeded random order.

    Each class is cut into k near-equal runs of its shuffled order. The cuts come from counts per
    slice, which are the first digits of a digest whose values are uniform whatever the keys are. A
    slice that holds a cut and more than ``SLICE_ROWS`` rows is sliced again, so the rows that are
    ordered to find the cuts stay few at any size of input.
    """
    df = df.withColumns({"_digest": shuffle_key(keys, seed), "_class": F.col(label).cast("string")})
    wanted: dict[tuple[str, str], list[int]] = {}
    digits, inside, largest = 0, df.select("_class", "_digest"), None
    while largest is None or (largest > SLICE_ROWS and digits < 30):
        digits += 3
        counts = inside.groupBy("_class", F.substring("_digest", 1, digits).alias("s")).agg(
            F.count(F.lit(1)).alias("n")).orderBy("_class", "s").collect()
        if digits == 3:
            sizes: dict[str, int] = {}
            for r in counts:
                sizes[r["_class"]] = sizes.get(r["_class"], 0) + r["n"]
            wanted = {(c, ""): bucket_starts(n, k)[1:] for c, n in sizes.items()}
        wanted, largest = _finer(wanted, [tuple(r) for r in counts])
        inside = df.select("_class", "_digest").filter(_any_of([
            (F.col("_class") == c) & F.startswith("_digest", F.lit(s)) for c, s in wanted]))
    w = Window.partitionBy("_class", "_slice").orderBy("_digest")
    ranked = inside.withColumn("_slice", F.substring("_digest", 1, digits)).withColumn(
        "_i", F.row_number().over(w) - 1)
    cuts: dict[str, list[str]] = {}
    for r in ranked.filter(_any_of([
            (F.col("_class") == c) & (F.col("_slice") == s) & F.col("_i").isin(spots)
            for (c, s), spots in wanted.items()])).select("_class", "_digest").collect():
        cuts.setdefault(r["_class"], []).append(r["_digest"])
    fold = F.lit(1)
    for c, digests in cuts.items():
        for d in digests:
            fold = fold + ((F.col("_class") == c) & (F.col("_digest") >= d)).cast("int")
    return df.withColumn("fold", fold.cast("bigint")).drop("_digest", "_class")


def random_subset(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Reproducible sample without replacement: the same rows whatever the partitioning."""
    return df.filter(digest_share(shuffle_key(keys, seed)) < fraction)


def date_split(df: DataFrame, day: str, split_date) -> DataFrame:
    return df.withColumn(
        "split", F.when(F.col(day) >= F.lit(split_date).cast("date"), "test").otherwise("train"))


def month_batches(df: DataFrame, month: str = "arrival_date_month",
                  names: dict[str, str] | None = None) -> DataFrame:
    """Label the baseline month and later batches; other months are left out."""
    names = names or {"June": "baseline", "July": "batch_1", "August": "batch_2"}
    out = F
    for m, label in names.items():
        out = out.when(F.col(month) == m, label)
    return df.withColumn("batch", out).filter(F.col("batch").isNotNull())
