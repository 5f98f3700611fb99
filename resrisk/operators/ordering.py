"""Exact positions, running totals and cut points along a global order.

A window without PARTITION BY would pull the table into one task.  Here an order is split
into *levels*: coarse buckets that never decrease along the order.  Running totals are then
the sum of (a) a window inside each leaf bucket and (b) offsets computed from the per-bucket
totals, which are few.  Buckets are pure functions of the row, so recomputed tasks agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

SLICES = 65_536
SLICES_PER_DAY = 8_192
LAST_DAY = dt.date(9999, 12, 31)


def slice_of(unit: Column, slices: int = SLICES) -> Column:
    """Slice number of a value in [0, 1]; a window over all slices stays small."""
    return F.least(F.floor(unit * slices), F.lit(slices - 1)).cast("int")


def span_of(df: DataFrame, value: str) -> tuple[float, float]:
    row = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")
                 ).first()
    return row["lo"] or 0.0, row["hi"] or 0.0


def span_slice(value: Column, span: tuple[float, float], slices: int = SLICES) -> Column:
    """Slice of any numeric value, scaled by the range the column has."""
    lo, hi = span
    unit = (value.cast("double") - lo) / ((hi - lo) or 1.0)
    return slice_of(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)), slices)


def day_levels(day: str, key: str, span: tuple[float, float]) -> list[Column]:
    """Calendar day, then slices of the key, so that one hot day spreads over many tasks."""
    return [_day(day), span_slice(F.col(key), span, SLICES_PER_DAY)]


def _day(day: str) -> Column:
    return F.coalesce(F.col(day), F.lit(LAST_DAY))


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    levels: Sequence[Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals along ``order`` (which must be unique within ``by``)."""
    return _running(df, order, sums, levels, by, F.sum,
                    lambda parts: reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), parts))


def running_max(
    df: DataFrame,
    order: Sequence[Column],
    values: dict[str, Column],
    levels: Sequence[Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running maxima along ``order``."""
    return _running(df, order, values, levels, by, F.max,
                    lambda parts: F.greatest(*parts) if len(parts) > 1 else parts[0])


def _running(df, order, values, levels, by, agg, combine) -> DataFrame:
    by = list(by)
    names = [f"_lv{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(names, levels)))
    keys = by + names
    leaf = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = base.withColumns({f"_in_{n}": agg(c).over(leaf) for n, c in values.items()})

    totals = base.groupBy(*keys).agg(*[agg(c).alias(n) for n, c in values.items()])
    offsets = None
    for depth in range(len(names), 0, -1):
        parent, here = by + names[: depth - 1], by + names[:depth]
        level = totals if depth == len(names) else totals.groupBy(*here).agg(
            *[agg(n).alias(n) for n in values])
        before = (
            Window.partitionBy(*parent)
            .orderBy(names[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        part = level.select(*here, *[agg(n).over(before).alias(f"_off{depth}_{n}")
                                     for n in values])
        offsets = part if offsets is None else offsets.join(part, here)
    depths = range(1, len(names) + 1)
    return inner.join(offsets, keys).select(
        *df.columns,
        *[combine([F.col(f"_in_{n}"), *[F.col(f"_off{d}_{n}") for d in depths]]).alias(n)
          for n in values],
    )


#: A slice of a value's range holds about SLICE_VALUES distinct values until there are EVEN_SLICES,
#: then up to LARGE_SLICE until there are MOST_SLICES.
SLICE_VALUES, EVEN_SLICES, LARGE_SLICE, MOST_SLICES = 180, 128, 100_000, 1024


def with_value_levels(counts: DataFrame, value: str, by: Sequence[str], **totals: Column
                      ) -> DataFrame:
    """Add ``_slice``, the slice of a value among those of its group, and group totals.

    Slices lie between approximate quantiles of the rows of ``counts``, so that outliers do not
    crowd the rest into one slice. Their number follows the number of rows, which are written once:
    the edges, the totals and the result all read them. Without groups the facts are a scalar and
    need no join.
    """
    by = list(by)
    counts = written_table(counts, "value-levels")
    # A power of two, so that a row finds its slice by halving.
    n = counts.count()
    # Two at least: a slice that is a literal would leave later joins on it without a key.
    wanted = max(n // LARGE_SLICE, min(EVEN_SLICES, n // SLICE_VALUES), 2)
    halvings = (min(MOST_SLICES, wanted) - 1).bit_length()
    slices = 1 << halvings
    cuts = [i / slices for i in range(1, slices)]
    facts = F.struct(
        F.percentile_approx(F.col(value).cast("double"), cuts, 20 * slices).alias("edges"),
        *[c.alias(n) for n, c in totals.items()])
    if by:
        # A null-safe join, as a group may be null.
        of = counts.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(facts.alias("_facts"))
        known = counts.join(of, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(
            *[f"_by_{c}" for c in by])
    else:
        known = counts.withColumn("_facts", counts.agg(facts).scalar())
    edges, place = F.col("_facts.edges"), F.col("_slice")
    known = known.withColumn("_slice", F.lit(0))
    for step in (1 << i for i in reversed(range(halvings))):
        reached = edges[place + (step - 1)] <= F.col(value).cast("double")
        known = known.withColumn("_slice", F.when(reached, place + step).otherwise(place))
    return known.withColumns({n: F.col(f"_facts.{n}") for n in totals}).drop("_facts")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) as rows (by, prob, value).

    With ``weight`` each row stands for that many equal ones.

    The built-in exact percentile keeps all distinct values of a group in one task.  Here distinct
    values are counted, ordered slice by slice, and only those at the wanted ranks are kept.
    """
    keys = list(by)
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    )
    placed = with_value_levels(counts, "v", keys, _total=F.sum("n"))
    ranked = running_sums(placed, [F.asc("v")], {"_cum": F.col("n")}, [F.col("_slice")], keys)
    rank = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.floor(rank(p)).alias("low"),
                 (rank(p) - F.floor(rank(p))).alias("part")) for p in probs
    ])
    holds = lambda r: (r >= F.col("_cum") - F.col("n")) & (r < F.col("_cum"))
    hits = ranked.select(*keys, "v", "n", "_cum", F.inline(wanted)).select(
        *keys, "prob", "part",
        F.when(holds(F.col("low")), F.col("v")).alias("a"),
        F.when(holds(F.col("low") + 1), F.col("v")).alias("b"),
    ).filter("a IS NOT NULL OR b IS NOT NULL")
    low, high = F.max("a"), F.coalesce(F.max("b"), F.max("a"))
    return hits.groupBy(*keys, "prob").agg(
        (low + F.max("part") * (high - low)).alias("value")
    ).select(*by, "prob", "value")


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
                     ) -> DataFrame:
    """Exact quantiles as one row per group with a column per quantile."""
    rows = exact_quantiles(df, value, list(probs.values()), by)
    return rows.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for n, p in probs.items()
    ])


def global_position(
    df: DataFrame, day: str, keys: Sequence[str], by: Sequence[str] = (), name: str = "position",
    span: tuple[float, float] | None = None,
) -> DataFrame:
    """0-based row position by (day, keys); rows without a day come last."""
    order = [_day(day), *[F.col(k) for k in keys]]
    levels = day_levels(day, keys[0], span or span_of(df, keys[0]))
    out = running_sums(df, order, {name: F.lit(1)}, levels, by)
    return out.withColumn(name, F.col(name) - 1)


def bucket_of(position: Column, n: Column | int, k: int) -> Column:
    """1-based index of k near-equal contiguous buckets; the first n % k get one extra row."""
    n = F.lit(n) if isinstance(n, int) else n
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1)) + 1).otherwise(
        extra + F.floor((position - edge) / F.greatest(size, F.lit(1))) + 1
    ).cast("bigint")


def bucket_starts(n: int, k: int) -> list[int]:
    size, extra = divmod(n, k)
    return [i * size + min(i, extra) for i in range(k)]


class CutKeys:
    """Order keys found at chosen positions; turns position tests into plain row filters.

    Splits and folds need a handful of cut points, not a position per row.  Counts per day
    (bounded by the calendar) say on which day a cut falls; only those days are ordered.
    The driver keeps one key per cut.
    """

    def __init__(self, df: DataFrame, day: str, keys: Sequence[str],
                 positions: Callable[[int], Sequence[int]]):
        self.day, self.keys = day, list(keys)
        self.types = [f.dataType for f in df.select(day, *keys).schema.fields]
        per_day = (
            df.groupBy(_day(day).alias("d")).agg(
                F.count(F.lit(1)).alias("n"), F.min(keys[0]).cast("double").alias("lo"),
                F.max(keys[0]).cast("double").alias("hi")).collect()
        )
        per_day.sort(key=lambda r: r["d"])
        self.n = sum(r["n"] for r in per_day)
        self.all_have_days = not any(r["d"] == LAST_DAY for r in per_day)
        wanted = sorted({p for p in positions(self.n) if 0 <= p < self.n})
        targets, start, i = {}, 0, 0
        for row in per_day:
            while i < len(wanted) and wanted[i] < start + row["n"]:
                targets[wanted[i]] = (row["d"], wanted[i] - start)
                i += 1
            start += row["n"]
        self.at: dict[int, tuple] = {}
        if not targets:
            return
        days = sorted({d for d, _ in targets.values()})
        slim = df.select(_day(day).alias(day), *keys).filter(F.col(day).isin(days))
        span = min(r["lo"] for r in per_day), max(r["hi"] for r in per_day)
        order = [F.col(k) for k in keys]
        levels = [span_slice(F.col(keys[0]), span, SLICES_PER_DAY)]
        ranked = running_sums(slim, order, {"position": F.lit(1)}, levels, by=[day])
        ranked = ranked.withColumn("position", F.col("position") - 1)
        hit = reduce(
            lambda a, b: a | b,
            [(F.col(day) == d) & (F.col("position") == off) for d, off in targets.values()],
        )
        found = {(r[day], r["position"]): tuple(r[k] for k in keys)
                 for r in ranked.filter(hit).collect()}
        self.at = {p: (d, *found[(d, off)]) for p, (d, off) in targets.items()}

    def _cut(self, position: int) -> tuple[dt.date, Column]:
        """Day of the row at a position, and whether a row of that day comes before it."""
        day, *keys = self.at[position]
        cut = [F.lit(v).cast(t).alias(c) for v, t, c in zip(keys, self.types[1:], self.keys)]
        return day, F.struct(*self.keys) < F.struct(*cut)

    def before(self, position: int) -> Column:
        """True for the first ``position`` rows; false, or null without a day, for the others.

        The comparison of the day stands alone beside the rest, so it reaches the scan.
        """
        if position <= 0:
            return F.lit(False)
        if position >= self.n:
            return F.lit(True)
        last, earlier = self._cut(position)
        day = F.col(self.day)
        if last == LAST_DAY:
            return day.isNotNull() | earlier
        return (day <= last) & ((day < last) | earlier)

    def after(self, position: int) -> Column:
        """True for the rows from ``position`` on, those without a day included."""
        if position <= 0:
            return F.lit(True)
        if position >= self.n:
            return F.lit(False)
        first, earlier = self._cut(position)
        day = F.col(self.day)
        if first == LAST_DAY:
            return day.isNull() & ~earlier
        if self.all_have_days:
            return (day >= first) & ((day > first) | ~earlier)
        return (day.isNull() | (day >= first)) & (day.isNull() | (day > first) | ~earlier)

    def within(self, start: int, end: int) -> Column:
        return self.after(start) & self.before(end)

    def label(self, starts: Sequence[int]) -> Column:
        """1-based number of the contiguous bucket, given ascending bucket starts."""
        return reduce(
            lambda acc, s: acc + self.after(s).cast("int"), starts[1:], F.lit(1)
        ).cast("bigint")


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows by an explicit key (a top-n heap per task, no global sort)."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def unpivot(df: DataFrame, dims: Sequence[str], keep: Sequence[Column | str] = (),
            names: tuple[str, str] = ("dimension", "segment"), cast: str = "string") -> DataFrame:
    """Long form of several columns in one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(d).alias(names[0]), F.col(d).cast(cast).alias(names[1])) for d in dims
    ])
    return df.select(*keep, F.inline(pairs))


def top_categories(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Most frequent values of each dimension; ties go to the smaller value."""
    long = unpivot(df, list(dims)).fillna({"segment": "UNKNOWN"})
    return most_frequent(long.groupBy("dimension", "segment").agg(F.count(F.lit(1)).alias("n_rows")), dims)


def most_frequent(counts: DataFrame, dims: dict[str, int]) -> DataFrame:
    """`top_categories` of rows already counted as ``n_rows``."""
    w = Window.partitionBy("dimension").orderBy(F.desc("n_rows"), "segment")
    limit = F.create_map(*[F.lit(x) for d, n in dims.items() for x in (d, n)])
    return (
        counts.withColumn("rank", F.row_number().over(w).cast("bigint"))
        # The literal lets Spark cut each task's rows before the window.
        .filter(F.col("rank") <= max(dims.values()))
        .filter(F.col("rank") <= limit[F.col("dimension")])
    )


def argmax_per_group(df: DataFrame, group: str, metric: str, winner: str) -> DataFrame:
    """Winner per group; ties go to the smaller name (a partial aggregate, no window)."""
    best = F.min_by(F.struct(winner, metric), F.struct(-F.col(metric), F.col(winner)))
    return (
        df.groupBy(group).agg(best.alias("b"))
        .select(group, F.col(f"b.{winner}").alias("winner"), F.col(f"b.{metric}").alias(metric))
    )


def win_counts(df: DataFrame, winners: DataFrame, winner: str) -> DataFrame:
    wins = winners.groupBy(F.col("winner").alias(winner)).agg(F.count(F.lit(1)).alias("wins"))
    return df.select(winner).distinct().join(wins, winner, "left").fillna({"wins": 0})


def domain_rank(col: str, domain: Sequence[str]) -> Column:
    """1-based place of a value in a fixed order; 0 when it is not part of it."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(col))


def rank_table(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank 1..n of a summary table of a fixed number of rows: the window is one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
