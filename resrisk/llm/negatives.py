"""Hard negatives by exact scores, bounded along spanning trees of the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

#: Rows of a block of candidates, at most, and of anchors, about.
_CANDIDATES, _ANCHORS = 1024, 512
#: Whole numbers up to here are exact as 32-bit and as 64-bit floats.
_EXACT32, _EXACT64 = float(1 << 24), float(1 << 53)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shortest spanning tree from the first row on: order, place of each one's parent in that
    order (-1 for the first) and the length of the edge to it, never too short."""
    n = len(vectors)
    square = (vectors * vectors).sum(1)
    best, near = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    order, parent = np.zeros(n, np.int64), np.full(n, -1)
    place = np.zeros(n, np.int64)
    now = 0
    for i in range(n):
        order[i], place[now] = now, i
        parent[i] = place[near[now]] if i else -1
        left[now] = False
        reach = np.maximum(square + square[now] - 2 * (vectors @ vectors[now]), 0.0)
        closer = left & (reach < best)
        best[closer], near[closer] = reach[closer], now
        now = int(np.argmin(np.where(left, best, np.inf)))
    rows = vectors[order]
    edge = np.sqrt(((rows - rows[np.maximum(parent, 0)]) ** 2).sum(1)) * (1 + 1e-12)
    return order, parent, edge


def _floats(values: np.ndarray) -> bytes:
    """As 32-bit floats where these are exact."""
    narrow = not len(values) or np.abs(values).max() < _EXACT32
    return values.astype(np.float32 if narrow else np.float64).tobytes()


def _unfloats(blob: bytes, rows: int, size: int) -> np.ndarray:
    kind = np.float32 if len(blob) == 4 * rows * size else np.float64
    return np.frombuffer(blob, kind).reshape(rows, size).astype(np.float64)


class _Best:
    """For each of some rows the first `most` (score, id): higher scores first, then smaller ids."""

    def __init__(self, rows: int, most: int) -> None:
        self.most = most
        self.scores = [np.zeros(0)] * rows
        self.ids = [np.zeros(0, np.int64)] * rows

    def least(self, row: int) -> float:
        """Scores below it have no place."""
        return self.scores[row][-1] if len(self.scores[row]) == self.most else -np.inf

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores[row], scores]), np.concatenate([self.ids[row], ids])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        once = np.concatenate([[True], (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])])
        self.scores[row], self.ids[row] = scores[once][:self.most], ids[once][:self.most]


class _Anchors:
    """A block of anchors in the order of its spanning tree, with what has been found for them."""

    def __init__(self, block: dict, size: int, most: int, window: tuple[int, int] | None) -> None:
        self.ids, self.labels = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels"))
        self.vectors = _unfloats(block["vectors"], len(self.ids), size)
        self.norms = np.sqrt((self.vectors ** 2).sum(1))
        self.parent = np.frombuffer(block["parent"], np.int64)
        self.edge = np.frombuffer(block["edge"], np.float64)
        self.positive_ids, self.positive_scores = block["positive_ids"] or [], block["positive_scores"] or []
        # The targets of an anchor: itself for the positives, else one per positive with its window.
        self.targets: list[list[int]] = []
        self.low, self.high = [], []
        for scores in self.positive_scores if window else [[None]] * len(self.ids):
            self.targets.append(list(range(len(self.low), len(self.low) + len(scores))))
            # Whole-number bounds of low * p <= 100 * score <= high * p.
            self.low += [-np.inf if p is None else float(-(-window[0] * p // 100)) for p in scores]
            self.high += [np.inf if p is None else float(window[1] * p // 100) for p in scores]
        self.same_label = window is None
        self.found = _Best(len(self.low), most)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
        """Score a block of candidates where the bounds ask for it; the number of scores taken.

        A candidate's score at an anchor differs from that at the parent by no more than the edge
        times the candidate's norm. Where that range misses what the anchor still looks for, the
        range goes on to the children in place of a score.
        """
        norms = np.sqrt((vectors ** 2).sum(1)) * (1 + 1e-12)
        low, high = (np.zeros((len(self.ids), len(ids))) for _ in range(2))
        taken = 0
        for a in range(len(self.ids)):
            eligible = (labels == self.labels[a]) == self.same_label
            eligible &= ids != self.ids[a]
            if self.parent[a] < 0:
                low[a], high[a], ask = -np.inf, np.inf, np.ones(len(ids), bool)
            else:
                reach = self.edge[a] * norms
                slack = 1e-9 * (1 + self.norms[a] * norms)
                low[a], high[a] = low[self.parent[a]] - reach - slack, high[self.parent[a]] + reach + slack
                floor = min((max(self.low[t], self.found.least(t)) for t in self.targets[a]), default=np.inf)
                ceiling = max((self.high[t] for t in self.targets[a]), default=-np.inf)
                ask = eligible & (high[a] >= floor) & (low[a] <= ceiling)
            at = np.flatnonzero(ask)
            if not len(at):
                continue
            score = self._scores(vectors[at], norms[at], a)
            taken += len(at)
            low[a, at] = high[a, at] = score
            mine = eligible[at]
            score, own = score[mine], ids[at][mine]
            for t in self.targets[a]:
                good = (score >= max(self.low[t], self.found.least(t))) & (score <= self.high[t])
                if good.any():
                    self.found.add(t, score[good], own[good])
        return taken

    def _scores(self, vectors: np.ndarray, norms: np.ndarray, a: int) -> np.ndarray:
        scores = vectors @ self.vectors[a]
        # Beyond 53 bits a product of floats may be rounded.
        for i in np.flatnonzero(norms * self.norms[a] >= _EXACT64):
            scores[i] = float(sum(int(x) * int(y) for x, y in zip(vectors[i], self.vectors[a])))
        return scores

    def rows(self) -> Iterator[tuple]:
        """(anchor_id, positive_id, positive_score, id, score) of all that was found."""
        for a, targets in enumerate(self.targets):
            for j, t in enumerate(targets):
                known = (None, None) if self.same_label else (self.positive_ids[a][j], self.positive_scores[a][j])
                for score, i in zip(self.found.scores[t], self.found.ids[t]):
                    yield int(self.ids[a]), *known, int(i), int(max(min(score, 2.0 ** 62), -2.0 ** 62))


_BLOCK = "ids binary, labels binary, vectors binary"
_TREE = (f"ablock bigint, {_BLOCK}, parent binary, edge binary, positive_ids array<array<bigint>>, "
         "positive_scores array<array<bigint>>")
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
_NAMES = ["anchor_id", "positive_id", "positive_score", "id", "score"]


def _columns(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), vectors


def _candidate_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed where they lie: (cblock, ids, labels, vectors), at most `_CANDIDATES` a block."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, _CANDIDATES):
                ids, labels, vectors = _columns(batch.slice(at, _CANDIDATES), size)
                yield pa.record_batch([
                    pa.array([n], pa.int64()),
                    *[pa.array([x], pa.binary()) for x in (ids.tobytes(), labels.tobytes(), _floats(vectors))]],
                    names=["cblock", "ids", "labels", "vectors"])
                n += 1

    return rows.select("id", "label", "v").mapInArrow(pack, f"cblock bigint, {_BLOCK}")


def _anchor_blocks(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors dealt into blocks of near ones, each with a spanning tree.

    Anchors on the same sides of sixteen fixed planes come together: cells follow each other in
    order of their number, and a crowded one is cut by hash of the id.
    """
    planes = np.random.default_rng(size).normal(size=(size, 16))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cell = ((vectors @ planes > 0) * (1 << np.arange(16))).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        part = rows.select(["id", "label", "v"]).combine_chunks().to_batches()[0]
        ids, labels, vectors = _columns(part, size)
        order, parent, edge = spanning_tree(vectors)
        lists = pa.list_(pa.list_(pa.int64()))
        return pa.table({
            "ablock": rows["ablock"].slice(0, 1),
            **{name: pa.array([x], pa.binary()) for name, x in (
                ("ids", ids[order].tobytes()), ("labels", labels[order].tobytes()), ("vectors", _floats(vectors[order])),
                ("parent", parent.tobytes()), ("edge", edge.tobytes()))},
            **{c: pa.array([rows[c].take(pa.array(order)).to_pylist()], lists) for c in ("positive_ids", "positive_scores")}})

    kinds = "id bigint, label bigint, v array<double>, positive_ids array<bigint>, positive_scores array<bigint>"
    told = written_table(anchors.mapInArrow(near, kinds + ", cell bigint"), "llm-negatives-cells")
    # At most 65,536 cells.
    cells = told.groupBy("cell").agg(F.count(F.lit(1)).alias("own"))
    cells = cells.withColumn("before", F.sum("own").over(Window.orderBy("cell")) - F.col("own"))
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("own"))
    dealt = told.join(F.broadcast(cells), "cell").withColumn("ablock", F.floor(place / _ANCHORS)).drop("cell", "own", "before")
    return written_table(dealt.groupBy("ablock").applyInArrow(pack, _TREE), "llm-negatives-anchors")


def _found(candidates: DataFrame, anchors: DataFrame, size: int, most: int, window: tuple[int, int] | None,
           blocks: int, groups: int, label: str) -> DataFrame:
    """What tasks find for the anchors: each block of anchors meets each block of candidates.

    One group of candidates: the anchors' blocks are few, and sent to all tasks. Else blocks of
    anchors and of candidates meet by (block, group) in a shuffled join, in order, so that a task
    holds the results of one block of anchors at a time.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    mine = candidates.select(*[F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "vectors")],
                             F.pmod(F.xxhash64("cblock"), F.lit(groups)).alias("group"), every(blocks).alias("ablock"))
    if groups == 1:
        pairs = mine.drop("group").join(F.broadcast(anchors), "ablock")
    else:
        pairs = mine.join(anchors.withColumn("group", every(groups)), ["ablock", "group"]).sortWithinPartitions("ablock", "group")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Anchors] = {}

        def send(blocks: list[_Anchors]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                columns = list(zip(*block.rows()))
                if columns:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                number = row.column("ablock")[0].as_py()
                if number not in held:
                    if len(held) >= most_held:
                        yield from send(list(held.values()))
                        held = {}
                    names = ["ids", "labels", "vectors", "parent", "edge", "positive_ids", "positive_scores"]
                    held[number] = _Anchors({c: row.column(c)[0].as_py() for c in names}, size, most, window)
                ids, labels = (np.frombuffer(row.column(c)[0].as_buffer(), np.int64) for c in ("c_ids", "c_labels"))
                held[number].meet(ids, labels, _unfloats(row.column("c_vectors")[0].as_py(), len(ids), size))
        yield from send(list(held.values()))

    most_held = blocks if groups == 1 else 1
    return written_table(pairs.mapInArrow(meet, _FOUND), label)


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first `most` of each group, with their rank; equal ids with equal scores count once."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                   scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
                   broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become whole numbers floor(scale * component); a score is the inner product of two
    rows, higher ones come first, ties by smaller key. Rows for which `anchor` holds are anchors.
    An anchor's positives are its first `positives` other rows of the same label. For each, the
    first `negatives` rows of another label are returned whose score is within `window` per cent of
    the positive's.

    Anchors are dealt into blocks of near ones, and each block gets a spanning tree. At the root
    all candidates are scored. At a child a score lies within that of its parent plus or minus the
    edge times the candidate's norm; only candidates whose range overlaps what the child still
    looks for are scored anew: at least the fifth best so far for positives, a positive's window
    above its tenth best so far for negatives. So the result is exact, and the trees save work
    where anchors lie close to each other; anchors far apart are scored against every row. Anchors
    are a query set: their blocks are sent to all tasks up to `broadcast_bytes`, else blocks of
    both kinds meet in a shuffled join. Each task gives a few rows for an anchor.

    Rows without key, label (a whole number) or vector, or with a null or non-finite component,
    take no part, nor do those whose length is not the commonest (the longer of two equally common).
    Rows of one key with equal scores count once; a row is no candidate of the anchor with its key.
    If rows share an anchor's key, the smallest (label, vector) is the anchor. Scores are exact
    up to 53 bits, then rounded, and end at 62 bits. Extra columns are left out, whatever their
    names. Without anchors or partners the result is empty.
    """
    scaled = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double") * scale)
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("v") > 0)
    rows = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
                       scaled.alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    empty = rows.sparkSession.createDataFrame([], result)
    if common is None:
        return empty
    size = common["size"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floored = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * size, size, dtype=np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(floored)),
                                   batch.column(3)], names=["id", "label", "v", "is_anchor"])

    rows = rows.filter(F.size("v") == size).mapInArrow(whole, "id bigint, label bigint, v array<double>, is_anchor boolean")
    anchors = rows.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    anchors = written_table(anchors, "llm-negatives-queries")
    n_anchors = anchors.count()
    if not n_anchors:
        return empty
    candidates = _candidate_blocks(rows, size)
    few = n_anchors * (8 * size + 64) <= broadcast_bytes
    groups = 1 if few else 1 + common["n"] // (64 * _CANDIDATES)
    none = F.lit(None).cast("array<bigint>")

    def search(queries: DataFrame, most: int, within: tuple[int, int] | None, name: str) -> DataFrame:
        blocks = _anchor_blocks(queries, size)
        return _found(candidates, blocks, size, most, within, -(-n_anchors // _ANCHORS), groups, f"llm-negatives-{name}")

    own = anchors.select("id", "label", "v", none.alias("positive_ids"), none.alias("positive_scores"))
    best = _first(search(own, positives, None, "positives"), ["anchor_id"], positives)
    best = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asked = anchors.join(best, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "v", F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    asked = written_table(asked, "llm-negatives-asked")
    if asked.isEmpty():
        return empty
    found = search(asked, negatives, window, "found")
    return _first(found, ["anchor_id", "positive_id", "positive_score"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
