"""Near duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written_table
from .graph import components
from .names import shielded

_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Hasher:
    """Hashes of words and shingles of one text, as arrays."""

    def __init__(self) -> None:
        self.letters = np.random.default_rng(515).integers(0, 2**64, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if n + 1 > len(self.up):
            size = max(2 * n, 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self.space[text]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[text] * self.up[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def bag(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, sorted, and how often each occurs; fewer words make one shingle."""
        w = self.words(text)
        if not len(w):
            return w, np.zeros(0, np.int64)
        k = min(size, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = (h + w[i:len(w) - k + 1 + i]) * _M1
            h ^= h >> np.uint64(32)
        return np.unique(_mix(h + np.uint64(k)), return_counts=True)


def signatures(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (docs x slots) of weighted sets given as rows (shingle, weight, doc).

    Each shingle has a Poisson process in time and weight: its points below the weight count. The
    weight axis is cut into rings [0, 1), [1, 2), [2, 4), [4, 8) ..., each a process of its own
    with a rate of its width, so a weight w needs about log2(w) processes, and the outermost is
    thinned to the part below w. A point falls into a slot by hash; a slot keeps its earliest
    time. Two slots agree with the probability of the weighted Jaccard similarity. Points come in
    order of time, and a process ends once it is later than all slots of its document.
    """
    rings = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(shingle)), rings)
    ring = np.arange(len(row)) - np.repeat(np.cumsum(rings) - rings, rings)
    low = np.where(ring > 0, 2.0 ** (ring - 1), 0.0)
    width = np.where(ring > 0, low, 1.0)
    seed = _mix(shingle[row] + ring.astype(np.uint64) * _GOLDEN)
    limit, base = weight[row].astype(np.float64), doc[row] * slots
    time = np.zeros(len(row))
    out = np.full(docs * slots, np.inf)
    step = 0
    while len(seed):
        step += 1
        r = _mix(seed + np.uint64(step * int(_M2) % (1 << 64)))
        s = _mix(r ^ _GOLDEN)
        time -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width
        slot = ((s >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        below = low + width * ((s & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32)) < limit
        np.minimum.at(out, (base + slot)[below], time[below])
        on = time < np.repeat(out.reshape(docs, slots).max(axis=1), slots)[base]
        seed, time, low, width, limit, base = (x[on] for x in (seed, time, low, width, limit, base))
    return out.reshape(docs, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def _dump(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    return bag[0].tobytes() + bag[1].astype(np.uint32).tobytes()


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64)


def _bags(texts: pa.Array, size: int, hasher: _Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t in pc.utf8_lower(texts.cast(pa.string())):
        b = t.as_buffer() if t.is_valid else None
        yield hasher.bag(np.frombuffer(b, np.uint8) if b is not None and b.size else np.zeros(0, np.uint8), size)


def _marks(bag: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """128 bits that tell bags apart."""
    x = bag[0] + bag[1].astype(np.uint64) * _GOLDEN
    return tuple(int(_mix(x ^ k).sum(dtype=np.uint64).astype(np.int64)) for k in (_M1, _M2))


#: Shingles that a task signs at once: a dozen arrays of that length are at work.
_UNITS = 200_000


def _signed(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Key, two marks of the bag, the band hashes and 16 bits of each slot of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        number = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                got, units, begin = [], 0, at
                # A block ends by its shingles too, so long texts do not gather.
                for bag in _bags(batch.column(1).slice(at, 1024), size, hasher):
                    got.append(bag)
                    units += len(bag[0])
                    at += 1
                    if units > _UNITS:
                        break
                n = len(got)
                doc = np.repeat(np.arange(n), [len(b[0]) for b in got])
                sig = signatures(np.concatenate([b[0] for b in got]), np.concatenate([b[1] for b in got]), doc, n, bands * rows)
                bits = _mix(sig.view(np.uint64)).reshape(n, bands, rows)
                low = (bits & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, -1)
                h = np.zeros((n, bands), np.uint64) + number
                for i in range(rows):
                    h = _mix(h + bits[:, :, i])
                marks = np.array([_marks(b) for b in got], np.int64).reshape(n, 2)
                offsets = np.arange(0, (n + 1) * bands, bands, dtype=np.int32)
                yield pa.record_batch([
                    batch.column(0).slice(begin, n), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                    pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary())],
                    names=[key, "_k1", "_k2", "_bands", "_slots"])

    return docs.select(key, text).mapInArrow(
        sign, f"`{key}` {kind}, _k1 bigint, _k2 bigint, _bands array<bigint>, _slots binary")


def _with_marks(docs: DataFrame, text: str, size: int) -> DataFrame:
    """`docs` with the two marks of each text's bag."""
    @F.arrow_udf("_k1 bigint, _k2 bigint")
    def marks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _Hasher()
        for part in texts:
            found = np.array([_marks(b) for b in _bags(part, size, hasher)], np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["_k1", "_k2"])

    return docs.withColumn("_both", marks(F.col(text))).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_both._k1", "_both._k2")


#: Documents that a task remembers to have passed on.
_SEEN = 100_000


def _bag_table(wanted: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(cid, bag) of the wanted classes, from the text of each class's first document.

    Documents are found by key and marks, so different texts of one key do not meet. A task passes
    on a document that repeats key and bag once (as long as it remembers it).
    """
    kind = docs.schema[key].dataType.simpleString()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = _Hasher(), {}
        for batch in batches:
            marks = np.array([_marks(b) for b in _bags(batch.column(1), size, hasher)], np.int64).reshape(-1, 2)
            fresh = []
            for who in zip(batch.column(0).to_pylist(), *marks.T.tolist()):
                fresh.append(who not in seen)
                seen[who] = None
                if len(seen) > _SEEN:
                    seen.pop(next(iter(seen)))
            yield pa.record_batch(
                [batch.column(0), pa.array(marks[:, 0]), pa.array(marks[:, 1]), batch.column(1)],
                names=["_key", "_k1", "_k2", "_text"]).filter(pa.array(fresh, pa.bool_()))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array(
                    [_dump(b) for b in _bags(part.column(1), size, hasher)], pa.binary())], names=["cid", "bag"])

    texts = docs.select(key, text).mapInArrow(marked, f"_key {kind}, _k1 bigint, _k2 bigint, _text string")
    same = F.col("_first").eqNullSafe(F.col("_key")) & (wanted["_k1"] == texts["_k1"]) & (wanted["_k2"] == texts["_k2"])
    found = wanted.join(texts, same).select("cid", "_text")
    return found.mapInArrow(bags, "cid bigint, bag binary").dropDuplicates(["cid"])


def _verify(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """`pairs` (a, b) with `linked`: whether the bags overlap by `least` or more."""
    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similarity(_load(a.as_py()), _load(b.as_py())) >= least for a, b in zip(x, y)], pa.bool_())

    both = pairs.join(bags.select(F.col("cid").alias("a"), F.col("bag").alias("_x")), "a")
    both = both.join(bags.select(F.col("cid").alias("b"), F.col("bag").alias("_y")), "b")
    return both.select("a", "b", linked("_x", "_y").alias("linked"))


#: Members of one side of a block of comparisons, and the bytes of their bags, about.
_BLOCK, _BLOCK_BYTES = 1024, 8 << 20


def _rest_of_buckets(now: DataFrame, facts: DataFrame, least: float, bands: int, rows_each: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, at least one if there is any.

    In each bucket every member outside the largest component meets all members of other
    components. Bucket members are dealt into blocks of bounded size. A block compares signatures
    first: a pair goes on if the slots that agree are no fewer than five standard deviations below
    what a similarity of `least` has, and if no earlier band agrees, where the pair meets too. Then
    it verifies on the bags, likeliest first, until a member is linked to the other component: for
    the classes one link does. `facts` has cid, bag and _slots.
    """
    slots_each = bands * rows_each
    weighed = now.join(facts.select("cid", F.octet_length("bag").alias("_bytes")), "cid")
    sizes = weighed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_bytes"))
    heads = sizes.groupBy("bucket").agg(
        F.max(F.struct("_n", "component", "_bytes")).alias("_main"), F.sum("_n").alias("_all"),
        F.sum("_bytes").alias("_all_bytes"), F.count(F.lit(1)).alias("_parts"))
    parts = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_BYTES))
    heads = heads.filter("_parts > 1").select(
        "bucket", F.col("_main.component").alias("_main"), parts(F.col("_all"), F.col("_all_bytes")).alias("_wide"),
        parts(F.col("_all") - F.col("_main._n"), F.col("_all_bytes") - F.col("_main._bytes")).alias("_high"))
    rows = now.join(heads, "bucket").join(facts, "cid")
    deal = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keep = ["bucket", "band", "cid", "component", "_slots", "bag"]
    outside = rows.filter("component != _main").select(
        *keep, F.lit(True).alias("outside"), deal("_high", 1).alias("i"), every("_wide").alias("j"))
    others = rows.select(*keep, F.lit(False).alias("outside"), every("_high").alias("i"), deal("_wide", 2).alias("j"))
    bound = least * slots_each - 5 * (slots_each * least * (1 - least)) ** 0.5

    def compare(block: pa.Table) -> pa.Table:
        side = block["outside"].to_numpy()
        cid, component = block["cid"].to_numpy(), block["component"].to_numpy()
        table = np.frombuffer(b"".join(block["_slots"].to_pylist()), np.uint16).reshape(len(cid), -1)
        bags, first = block["bag"], int(block["band"][0].as_py()) * rows_each
        a, b = [], []
        for x in np.flatnonzero(side):
            y = np.flatnonzero(~side & (component != component[x]))
            same = table[y] == table[x]
            agree = same.sum(1)
            met = same[:, :first].reshape(len(y), -1, rows_each).all(2).any(1) if first else np.zeros(len(y), bool)
            on = np.flatnonzero((agree >= bound) & ~met)
            mine, linked = None, set()
            for i in on[np.argsort(-agree[on], kind="stable")]:
                if component[y[i]] in linked:
                    continue
                mine = mine or _load(bags[int(x)].as_py())
                if similarity(mine, _load(bags[int(y[i])].as_py())) >= least:
                    linked.add(component[y[i]])
                    a.append(cid[x])
                    b.append(cid[y[i]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return outside.unionByName(others).groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


#: Bucket members that a file holds, about, where a table is of a few numbers a row.
_FILE_ROWS = 1_000_000


def _classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8,
             bands: int = 25, rows: int = 5, leader_rounds: int = 3, leaders: int = 4) -> tuple[DataFrame, DataFrame]:
    """The documents (key and marks of the bag), and `class_id`, `class_size` and `best` of each bag.

    Of the bags of a class one is the best: that of the document to keep. Method and options as in
    `near_classes`.
    """
    spark = docs.sparkSession
    signed = written_table(_signed(docs, key, text, shingle, bands, rows), "llm-near-signed")
    # A file costs about as much as thousands of its rows, and tables of members, pairs and links
    # would else have one for each partition of the shuffle before, a dozen times over.
    files = 1 + signed.count() * bands // _FILE_ROWS
    classes = signed.groupBy("_k1", "_k2").agg(
        F.min(key).alias("_first"), F.count(F.lit(1)).alias("_copies"), F.first("_bands").alias("_bands"),
        F.first("_slots").alias("_slots"))
    classes = written_table(classes.withColumn("cid", F.monotonically_increasing_id()), "llm-near-nodes")
    banded = classes.select("cid", F.posexplode("_bands").alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    members = written_table(banded.join(full, "bucket"), "llm-near-members", files)
    wanted = classes.join(members.select("cid").distinct(), "cid").select("cid", "_k1", "_k2", "_first")
    bags = written_table(_bag_table(wanted, docs, key, text, shingle), "llm-near-bags")
    tested = spark.createDataFrame([], "a bigint, b bigint, linked boolean")
    found = None
    for turn in range(leader_rounds + 1):
        now = members.withColumn("component", F.col("cid"))
        if found is not None:
            now = members.join(found, F.col("cid") == F.col("node"), "left").select(
                "bucket", "band", "cid", F.coalesce("component", "cid").alias("component"))
        if turn < leader_rounds:
            # The first order is the same in all buckets, so most members meet one leader only.
            orders = [F.xxhash64("cid", "bucket", F.lit(turn), F.lit(i)) for i in range(leaders)] if turn else [F.col("cid")]
            heads = now.groupBy("bucket").agg(
                F.array(*[F.min(F.struct(o.alias("o"), F.col("cid"), F.col("component"))) for o in orders]).alias("_heads"),
                F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo != _hi")
            heads = heads.select("bucket", F.explode(F.array_distinct(F.transform(
                "_heads", lambda h: F.struct(h["cid"].alias("cid"), h["component"].alias("component"))))).alias("_head"))
            pairs = now.join(heads, "bucket").filter(F.col("component") != F.col("_head.component")).select(
                F.least("cid", "_head.cid").alias("a"), F.greatest("cid", "_head.cid").alias("b"))
        else:
            facts = bags.join(classes.select("cid", "_slots"), "cid")
            checked = _rest_of_buckets(now, facts, least, bands, rows).withColumn("linked", F.lit(True))
            checked = written_table(checked, "llm-near-checked", files)
            if not checked.isEmpty():
                links = tested.filter("linked").unionByName(checked)
                found = written_table(components(links, files), "llm-near-components", files)
            break
        new = pairs.distinct()
        if turn:
            new = new.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = written_table(new, "llm-near-pairs", files)
        if new.isEmpty():
            if turn and turn < leader_rounds:
                continue
            break
        checked = written_table(_verify(new, bags, least), "llm-near-checked", files)
        tested = tested.unionByName(checked)
        if not checked.filter("linked").isEmpty():
            found = written_table(components(tested.filter("linked"), files), "llm-near-components", files)
    nodes = classes.select("_k1", "_k2", "_first", "_copies", "cid")
    if found is not None:
        nodes = nodes.join(found, F.col("cid") == F.col("node"), "left").withColumn("cid", F.coalesce("component", "cid"))
    # A null key is no class's smallest if there is another.
    first = F.min(F.struct(F.col("_first").isNull().alias("none"), F.col("_first").alias("id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2")))
    sizes = nodes.groupBy("cid").agg(first.alias("_best"), F.sum("_copies").alias("class_size"))
    best = (F.col("_k1") == F.col("_best.k1")) & (F.col("_k2") == F.col("_best.k2"))
    nodes = nodes.join(sizes, "cid").select("_k1", "_k2", F.col("_best.id").alias("class_id"), "class_size", best.alias("best"))
    nodes = written_table(nodes, "llm-near-classes", files)
    drop_written(spark, members, bags, prefix="llm-near-pairs")
    return signed.select(key, "_k1", "_k2"), nodes


@shielded
def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, `class_id`, `class_size` and `kept`.

    Documents are linked if the weighted Jaccard similarity of their bags of `shingle` lower-cased
    words is `least` or more; a class is a connected component. Documents of equal bags are one
    node from the start, however many. Others are candidates if a band of `rows` signature slots
    agrees (a pair at 0.8 is missed by all 25 bands with a probability of 5e-5), and every link is
    verified on the bags themselves.

    In a bucket of equal bands members are compared to one leader, so a bucket of n documents
    gives n pairs. Members that are not yet in a leader's class are compared to a few other
    leaders of the bucket in the next rounds. After `leader_rounds` all that is left, pairs of a
    bucket in different classes, goes through `_rest_of_buckets`: no bucket is capped, and a
    linked pair is passed over with a probability below 1e-6.

    `class_id` is the smallest key of the class, null if it has none, and the document with that
    key is kept; if different bags of the class share it, that with the smallest marks. A document
    is a key and a bag: different texts of one key are judged apart, also without a key. Rows that
    repeat both are one document, marked alike. A text without words equals every other such text,
    null included. Other input columns are left out. An empty table gives an empty one.

    Options: `shingle`, `least`, `bands`, `rows`, `leader_rounds` and `leaders`.
    """
    signed, nodes = _classes(docs, text, key, **options)
    kept = F.col("best") & F.col(key).eqNullSafe(F.col("class_id"))
    return signed.join(nodes, ["_k1", "_k2"]).select(key, "class_id", "class_size", kept.alias("kept"))


@shielded
def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One document of each class, with the columns of `docs`; rows that repeat its key and bag go too.

    Rows are told apart by key and bag, so different texts that share a key, or have none, are
    each decided on their own. Options as in `near_classes`.
    """
    _, nodes = _classes(docs, text, key, **options)
    kept = nodes.filter("best").select(F.col("class_id").alias("_kept_key"), F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2"))
    marked = _with_marks(docs, text, options.get("shingle", 5))
    # Repeated rows are merged before they meet the kept ones, in part where they lie.
    once = marked.dropDuplicates([key, "_k1", "_k2"])
    same = F.col(key).eqNullSafe(F.col("_kept_key")) & (F.col("_k1") == F.col("_b1")) & (F.col("_k2") == F.col("_b2"))
    return once.join(kept, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
