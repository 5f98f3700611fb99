"""Repeated byte strings, found by a blockwise suffix sort over a difference-cover sample.

Two suffixes that agree on their first `length` bytes are what has to be found. A difference cover
of period V meets every pair of positions: for any i and j there is a shift d < V with both i + d
and j + d in the sample. So the pair's sampled suffixes agree on `length - V + 1` bytes at least.

1. Only sampled suffixes are sorted first, bucket by bucket, by a fingerprint of these bytes;
   those that tie get the rank "repeated".
2. A suffix can tie on the whole length only if one of the V positions from it on is sampled and
   repeated. These are sorted, again one bucket at a time, by a fingerprint of the whole length.
3. Each document's repeated starts are gathered, and the bytes they cover are cut.

A bucket holds about a fixed number of suffixes at any size of input. A fingerprint has 64 bits
within the order of its bucket; it decides a tie, no text is moved for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written_table
from .names import shielded

#: A perfect difference set: each non-zero difference mod 133 occurs once. Fixed values.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.random.default_rng(20_11).integers(0, 2**64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse mod 2^64, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sums(text: np.ndarray) -> np.ndarray:
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_letters()[text] * _POWERS.get(len(text))[0], out=out[1:])
    return out


def _fingerprints(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of `length` bytes from each start; equal strings have equal fingerprints."""
    down = _POWERS.get(len(sums))[1]
    h = (sums[starts + length] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: small numbers then compress well in a shuffle."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; `np.unique` may hash them first, which takes several times as long."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _steps(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places as differences within each document; `counts` are the places of each document."""
    d = np.diff(places, prepend=places[:1])
    first = np.cumsum(counts) - counts
    d[first] = places[first]
    return d.astype(np.uint32)


def _unsteps(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(d.astype(np.int64))
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - d[first], counts)


#: `bucket`, then suffixes of one batch of documents: `found` ones are known to be repeated, of
#: the others `marks` has fingerprints. `docs`, `counts`, `places`: where they start.
_BLOCK = "bucket int, found boolean, docs binary, counts binary, places binary, marks binary"
_BLOCK_NAMES = ["bucket", "found", "docs", "counts", "places", "marks"]


def _blocks(doc: np.ndarray, place: np.ndarray, mark: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of suffixes given by document, place and fingerprint, in order of document and place.

    Of a fingerprint that occurs more often in the batch, one suffix is sent as a question with a
    `found` twin: all others are known to be repeated without it. So a passage that a third of all
    rows share is one row per batch in its bucket.
    """
    if not len(doc):
        return
    by = np.argsort(mark)
    m = mark[by]
    same = m[1:] == m[:-1]
    again = np.zeros(len(m), bool)
    again[1:] = same
    multiple = again.copy()
    multiple[:-1] |= same
    is_found, is_asked = np.zeros(len(m), bool), np.zeros(len(m), bool)
    is_found[by] = multiple
    is_asked[by] = ~again
    # High bits choose the bucket, so all bits take part in the order within it.
    bucket = ((mark >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    rows = {n: [] for n in _BLOCK_NAMES}
    for found, chosen in ((True, is_found), (False, is_asked)):
        at = np.flatnonzero(chosen)
        if found:  # dealt by document, as the order no longer matters
            own = (doc[at].view(np.uint64) * _M1 >> np.uint64(33)).astype(np.int64) % buckets
        else:
            own = bucket[at]
        # Sixteen bits sort in linear time; equal buckets keep the order of document and place.
        order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")
        at, own = at[order], own[order]
        for part in np.split(at, np.flatnonzero(np.diff(own)) + 1):
            if not len(part):
                continue
            d = doc[part]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            counts = np.diff(np.append(first, len(d))).astype(np.int64)
            rows["found"].append(found)
            rows["docs"].append(_planes(d[first]))
            rows["counts"].append(_planes(counts.astype(np.uint32)))
            rows["places"].append(_planes(_steps(place[part], counts)))
            rows["marks"].append(b"" if found else mark[part].tobytes())
        starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else []
        rows["bucket"] += [int(own[i]) for i in starts]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    yield pa.record_batch([pa.array(rows[n], k) for n, k in zip(_BLOCK_NAMES, kinds)], names=_BLOCK_NAMES)


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows one by one, so that only one row's bytes are copied at a time."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def _read_block(row: dict, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of the block's suffixes, or of those at some of its positions."""
    counts = _unplanes(row["counts"], np.uint32).astype(np.int64)
    places = _unsteps(_unplanes(row["places"], np.uint32), counts)
    docs = _unplanes(row["docs"], np.int64)
    if at is None:
        return np.repeat(docs, counts), places
    return docs[np.searchsorted(np.cumsum(counts), at, side="right")], places[at]


#: Places of repeated suffixes of the documents of one group.
_PLACES = "grp int, docs binary, counts binary, places binary"


#: A prime and a multiplier that keep products within 63 bits.
_PRIME, _FACTOR = 2_147_483_647, 2_654_435_761


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return ((doc % _PRIME * _FACTOR >> 16) % groups).astype(np.int32)


def _group_column(doc: Column, groups: int) -> Column:
    """The same number as `_group` gives."""
    return (F.shiftright(F.pmod(doc, F.lit(_PRIME).cast("long")) * F.lit(_FACTOR), 16) % F.lit(groups)).cast("int")


def _by_group(doc: np.ndarray, place: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows of `_PLACES`: in order of group, document and place, each place once."""
    u, inverse = np.unique(doc, return_inverse=True)
    g = _group(u, groups)
    order = np.argsort(g, kind="stable")
    rank = np.empty(len(u), np.uint64)
    rank[order] = np.arange(len(u), dtype=np.uint64)
    both = _distinct(rank[inverse] << np.uint64(32) | place.astype(np.uint64))
    at, place = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.bincount(at, minlength=len(u))
    steps, ends = _steps(place, counts), np.cumsum(counts)
    g, u = g[order], u[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
    rows = [(int(g[a]), _planes(u[a:b]), _planes(counts[a:b].astype(np.uint32)),
             _planes(steps[ends[a] - counts[a]:ends[b - 1]])) for a, b in zip(cuts[:-1], cuts[1:])]
    kinds = [pa.int32(), *[pa.binary()] * 3]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["grp", "docs", "counts", "places"])


def _sort_buckets(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Sort one bucket at a time; give the places of the suffixes that tie, by group of documents.

    Rows come in order of bucket. One bucket is held, and the ties found since the last output.
    """
    now, asked, found, n = None, [], [], 0

    def close() -> int:
        if not asked:
            return 0
        marks = [np.frombuffer(row["marks"], np.uint64) for row in asked]
        mark = np.concatenate(marks)
        by = np.argsort(mark)
        m = mark[by]
        same = m[1:] == m[:-1]
        tie = np.zeros(len(m), bool)
        tie[1:] = same
        tie[:-1] |= same
        # Only blocks with a tie are read further.
        hits, ends = np.sort(by[tie]), np.cumsum([len(x) for x in marks])
        cuts = np.searchsorted(hits, ends)
        for row, end, some, own in zip(asked, ends, np.split(hits, cuts[:-1]), marks):
            if len(some):
                found.append(_read_block(row, some - (end - len(own))))
        asked.clear()
        return len(hits)

    for batch in batches:
        for row in _rows(batch):
            if row["bucket"] != now:
                n += close()
                now = row["bucket"]
            if row["found"]:
                found.append(_read_block(row))
                n += len(found[-1][0])
            else:
                asked.append(row)
            if n >= _HELD:
                yield from _by_group(*(np.concatenate(x) for x in zip(*found)), groups)
                found, n = [], 0
    n += close()
    if n:
        yield from _by_group(*(np.concatenate(x) for x in zip(*found)), groups)


def _places_of(blocks: pa.Table) -> dict[int, np.ndarray]:
    """Sorted distinct places by document."""
    parts: dict[int, list] = {}
    for row in _rows(blocks):
        counts = _unplanes(row["counts"], np.uint32).astype(np.int64)
        places = _unsteps(_unplanes(row["places"], np.uint32), counts)
        for d, p in zip(_unplanes(row["docs"], np.int64).tolist(), np.split(places, np.cumsum(counts)[:-1])):
            parts.setdefault(d, []).append(p)
    return {d: _distinct(np.concatenate(p)) for d, p in parts.items()}


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(document, bytes), without copies."""
    docs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    for i, t in enumerate(texts):
        b = t.as_buffer() if t.is_valid else None
        yield int(docs[i]), np.frombuffer(b, np.uint8) if b is not None and b.size else np.zeros(0, np.uint8)


#: Suffixes that a task collects before it sorts and sends them.
_HELD = 500_000


def _collected(found: Iterator[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    doc, place, mark, n = [], [], [], 0
    for d, p, m in found:
        if not len(p):
            continue
        doc.append(np.full(len(p), d, np.int64))
        place.append(p)
        mark.append(m)
        n += len(p)
        if n >= _HELD:
            yield from _blocks(*map(np.concatenate, (doc, place, mark)), buckets)
            doc, place, mark, n = [], [], [], 0
    if n:
        yield from _blocks(*map(np.concatenate, (doc, place, mark)), buckets)


def _sorted_by_bucket(blocks: DataFrame, buckets: int, groups: int, label: str) -> DataFrame:
    dealt = blocks.repartition(max(1, min(buckets, 4096)), "bucket").sortWithinPartitions("bucket")
    return written_table(dealt.mapInArrow(lambda x: _sort_buckets(x, groups), _PLACES), label)


def _sampled(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    reach = length - PERIOD + 1
    cover = np.array(COVER)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for doc, text in _texts(batch):
                    if len(text) >= length:
                        n = len(text) - reach + 1
                        starts = (np.arange(0, n, PERIOD)[:, None] + cover).ravel()
                        starts = starts[starts < n]
                        yield doc, starts, _fingerprints(_sums(text), starts, reach)
        yield from _collected(found(), buckets)

    return rows.select("_doc", "_bytes").mapInArrow(sample, _BLOCK)


def _candidates(rows: DataFrame, length: int, buckets: int, turn: int, turns: int) -> DataFrame:
    """Suffixes with a repeated sampled suffix within reach, of the share of this turn."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for (doc, text), blob in zip(_texts(batch), batch.column(2)):
                    repeated = np.frombuffer(blob.as_buffer(), np.uint32).astype(np.int64)
                    n = max(len(text) - length + 1, 0)
                    # Starts from PERIOD - 1 before a repeated sample up to the sample itself.
                    size = len(text) + 2
                    edge = np.bincount(np.maximum(repeated - PERIOD + 1, 0), minlength=size) - np.bincount(
                        repeated + 1, minlength=size)
                    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                    # Equal strings begin alike, so their first bytes tell the turn: only the
                    # fingerprints of this turn are computed.
                    first = _letters()[text[starts]] + (_letters()[text[starts + 1]] << np.uint64(1)) + (
                        _letters()[text[starts + 2]] << np.uint64(2))
                    starts = starts[(first >> np.uint64(40)) % np.uint64(turns) == turn]
                    yield doc, starts, _fingerprints(_sums(text), starts, length)
        yield from _collected(found(), buckets)

    return rows.select("_doc", "_bytes", "_places").mapInArrow(candidates, _BLOCK)


def covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of bytes that strings of `length` bytes at `starts` cover."""
    if not len(starts):
        return starts, starts
    first = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    begin = starts[first]
    end = starts[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)] + length
    return begin, end


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """`docs` with `_bytes` and `_doc`, a number of its own for each row.

    It is the key where that is a whole number and no two rows share one or lack it; otherwise
    the rows are numbered, and written once with their numbers.
    """
    rows = docs.withColumn("_bytes", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    same = docs.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").groupBy("_k").count().filter("count > 1")
    plain = docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if plain and docs.filter(F.col(key).isNull()).isEmpty() and same.isEmpty():
        return rows.withColumn("_doc", F.col(key).cast("long"))
    return written_table(rows.withColumn("_doc", F.monotonically_increasing_id()), "llm-suffix-rows")


@shielded
def repeated_spans(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id",
                   bucket_size: int = 300_000, group_bytes: int = 8 << 20, turns: int = 2) -> DataFrame:
    """Every row of `docs` with `spans` (array of begin, end) and `kept_bytes` (binary).

    A span is a maximal run of bytes covered by strings of `length` bytes that start anywhere else
    too, in the same document or another. Texts are whole, as UTF-8; strings do not cross
    documents. `turns` splits the sort of the whole-length suffixes into that many rounds, each
    of which reads the candidates' texts again and needs a fraction of the shuffle space.

    A null text is empty and has no span. Rows that repeat key and text are documents of their
    own, so their texts repeat. An empty table gives an empty one. Input columns called as the
    results are replaced. `length` must be at least 140: below, the sample has no reach left.
    """
    if length < PERIOD + 7:
        raise ValueError(f"length must be at least {PERIOD + 7}")
    out = ["spans", "kept_bytes"]
    rows = _keyed(docs.drop(*out), text, key)
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    buckets = int(total * len(COVER) / PERIOD / bucket_size) + 1
    groups = int(total / group_bytes) + 1
    # The same rule as in _group: documents and their places meet in groups of bounded size.
    rows = rows.withColumn("_grp", _group_column(F.col("_doc"), groups))
    ranks = _sorted_by_bucket(_sampled(rows, length, buckets), buckets, groups, "llm-suffix-sample")

    def attach(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        places = _places_of(blocks)
        texts = texts.select(["_doc", "_bytes"])
        keep = pa.array([i for i, d in enumerate(texts["_doc"].to_pylist()) if d in places], pa.int64())
        texts = texts.take(keep)
        blobs = [places[d].astype(np.uint32).tobytes() for d in texts["_doc"].to_pylist()]
        return texts.append_column("_places", pa.array(blobs, pa.binary()))

    survivors = rows.select("_grp", "_doc", "_bytes").groupBy("_grp").cogroup(ranks.groupBy("grp")).applyInArrow(
        attach, "_doc bigint, _bytes binary, _places binary")
    survivors = written_table(survivors, "llm-suffix-texts")
    starts = None
    for turn in range(turns):
        some = _sorted_by_bucket(_candidates(survivors, length, buckets, turn, turns), buckets, groups, "llm-suffix-starts")
        starts = some if starts is None else starts.unionByName(some)
    drop_written(spark, prefix="llm-suffix-texts")
    drop_written(spark, prefix="llm-suffix-sample")
    kept = [c for c in docs.columns if c not in out]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema]

    def cut(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        places = _places_of(blocks)
        spans, left = [], []
        for doc, text in zip(rows["_doc"].to_pylist(), rows["_bytes"].to_pylist()):
            begin, end = covered(places.get(doc, np.zeros(0, np.int64)), length)
            spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
            left.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)])))
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return rows.select(kept).append_column("spans", pa.array(spans, kind)).append_column(
            "kept_bytes", pa.array(left, pa.binary()))

    return rows.groupBy("_grp").cogroup(starts.groupBy("grp")).applyInArrow(
        cut, ", ".join([*fields, "spans array<struct<begin: bigint, end: bigint>>", "kept_bytes binary"]))
