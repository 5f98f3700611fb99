"""Line duplicates: two Bloom filters find suspected repeats, which alone are counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table

#: Bits of the Bloom filters for each line expected, and the lines that a shard of them expects.
_BITS, _SHARD = 16, 1 << 20
#: Line hashes that a task collects before it sends them.
_HELD = 1 << 20


def line_key(line: bytes) -> bytes:
    """Without ASCII white space at both ends, A-Z lower-cased (what `bytes` means by both)."""
    return line.strip().lower()


def _lines(text: pa.Scalar) -> list[bytes]:
    data = text.as_buffer() if text.is_valid else None
    return data.to_pybytes().split(b"\n") if data is not None else [b""]


def _is_long(key: bytes, least: int) -> bool:
    """At least so many code points: bytes that do not continue another."""
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _hashes(text: pa.Scalar, least: int) -> set[bytes]:
    """128-bit hashes of the distinct long lines of one text."""
    keys = {line_key(line) for line in _lines(text)}
    return {xxhash.xxh3_128_digest(k) for k in keys if _is_long(k, least)}


def _seen_lines(texts: DataFrame, least: int, shards: int) -> DataFrame:
    """(shard, hashes, again): 64-bit line hashes by filter shard, and which the task saw twice."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            shard = (found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(found)]])
            spans = list(zip(cuts[:-1], cuts[1:]))
            return pa.record_batch([
                pa.array([int(shard[a]) for a, _ in spans], pa.int32()),
                pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in spans], pa.binary()),
            ], names=["shard", "hashes", "again"])

        for batch in batches:
            for text in batch.column(0):
                own = _hashes(text, least)
                if own:
                    held.append(np.frombuffer(b"".join(own), ">u8")[::2].astype(np.uint64))
                    n += len(own)
                if n >= _HELD:
                    yield send()
                    held, n = [], 0
        if n:
            yield send()

    return texts.mapInArrow(collect, "shard int, hashes binary, again binary")


class _Bloom:
    """A Bloom filter of one shard with two bits a hash; both come from its lower half."""

    def __init__(self, bits: int) -> None:
        self.size, self.bits = np.uint64(bits), np.zeros(bits, bool)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = h & np.uint64(0xFFFFFFFF)
        other = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return tuple((x * self.size >> np.uint64(32)).astype(np.int64) for x in (low, other))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = self.places(h)
        return self.bits[a] & self.bits[b]

    def add(self, h: np.ndarray) -> None:
        for place in self.places(h):
            self.bits[place] = True


def _suspects(seen: DataFrame, shards: int) -> DataFrame:
    """Hashes that may occur twice, each about once.

    A task takes one shard after the other and holds its two filters. A hash found in the filter
    of those seen once is a suspect; the filter of those seen twice keeps it from being sent again,
    however often the line occurs. What the first filter lets through by chance is sent too, and a
    hash that the second holds by chance is checked against the hashes sent.
    """
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice, sent = None, None, None, np.zeros(0, np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                h = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                again = np.unpackbits(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8), count=len(h)).astype(bool)
                if shard != now:
                    now, once, twice, sent = shard, _Bloom(_BITS * _SHARD), _Bloom(_BITS * _SHARD), np.zeros(0, np.uint64)
                found = h[again | once.has(h)]
                known = twice.has(found)
                if len(sent):  # the filter may know a hash by chance: the sent ones decide
                    known &= sent[np.minimum(np.searchsorted(sent, found), len(sent) - 1)] == found
                fresh = found[~known]
                once.add(h)
                twice.add(fresh)
                if len(fresh):
                    sent = np.union1d(sent, fresh)
                    yield pa.record_batch([pa.array(fresh.view(np.int64))], names=["h"])

    dealt = seen.repartition(max(1, min(shards, 4096)), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(test, "h bigint").distinct()


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 40,
                   least_docs: int = 5, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Every row of `docs` with `kept_text`, `n_lines` (before) and `n_dropped`.

    A text is split at line feeds. Lines are equal if their keys are: the line without ASCII white
    space at both ends and with A-Z lower-cased. Keys of `least_chars` code points or more found in
    `least_docs` documents or more lose all their lines except in the document with the largest
    key column; the other lines stay as they are, joined by line feeds.

    1. Tasks collect 64-bit hashes of the distinct long lines of each document. They meet by shard
       in two Bloom filters, of the lines seen once and of those seen twice. The number of shards
       follows the bytes of text, so a shard's filters have a fixed size at any size of input.
    2. Texts are read again; lines whose hash is no suspect (one by chance in a hundred is) go no
       further. Up to `broadcast_rows` suspects (16 MB) are sent to all tasks; more meet the lines'
       hashes in a shuffled join. Only what is left is counted exactly, under 128 bits of hash and with
       partial aggregates, so a line of a third of all documents is one row per task.
    3. Each document gets the list of its lines to drop, and its text is cut.

    A null or empty text is one empty line and comes back as an empty text. Every row is a document
    of its own, also if it repeats another; rows that share the largest key all keep the line. A
    null key is smaller than any other; if no document with the line has a key, all keep it. Input
    columns called as the results are replaced. An empty table gives an empty one.
    """
    if least_docs < 2:
        raise ValueError("a repeat needs two documents")
    out = ["kept_text", "n_lines", "n_dropped"]
    kept_cols = [c for c in docs.columns if c not in out]
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    n_bytes = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = int(n_bytes / (least_chars + 1) / _SHARD) + 1
    suspects = written_table(_suspects(_seen_lines(texts, least_chars, shards), shards), "llm-lines-suspects")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [list(_hashes(t, least_chars)) for t in part.column(2)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in own]))
                full = b"".join(b"".join(x) for x in own)
                h = np.frombuffer(full, ">u8")[::2].astype(np.uint64).view(np.int64)
                yield pa.record_batch([
                    part.column(0).take(row), part.column(1).take(row), pa.array(h),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(h), [None, pa.py_buffer(full)]).cast(pa.binary())],
                    names=["id", "mark", "h", "line"])

    # A row is known by its key and text, so that rows without a key do not share one list.
    mark = F.xxhash64(F.col(f"`{text}`"))
    marked = docs.select(F.col(f"`{key}`").alias("id"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))
    found = marked.mapInArrow(explode, f"id {kind}, mark bigint, h bigint, line binary")
    few = suspects.count() <= broadcast_rows
    found = found.join(F.broadcast(suspects) if few else suspects, "h", "left_semi").drop("h")
    found = written_table(found, "llm-lines-suspected")
    keys = found.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    keys = written_table(keys.filter(F.col("n") >= least_docs).drop("n"), "llm-lines-repeated")
    drops = found.join(keys, "line").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy("id", "mark").agg(F.collect_set("line").alias("drops"))
    drops = written_table(drops, "llm-lines-drops")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_cols]).alias("row"),
                       F.col(f"`{key}`").alias("_id"), mark.alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark"))
    # The same plan at every size; the lists are the smaller side of each partition.
    rows = rows.join(drops.hint("shuffle_hash"), same, "left").select("row", "drops")

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            done = []
            for t, drop in zip(texts, lists):
                lines = t.encode("utf-8").split(b"\n") if t is not None else [b""]
                left = lines
                if drop is not None and len(drop):
                    gone = {bytes(d) for d in drop}
                    left = [x for x in lines if not _is_gone(x, gone, least_chars)]
                done.append((b"\n".join(left).decode("utf-8"), len(lines), len(lines) - len(left)))
            yield pd.DataFrame(done, columns=["text", "n_lines", "n_dropped"])

    cut_rows = rows.select("row", cut(F.col(f"row.`{text}`"), "drops").alias("cut"))
    return cut_rows.select(*[F.col(f"row.`{c}`") for c in kept_cols], F.col("cut.text").alias("kept_text"),
                           F.col("cut.n_lines").alias("n_lines"), F.col("cut.n_dropped").alias("n_dropped"))


def _is_gone(line: bytes, gone: set[bytes], least: int) -> bool:
    key = line_key(line)
    return len(key) >= least and xxhash.xxh3_128_digest(key) in gone
