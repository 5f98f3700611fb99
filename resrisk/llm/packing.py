"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

#: Split pattern of the byte-level vocabulary; fixed values.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The look-ahead matters only where white space of two or more characters meets a word.
_PLAIN_SPLIT = SPLIT.replace(r"\s+(?!\S)|", "")
#: The library's white space is Unicode's, which lacks U+001C to U+001F.
_RUN = re.compile(r"[^\S\x1c-\x1f]{2}(?:\S|[\x1c-\x1f])")


@lru_cache(maxsize=4)
def _encoder(path: str):
    """text -> ids for a `tokenizers` file with byte-level merges; loaded once per worker.

    The ids are those of the tokenizers library. Where the file's vocabulary is plain byte-level
    BPE, the same merges run through tiktoken, which is several times faster; texts with a special
    token's string in them, and files of any other kind, go through tokenizers itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    by_library = lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if (pre.get("type"), pre.get("add_prefix_space")) != ("ByteLevel", False) or spec.get("normalizer"):
        return by_library
    # The vocabulary writes each byte as a printable character: 188 stand for themselves, the
    # others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    plain, full = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                   for name, p in (("plain", _PLAIN_SPLIT), ("full", SPLIT)))

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return by_library(text)
        return (full if _RUN.search(text) else plain).encode_ordinary(text)

    return encode


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                  text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of at most `capacity` ids: key, piece, start, length, ids (array of int), part, nth.

    A document's ids are its tokens and `end_id`. Only a longer one is cut, into pieces of
    `capacity` ids of which the first may be shorter. `part` and `nth` place the piece: it is the
    nth (from 0) of its length in its input partition. They are stable only in a written table.
    A null text is empty: one piece with `end_id`. Other input columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids array<int>, part int, nth bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode, part = _encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                ids, row, piece, start, length = [], [], [], [], []
                for i, t in enumerate(texts.to_pylist()):
                    own = encode(t) if t else []
                    own.append(end_id)
                    ids.append(np.array(own, np.int32))
                    n, begin = len(own), 0
                    end = n % capacity or min(capacity, n)
                    while begin < n:
                        row.append(i)
                        piece.append(piece[-1] + 1 if begin else 0)
                        start.append(begin)
                        length.append(end - begin)
                        begin, end = end, end + capacity
                nth = np.empty(len(length), np.int64)
                for j, n in enumerate(length):
                    nth[j] = seen[n]
                    seen[n] += 1
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.record_batch([
                    keys.take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                    pa.array(np.full(len(row), part, np.int32)), pa.array(nth),
                ], names=[key, "piece", "start", "length", "ids", "part", "nth"])

    return docs.select(key, text).mapInArrow(cut, schema)


class _Bins:
    """Bins of the same content, kept together with their number; a bin is a list of runs.

    A run is (length, items per bin, rank of the first item). Items of a length are handed out in
    order of rank, bin after bin.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.next_rank: dict[int, int] = {}
        self.by_gap: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}

    def add(self, number: int, runs: list, items: list[tuple[int, int]]) -> None:
        """Put `items` (length, items per bin) into `number` bins that hold `runs`."""
        runs = list(runs)
        for length, per_bin in items:
            first = self.next_rank.get(length, 0)
            self.next_rank[length] = first + number * per_bin
            runs.append((length, per_bin, first))
        gap = self.capacity - sum(length * per_bin for length, per_bin, _ in runs)
        self.by_gap.setdefault(gap, []).append((number, runs))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Groups of equal bins (number, runs) for `counts` items of each length.

    Items above a third of the capacity go at most two to a bin: the largest is matched with the
    largest that still fits beside it. Smaller items follow in falling length; each goes into the
    smallest gap that holds it, else into a new bin. Equal items are placed together, so the work
    depends on the number of different lengths (at most the capacity) and not on the items.
    """
    from bisect import bisect_left, bisect_right, insort

    bins = _Bins(capacity)
    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        if i < 0:
            bins.add(left.pop(a), [], [(a, 1)])
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n == 0:  # a single item of this length, and no other fits: look for a smaller partner
            j = i - 1
            if j < 0:
                bins.add(left.pop(a), [], [(a, 1)])
                large.pop()
                continue
            b, n = large[j], 1
        bins.add(n, [], [(a, 2)] if a == b else [(a, 1), (b, 1)])
        for length in (a, b):
            left[length] -= n
        for length in {a, b}:
            if not left[length]:
                left.pop(length)
                large.remove(length)
    gaps = sorted(bins.by_gap)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            i = bisect_left(gaps, length)
            gap = gaps[i] if i < len(gaps) else capacity
            if i < len(gaps):
                number, runs = bins.by_gap[gap].pop()
                if not bins.by_gap[gap]:
                    del bins.by_gap[gap]
                    gaps.pop(i)
            else:
                number, runs = -(-n // (capacity // length)), []
            # The gap that is left by one item is the smallest that holds the next.
            per_bin = gap // length
            full = min(number, n // per_bin)
            rest = n - full * per_bin if full < number else 0
            rest = min(rest, per_bin - 1)
            before = set(bins.by_gap)
            if full:
                bins.add(full, _first(runs, 0), [(length, per_bin)])
            if rest:
                bins.add(1, _first(runs, full), [(length, rest)])
            if number - full - bool(rest) > 0 and runs:
                bins.by_gap.setdefault(gap, []).append((number - full - bool(rest), _first(runs, full + bool(rest))))
            n -= full * per_bin + rest
            for g in set(bins.by_gap) - before:
                insort(gaps, g)
    return [group for groups in bins.by_gap.values() for group in groups]


def _first(runs: list[tuple[int, int, int]], skipped: int) -> list[tuple[int, int, int]]:
    """The runs of bins that follow `skipped` bins of the same group."""
    return [(length, per_bin, first + skipped * per_bin) for length, per_bin, first in runs]


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """`pieces` (columns length, part, nth; a written table) with sequence_id and offset.

    The driver gets one count per length, at most `capacity` rows, and plans all bins from these.
    A piece's rank among those of its length is its `nth` plus the pieces of that length in
    earlier parts; rank and length then give its bin.
    """
    spark = pieces.sparkSession
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    by_part = written_table(by_part, "llm-pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    first = by_part.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    runs, sequence = [], 0
    for number, content in plan_bins(counts, capacity):
        offset = 0
        for length, per_bin, rank in content:
            runs.append((length, rank, rank + number * per_bin, per_bin, sequence, offset))
            offset += length * per_bin
        sequence += number
    runs = spark.createDataFrame(runs, "length bigint, low bigint, high bigint, per_bin bigint, sequence bigint, at bigint")
    # A few thousand runs at most, whatever the input: each is bounded by the number of lengths.
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "per_bin", "sequence", "at"))).alias("_runs"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("_rank", F.col("nth") + F.col("_first"))
    ranked = ranked.join(F.broadcast(runs), "length")
    run = F.filter("_runs", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"]))[0]
    ranked = ranked.withColumn("_run", run)
    nth = F.col("_rank") - F.col("_run.low")
    return ranked.withColumns({
        "sequence_id": F.col("_run.sequence") + F.floor(nth / F.col("_run.per_bin")),
        "offset": F.col("_run.at") + (nth % F.col("_run.per_bin")) * F.col("length"),
    }).drop("_first", "_rank", "_runs", "_run")


def written_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   text: str = "text", key: str = "doc_id") -> DataFrame:
    """`cut_documents` as a table in the shared folder, where part and nth no longer change."""
    return written_table(cut_documents(docs, tokenizer, capacity, end_id, text, key), "llm-pack-pieces")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of the documents with ids, `sequence_id` and `offset`: key, piece, start, length, ids.

    Each piece lies in one sequence of at most `capacity` ids, without gaps from offset 0. Pieces
    are written once with their ids, as ranks among equal lengths must not change between two
    readings; ids are then read where a caller wants them and otherwise not moved. Repeated rows
    are packed each; null keys and texts are kept; an empty table gives an empty one.
    """
    pieces = written_pieces(docs, tokenizer, capacity, end_id, text, key)
    return place_pieces(pieces, capacity).select(key, "piece", "start", "length", "ids", "sequence_id", "offset")
