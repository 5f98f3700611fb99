"""Repeated byte strings against a brute-force search."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from resrisk.llm import suffix


def brute(texts, length=200):
    seen = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]].append((d, i))
    marks = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i:i + length] = b"\1" * length
    out = []
    for b, m in zip(data, marks):
        spans, i = [], 0
        while i < len(m):
            j = i
            while j < len(m) and m[j] == m[i]:
                j += 1
            if m[i]:
                spans.append((i, j))
            i = j
        out.append((spans, bytes(x for x, y in zip(b, m) if not y)))
    return out


def found(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    rows = suffix.repeated_spans(docs.repartition(3), **options).orderBy("doc_id").collect()
    return [([(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept_bytes"])) for r in rows]


def made(seed, n=24):
    rnd = random.Random(seed)
    words = ["the", "of", "né", "wörter", "a", "tion", "er", "汉字", "\n"]
    text = lambda k: " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(k))
    passages = [text(k) for k in (25, 31, 45, 60, 80, 150)]
    out = []
    for _ in range(n):
        parts = [text(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(20)
            parts += [p[a:len(p) - rnd.randrange(20)], text(rnd.randrange(0, 30))]
        out.append(" ".join(parts))
    return [*out, None, "", "ab" * 300, out[0], out[0][50:], "x" * 199, "y" * 200, "z" * 201]


def test_cover_meets_every_pair():
    cover = set(suffix.COVER)
    for a in range(suffix.PERIOD):
        assert any((d % suffix.PERIOD in cover) and ((d + a) % suffix.PERIOD in cover) for d in range(suffix.PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    texts = made(seed)
    assert found(spark, texts, bucket_size=50, group_bytes=4000, turns=1 + seed) == brute(texts)


def test_packed_places():
    doc = np.array([5, 5, -7, 9, 9, 9], np.int64)
    place = np.array([3, 900_000, 0, 1, 2, 70_000], np.int64)
    got = {}
    for batch in suffix._by_group(doc, place, 3):
        got |= {d: p.tolist() for d, p in suffix._places_of(batch).items()}
    assert got == {5: [3, 900_000], -7: [0], 9: [1, 2, 70_000]}


def test_repeated_keys_nulls_and_empty(spark):
    long = " ".join(map(str, range(200)))
    docs = spark.createDataFrame([(1, long), (1, long), (None, "short"), (None, None)], "doc_id bigint, text string")
    rows = suffix.repeated_spans(docs).collect()
    assert sorted(len(r["kept_bytes"]) for r in rows) == [0, 0, 0, 5]
    assert suffix.repeated_spans(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_spans(docs, length=100)


def test_places_are_sorted_and_not_hashed(monkeypatch):
    """np.unique without an inverse hashes its values, which was most of the time of op6."""
    rnd = np.random.default_rng(5)
    doc, place = rnd.integers(-9, 9, 5000), rnd.integers(0, 400, 5000)
    want = {d: np.unique(place[doc == d]).tolist() for d in np.unique(doc).tolist()}
    unique = np.unique

    def sorting_only(a, return_inverse=False):
        assert return_inverse
        return unique(a, return_inverse=True)

    monkeypatch.setattr(np, "unique", sorting_only)
    blocks = [b for _ in range(2) for b in suffix._by_group(doc, place, 3)]
    got = suffix._places_of(pa.Table.from_batches(blocks))
    assert {d: p.tolist() for d, p in got.items()} == want
    assert list(suffix._by_group(doc[:1], place[:1], 3))[0].num_rows == 1
    assert suffix._distinct(place[:0]).tolist() == []
