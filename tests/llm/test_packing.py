"""Packing against the tokenizers library and against the definition of the result."""

import random
import zlib

import numpy as np
import pytest
from resrisk.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = ["", None, "a", "two  spaces   and\n\n tabs\t\t x ", "I'm they'll won't 123 4567 Ünï çode 汉字 🙂",
         "<|endoftext|> inside <|endoftext|>", " lead", "trail  ", "word " * 3000, "x  y  z", "\x1c\x1c a"]


def packed(spark, texts, capacity=64):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return [r.asDict() for r in packing.pack_documents(docs, PATH, capacity).collect()]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer
    library, encode = Tokenizer.from_file(PATH), packing._encoder(PATH)
    rnd = random.Random(1)
    made = ["".join(rnd.choice(" \n\taé1.'sT汉") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for text in [t for t in TEXTS if t] + made:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_and_sequences(spark):
    texts = TEXTS + [("lorem ipsum " * (i % 37)) for i in range(200)]
    rows, encode = packed(spark, texts), packing._encoder(PATH)
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = (encode(text) if text else []) + [2]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(r["length"] == 64 for r in own[1:]) and own[0]["length"] <= 64
        assert len(own) == -(-len(ids) // 64)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 64 + 1


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_item_once_and_fills_bins(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 1024])
    counts = {}
    for _ in range(rnd.randrange(1, 4000)):
        n = min(capacity, max(1, int(rnd.expovariate(3 / capacity))))
        counts[n] = counts.get(n, 0) + 1
    ranks, bins = {}, 0
    for number, runs in packing.plan_bins(counts, capacity):
        assert number > 0 and sum(n * per for n, per, _ in runs) <= capacity
        assert sum(per for n, per, _ in runs if 3 * n > capacity) <= 2
        bins += number
        for n, per, first in runs:
            ranks.setdefault(n, []).extend(range(first, first + number * per))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    # No more bins than best fit, item by item in falling order, needs.
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        gaps.append((fit if fit is not None else capacity) - n)
        if fit is not None:
            gaps.remove(fit)
    assert bins <= len(gaps) * 1.01 + 1


def test_repeated_null_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    assert packing.pack_documents(docs, PATH).count() == 3
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_digest_of_the_query(spark):
    from resrisk.llm import registry
    docs = spark.createDataFrame([([1, 2, 70000],)], "ids array<int>")
    got = docs.select(registry.ids_crc32("ids").alias("c")).first()["c"]
    assert got == zlib.crc32(np.array([1, 2, 70000], "<u4").tobytes())


def test_ids_equal_the_library_around_odd_white_space():
    import random

    from resrisk.llm.packing import _encoder
    from resrisk.llm.registry import tokenizer_path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    encode, rng = _encoder(tokenizer_path()), random.Random(4)
    fixed = [" \u2003\x1c", " \xa0\x1c", "\n\n\x1d", "\x85\x85a", "  \x1f "]
    for text in fixed + ["".join(rng.choice(" \n\x1c\x1d\x1f\x85\u2003\xa0\u200ba'1.") for _ in range(rng.randint(1, 9))) for _ in range(4000)]:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
