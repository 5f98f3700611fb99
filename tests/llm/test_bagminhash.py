"""Weighted near-duplicate classes against all pairs, and the signature against the similarity."""

import random
from collections import Counter

import numpy as np
import pytest
from resrisk.llm import bagminhash
from resrisk.llm.graph import components


def bag_of(text, size=5):
    w = (text or "").lower().split()
    k = min(size, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def made(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 40, 120, 400]))]
        if rnd.random() < 0.3:
            base = (base[:12] * 30)[:300]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(6)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(rnd.choice([" ", "\n", "  "]).join(copy))
    return [*texts, None, "", "  "]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    texts = made(seed)
    bags = [bag_of(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, class_id int")
    rows = bagminhash.near_classes(docs.repartition(3), leader_rounds=1 + seed).orderBy("doc_id").collect()
    assert [r["class_id"] for r in rows] == [first[x] for x in label]
    assert [r["kept"] for r in rows] == [first[x] == i for i, x in enumerate(label)]
    assert [r["class_size"] for r in rows] == [label.count(x) for x in label]


def test_signature_estimates_weighted_similarity():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 2**64, 60, dtype=np.uint64)
    wa, wb = rnd.integers(1, 20, 60), rnd.integers(1, 20, 60)
    wb[:20] = wa[:20]
    slots = 20_000
    sig = bagminhash.signatures(np.concatenate([x, x]), np.concatenate([wa, wb]), np.repeat([0, 1], 60), 2, slots)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / slots) ** 0.5


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)]
    label = {n: n for e in links for n in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    loops = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {n: c for n, c in label.items() if n not in loops}


def test_repeated_rows_null_keys_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text here"), (None, None)], "doc_id bigint, text string")
    rows = bagminhash.near_classes(docs).collect()
    assert sorted(str(r["class_size"]) for r in rows) == ["1", "1", "2", "2"]
    assert bagminhash.near_classes(docs.limit(0)).count() == 0


def test_drop_near_copies_by_row(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text here"),
            (None, "no id one"), (None, "no id two"), (None, "no id two"), (None, None), (None, " "),
            # Near copies: of a kept row with the same key, of each other without a key, and of a row with a key.
            (7, base), (7, base + " tail"), (8, base + " end"), (None, base + " more"),
            (None, base.replace("w", "v")), (None, base.replace("w", "v") + " x"),
            # A clean text whose key is that of a row that goes.
            (8, "text of its own")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, row int")
    left = bagminhash.drop_near_copies(docs.repartition(3))
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    texts = [t for k, t in got]
    assert {(5, "a b c d e f"), (5, "other text here"), (None, "no id one"), (None, "no id two"), (8, "text of its own")} <= set(got)
    assert len(got) == 8 and len([t for t in texts if not (t or "").strip()]) == 1
    assert [k for k, t in got if t and t.startswith("w0 ")] == [7]
    assert len([t for t in texts if t and t.startswith("v0 ")]) == 1
    # The marks say the same, one document a class.
    kept = [r for r in bagminhash.near_classes(docs).collect() if r["kept"]]
    assert len(kept) == 8 + 3  # two repeated rows and the second text without words are marked alike


def test_bags_of_one_key_do_not_meet(spark):
    docs = spark.createDataFrame([(None, f"x{i} y z u v {i % 2}") for i in range(200)], "doc_id bigint, text string")
    marked = bagminhash._with_marks(docs, "text", 5)
    wanted = marked.selectExpr("monotonically_increasing_id() AS cid", "_k1", "_k2", "doc_id AS _first")
    bags = bagminhash._bag_table(wanted, docs, "doc_id", "text", 5)
    plan = bags._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "_k1" in join and "_k2" in join
    assert bags.count() == 200


def test_narrow_tables_have_few_files(spark, monkeypatch):
    """Tables of members, pairs and links were written in a file for each partition of the shuffle before."""
    from resrisk.llm import graph

    files, real = {}, bagminhash.written_table

    def noted(df, label, *more):
        table = real(df, label, *more)
        files.setdefault(label, []).append(len(table.inputFiles()))
        return table

    for module in (bagminhash, graph):
        monkeypatch.setattr(module, "written_table", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("16", "false")):
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(list(enumerate(made(3))), "doc_id bigint, text string")
        assert bagminhash.near_classes(docs).filter("kept").count() < docs.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    narrow = ("llm-near-members", "llm-near-pairs", "llm-near-checked", "llm-links", "llm-near-components", "llm-near-classes")
    assert set(narrow) <= set(files)
    assert all(n <= 1 for label in narrow for n in files[label]), files
