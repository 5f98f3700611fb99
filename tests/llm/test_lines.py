"""Line duplicates against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from resrisk.llm import lines
from resrisk.session import release, written_table

SCHEMA = "doc_id bigint, text string, n_lines string, id string, row string"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def by_hand(rows, least_chars, least_docs):
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(-1 if doc is None else doc)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if keeper.get(key_of(x), -1 if doc is None else doc) == (-1 if doc is None else doc)]
        out.append((doc, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "old", "x", "y") for d, t in rows], SCHEMA)
    got = lines.repeated_lines(df, **kw)
    assert got.columns == ["doc_id", "text", "id", "row", "kept_text", "n_lines", "n_dropped"]
    rows = got.collect()
    assert all((r["id"], r["row"]) == ("x", "y") for r in rows)
    return sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in rows), key=str)


def test_equal_to_plain_python(spark):
    rng = random.Random(3)
    pool = ["short", "A line of many words", "a LINE of many words ", "\ta line of many words\r", "éé àà ùù öö ññ",
            "ÉÉ àà ùù öö ññ", "", "   ", "  wide space stays", "wide space stays", "x" * 12, "X" * 12, "x" * 11]
    rows = [(rng.choice([None, i, i, i % 40]), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "only one line of its kind"), (7, rows[0][1]), (7, rows[0][1])]
    for least_docs, broadcast in ((2, 1 << 20), (5, 1 << 20), (5, 0)):
        want = by_hand(rows, 12, least_docs)
        assert run(spark, rows, least_chars=12, least_docs=least_docs, broadcast_rows=broadcast) == want
    assert any(w[3] for w in want)


def test_no_keys_long_texts_and_empty_tables(spark):
    shared = "this line is found in a good many of the documents"
    rows = [(None, shared)] * 6
    assert run(spark, rows) == by_hand(rows, 40, 5) and by_hand(rows, 40, 5)[0][3] == 0
    long = "\n".join(f"line number {i} of a very long text, unlike the others" for i in range(60_000))
    rows = [(i, shared + f"\nown {i}") for i in range(9)] + [(9, long + "\n" + shared), (10, "y" * 3_000_000 + "\n" + shared)]
    assert run(spark, rows) == by_hand(rows, 40, 5)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, least_docs=1)


def test_suspects_cover_all_repeats_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "_SHARD", 64)
    rows = [(i, "\n".join(f"a line that some documents share: {j:06d}" for j in range(i * 20, i * 20 + 40))) for i in range(60)]
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(7)
    seen = written_table(lines._seen_lines(texts, 40, 30), "llm-lines-test")
    all_hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in seen.collect()])
    found, count = np.unique(all_hashes, return_counts=True)
    sent = {r["h"] for r in lines._suspects(seen, 30).collect()}
    again = {int(x) for r in seen.collect() for x in np.frombuffer(r["hashes"], np.int64)[
        np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(r["hashes"]) // 8).astype(bool)]}
    assert {int(x) for x in found[count > 1].view(np.int64)} | again <= sent
    assert run(spark, rows, least_docs=2) == by_hand(rows, 40, 2)


def test_registered_query_is_the_operator(spark):
    from resrisk.llm import queries

    df = queries()["op13_line_dedup"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and df.filter("n_dropped > 0").count() > 0
    release(df)
