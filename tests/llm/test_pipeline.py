"""The pipeline's stages on odd rows, and its tables."""

import pathlib
import sys

import pytest
from resrisk import session

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _words int, _k1 string, _host string"


def rows():
    clean = " ".join(f"word{i} of a clean text that says something new each time {i * i}" for i in range(30))
    near = clean.replace("word7 ", "word8 ")
    out = [(i, f"{clean} and an end of its own {i % 3}", "en", "src0", 1, 5, "k", "h") for i in range(1, 7)]
    out += [(10, near, "en", "src1", 1, 5, "k", "h"), (11, None, None, None, None, None, None, None), (12, "", "", "", 0, 0, "", ""),
            (None, clean + " nobody's", "en", "src2", 1, 1, "k", "h"), (13, "½ \\x1c", "en", "src1", 1, 1, "k", "h"),
            (14, " ".join(f"long{i}" for i in range(30_000)), "en", "src1", 1, 1, "k", "h")]
    return out + [out[0], out[0]]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[1:], ids=[n for n, _ in corpus_pipeline.STAGES[1:]])
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    with session.scratch():
        got = stage(spark, docs, "/root/testdata/sf0.001")
        kept = got.collect()
        assert kept and stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != "packing":
            assert got.columns == docs.columns
            given = {tuple(r) for r in docs.collect()}
            assert all(tuple(r) in given for r in kept)
        if name == "exact dedup":
            assert len({r["text"] or "" for r in kept}) == len(kept)
            assert {r["text"] or "" for r in kept} == {t[1] or "" for t in rows()}
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {t[0] for t in rows()}


def test_run_leaves_no_tables_once_released(spark):
    before = set(session._WRITTEN)
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = pieces.select("doc_id", "piece", "sequence_id", "offset", "length").collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 1024
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    session.release(pieces)
    assert set(session._WRITTEN) == before
