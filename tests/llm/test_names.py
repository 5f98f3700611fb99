"""Input columns called like an operator's own keep their values."""

import pytest
from resrisk import session
from resrisk.llm import bagminhash, exact, html, mixing, quality, suffix, urls

NAMES = ["_words", "_k1", "_k2", "_host", "_count", "_name", "_length", "_full", "_text", "_doc", "_grp", "_bytes", "_n", "_row", "_key"]


@pytest.mark.parametrize("run", [
    lambda d: exact.group_copies(d), lambda d: exact.drop_copies(d), lambda d: bagminhash.drop_near_copies(d),
    lambda d: suffix.repeated_spans(d), lambda d: mixing.poisson_mix(d, {"a": 1.0}, seed=1), lambda d: quality.judge_quality(d, []),
    lambda d: html.extract_text(d), lambda d: urls.judge_urls(d, [("org/", "allow")]),
], ids=["group_copies", "drop_copies", "drop_near_copies", "repeated_spans", "poisson_mix", "judge_quality", "extract_text", "judge_urls"])
def test_values_stay(spark, run):
    schema = "doc_id bigint, text string, source string, page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame([(i, f"text number {i} has words", "a", i, f"http://h{i}.org/", f"<p>page {i}</p>", *[f"{n} {i}" for n in NAMES])
                                  for i in range(4)], schema)
    with session.scratch():
        got = run(docs).collect()
    assert got
    for r in got:
        assert [r[n] for n in NAMES] == [f"{n} {r['doc_id']}" for n in NAMES]
