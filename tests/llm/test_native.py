"""URL filter, quality rules, exact duplicates and mixing against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from resrisk.llm import exact, mixing, quality, urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


# --- URLs ---------------------------------------------------------------------------------

def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def rule_for(host, path):
    fits = [(len(r), r, v) for r, v in RULES for name, rest in [r.split("/", 1)]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "x", "http://", "http://A.Example.ORG", "http://a.example.org/es/1", "https://example.org/en/12?x=/",
        "http://b.com/fr/1", "http://b.com/fr", "http://b.com/de/#/fr/", "http://b.com/en/", "a://b://c/d", "http://xorg/es/",
        "http://É.org/q", "http://h.net/1", "http://c.com/en/", "http://b.com/x\n/y"]


def test_hosts_rules_and_ranks(spark):
    pages = spark.createDataFrame([(i, u, None, "old") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, verdict string")
    edges = spark.createDataFrame([("h.net", "c.com", 3), ("c.com", "h.net", 1)], "source string, target string, links bigint")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, RULES, edges).collect()}
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        rule, verdict = rule_for(host, path)
        assert got[i]["rule"] == rule
        if rule:
            assert got[i]["verdict"] == verdict
    # b.com has two pages of the blocked path and one of the allowed one; nobody links to it.
    assert got[10]["verdict"] == "allow" and got[14]["verdict"] == "allow"
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


def test_ranks_against_power_iteration(spark):
    rnd = random.Random(5)
    hosts = [f"h{i}" for i in range(12)]
    links = Counter((rnd.choice(hosts), rnd.choice(hosts)) for _ in range(40))
    links = {k: n for k, n in links.items() if k[0] != k[1]}
    seeds = {h: (rnd.randrange(3), rnd.randrange(2)) for h in hosts}
    got = {r["host"]: r for r in urls.propagate(
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trusted int, blocked int"),
        spark.createDataFrame([(*k, n) for k, n in links.items()], "source string, target string, links int"), max_rounds=30).collect()}
    for name, col, turn in (("trust", 0, 1), ("distrust", 1, -1)):
        moves = [(*k[::turn], n) for k, n in links.items()]
        out = Counter()
        for a, _, n in moves:
            out[a] += n
        total = sum(s[col] for s in seeds.values())
        start = {h: seeds[h][col] / total for h in hosts}
        rank = {h: 0.15 * x for h, x in start.items()}
        for _ in range(30):
            new = {h: 0.15 * x for h, x in start.items()}
            for a, b, n in moves:
                new[b] += 0.85 * rank[a] * n / out[a]
            rank = new
        for h in hosts:
            assert (got[h][name] if h in got else 0) == pytest.approx(rank[h], abs=1e-4)


def test_distrust_blocks_a_host_that_links_to_blocked_pages(spark):
    link = "<a class=x href='HTTP://bad.com/de/1'>x</a>"
    pages = spark.createDataFrame(
        [(1, "http://bad.com/de/1", ""), (2, "http://fan.net/a", link * 3), (3, "http://good.org/", "<a href=//calm.net/>c</a>"),
         (4, "http://calm.net/a", None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in urls.judge_urls(pages, RULES).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "ranks"), 3: ("allow", "rule"), 4: ("allow", "ranks")}


# --- quality ------------------------------------------------------------------------------

def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(spark):
    rnd = random.Random(6)
    texts = [None, "", " ", "a", "a b", "a b c", "a a a a", "a b c a b c", "\n\n x\n x\n y\r\n#*$%&|<>\n", "É 汉字 🙂 a\x0bb\x0cc\x1cd\xa0e"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rnd.choice(["x y", "z", "", "w w w"]) for _ in range(20)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    rows = quality.judge_quality(docs, []).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        want = counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])
    # A filter on a result must not change it.
    assert quality.text_statistics(docs).filter("n_repeat_words > 3").count() == sum(counts(t)[4] > 3 for t in texts)
    assert quality.keep_good(docs, []).columns == docs.columns
    assert quality.judge_quality(docs.limit(0), []).count() == 0


def test_learned_rules(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        a, b = rnd.random(), rnd.random()
        rows.append((i, a, b, (a > 0.8 and b < 0.5) or a < 0.1))
    data = spark.createDataFrame(rows, "doc_id bigint, a double, b double, bad boolean")
    rules = quality.learn_rules(data, ["a", "b"])
    got = {r["doc_id"]: r["no"] for r in data.select("doc_id", quality.rejects(rules).alias("no")).collect()}
    wrong = sum((got[i] is not None) != bad for i, _, _, bad in rows)
    assert 2 <= len(rules) <= 8 and wrong < 120
    assert quality.learn_rules(data.filter("bad"), ["a", "b"]) == []
    assert quality.learn_rules(data.limit(0), ["a", "b"]) == []


def test_fit_leaves_out_conflicting_labels(spark):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(3, 0, 0), (4, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.fit_quality(docs, labels) == []


# --- exact duplicates ---------------------------------------------------------------------

def test_copies(spark):
    rnd = random.Random(8)
    texts = [rnd.choice(["a", "b", "", None, "same prefix " * 40 + "x", "same prefix " * 40 + "y", "é", "e\u0301"]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for options in ({}, {"filter_bits": 32_768, "prefix_chars": 4}):
        for r in exact.group_copies(docs, **options).collect():
            own = groups[r["text"] or ""]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
    assert sorted(r["doc_id"] for r in exact.drop_copies(docs).collect()) == sorted(map(max, groups.values()))
    assert exact.drop_copies(docs).columns == docs.columns


def test_copies_of_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(7, "t"), (7, "t"), (None, "t"), (None, "u"), (7, "v")], "doc_id bigint, text string")
    rows = exact.group_copies(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["group_size"], r["kept"]) for r in rows) == [
        ("7", "t", 3, True), ("7", "t", 3, True), ("7", "v", 1, True), ("None", "t", 3, False), ("None", "u", 1, True)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact.drop_copies(docs).collect()) == [("7", "t"), ("7", "v"), ("None", "u")]
    assert exact.drop_copies(docs.limit(0)).count() == 0


def test_groups_of_copies_that_share_a_key(spark):
    rows = [(7, "t"), (7, "t"), (7, "u"), (7, "u"), (None, "v"), (None, "v"), (None, "w"), (None, "w"), (None, None), (None, ""), (3, "t"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for options in ({}, {"filter_bits": 32_768, "prefix_chars": 4}):
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in exact.drop_copies(docs, **options).collect())
        assert got == [("7", "t"), ("7", "u"), ("7", "x"), ("None", ""), ("None", "v"), ("None", "w")]


def test_large_group_of_copies_meets_its_result_in_parts(spark):
    rows = [(i, "copied " * 60) for i in range(500)] + [(1000 + i, f"text {i % 30}") for i in range(60)] + [(None, "copied " * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = exact.group_copies(docs).collect()
    assert len(got) == len(rows)
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(499, 501)} | {(1030 + i, 2) for i in range(30)}
    assert sorted(r["doc_id"] for r in exact.drop_copies(docs).collect()) == [499, *range(1030, 1060)]


# --- mixing -------------------------------------------------------------------------------

def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def drawn(seed, key, j):
    return int(hashlib.md5(f"{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) / (1 << 52)


def test_counts_and_order(spark):
    rows = [(i, ["a", "b", None, "c"][i % 4 if i % 3 else 0], "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, copy string")
    weights = {"a": 1.0, "b": 60.0, "c": 0.0}
    sizes = Counter(s for _, s, _ in rows)
    share = {s: weights.get(s, 1.0) for s in sizes}
    rate = {s: 2 * 900 * share[s] / sum(share.values()) / n for s, n in sizes.items()}
    want = Counter()
    for i, s, _ in rows:
        parts = max(1, math.ceil(rate[s] / 64))
        want[i] = sum(poisson(drawn(9, i, j), rate[s] / parts) for j in range(1, parts + 1))
    mixed = mixing.poisson_mix(docs, weights, epochs=2.0, seed=9)
    got = mixed.collect()
    assert Counter(r["doc_id"] for r in got) == +want
    assert all({r["copy"] for r in got if r["doc_id"] == i} == set(range(want[i])) for i in (1, 5, 7))
    assert abs(len(got) - 1800) < 4 * 1800 ** 0.5
    assert [r["shuffle_key"] for r in mixed.coalesce(1).limit(5).collect()] != []
    salted = mixing.poisson_mix(docs, weights, epochs=2.0, seed=9, sent=0)
    assert sorted(map(str, salted.collect())) == sorted(map(str, got))
    assert mixing.poisson_mix(docs, weights, seed=9).count() != 0
    assert mixing.poisson_mix(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(docs, {"a": -1.0})


def test_large_rate_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "s"), (1, "s"), (1, "s")], "doc_id bigint, source string")
    got = mixing.poisson_mix(docs, {}, epochs=500.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    n = {r["doc_id"]: r["n"] for r in got}
    assert 400 < n[None] < 600 and 800 < n[1] < 1200 and n[1] % 2 == 0
