"""Chat examples read back exactly; language codes on held-out texts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from resrisk.llm import chat, langid


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>imstarend_\n ", max_size=30))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat._plain_role(chat._role(text)) == text


def rows():
    rnd = random.Random(3)
    said = ["", None, "<|im_end|><|im_start|>assistant ok", "hi\n", "<\\|im_end|>", "ünï 🙂", "<", "|im_end|>"]
    out = []
    for c in [None, -1, 0, 5, 6, 7]:
        for t in range(rnd.randrange(1, 9)):
            out.append((c, t, rnd.choice(["user", "assistant", "system", None, "odd\nrole\\n"]), rnd.choice(said), "extra"))
    return [*out, out[3], (9, 0, "user", "only a question", "extra")]


def test_examples_read_back(spark):
    data = rows()
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, example string")
    examples = chat.prefix_examples(turns.repartition(4))
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    full = {}
    for r in chat.render_examples(examples).collect():
        full.setdefault(r["conv_id"], []).append(r)
    for c in {r[0] for r in data}:
        own = sorted(((t, r or "", x or "") for k, t, r, x, _ in data if k == c))
        said = [x for _, r, x in own if r == "assistant"]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, said)) and got[c]["n_examples"] == len(said)
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        # Every assistant turn is an example of its own with all turns before it.
        texts = sorted(full.get(c, []), key=lambda r: r["example"])
        assert [chat.unescape(r["text"][r["loss_start"]:r["loss_end"]]) for r in texts] == said
        ends = [i for i, (_, r, _) in enumerate(own) if r == "assistant"]
        for r, i in zip(texts, ends):
            assert chat.read_turns(r["text"]) == [(role, x) for _, role, x in own[:i + 1]]
    empty = chat.prefix_examples(turns.limit(0))
    assert empty.count() == chat.read_back(empty).count() == chat.render_examples(empty).count() == 0


def test_a_hot_conversation_is_cut_into_runs(spark):
    turns = spark.range(3000).selectExpr(
        "if(id < 2000, NULL, id % 7) AS conv_id", "id AS turn", "if(id % 3 = 0, 'assistant', 'user') AS role",
        "concat('t', id, ' <|') AS text")
    examples = chat.prefix_examples(turns)
    hot = examples.filter("conv_id IS NULL").collect()
    # Two thirds of the rows lie in about two thirds of the parts.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r["place"] >> 40 for r in hot}) > parts / 2
    # Stored anew and in another order, the prefixes are the same.
    mixed = examples.repartition(5, "piece")
    ordered = sorted(mixed.filter("conv_id IS NULL").collect(), key=lambda r: r["place"])
    text = "".join(r["piece"] for r in ordered)
    assert [r["turn"] for r in ordered] == list(range(2000))
    replies = [r for r in ordered if r["example"] is not None]
    assert [r["example"] for r in replies] == list(range(667))
    assert all(chat.unescape(text[r["loss_start"]:r["loss_end"]]) == f"t{3 * i} <|" for i, r in enumerate(replies))
    got = {r["conv_id"]: r for r in chat.read_back(mixed).collect()}
    said = "".join(f"{'assistant' if i % 3 == 0 else 'user'}\nt{i} <|\n" for i in range(2000))
    assert got[None]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[None]["formatted_chars"] == len(text) and got[None]["n_examples"] == 667


@pytest.mark.parametrize("stretch", [7, 60, 1 << 20])
def test_whole_texts_of_cut_conversations(spark, stretch):
    turns = spark.createDataFrame([x[:4] for x in rows()], "conv_id bigint, turn bigint, role string, text string")
    found = chat.whole_texts(chat.prefix_examples(turns).repartition(3, "piece"), stretch=stretch).collect()
    for c in {x[0] for x in rows()}:
        own = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows() if k == c))
        want = [[(r, x) for _, r, x in own[:i + 1]] for i, (_, r, _) in enumerate(own) if r == "assistant"]
        of = sorted((r for r in found if r["conv_id"] == c), key=lambda r: len(r["text"]))
        assert [chat.read_turns(r["text"]) for r in of if r["example"] is not None] == want
        assert [r["last"] for r in of] == [False] * (len(of) - 1) + [True]
        assert chat.read_turns(of[-1]["text"]) == [(r, x) for _, r, x in own]
        assert all(r["loss_start"] is None for r in of if r["example"] is None)


def test_digests_are_read_from_whole_examples(spark, monkeypatch):
    """The registered query reads texts that hold all turns before a reply, not the turns one by one."""
    made, texts = [], chat.whole_texts

    def kept(*args, **kw):
        made.append(texts(*args, **kw))
        return made[-1]

    monkeypatch.setattr(chat, "whole_texts", kept)
    turns = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(7)],
                                  "conv_id bigint, turn bigint, role string, text string")
    got = chat.read_back(chat.prefix_examples(turns)).first()
    assert sorted(len(chat.read_turns(r["text"])) for r in made[0].collect()) == [2, 4, 6, 7]
    assert got["n_turns"] == 7 and got["n_examples"] == 3
    assert got["loss_sha256"] == hashlib.sha256(b"t1t3t5").hexdigest()


def test_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q" * 9_000_000), (1, 1, "assistant", "<|" * 3_000_000), (1, 2, "assistant", "")],
                                  "conv_id bigint, turn bigint, role string, text string")
    got = chat.read_back(chat.prefix_examples(turns)).collect()
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [
        (3, 6_000_000, hashlib.sha256(("<|" * 3_000_000).encode()).hexdigest())]


@pytest.mark.parametrize("classes", [2, 4, 6, 9, 40])
def test_code_words_are_apart(classes):
    code = langid.code_words(classes)
    apart = (code.shape[1] - code @ code.T) / 2
    assert (apart + np.eye(classes) * 99 >= max(1, code.shape[1] / 5)).all()
    assert (np.abs(code.sum(0)) < classes).all()


def test_languages(spark):
    rnd = random.Random(4)
    parts = {"xx": "ka lo mi tu".split(), "yy": "sch ung ein ver".split(), "zz": "ción que los ñ".split(), "ww": "汉 字 语 言".split(),
             "vv": "ing the and er".split(), "uu": "ai eau oi ç".split(), "tt": "ov ski na ij".split()}
    made = lambda k, n: " ".join("".join(rnd.choice(parts[k]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    train = spark.createDataFrame([(i, made(k, 30), k) for i in range(40) for k in parts] + [(None, None, "xx"), (1, "text", None)],
                                  "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    assert model.languages == sorted(parts)
    test = [(i, made(k, 8), k) for i in range(20) for k in parts]
    right = sum(model.predict(t)[0] == k for _, t, k in test)
    assert right >= 0.97 * len(test)
    docs = spark.createDataFrame([(1, None, 0.0), (2, "12 !?", 0.0), (3, "", 0.0), (4, test[0][1], 0.0)], "doc_id bigint, text string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["ambiguous"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert 0 <= got[4]["score"] <= 1
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.fit(train.limit(0))
    assert none.predict("some text") == ("und", 0.0, True)


def test_number_signs_are_no_letters_and_far_texts_have_a_score():
    import numpy as np

    model = langid.Model(["a", "b"], np.array([[1.0], [-1.0]]), np.zeros((1, langid.SLOTS)), np.ones(1), np.ones(1))
    for text in ("½", "² ① 12", "", None, "٣"):
        assert model.predict(text)[0] == "und"
    assert model.predict("é")[0] in ("a", "b")
    model.losses = lambda margins: np.array([5000.0, 5001.0])
    lang, score, _ = model.predict("text")
    assert lang == "a" and 0.7 < score < 0.74
