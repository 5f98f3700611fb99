"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 3) of the lower-cased words of the whole text."""
    b = np.frombuffer(f" {_SPACES.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    mixed = np.concatenate([b, two * np.uint32(2654435761), (three + np.uint32(77)) * np.uint32(2246822519)])
    return np.bincount((mixed ^ mixed >> np.uint32(15)) % np.uint32(SLOTS), minlength=SLOTS)


def code_words(classes: int, seed: int = 3) -> np.ndarray:
    """A codeword of +1 / -1 for each class.

    All two-part splits of up to six classes; beyond, of 64 random codes of 12 bits per doubling
    of the classes the one whose closest two words lie furthest apart.
    """
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    bits = 12 * int(np.ceil(np.log2(classes)))
    rng, best, distance = np.random.default_rng(seed), None, -1.0
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = code.shape[1] - code @ code.T
        np.fill_diagonal(apart, np.inf)
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


@dataclass
class Model:
    """languages, their codewords, and per bit: n-gram weights, scale and decoding weight."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Per bit: mean log-odds of the n-grams, times the bit's scale."""
        return self.weights @ counts / max(counts.sum(), 1) * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Per language: logistic loss of the margins against its codeword, weighted by bit."""
        return np.logaddexp(0, -self.code * margins) @ self.bit_weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); `und` without a letter or a learned language."""
        # The pattern takes number-like signs too; a letter is what Unicode calls one.
        if not text or not self.languages or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
            return "und", 0.0, True
        losses = self.losses(self.margins(gram_counts(text)))
        p = np.exp(losses.min() - losses)
        p /= p.sum()
        best = int(p.argmax())
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < 0.2)


def _rows_to_fit(docs: DataFrame, text: str, language: str, key: str, rows_per_language: int) -> DataFrame:
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(language).alias("_lang"))
    docs = docs.filter("_lang IS NOT NULL AND _text IS NOT NULL")
    sizes = {r["_lang"]: r["count"] for r in docs.groupBy("_lang").count().collect()}
    slot = F.pmod(F.xxhash64("_key", F.lit("language sample")), F.lit(1 << 20))
    below = F.lit(0)
    for name, n in sorted(sizes.items()):
        below = F.when(F.col("_lang") == name, int(min(1.0, rows_per_language / n) * (1 << 20))).otherwise(below)
    return docs.filter(slot < below).select("_lang", "_text")


def fit(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id",
        rows_per_language: int = 3000) -> Model:
    """A model from the whole texts of about `rows_per_language` rows of each language, or all.

    Rows are chosen by a hash of the key. N-gram counts are summed per language in Spark; the
    driver gets one vector of `SLOTS` counts for each language. The classifier of a bit weighs
    each n-gram by its log-odds between the languages with that bit and those without, each
    language with the same weight. A second pass over the same rows measures each bit: scale by
    the spread of its margins, decoding weight by its error.
    """
    rows = _rows_to_fit(docs, text, language, key, rows_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(*(c.to_pylist() for c in batch.columns)):
                c = gram_counts(t)
                sums[lang] = sums.get(lang, 0) + c / max(c.sum(), 1)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])], names=["lang", "counts"])

    found = rows.mapInArrow(count, "lang string, counts array<double>")
    found = found.select("lang", F.posexplode("counts").alias("slot", "n")).filter("n > 0").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = found.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).collect()
    languages = sorted(r["lang"] for r in found)
    share = np.zeros((len(languages), SLOTS))
    for r in found:
        at = languages.index(r["lang"])
        for slot, n in r["counts"]:
            share[at, slot] = n
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((1, SLOTS)), np.ones(1), np.ones(1))
    share = share / share.sum(1, keepdims=True) + 1e-6
    code = code_words(len(languages))
    weights = np.zeros((code.shape[1], SLOTS))
    for b in range(code.shape[1]):
        ones, rest = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(ones) and len(rest):
            weights[b] = np.log(ones.mean(0)) - np.log(rest.mean(0))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, right = 0, np.zeros(code.shape[1]), np.zeros(code.shape[1])
        for batch in batches:
            for lang, t in zip(*(c.to_pylist() for c in batch.columns)):
                m = model.margins(gram_counts(t)) * code[languages.index(lang)]
                n, size, right = n + 1, size + np.abs(m), right + (m > 0)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([size.tolist()]), pa.array([right.tolist()])], names=["n", "size", "right"])

    parts = rows.mapInArrow(measure, "n bigint, size array<double>, right array<double>")
    sums = parts.agg(F.sum("n").alias("n"), *[
        F.sum(F.col(c)[b]).alias(f"{c}{b}") for c in ("size", "right") for b in range(code.shape[1])]).first()
    for b in range(code.shape[1]):
        error = (sums["n"] - sums[f"right{b}"] + 1) / (sums["n"] + 2)
        model.scale[b] = 4 / max(sums[f"size{b}"] / sums["n"], 1e-9)
        model.bit_weight[b] = max(0.05, np.log((1 - error) / error))
    model.bit_weight /= model.bit_weight.mean()
    return model


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score, ambiguous) of a text column."""
    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])
    return run(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of `docs` with `lang_pred`, `score` and `ambiguous`, from its whole text.

    A null text, or one without a letter, is `und` with score 0 and ambiguous. A result is
    ambiguous if its score is less than 0.2 above the next language's. Rows are judged one by one;
    input columns called as the results are replaced; an empty table gives an empty one.
    """
    out = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in docs.columns if c not in out]
    found = docs.select(*[F.col(f"`{c}`") for c in kept], predict(F.col(text), model).alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col("_found.lang").alias("lang_pred"), "_found.score", "_found.ambiguous")
