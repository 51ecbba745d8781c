"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are lower-cased runs of letters, with one blank in place of whatever
stands between them.  Character 1- to 3-grams are hashed into ``BUCKETS``
features with TF-IDF weights ((1 + ln tf) * idf, unit length).  The weights are
learnt by follow-the-regularised-leader (FTRL-proximal) with per-coordinate
rates and an elastic-net penalty, which leaves most of them at zero; a
temperature fitted on rows kept out of training calibrates the probabilities.

The model is fitted in one task on a bounded sample: ``FIT_DOCS`` labelled
documents that come first by a hash of the id, and the first ``FIT_LANG`` of every
language, so that none is missed; one text for each id and language, as long as
whole texts fit into ``FIT_BYTES``, the first of every language foremost.  Document
frequencies count all rows that may be learnt from.  Every whole text is scored.

Cases: null texts and texts without a letter are ``und`` with score 0; languages
never seen in training are never predicted; without any labelled row all is
``und``; equal texts get equal results, so repeated rows do; of equally probable
languages the first by name counts; a very long text is scored whole; rows with a
null id are scored, but not learnt from; a row is learnt from only with a text and
a language of its own; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from umbra.llm.kernels import blocks, by_batch, utf8
from umbra.llm.toxicity import within_bytes

FIT_DOCS = 3_000
FIT_LANG = 50
FIT_BYTES = 32 << 20
BITS = 14
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
BLOCK = 1 << 18


def _fold() -> np.ndarray:
    """Lower-cased letter for each code point of the basic plane, 0 for what is no letter."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD = _fold()
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block, with single blanks (0) between words, and the texts' offsets in them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    char_off = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    folded = _FOLD[np.minimum(points, 0xFFFF)]
    if (wide := points >= 0x10000).any():  # few characters: letters among them stay as they are
        kinds = np.unique(points[wide])
        real = kinds[[chr(c).isalpha() for c in kinds]]
        folded[wide] = np.where(np.isin(points[wide], real), points[wide], 0)
    keep = folded > 0
    keep[1:] |= folded[:-1] > 0
    if folded.size:
        keep[char_off[:-1][np.diff(char_off) > 0]] = True
    kept_off = np.concatenate(([0], np.cumsum(keep)))[char_off]
    return folded[keep], kept_off


def grams(points: np.ndarray) -> np.ndarray:
    """Feature of each 1-, 2- and 3-gram of one text."""
    p = np.concatenate((np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)))
    one = p[1:-1] * _MULT[0]
    two = (p[:-1] + np.uint32(1)) * _MULT[1] ^ p[1:] * _MULT[2]
    three = (p[:-2] + np.uint32(7)) * _MULT[2] ^ (p[1:-1] + np.uint32(3)) * _MULT[0] ^ p[2:] * _MULT[1]
    all_ = np.concatenate((one[p[1:-1] > 0], two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)))
    all_ ^= all_ >> np.uint32(15)
    all_ *= np.uint32(0x2C1B3C6D)
    return (all_ >> np.uint32(32 - BITS)).astype(np.int64)


def _vector(points: np.ndarray, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(points), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    x = 1 + np.log(counts[at])
    if idf is not None:
        x = x * idf[at]
        x /= np.linalg.norm(x) or 1.0
    return at, x


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, points: np.ndarray) -> np.ndarray:
        at, x = _vector(points, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, points: np.ndarray) -> tuple[str, float]:
        z = self.logits(points) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str | None, str]], seen: np.ndarray, total: int) -> LanguageModel | None:
    """A model from (text, language) and the number of texts, of ``total``, that have each feature; every fifth row of a language sets the temperature only."""
    raw, off = utf8(pa.array([t or "" for t, _ in rows], pa.large_string()))
    texts = []
    for lo, hi in blocks(off, BLOCK):
        points, to = letters(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        texts += [points[a:b] for a, b in zip(to[:-1], to[1:])]
    rows = [(p, lang) for p, (_, lang) in zip(texts, rows) if p.any()]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    y = np.array([languages.index(lang) for _, lang in rows])
    counts = [_vector(p, None) for p, _ in rows]
    idf = np.log((1 + total) / (1 + seen)) + 1
    data = []
    for at, x in counts:
        x = x * idf[at]
        data.append((at, x / (np.linalg.norm(x) or 1.0)))
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    nth = np.array([int((y[:i] == y[i]).sum()) for i in range(len(rows))])
    train = [i for i in range(len(rows)) if nth[i] % 5 != 4 or len(rows) < 50]

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            at, x = data[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model = LanguageModel(languages, idf, w[:-1], w[-1])
    held = [i for i in range(len(rows)) if nth[i] % 5 == 4] or train
    logits = np.array([data[i][1] @ model.weights[data[i][0]] + model.bias for i in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 5.0, 60), key=loss))
    return model


def _apply(model):
    def run(batches):
        m = model.value
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(off, BLOCK):
                points, to = letters(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                langs, scores = [], []
                for a, b in zip(to[:-1], to[1:]):
                    lang, score = m.predict(points[a:b]) if m is not None and points[a:b].any() else ("und", 0.0)
                    langs.append(lang)
                    scores.append(score)
                yield pa.record_batch({"id": batch.column(0)[lo:hi], "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def train_languages(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FIT_DOCS) -> LanguageModel | None:
    """A model from the labelled documents that ``allowed`` lets in: ``limit`` of them, and ``FIT_LANG`` of each language."""
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), allowed.alias("allowed"))
    named = named.filter("lang is not null and text is not null and allowed").drop("allowed")
    ids = named.filter("id is not null").select("id", "lang", F.xxhash64("id").alias("h"))
    first = ids.orderBy("h", "id").limit(limit)
    # Spark cuts each task's rows to the first of every language before they meet, so a hot language is no burden
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    by_lang = ids.withColumn("n", nth).filter(F.col("n") <= FIT_LANG)
    chosen = first.withColumn("n", F.lit(FIT_LANG + 1)).unionByName(by_lang).groupBy("id", "lang").agg(F.min("n").alias("n"))
    # the bounds hold for the ids that are broadcast and the texts that meet in a task
    texts = named.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang", "n").agg(F.min("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(named.select("text")))
    one = texts.repartition(1).sortWithinPartitions("n", F.xxhash64("id"), "lang").select(F.col("id").cast("string").alias("id"), "text", "lang")
    made = one.mapInArrow(_fit_task(shared), "model binary").first()
    return pickle.loads(made.model) if made is not None else None


def _fit_task(shared):
    def run(batches):
        rows = within_bytes(batches, FIT_BYTES)
        if rows:
            rows.sort(key=lambda r: (r[0][::-1], r[2], r[1]))
            yield pa.record_batch({"model": pa.array([pickle.dumps(fit([(text, lang) for _, text, lang in rows], *shared.value))], pa.binary())})

    return run


def _count(batches):
    """Number of texts with each feature, and under ``BUCKETS`` of all that have a letter."""
    seen = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        raw, off = utf8(batch.column(0))
        for lo, hi in blocks(off, BLOCK):
            points, to = letters(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for a, b in zip(to[:-1], to[1:]):
                if points[a:b].any():
                    seen[:-1] += np.bincount(grams(points[a:b]), minlength=BUCKETS) > 0
                    seen[-1] += 1
    at = np.flatnonzero(seen)
    yield pa.record_batch({"feature": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    seen = np.zeros(BUCKETS + 1)
    for r in texts.mapInArrow(_count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[r.feature] = r.n
    return seen[:-1], int(seen[-1])


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (calibrated probability) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(by_batch(_apply(shared)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
