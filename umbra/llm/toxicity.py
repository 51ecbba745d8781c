"""Toxicity by maximum-scoring segments of token log-odds.

*Token scores.*  Each word has a chain of tokens: its prefixes of 4, 5, 6 and 8
bytes, then itself.  A token's share of toxic contexts is estimated with a
Dirichlet prior centred on the share of the token before it in the chain (the
first one's on the share of all words), so rare and unseen words fall back on
their prefixes.  Contexts are distinct pairs of neighbouring words, so that
copies of one document count once.  A word scores the log-odds of the longest
token known, if above ``FLOOR`` (else 0), less a drift that makes the expected
score of clean text negative.

*Segments.*  All maximal scoring segments (Ruzzo-Tompa) of the whole text, in
linear time; runs of words that score below zero are summed up beforehand.

*Calibration.*  For random words the best of n words' segments follows an
extreme-value law with parameters lambda and K, taken from clean documents
(Karlin-Altschul): a segment of score S has E = K n exp(-lambda S), and is
significant if E is at most ``EVALUE``.  A document's evidence is the sum of
lambda S - ln(K n) over its significant segments; a logistic curve, fitted on
documents kept out of the counts, turns it into a probability.

Every fourth document of a class is kept out of the counts.  On those the prior's
weight, the drift and the E-value are chosen by log-loss among ``GRID``, and the
curve is fitted.

The model is fitted on a bounded sample: the ``FIT_DOCS`` labelled documents
that come first by a hash of the id, of which whole texts up to ``FIT_BYTES`` in
all are used, one text for each id.  Scoring covers every word of every text.

Cases: null, empty and word-less texts get the score of no evidence; equal texts
get equal scores, so repeated rows and ties do; very long texts are scored
whole, in one block each; a label without a text, or a null id, teaches nothing;
without labels, or with one class only, every score is 0; an empty table gives no
rows; other columns are ignored, whatever their names (``drop_toxic`` keeps them).
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import Words, blocks, by_batch, give_back, mix, utf8

FIT_DOCS = 5_000
PREFIXES = (4, 5, 6, 8)
FIT_BYTES = 32 << 20
#: Weights of the prior, drifts, and largest E-values of a significant segment.
GRID = ((2.0, 8.0), (0.1, 0.3, 0.7, 1.5), (0.01, 0.1, 1.0))
#: Log-odds that count, and the least number of contexts of a token.
FLOOR, LEAST = 2.0, 4
LEVELS = len(PREFIXES) + 1
_SEGMENT = "array<struct<start_word:int,end_word:int,score:double,evalue:double>>"


def fit_rows(id_col: str, modulus: int, held_out: int) -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo ``modulus``, is not ``held_out``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``limit`` allowed labelled ids, first by a hash of the id; one row for each."""
    some = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & allowed).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    # limit bounds the rows that are broadcast; rows that repeat an id become one before they are moved
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(some), "id")
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def _chain(w: Words) -> np.ndarray:
    """Token hashes of each word, (LEVELS, words); a prefix as long as the word or longer repeats the level before it."""
    out = np.empty((LEVELS, w.starts.size), np.uint64)
    size = w.ends - w.starts
    for k, n in enumerate(PREFIXES):
        h = w.prefix_hash(np.minimum(w.starts + n, w.ends)) ^ np.uint64(k + 1)
        out[k] = h if k == 0 else np.where(size > PREFIXES[k - 1], h, out[k - 1])
    out[-1] = w.hash
    return out


@dataclass
class ToxicityModel:
    keys: list  # for each level, sorted token hashes
    scores: list  # and their scores, drift taken off
    drift: float
    evalue: float
    log_k: float = 0.0
    lam: float = 1.0
    slope: float = 1.0
    bias: float = 0.0

    def word_scores(self, chain: np.ndarray) -> np.ndarray:
        """Scores of words from their tokens; a word without a known token scores the drift."""
        out = np.full(chain.shape[1], -self.drift)
        for level, keys in enumerate(self.keys):
            if not keys.size:
                continue
            h = chain[level]
            maybe = np.flatnonzero(self.filters[level][(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), keys.size - 1)
            same = keys[at] == h[maybe]
            out[maybe[same]] = self.scores[level][at[same]]
        return out

    @property
    def filters(self) -> list:
        if not hasattr(self, "_filters"):
            self._filters = []
            for keys in self.keys:
                bits = np.zeros(1 << 20, bool)
                bits[(keys >> np.uint64(44)).astype(np.int64)] = True
                self._filters.append(bits)
        return self._filters

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant maximal segments of one text: first word, word after the last, score, E-value."""
        found = []
        for a, b, s in maximal_segments(scores):
            log_e = self.log_k + math.log(scores.size) - self.lam * s
            if log_e <= math.log(self.evalue):
                found.append((a, b, s, math.exp(log_e)))
        return found

    def score(self, passages: list) -> float:
        x = self.bias + self.slope * evidence([p[3] for p in passages])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def evidence(evalues: list[float]) -> float:
    """Sum of -ln E, up to 200, beyond which no probability changes."""
    return min(sum(-math.log(max(e, 1e-300)) for e in evalues), 200.0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan over positive scores.

    Each candidate knows the nearest one before it with a smaller sum before (-1: none); where there is none,
    those so far are final."""
    up = np.flatnonzero(scores > 0)
    if not up.size:
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    done: list[tuple[int, int, float]] = []
    start, end, low, high, back = [], [], [], [], []
    for i, a, b in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        first, j = i, len(low) - 1
        while j >= 0 and low[j] >= a:
            j = back[j]
        while j >= 0 and high[j] < b:
            # the new one takes in all from candidate j on, whose own predecessor is known
            first, a, k = start[j], low[j], back[j]
            del start[j:], end[j:], low[j:], high[j:], back[j:]
            j = k
        if j < 0:
            done += [(x, y, h - m) for x, y, m, h in zip(start, end, low, high)]
            start, end, low, high, back = [], [], [], [], []
        start.append(first)
        end.append(i + 1)
        low.append(a)
        high.append(b)
        back.append(j)
    return done + [(x, y, h - m) for x, y, m, h in zip(start, end, low, high)]


def _log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def fit(rows: list[tuple[str | None, int]]) -> ToxicityModel | None:
    """A model from (text, 0 or 1); None if a class is missing.  Every fourth row of a class is kept for calibration."""
    texts, y = [t or "" for t, _ in rows], np.array([v for _, v in rows], bool)
    part = np.zeros(len(rows), bool)
    for kind in (True, False):
        part[np.flatnonzero(y == kind)[3::4]] = True
    if not (y[~part].any() and (~y[~part]).any()):
        return None
    raw, off = utf8(pa.array(texts, pa.large_string()))
    hashes, contexts, words, chains, counts = [], [], np.zeros(0, np.uint64), [], []
    for lo, hi in blocks(off):
        w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True, alnum=True)
        hashes.append(w.hash)
        contexts.append(mix(np.concatenate((w.hash[1:2], w.hash[:-1])) * np.uint64(3) + np.concatenate((w.hash[1:], w.hash[-1:]))) if w.hash.size else w.hash)
        counts.append(w.counts())
        # chains of words not seen before
        _, first = np.unique(w.hash, return_index=True)
        first = first[~np.isin(w.hash[first], words)]
        words = np.concatenate((words, w.hash[first]))
        chains.append(_chain(w)[:, first])
    counts = np.concatenate(counts)
    ends = np.cumsum(counts)
    order = np.argsort(words)
    chain = np.concatenate(chains, axis=1)[:, order]
    word = np.searchsorted(words[order], np.concatenate(hashes))
    text = np.repeat(np.arange(len(rows)), counts)
    use = ~part[text]
    context, toxic = np.concatenate(contexts)[use], y[text][use]
    if not toxic.any() or toxic.all():
        return None
    best = (math.inf, None)
    weights, drifts, evalues = GRID
    levels = _count(chain, word[use], context, toxic)
    for weight in weights:
        keys, odds = _tokens(levels, weight, toxic)
        for drift in drifts:
            model = ToxicityModel(keys, [np.where(x > FLOOR, x, 0.0) - drift for x in odds], drift, 1.0)
            scores = model.word_scores(chain)[word]
            model.lam, model.log_k = _karlin_altschul(*_distribution(scores[use][~toxic], odds))
            model.evalue = max(evalues)
            found = [[p[3] for p in model.passages(scores[b - n : b])] if n else [] for n, b, held in zip(counts, ends, part) if held]
            for evalue in evalues:
                x = np.array([evidence([e for e in some if e <= evalue]) for some in found])
                slope, bias = _logistic(x, y[part])
                p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
                loss = -np.log(np.maximum(np.where(y[part], p, 1 - p), 1e-12)).mean()
                if loss < best[0] - 1e-12:
                    best = (loss, replace(model, evalue=evalue, slope=slope, bias=bias))
    return best[1]


def _count(chain: np.ndarray, word: np.ndarray, context: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """For each level: its tokens, the place of each one's first occurrence, the token of each occurrence, and
    the numbers of distinct toxic and of all contexts of each."""
    out = []
    for level in chain:
        at = level[word]
        tokens, first, of = np.unique(at, return_index=True, return_inverse=True)
        _, one = np.unique(mix(at + mix(context ^ toxic.astype(np.uint64))), return_index=True)
        out.append((tokens, first, of.astype(np.int32), np.bincount(of[one], toxic[one], tokens.size), np.bincount(of[one], minlength=tokens.size)))
    return out


def _tokens(levels: list[tuple], weight: float, toxic: np.ndarray) -> tuple[list, list]:
    """Of each level the tokens that matter, and their log-odds, under a prior of ``weight`` contexts."""
    root = toxic.mean()
    share_of_word = np.full(toxic.size, root)
    above = np.zeros(toxic.size, bool)
    keys, odds = [], []
    for tokens, first, of, bad, both in levels:
        # a word that ends at an earlier level keeps that level's share
        share = (bad + weight * share_of_word[first]) / (both + weight)
        x = _log_odds(share) - _log_odds(root)
        # kept: what scores above zero, and what takes such a score back
        keep = (both >= LEAST) & ((x > FLOOR) | above[first])
        keys.append(tokens[keep])
        odds.append(x[keep])
        share_of_word = share[of]
        above |= (keep & (x > FLOOR))[of]
    return keys, odds


def _distribution(clean: np.ndarray, odds: list) -> tuple[np.ndarray, np.ndarray]:
    """Scores of clean words, and the share of each."""
    values, counts = np.unique(np.round(clean, 2), return_counts=True)
    if not (values > 0).any() and clean.size:
        # no clean word scored above zero: by the rule of three, 3 of them might have
        top = max((float(v.max()) for v in odds if v.size), default=1.0)
        values, counts = np.append(values, max(top, 0.1)), np.append(counts, 3)
    return values, counts / max(1, counts.sum())


def _karlin_altschul(values: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """The positive root of E[exp(lambda s)] = 1, and ln K for a scan whose steps rarely rise."""
    if not (values > 0).any() or (values * share).sum() >= 0:
        return 1.0, 0.0
    lo, hi = 0.0, 1.0
    grown = lambda lam: float((share * np.exp(np.minimum(lam * values, 700))).sum()) - 1
    while grown(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if grown(mid) < 0 else (lo, mid)
    rises = share[values > 0]
    lift = float((rises * np.exp(np.minimum(hi * values[values > 0], 700))).sum())
    return hi, math.log(max(min(lift, 1.0), 1e-6))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and bias of a regularised one-feature logistic fit, by Newton's method."""
    scale = max(1.0, float(np.abs(x).max())) if x.size else 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum()])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return max(a, 0.0) / scale, b


def _apply(model):
    def run(batches):
        m = model.value
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                scores, segments = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                if m is not None:
                    w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True, alnum=True)
                    s = m.word_scores(_chain(w))
                    scores[:] = m.score([])
                    for k in np.unique(np.searchsorted(w.word_off, np.flatnonzero(s > 0), "right") - 1):
                        found = m.passages(s[w.word_off[k] : w.word_off[k + 1]])
                        scores[k] = m.score(found)
                        segments[k] = [{"start_word": a, "end_word": b, "score": x, "evalue": e} for a, b, x, e in found]
                kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))
                yield pa.record_batch({"id": batch.column(0)[lo:hi], "score": pa.array(scores), "passages": pa.array(segments, kind)})

    return run


def _keep(model, at: int, threshold: float):
    def run(batches):
        for batch in batches:
            rows = pa.record_batch({"id": pa.nulls(batch.num_rows), "text": batch.column(at)})
            scores = np.concatenate([x.column(1).to_numpy() for x in _apply(model)([rows])] or [np.zeros(0)])
            yield batch.filter(pa.array(scores < threshold))

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(by_batch(_keep(shared, docs.columns.index(text_col), threshold)), docs.schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` in 0 to 1 and ``passages`` (every significant toxic passage) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(by_batch(_apply(shared)), f"id {kind}, score double, passages {_SEGMENT}").withColumnRenamed("id", id_col)


def within_bytes(batches, most: int, text: int = 1) -> list[tuple]:
    """Rows of batches, of those whose texts fit into ``most`` bytes taken one after the other."""
    rows = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            size = len(r[text].encode())
            if size <= most:
                most -= size
                rows.append(r)
    return rows


def _fit_task(batches):
    rows = within_bytes(batches, FIT_BYTES)
    if rows:
        rows.sort(key=lambda r: (r[0][::-1], r[1]))
        model = pickle.dumps(fit([(text, label) for _, text, label in rows]))
        del rows
        give_back()
        yield pa.record_batch({"model": pa.array([model], pa.binary())})


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_DOCS) -> ToxicityModel | None:
    """A model from the labelled sample (at most ``limit`` texts), fitted in one task, so that the driver holds the model only."""
    sample = labelled_sample(docs, labels, "toxic", allowed, limit, id_col, text_col)
    made = sample.select(F.col("id").cast("string").alias("id"), "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(_fit_task, "model binary").first()
    return pickle.loads(made.model) if made is not None else None
