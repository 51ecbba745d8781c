"""Quality classifier: a sparse rule ensemble over text statistics.

1. *Statistics.*  Each whole text gives a row of counts and ratios (kernels over
   blocks of texts): its size, word and line shape, characters by class, and how
   much of it repeats.
2. *Rules.*  Boosted trees of depth ``DEPTH`` are grown on statistics; every path
   from a root to a node is a rule, a conjunction of comparisons.
3. *Lasso.*  A logistic model over rules with an L1 penalty (proximal gradient
   with momentum) keeps few of them.
4. *Compilation.*  The kept rules become one Spark column expression over the
   statistics, so scoring runs inside Spark's generated code.

The model is fitted on a bounded sample: statistics of the ``FIT_ROWS`` labelled
ids that come first by a hash of the id, one row for each.  Statistics and scores
cover all texts.

Cases: null and empty texts have statistics of zeros and a score like any other,
a very long text too; equal texts get equal scores, so repeated rows and ties do;
rows with a null id are scored, but not learnt from; without labels, or with one
class only, every score is the share of that class (0 without labels); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import Words, blocks, by_batch, run_hashes, utf8
from umbra.sources.scratch import written

FIT_ROWS = 8_000
TREES, DEPTH, BINS, PENALTY = 12, 3, 32, 0.002

STATISTICS = (
    "log_words", "word_length", "longest_word", "distinct_words", "adjacent_repeats", "top_word", "log_lines", "line_words",
    "repeated_lines", "upper", "digits", "punctuation", "symbols", "wide", "spaces", "symbol_words", "stop_marks",
)


def _class(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_CLASSES = {
    "upper": _class(range(65, 91)),
    "digits": _class(range(48, 58)),
    "punctuation": _class(b".,;:?!'\"()-"),
    "symbols": _class(b"#$%&*+/<=>@[\\]^_`{|}~!"),
    "wide": _class(range(128, 256)),
    "spaces": _class([0x20, *range(0x09, 0x0E)]),
    "stop_marks": _class(b".?!"),
}


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])


def statistics_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) of a block."""
    n, size = off.size - 1, np.maximum(np.diff(off), 1)
    w = Words(raw, off, lower=True)
    words, lens = w.counts(), w.ends - w.starts
    some = np.maximum(words, 1)
    got = {k: _sums(flags[raw], off) / size for k, flags in _CLASSES.items()}
    got["stop_marks"] = got["stop_marks"] * size / some
    got["log_words"] = np.log1p(words)
    got["word_length"] = _sums(lens, w.word_off) / some
    full = np.flatnonzero(words)
    got["longest_word"] = np.zeros(n)
    got["longest_word"][full] = np.maximum.reduceat(lens, w.word_off[full]) if full.size else 0
    marks = np.concatenate(([0], np.cumsum(_CLASSES["symbols"][raw])))
    got["symbol_words"] = _sums(marks[w.ends] > marks[w.starts], w.word_off) / some
    same = np.zeros(w.hash.size, bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.word_off[:-1][words > 0]] = False
    got["adjacent_repeats"] = _sums(same, w.word_off) / some
    distinct, top = _repeats(w.hash, w.word_off)
    got["distinct_words"], got["top_word"] = distinct / some, top / some
    line_starts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], np.flatnonzero(raw == 10) + 1)))
    line_starts = line_starts[line_starts < raw.size]
    line_ends = np.concatenate((line_starts[1:], [raw.size])) if line_starts.size else line_starts
    line_off = np.searchsorted(line_starts, off)
    lines = np.maximum(np.diff(line_off), 1)
    got["log_lines"], got["line_words"] = np.log1p(np.diff(line_off)), words / lines
    # a line is its words
    last = np.searchsorted(w.starts, line_ends) - 1
    first = np.searchsorted(w.starts, line_starts)
    solid = last >= first
    h = np.zeros(line_starts.size, np.uint64)
    h[solid] = run_hashes(w.hash, first[solid], last[solid] + 1)
    unlike, _ = _repeats(h, line_off)
    got["repeated_lines"] = 1 - unlike / lines
    got["repeated_lines"][np.diff(line_off) == 0] = 0
    return np.stack([np.asarray(got[k], float) for k in STATISTICS], axis=1)


def _repeats(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries, and the count of the most frequent one, of each range."""
    h = h.copy()
    for a, b in zip(off[:-1], off[1:]):
        h[a:b].sort()
    first = np.ones(h.size, bool)
    first[1:] = h[1:] != h[:-1]
    some = np.flatnonzero(np.diff(off))
    first[off[some]] = True
    at = np.flatnonzero(first)
    runs = np.diff(np.concatenate((at, [h.size])))
    run_off = np.searchsorted(at, off)
    top = np.zeros(off.size - 1)
    if some.size:
        top[some] = np.maximum.reduceat(runs, run_off[some])
    return np.diff(run_off), top


def _measure(batches):
    for batch in batches:
        raw, off = utf8(batch.column(1))
        for lo, hi in blocks(off):
            x = statistics_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(c) for c in x.T)], names=["id", *STATISTICS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the statistics of every whole text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(by_batch(_measure), f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold), all of which hold


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as a Spark expression over the statistics."""
        x = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, at_most, threshold in rule:
                c = F.col(STATISTICS[k])
                holds = holds & ((c <= threshold) if at_most else (c > threshold))
            x = x + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, at_most, threshold in rule:
        out &= (x[:, k] <= threshold) if at_most else (x[:, k] > threshold)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All root-to-node paths of gradient-boosted trees on half samples of the rows."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    margin, rules, rng = np.zeros(len(y)), {}, np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        # half of the statistics for each tree, so that rules differ
        use = rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2 + 1]
        stack: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        while stack:
            rule, rows = stack.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0.0)
            if len(rule) < depth and rows.size >= 10:
                for k in use:
                    if not cuts[k].size:
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, k], grad[rows], cuts[k].size + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, k], hess[rows], cuts[k].size + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    if gain.max() > best[0]:
                        best = (float(gain.max()), int(k), float(cuts[k][gain.argmax()]))
            if best[1] < 0:
                margin[rows] += 0.5 * g / (h + 1)
                continue
            for at_most in (True, False):
                part = x[rows, best[1]] <= best[2]
                more = (*rule, (best[1], at_most, best[2]))
                rules.setdefault(more, None)
                stack.append((more, rows[part == at_most]))
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of a logistic model with an L1 penalty, by accelerated proximal gradient."""
    n, k = r.shape
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    v, c, t = w, b, 1.0
    norm = np.ones(k)
    for _ in range(20):  # the largest eigenvalue sets the step
        norm = r.T @ (r @ norm)
        size = np.linalg.norm(norm) or 1.0
        norm /= size
    step = 4 * n / (size + n)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y) / n
        new = v - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb, nt = c - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not y.size:
        return RuleModel(-30.0)
    share = float(y.mean())
    if share in (0.0, 1.0):
        return RuleModel(30.0 if share else -30.0)
    rules = grow_rules(x, y)
    r = np.stack([_holds(rule, x) for rule in rules], axis=1).astype(np.int8) if rules else np.zeros((len(y), 0), np.int8)
    # rules that hold on the same rows are one
    _, one = np.unique(r, axis=1, return_index=True)
    one = np.sort(one)
    w, b = lasso(r[:, one].astype(float), y)
    return RuleModel(b, [(rules[k], float(v)) for k, v in zip(one, w) if v])


def score_quality(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_ROWS) -> DataFrame:
    """``id_col``, ``score`` (probability of label 1) and the statistics of each row of ``docs``.

    ``allowed`` (over ``labels``) says which labelled rows may be learnt from; ``limit`` bounds their number."""
    stats = written(text_statistics(docs, id_col, text_col), "statistics")
    some = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & allowed)
    some = some.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    # limit bounds the rows that are broadcast and collected
    rows = stats.join(F.broadcast(some), "id").groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct(*STATISTICS)).alias("s")).collect()
    rows.sort(key=lambda r: r.id)
    data = np.array([(r.label, *r.s) for r in rows], float).reshape(len(rows), 1 + len(STATISTICS))
    model = fit(data[:, 1:], data[:, 0])
    return stats.withColumn("score", model.score()).select(F.col("id").alias(id_col), "score", *STATISTICS)
