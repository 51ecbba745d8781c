"""Benchmark decontamination: passages of a document within a small edit distance of a benchmark item.

Texts are read as lower-case words of letters and digits.  A passage leaks an
item of L words if it lies within ``tolerance * L`` word edits of it.

1. *Windows.*  At every word, one window for each item length L.  Each edit
   breaks at most two of an item's L - 1 word pairs, so a window is dropped
   unless enough of its word pairs occur in items of that length.  A table from
   word pair to item lengths tells; it loses no leak of up to ``tolerance * L``
   replaced, added or dropped words.
2. *CGK embedding.*  A random walk copies the window's words, staying or moving
   on by a random bit of (step, word); strings within a small edit distance
   become strings with a small Hamming distance, as the walks meet again.  A walk
   takes 2 L steps, after which a string of L words is used up on average.
3. *Bit sampling.*  Each walk is hashed at a few random steps, many times over;
   windows and items that agree on a sample are candidates.
4. *Pieces.*  Insertions at the front part two walks for long, so bit sampling
   alone misses some leaks at the full tolerance.  An item with ``e`` edits allowed
   falls into ``e + 1`` pieces of words; one of them stands unchanged in every
   leak, at most ``e`` words away from its place.  Windows with a piece of an item
   in its place are candidates too, which brings the recall to 1.
5. *Verification.*  The exact word edit distance between the item and the best
   passage that starts at the window's start.

The benchmark is the stated query set.  It is used in blocks of about
``BLOCK_ITEMS`` bytes of text; blocks are assigned by a hash of the item, so a
larger benchmark only means more blocks.  A block's index is broadcast; with
several blocks, each one's results are written before the next one is sent.

Cases: null or empty texts and items match nothing; items with fewer than
``MIN_WORDS`` words must stand in the text word for word, as an edit would make
them a common phrase; repeated items and rows give one row for each (document,
item); of equally near passages the first counts; a very long text or item is
searched whole, in parts of bounded size; a null id is an id like others in
``leaks``; with an empty benchmark nothing leaks; other columns are ignored,
whatever their names (``decontaminate`` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.kernels import Words, blocks, by_batch, mix, utf8
from umbra.sources.scratch import written

TOLERANCE = 0.2
MIN_WORDS = 8
WALKS, SAMPLES, PICKS = 4, 12, 3
BLOCK = 2 << 20
#: Words of the windows that are looked up, or of the passages that are verified, at once.
AT_ONCE = 1 << 18
BLOCK_ITEMS = 2 << 20
_SALT, _PICK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9FB21C651E98DF25)
_END = np.uint64(0x1F83D9ABFB41BD6B)


def _edits(length: int, tolerance: float) -> int:
    return int(tolerance * length) if length >= MIN_WORDS else 0


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0xD1342543DE82EF95) + h[1:])


def _pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of an item."""
    bounds = [length * i // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _piece_keys(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place in ``at`` on."""
    key = np.full(at.size, n, np.uint64)
    for i in range(n):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(at + i, h.size - 1)])
    return key


def _walk_keys(tokens: np.ndarray, length: int) -> np.ndarray:
    """Keys, (windows, WALKS * SAMPLES), of windows of ``length`` word hashes each, (windows, length)."""
    rows, steps = len(tokens), 2 * length
    padded = np.concatenate((tokens, np.full((rows, 1), _END)), axis=1).ravel()
    row, keys = np.arange(rows) * (length + 1), np.empty((rows, WALKS * SAMPLES), np.uint64)
    rng = np.random.default_rng(length)
    for walk in range(WALKS):
        salts = mix((np.arange(steps, dtype=np.uint64) + np.uint64(1 + 100_003 * walk)) * _SALT) | np.uint64(1)
        copied, at = np.empty((steps, rows), np.uint64), np.zeros(rows, np.int64)
        for step in range(steps):
            word = padded[row + at]
            copied[step] = word
            at += ((word * salts[step]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, length, out=at)
        for s in range(SAMPLES):
            # a sum under odd multipliers, mixed once: all picked words must agree
            key = np.full(rows, walk * SAMPLES + s + 1, np.uint64)
            for p in np.sort(rng.choice(steps, min(PICKS, steps), replace=False)):
                key = key * _PICK + copied[p]
            keys[:, walk * SAMPLES + s] = mix(key)
    return keys


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges of ``n`` from ``first`` on, one range after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _best_passage(items: np.ndarray, passages: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: the least edit distance between the item and a beginning of the passage, and that beginning's length."""
    rows, length = items.shape
    width = passages.shape[1]
    before = np.tile(np.arange(width + 1), (rows, 1))
    for i in range(1, length + 1):
        now = np.empty_like(before)
        now[:, 0] = i
        lo, hi = max(1, i - edits - 1), min(width, i + edits + 1)
        now[:, 1:] = length + width
        diff = (passages[:, lo - 1 : hi] != items[:, i - 1 : i]).astype(np.int64)
        step = np.minimum(before[:, lo - 1 : hi] + diff, before[:, lo : hi + 1] + 1)
        left = now[:, 0] if lo == 1 else np.full(rows, length + width)
        for k in range(hi - lo + 1):
            left = np.minimum(step[:, k], left + 1)
            now[:, lo + k] = left
        before = now
    end = before.argmin(1)
    return before[np.arange(rows), end], end


class _Index:
    """Of one block of items: a table from word pair to item lengths, and sorted piece and sample keys for each length.

    A table entry has a bit for each class of lengths; with over 64 lengths several share a bit.
    """

    def __init__(self, items: list[tuple[int, str]], tolerance: float):
        self.tolerance = tolerance
        raw, off = utf8(pa.array([t for _, t in items], pa.string()))
        w = Words(raw, off, lower=True, alnum=True)
        by_length: dict[int, list] = {}
        for k, (item, _) in enumerate(items):
            h = w.hash[w.word_off[k] : w.word_off[k + 1]]
            if h.size:
                by_length.setdefault(h.size, []).append((item, h))
        n_pairs = sum(length * len(found) for length, found in by_length.items())
        self.shift = np.uint64(64 - max(16, math.ceil(math.log2(max(1, 16 * n_pairs)))))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        self.lengths = []
        for n, (length, found) in enumerate(sorted(by_length.items())):
            hashes = np.array([h for _, h in found])
            for h in hashes:
                self.table[(_pairs(h) >> self.shift).astype(np.int64)] |= np.uint64(1 << n % 64)
            cuts = _pieces(length, _edits(length, tolerance))
            tables = []
            for size in sorted({m for _, m in cuts}):
                begins = np.array([a for a, m in cuts if m == size])
                keys = _piece_keys(hashes.ravel(), (np.arange(len(found))[:, None] * length + begins).ravel(), size)
                order = np.argsort(keys, kind="stable")
                tables.append((size, keys[order], order // begins.size, begins[order % begins.size]))
            # an item without allowed edits is its own only piece
            walks = _walk_keys(hashes, length).ravel() if _edits(length, tolerance) else np.zeros(0, np.uint64)
            order = np.argsort(walks, kind="stable")
            self.lengths.append((np.uint64(1 << n % 64), length, np.array([i for i, _ in found]), hashes, tables, walks[order], order // (WALKS * SAMPLES)))

    def _starts(self, at: np.ndarray, length: int) -> np.ndarray:
        """Starts of windows of ``length`` words with enough of the word pairs that begin at ``at``."""
        need = max(1, length - 1 - 2 * _edits(length, self.tolerance))
        if at.size < need:
            return at[:0]
        first, last = at[: at.size - need + 1], at[need - 1 :]
        lo = np.maximum(last - (length - 2), 0)
        near = lo <= first
        lo, size = lo[near], (first - lo)[near] + 1
        return np.unique(_ranges(lo, size))

    def _candidates(self, h: np.ndarray, start: np.ndarray, length: int, n_items: int, tables: list) -> np.ndarray:
        """Pairs of a window (by its place in ``start``) and an item with a piece in its place, as place * n_items + item."""
        edits = _edits(length, self.tolerance)
        low = np.maximum(start - edits, 0)
        low[1:] = np.maximum(low[1:], start[:-1] + length + edits)  # every word of the windows once
        places = _ranges(low, np.maximum(np.minimum(start + length + edits, h.size) - low, 0))
        found = []
        for size, keys, owner, begins in tables:
            mine = _piece_keys(h, places, size)
            a, b = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = b - a
            hit = _ranges(a, n)
            zero = np.repeat(places, n) - begins[hit]
            a, b = np.searchsorted(start, zero - edits, "left"), np.searchsorted(start, zero + edits, "right")
            found.append(np.unique(_ranges(a, b - a) * n_items + np.repeat(owner[hit], b - a)))
        return np.unique(np.concatenate(found))

    def _sampled(self, h: np.ndarray, end: np.ndarray, start: np.ndarray, length: int, n_items: int, walks: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs of a window (by its place in ``start``) and an item that agree on a bit sample, as place * n_items + item."""
        at = start[:, None] + np.arange(length)
        own = np.where(at < end[start][:, None], h[np.minimum(at, h.size - 1)], _END)
        # copies make equal windows
        _, one, same = np.unique(window_sums(own), return_index=True, return_inverse=True)
        mine = _walk_keys(own[one], length)
        a, b = np.searchsorted(walks, mine.ravel(), "left"), np.searchsorted(walks, mine.ravel(), "right")
        n = b - a
        pairs = np.unique(np.repeat(np.arange(n.size) // (WALKS * SAMPLES), n) * n_items + owner[_ranges(a, n)])
        # of each distinct window to all its places
        first = np.searchsorted(pairs, np.arange(len(one) + 1) * n_items)
        many = (first[1:] - first[:-1])[same]
        return np.repeat(np.arange(start.size), many) * n_items + pairs[_ranges(first[:-1][same], many)] % n_items

    def search(self, w: Words, text: np.ndarray):
        """Rows (text, item, start word, words, distance) of a block's texts."""
        h, end = w.hash, w.word_off[1:][text]
        if not h.size:
            return
        masks = self.table[(_pairs(h) >> self.shift).astype(np.int64)]
        masks[text[:-1] != text[1:]] = 0
        known = np.flatnonzero(masks)
        masks = masks[known]
        for bit, length, items, hashes, tables, walks, owner in self.lengths:
            edits = _edits(length, self.tolerance)
            at_once = max(1, AT_ONCE // (length + edits))
            start = self._starts(known[(masks & bit) != 0], length) if length > 1 else np.flatnonzero(np.isin(h, hashes))
            for part in np.array_split(start, -(-start.size // at_once)) if start.size else ():
                both = self._candidates(h, part, length, len(items), tables)
                if walks.size:
                    both = np.union1d(both, self._sampled(h, end, part, length, len(items), walks, owner))
                for some in np.array_split(both, -(-both.size // at_once)) if both.size else ():
                    k, begin = some % len(items), part[some // len(items)]
                    wide = begin[:, None] + np.arange(length + edits)
                    passage = np.where(wide < end[begin][:, None], h[np.minimum(wide, h.size - 1)], _END)
                    far, size = _best_passage(hashes[k], passage, edits)
                    size = np.minimum(size, end[begin] - begin)
                    for x in np.flatnonzero(far <= edits):
                        s = int(begin[x])
                        yield int(text[s]), int(items[k[x]]), s - int(w.word_off[text[s]]), int(size[x]), int(far[x])


def window_sums(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of word hashes."""
    return (rows * (mix(np.arange(1, 1 + rows.shape[1], dtype=np.uint64)) | np.uint64(1))).sum(1)


def _scan(index):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(off, BLOCK):
                w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True, alnum=True)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for t, item, start, size, far in index.value.search(w, w.text_of_word()):
                    if (t, item) not in best or (far, start) < best[t, item][:2]:
                        best[t, item] = (far, start, size)
                ids = batch.column(0)[lo:hi].take(pa.array([t for t, _ in best], pa.int64()))
                yield pa.record_batch(
                    {
                        "id": ids,
                        "item_id": pa.array([i for _, i in best], pa.int64()),
                        "distance": pa.array([x[0] for x in best.values()], pa.int64()),
                        "start_word": pa.array([x[1] for x in best.values()], pa.int64()),
                        "n_words": pa.array([x[2] for x in best.values()], pa.int64()),
                    }
                )

    return run


def _drop(index, at: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(at))
            clean = np.ones(batch.num_rows, bool)
            for lo, hi in blocks(off, BLOCK):
                w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True, alnum=True)
                for t, *_ in index.value.search(w, w.text_of_word()):
                    clean[lo + t] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, tolerance: float):
    """For each block of items, whether there are more, and the block's broadcast index, which ends with its turn."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).dropna().distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_ITEMS))
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k)
        index = spark.sparkContext.broadcast(_Index(sorted(tuple(r) for r in part.collect()), tolerance))
        yield n_blocks > 1, index
        if n_blocks > 1:
            index.unpersist()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each (document, item) that leaks: ``id_col``, ``item_id``, ``distance`` in word edits, ``start_word``, ``n_words``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for more, index in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, tolerance):
        rows = own.mapInArrow(by_batch(_scan(index)), "id long, item_id long, distance long, start_word long, n_words long")
        rows = written(rows, "leaks") if more else rows
        found = rows if found is None else found.unionAll(rows)
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns and without a shuffle."""
    for more, index in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, tolerance):
        docs = docs.mapInArrow(by_batch(_drop(index, docs.columns.index(text_col))), docs.schema)
        docs = written(docs, "clean") if more else docs
    return docs
