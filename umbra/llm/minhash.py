"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join.

A signature has 40 fields of b = 16 bits, each the low bits of a MinHash of the
document's word shingles; its distance to another is the number of fields that
differ.  It is split into 10 chunks of 4 fields.  By pigeonhole, two signatures
at a distance of 19 or less have a chunk with at most one differing field, so
each chunk is indexed under its 4 variants with one field left out, and every
pair under the threshold meets in some index entry.  At a similarity of exactly
0.8 a pair exceeds distance 19 with a probability near 1e-5, and less above it.

Links are then confirmed on the full shingle sets.  No entry's pairs are listed:

1. documents with equal sets are one class, represented by its smallest id;
2. in each entry every representative is tried with the entry's smallest one.
   The components of those within the threshold are found.  An entry with more
   than one of them is compared further, by signature: the members outside its
   largest component with all members.  The connected *families* that result
   have no pair within the threshold across two of them;
3. the shingle sets of a family's members meet in blocks of ``COMPARE``, a few
   members (``PIVOTS``) in every block of the family.  A block reports the exact
   links that join its members.  In a family of several blocks, the members outside
   its largest component then meet all others.  A pair inside one component needs
   no trial, as it can't change the result.

Members outside the largest component are dealt to cells with blocks of it, so a
family or entry of n members with r outside makes about 2 n r / block rows.  Sets
are 64-bit hashes of shingles: in a cell of ten million two differing shingles
share one with a probability near 3e-6.

Cases: null and blank texts have no shingles and no links (``component_id`` is
their own id); fewer words than a shingle make one shingle; rows that repeat an
id count as one document whose links are those of any of its rows; rows without
an id are linked with nothing; equal texts form one class whatever their number; a very
long text counts as several members when blocks are dealt; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from umbra.llm.components import components, forest, joined
from umbra.llm.kernels import Words, blocks, by_batch, by_group, mix, utf8, window_hashes, window_starts
from umbra.sources.scratch import forget, written

WIDTH = 5
FIELDS, CHUNK, THRESHOLD = 40, 4, 19
COMPARE = 1024  # members of a block of shingle sets, of up to ``LOAD`` shingles each on average
LOAD = 2048
NEAR = 512  # members of a block of signatures
PIVOTS = 8
_SEEDS = mix(np.arange(1, FIELDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, FIELDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and their number by text."""
    w = Words(raw, off, lower=True)
    at, per_text = window_starts(w.word_off, width)
    h = window_hashes(w.hash, width)[at] if at.size else np.zeros(0, np.uint64)
    words = w.counts()
    if (few := np.flatnonzero((words > 0) & (words < width))).size:
        spot = (np.cumsum(per_text) - per_text)[few]
        seed = np.zeros(few.size, np.uint64)
        for k in range(width):
            more = k < words[few]
            seed[more] = mix(seed[more] * np.uint64(0x9FB21C651E98DF25) + w.hash[w.word_off[few[more]] + k])
        h = np.insert(h, spot, seed)
        per_text = per_text.copy()
        per_text[few] = 1
    ends = np.cumsum(per_text)
    for a, b in zip(ends - per_text, ends):
        h[a:b].sort()
    first = np.ones(h.size, bool)
    first[1:] = h[1:] != h[:-1]
    first[(ends - per_text)[per_text > 0]] = True
    return h[first], np.diff(np.concatenate(([0], np.cumsum(first)))[np.concatenate(([0], ends))])


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                h, n = _sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                some = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[some]
                sig = np.zeros((hi - lo, FIELDS), np.uint32)
                sums = np.zeros((2, hi - lo), np.uint64)
                if some.size:
                    for k in range(FIELDS):
                        sig[some, k] = np.minimum.reduceat(((h * _SEEDS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), start)
                    sums[0, some] = np.add.reduceat(mix(h), start)
                    sums[1, some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), start)
                sig16 = (mix(sig.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
                yield pa.record_batch(
                    {
                        "id": batch.column(0)[lo:hi],
                        "n_shingles": pa.array(n, pa.int64()),
                        "s1": pa.array(sums[0].view(np.int64)),
                        "s2": pa.array(sums[1].view(np.int64)),
                        "sig": pa.array([x.tobytes() for x in sig16], pa.binary()),
                    }
                )

    return run


def _fields(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, FIELDS)


def _entries(batches):
    """Index entries: for each chunk, its fields without one of them."""
    for batch in batches:
        sig = _fields(batch.column(1)).astype(np.uint64)
        keys = []
        for c in range(0, FIELDS, CHUNK):
            for out in range(CHUNK):
                k = np.full(len(sig), c + out + 1, np.uint64)
                for f in range(CHUNK):
                    if f != out:
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, c + f])
                keys.append(k.view(np.int64))
        yield pa.record_batch({"key": pa.array(np.concatenate(keys)), "id": pa.array(np.tile(batch.column(0).to_numpy(zero_copy_only=False), len(keys)))})


def _shingle_sets(width: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                h, n = _sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                ends = np.cumsum(n)
                data = h.astype("<u8")
                sets = pa.array([data[a:b].tobytes() for a, b in zip(ends - n, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([c[lo:hi] for c in (batch.column(0), *batch.columns[2:])] + [sets], names=["id", "family", "n", "shingles"])

    return run


def _postings(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed sets: sizes, start of each, shingle numbers, and for each number its owners (start, owner)."""
    sets = column.to_pylist()
    size = np.array([len(x) // 8 for x in sets], np.int64)
    _, number = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
    owner = np.repeat(np.arange(size.size), size)[np.argsort(number, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(number)))) if number.size else np.zeros(1, np.int64)
    return size, np.cumsum(size) - size, number, start, owner


def _joins(table, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component labels after, and exact links that join components, among the members of one block (side 2) or across two (0 and 1)."""
    side = table.column("side").to_numpy()
    label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
    size, at, number, start, owner = _postings(table.column("shingles").combine_chunks())
    links: list[tuple[int, int]] = []
    if np.unique(label).size > 1:
        common = np.concatenate(([0], np.cumsum(np.diff(start)[number])))
        kinds, many = np.unique(label, return_counts=True)
        base = int((common[at + size] - common[at]).argmax()) if many.max() == 1 else int(np.flatnonzero(label == kinds[many.argmax()])[0])
        # what is joined to the base needs no trials of its own: others try it
        for i in [base, *range(len(label))]:
            if i != base and label[i] == label[base]:
                continue
            mine = number[at[i] : at[i] + size[i]]
            n = start[mine + 1] - start[mine]
            both = np.bincount(owner[np.arange(int(n.sum())) + np.repeat(start[mine] - (np.cumsum(n) - n), n)], minlength=len(label))
            link = 100 * both >= percent * (size + size[i] - both)
            link &= label != label[i]
            if side[i] != 2:
                link &= side != side[i]
            for k in np.unique(label[link]):
                links.append((i, int(np.flatnonzero(link & (label == k))[0])))
                label[label == k] = label[i]
    return label, links


def _settle(percent: int):
    """Links from the smallest member of each component of a block to its others."""

    def run(table):
        label, _ = _joins(table, percent)
        ids = table.column("id").to_numpy()
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        low = least[label]
        apart = low != ids
        return pa.table({"u": pa.array(low[apart], pa.int64()), "v": pa.array(ids[apart], pa.int64())})

    return run


def _link(percent: int):
    def run(table):
        comp = table.column("comp").to_numpy()
        pairs = [sorted((comp[i], comp[j])) for i, j in _joins(table, percent)[1]]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _across(threshold: int):
    """Pairs of components with members within the threshold, among those of one block or across two."""

    def run(table):
        sig = _fields(table.column("sig").combine_chunks())
        comp, side = table.column("comp").to_numpy(), table.column("side").to_numpy()
        label = np.unique(comp, return_inverse=True)[1]
        kinds, many = np.unique(label, return_counts=True)
        base = int(np.flatnonzero(label == kinds[many.argmax()])[0])
        u, v = [], []
        for i in range(len(comp)):
            if label[i] == label[base]:
                continue
            near = (sig != sig[i]).sum(1) <= threshold
            near &= label != label[i]
            if side[i] != 2:
                near &= side != side[i]
            for k in np.unique(label[near]):
                j = int(np.flatnonzero(near & (label == k))[0])
                u.append(min(comp[i], comp[j]))
                v.append(max(comp[i], comp[j]))
                label[label == k] = label[i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _cells(rows: DataFrame, group: str, load: Column, block: int) -> DataFrame:
    """Rows (``group``, id, comp, ...) dealt to cells (i, j) so that every member outside its group's largest
    component meets all others once; groups of one component are left out.

    ``side`` is 0 or 1 for the first or second block of a cell, and 2 in a block of its own."""
    kinds = rows.groupBy(group, "comp").agg(F.sum(load).alias("n"))
    kinds = kinds.groupBy(group).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    kinds = kinds.select(group, F.col("main.comp").alias("main"), F.ceil(F.col("n") / block).alias("whole"), F.ceil(F.col("main.n") / block).alias("w"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("r"))
    rows = rows.join(kinds, group)
    main, one = F.col("comp") == F.col("main"), F.col("whole") == 1
    at = F.pmod(F.xxhash64("id", group), F.when(main, F.col("w")).otherwise(F.col("r")))

    def cell(i, j, side):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))

    def count(n):
        return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)

    # blocks of other components have numbers below 0 when they come first
    others = F.transform(count(F.col("r")), lambda k: cell(-1 - F.least(k, at), F.greatest(k, at), F.when(k == at, 2).when(at < k, 0).otherwise(1)))
    with_main = F.transform(count(F.col("w")), lambda k: cell(k, at, 1))
    dealt = F.when(one, F.array(cell(F.lit(0), F.lit(0), 2)))
    dealt = dealt.when(main, F.transform(count(F.col("r")), lambda k: cell(at, k, 0))).otherwise(F.concat(others, with_main))
    rows = rows.withColumn("cell", F.explode(dealt))
    return rows.select(*(c for c in rows.columns if c not in ("main", "whole", "w", "r", "cell")), "cell.i", "cell.j", "cell.side")


def _families(reps: DataFrame) -> DataFrame:
    """``(node, component)`` of the representatives (id, sig) that other ones are near, directly or by others."""
    entries = reps.select("id", "sig").mapInArrow(by_batch(_entries), "key long, id long")
    shared = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub <> top").select("key", "hub")
    met = entries.join(shared, "key").select("key", "hub", "id")
    near = reps.select("id", "sig")
    hubs = reps.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig"))
    met = met.join(near, "id").join(hubs, "hub").mapInArrow(by_batch(_within(THRESHOLD)), "key long, hub long, id long, near boolean")
    met = written(met, "met")
    family = written(components(met.filter("near and id <> hub").select("hub", "id"), "hub", "id"), "near")
    # an entry of two, or one whose members are all near its hub, can't join more
    open_ = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("all")).filter("n > 2 and not all").select("key")
    state = met.join(open_, "key").select("key", "id").join(family.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left")
    state = written(state.select("key", "id", F.coalesce("comp", "id").alias("comp")), "open")
    forget(met)
    far = _cells(state, "key", F.lit(1), NEAR).join(near, "id").select("key", "i", "j", "side", "comp", "sig")
    far = far.groupBy("key", "i", "j").applyInArrow(by_group(_across(THRESHOLD)), "u long, v long")
    far = written(far.mapInArrow(forest, "u long, v long"), "far", n=F.count(F.lit(1)))
    forget(state)
    if not far.observed["n"]:
        return family
    more = components(far)
    alone = more.select("node").join(family, "node", "left_anti").select("node", F.col("node").alias("component"))
    return written(joined(family.unionAll(alone), more), "families")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept`` (the smallest id of its component)."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(own.mapInArrow(by_batch(_sketch(width)), "id long, n_shingles long, s1 long, s2 long, sig binary"), "sketch")
    some = sketch.filter("n_shingles > 0 and id is not null")
    same = ["n_shingles", "s1", "s2"]
    classes = written(some.groupBy(*same).agg(F.min(F.struct("id", "sig")).alias("rep")), "classes")
    reps = classes.select("rep.id", "rep.sig", "n_shingles")
    of = classes.select(*same, F.col("rep.id").alias("rep"))
    member = written(some.select("id", *same).join(of, same).select("id", "n_shingles", "rep"), "member")
    twice = written(sketch.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "twice", n=F.count(F.lit(1)))

    family = _families(reps)
    family = family.select(F.col("node").alias("id"), F.col("component").alias("family")).join(reps.select("id", F.greatest(F.lit(1.0), F.col("n_shingles") / LOAD).alias("load")), "id")
    family = written(family.join(family.groupBy("family").agg(F.ceil(F.sum("load") / COMPARE).alias("n")), "family").select("id", "family", "n"), "family")
    # a plain merge join at every size: the text moves once, whatever the other side's size
    sought = own.hint("merge").join(family, "id").select("id", "text", "family", "n")
    sets = written(sought.mapInArrow(by_batch(_shingle_sets(width)), "id long, family long, n long, shingles binary").filter(F.length("shingles") > 0), "sets", large=F.max("n"))
    block = F.pmod(F.xxhash64("id", "family"), F.col("n"))
    single = sets.select("family", block.alias("block"), "id", "shingles")
    large = (sets.observed["large"] or 0) > 1
    if large:  # some members of a large family go to each of its blocks
        nth = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("id"), "id"))
        pivots = family.filter("n > 1").withColumn("k", nth).filter(F.col("k") <= PIVOTS).select("id", "family")
        pivots = sets.filter("n > 1").join(pivots, ["id", "family"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        single = single.unionAll(pivots.filter(F.col("block") != block).select("family", "block", "id", "shingles"))
    single = single.select("family", "block", "id", F.col("id").alias("comp"), F.lit(2).alias("side"), "shingles")
    links = single.groupBy("family", "block").applyInArrow(by_group(_settle(percent)), "u long, v long")
    if twice.observed["n"]:  # rows that repeat an id are parts of one document
        mine = member.join(twice, "id")
        links = links.unionAll(mine.join(mine.groupBy("id").agg(F.min("rep").alias("u")), "id").select("u", F.col("rep").alias("v")))
    final = components(links)
    if large:
        state = sets.filter("n > 1").join(final.withColumnsRenamed({"node": "id", "component": "comp"}), "id", "left")
        state = written(state.select("family", "id", F.coalesce("comp", "id").alias("comp"), "shingles"), "large")
        state = _cells(state, "family", F.greatest(F.lit(1.0), F.length("shingles") / (8 * LOAD)), COMPARE)
        more = state.select("family", "i", "j", "side", "comp", "shingles").groupBy("family", "i", "j").applyInArrow(by_group(_link(percent)), "u long, v long")
        more = components(more)
        alone = more.select("node").join(final, "node", "left_anti").select("node", F.col("node").alias("component"))
        final = joined(final.unionAll(alone), more)

    final = final.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    out = member.join(final, "rep", "left").select("id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    rest = sketch.filter("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    if twice.observed["n"]:  # an empty row may share its id with others
        known = member.join(twice, "id").groupBy("id").agg(F.min("rep").alias("rep")).join(final, "rep", "left")
        rest = rest.drop("component_id").join(known.select("id", F.coalesce("component_id", "rep").alias("component_id")), "id", "left")
    out = out.unionAll(rest.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("id"))).withColumnRenamed("id", id_col)


def _within(threshold: int):
    def run(batches):
        for batch in batches:
            near = (_fields(batch.column("sig")) != _fields(batch.column("hub_sig"))).sum(1) <= threshold
            yield pa.record_batch({**{c: batch.column(c) for c in ("key", "hub", "id")}, "near": pa.array(near)})

    return run
