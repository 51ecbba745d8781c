import random
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from umbra.llm import decontamination, langid, quality, registry, toxicity
from umbra.llm.kernels import Words, blocks, utf8


def brute_segments(scores):
    """Ruzzo-Tompa's maximal segments by their recursive definition."""
    if not len(scores):
        return []
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            # of equal sums the shortest counts
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    a, b, s = best
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]
    return [*left, (a, b, s), *right]


def test_maximal_segments():
    r = random.Random(5)
    for _ in range(200):
        scores = np.array([r.choice([-1.37, -0.71, 0.53, 1.19, 2.31]) + r.random() / 1000 for _ in range(r.randrange(14))])
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(list(scores))]


def test_toxicity_held_out():
    r = random.Random(2)
    clean = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnrst"]
    rows = []
    for i in range(400):
        w = r.choices(clean, k=r.randrange(20, 200))
        y = int(i % 4 == 0)
        if y:
            at = r.randrange(len(w))
            w[at:at] = [f"vilex{r.choice(clean)}" for _ in range(4)]
        rows.append((" ".join(w), y))
    m = toxicity.fit(rows[:300])
    scores = []
    b = pa.record_batch({"id": pa.array(range(100)), "text": pa.array([t for t, _ in rows[300:]])})
    out = next(toxicity._apply(type("B", (), {"value": m}))([b]))
    scores = out.column("score").to_numpy()
    y = np.array([v for _, v in rows[300:]])
    assert ((scores >= 0.7) == y).mean() > 0.97
    for text, found in zip([t for t, _ in rows[300:]], out.column("passages").to_pylist()):
        for p in found:
            assert any(x.startswith("vilex") for x in text.split()[p["start_word"] : p["end_word"]])
    assert toxicity.fit([("a b c d e f g h", 0)] * 8) is None


def test_toxicity_awkward(spark, make_docs, awkward):
    docs = make_docs(awkward)
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels, toxicity.fit_rows("doc_id", 3, 1))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(docs, model).schema == docs.schema
    assert toxicity.score_toxicity(make_docs([]), None).collect() == []


def test_quality_held_out_and_spark_expression(spark):
    rows = registry.op4_quality_rules(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert len(rows) == 1000 and len(held) > 30 and np.mean([p == y for p, y in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_rules_are_the_same_in_spark(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    m = quality.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([v[0] for v in df.select(m.score()).collect()])
    want = m.bias + sum(w * quality._holds(rule, x) for rule, w in m.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and ((got > 0.5) == y).mean() > 0.95
    assert 0 < len(m.rules) < len(quality.grow_rules(x, y))


def test_quality_awkward(spark, make_docs, awkward):
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(make_docs(awkward), labels, toxicity.fit_rows("doc_id", 5, 0)).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    raw, off = utf8(pa.array(["a a a b\nx\nx\n", "", "Q!"]))
    s = dict(zip(quality.STATISTICS, quality.statistics_of(raw, off).T))
    assert np.allclose(s["adjacent_repeats"], [3 / 6, 0, 0]) and np.allclose(s["top_word"], [0.5, 0, 1])
    assert np.allclose(s["repeated_lines"], [1 / 3, 0, 0]) and np.allclose(s["upper"], [0, 0, 0.5])


def test_languages(spark, make_docs, awkward):
    rows = registry.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(rows) == 1000 and np.mean(held) > 0.95
    docs = make_docs(awkward)
    got = langid.identify_languages(docs, langid.train_languages(docs, toxicity.fit_rows("doc_id", 5, 0))).collect()
    blank = [r for r in got if r.doc_id in (1, 2, 3)]
    assert len(got) == len(awkward) and all((r.lang_pred, r.score) == ("und", 0.0) for r in blank)
    assert langid.identify_languages(make_docs([(1, "abc")]), None).first().lang_pred == "und"
    raw, off = utf8(pa.array(["\U0001f600 12"]))
    assert not langid.letters(raw, off)[0].any()
    raw, off = utf8(pa.array(["Ab, cÉ!", "12", "\U00020000x"]))
    points, to = langid.letters(raw, off)
    assert [[int(p) for p in points[a:b]] for a, b in zip(to[:-1], to[1:])][0][:3] == [97, 98, 0]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_decontamination_recall_and_exactness():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(14, 60)))) for i in range(40)]
    index = decontamination._Index(items, decontamination.TOLERANCE)
    texts, want = [], []
    for i, t in items * 3:
        w = t.split()
        for _ in range(int(r.choice([0, 0.05, 0.1, 0.15]) * len(w))):
            p = r.randrange(len(w))
            kind = r.randrange(3)
            w[p : p + (kind != 1)] = [r.choice(vocab)] if kind < 2 else []
        base = r.choices(vocab, k=r.randrange(200))
        p = r.randrange(len(base) + 1)
        texts.append(" ".join([*base[:p], *w, *base[p:]]))
        want.append(i)
    texts += [" ".join(r.choices(vocab, k=300)) for _ in range(50)]
    raw, off = utf8(pa.array(texts))
    found = set()
    for lo, hi in blocks(off):
        w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True, alnum=True)
        for t, item, start, size, far in index.search(w, w.text_of_word()):
            found.add((t + lo, item))
            own, wanted = texts[t + lo].split()[start : start + size], dict(items)[item].split()
            assert edit_distance(own, wanted) == far <= decontamination.TOLERANCE * len(wanted)
    assert np.mean([(k, i) in found for k, i in enumerate(want)]) >= 0.98
    assert not [f for f in found if f[0] >= len(want)]


def test_decontamination_awkward(spark, make_docs, awkward):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), *[(4, " ".join(awkward[8][1].split()[:40]))] * 2], "item_id long, text string")
    got = decontamination.leaks(make_docs(awkward), items).collect()
    # an item of two words leaks where it stands word for word
    short = {(d, 3, 0) for d, t, *_ in awkward if t and "one two" in t}
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=repr) == sorted([(7, 4, 0), (8, 4, 0), *short], key=repr)
    kept = decontamination.decontaminate(make_docs(awkward), items)
    assert kept.count() == len([t for _, t, *_ in awkward if not t or "one two" not in t]) - 2 and kept.columns == make_docs([]).columns
    assert decontamination.leaks(make_docs([]), items).collect() == []
    assert decontamination.leaks(make_docs(awkward), items.limit(0)).collect() == []


def brute_leaks(docs, items, tolerance=decontamination.TOLERANCE):
    """(document, item, least distance) by trying every passage."""
    found = {}
    for d, t in docs:
        w = t.lower().split()
        for i, x in items:
            v = x.lower().split()
            most = int(tolerance * len(v)) if len(v) >= decontamination.MIN_WORDS else 0
            far = min((edit_distance(v, w[a:b]) for a in range(len(w)) for b in range(a + max(1, len(v) - most), min(len(w), a + len(v) + most) + 1)), default=99)
            if far <= most:
                found[d, i] = far
    return found


def test_leaks_equal_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 150)  # several blocks of items
    monkeypatch.setattr(decontamination, "AT_ONCE", 40)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=n))) for i, n in enumerate([1, 2, 4, 6, 7, 8, 10, 12, 15, 15])]
    docs = []
    for d in range(30):
        w = r.choices(vocab, k=r.randrange(3, 25))
        v = r.choice(items)[1].split()
        for _ in range(r.randrange(4)):
            p = r.randrange(len(v))
            v[p : p + r.randrange(2)] = r.choices(vocab, k=r.randrange(2))
            v = v or ["w0"]
        p = r.randrange(len(w))
        docs.append((d, " ".join([*w[:p], *v, *w[p:]])))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontamination.leaks(make_docs(docs), table).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 20
    kept = {x.doc_id for x in decontamination.decontaminate(make_docs(docs), table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_bit_samples_of_walks_find_light_edits():
    """The embedding alone, without pieces, at half the tolerance."""
    r, found = random.Random(6), 0
    for k in range(60):
        item = np.array([r.getrandbits(63) for _ in range(40)], np.uint64)
        w = item.tolist()
        for _ in range(4):
            p = r.randrange(len(w))
            w[p : p + r.randrange(2)] = [r.getrandbits(63)] * r.randrange(2)
        w = np.array((w + [r.getrandbits(63) for _ in range(40)])[:40], np.uint64)
        a, b = decontamination._walk_keys(np.stack([item, w]), 40)
        found += bool((a == b).any())
    assert found >= 54


def test_all_exact_leaks_of_the_smallest_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in registry.op9_benchmark_decontamination(spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got


def test_segments_take_linear_time():
    began = time.process_time()
    assert len(toxicity.maximal_segments(np.tile([1.0, -1.5], 100_000))) == 100_000
    assert len(toxicity.maximal_segments(np.tile([1.5, -1.0], 100_000))) == 1
    assert len(toxicity.maximal_segments(np.concatenate((np.tile([1.0, -0.5], 50_000), np.tile([0.5, -1.0], 50_000))))) > 1
    assert time.process_time() - began < 3


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op10_toxicity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(rows) == 10_000 and np.mean(toxic) >= 0.82 and np.mean(clean) <= 0.01


def test_labelled_texts_are_bounded(spark, make_docs):
    docs = make_docs([(1, f"text {i % 3}") for i in range(10_000)] + [(i, "x" * i) for i in range(2, 60)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 1_000).collect()
    assert sorted(r.id for r in rows) == list(range(1, 60)) and [r.text for r in rows if r.id == 1] == ["text 0"]
    batch = pa.record_batch({"id": ["1", "2", "3"], "text": ["abcd", "é" * 9, "xyz"], "label": [0, 1, 0]})
    assert [r[0] for r in toxicity.within_bytes([batch, batch], 10)] == ["1", "3", "3"]


def test_models_on_repeated_ids_and_empty_tables(spark, make_docs):
    r = random.Random(9)
    rows = [(1, "same text here", "en")] * 5_000
    rows += [(i, " ".join(r.choices(["abc", "bcd", "cde"] if i % 2 else ["xyz", "zyx", "yyz"], k=12)) + (" ##" * (i % 2)), "en" if i % 2 else "de") for i in range(2, 200)]
    rows += [(1, "other words", None), (None, "xyz", "fr")]
    docs = make_docs(rows)
    model = langid.train_languages(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    got = langid.identify_languages(docs, model).collect()
    assert len(got) == len(rows) and np.mean([x.lang_pred == lang for x, (_, _, lang) in zip(got, rows) if lang]) > 0.98
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, labels, F.lit(True)).collect()
    assert len(scored) == len(rows)
    assert np.mean([(x.score >= 0.5) == x.doc_id % 2 for x in scored if x.doc_id and x.doc_id > 1]) > 0.95
    empty, none = make_docs([]), labels.limit(0)
    assert langid.train_languages(empty, F.lit(True)) is None
    assert langid.identify_languages(empty, model).collect() == []
    assert quality.score_quality(empty, labels, F.lit(True)).collect() == []
    assert {x.score for x in quality.score_quality(make_docs(rows[-5:]), none, F.lit(True)).collect()} == {0.0} or max(x.score for x in quality.score_quality(make_docs(rows[-5:]), none, F.lit(True)).collect()) < 1e-9
    assert toxicity.train_toxicity(docs, none, F.lit(True)) is None
    assert {x.score for x in toxicity.score_toxicity(docs.limit(3), None).collect()} == {0.0}
