import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa

import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_substrings
from tests.llm.test_models import brute_segments
from umbra.llm import toxicity
from umbra.llm.kernels import Words, utf8

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_toxicity(model, text):
    """The score of one text, from its words' scores, with segments by their definition."""
    w = Words(*utf8(pa.array([text or ""])), lower=True, alnum=True)
    scores = list(model.word_scores(toxicity._chain(w)))
    logs = [model.log_k + math.log(len(scores)) - model.lam * s for _, _, s in brute_segments(scores)] if any(x > 0 for x in scores) else []
    x = model.bias + model.slope * min(200.0, sum(-e for e in logs if e <= math.log(model.evalue)))
    return 1 / (1 + math.exp(-x))


def brute_mixing(rows, share=0.8):
    """Copies of each document, by raking in plain Python."""
    def cell(r):
        low = (r.text or "").lower()
        legal = any(x in low for x in ("licen", "copyright", "rights reserved"))
        return r.source or "", r.lang or "", "legal" if legal else "contact" if "@" in low or "phone" in low else "general"

    tokens = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    size, weight = defaultdict(int), {}
    for r in rows:
        size[cell(r)] += tokens[id(r)]
        weight[cell(r)] = 1.0
    for _ in range(60):
        for m in range(3):
            have, whole = defaultdict(float), defaultdict(float)
            for c, n in size.items():
                have[c[m]] += n * weight[c]
                whole[c[m]] += n
            for c in size:
                if have[c[m]] > 0:
                    weight[c] *= whole[c[m]] ** 0.7 / have[c[m]]
    level = share * sum(size.values()) / sum(n * weight[c] for c, n in size.items())
    copies = Counter()
    for r in rows:
        e = level * weight[cell(r)]
        e = e if tokens[id(r)] else min(1.0, e)
        draw = int(hashlib.md5(f"{r.doc_id}mix".encode()).hexdigest()[:13], 16) / 2**52
        copies[r.doc_id] += math.floor(e) + (draw < e - math.floor(e))
    return Counter({d: n for d, n in copies.items() if n})


def test_every_stage_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_before, before = docs, {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / str(k))
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == COLUMNS
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.train_toxicity(docs_before, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.fit_rows("doc_id", 3, 1))
            short = {d: r.text for d, r in before.items() if len((r.text or "").split()) <= 60}
            assert {d for d in after if d in short} == {d for d, t in short.items() if brute_toxicity(model, t) < 0.7}
            assert len(before) * 0.7 < len(after) < len(before)
        elif name == "near_dedup":
            want = {d for d, _, _, kept in brute_components([(d, r.text) for d, r in before.items()], width=5) if kept}
            assert set(after) == want
        elif name == "substring_dedup":
            want = {d: n - gone for d, n, gone, _ in brute_substrings([(d, r.text) for d, r in before.items()])}
            assert {d: len(r.text.split()) for d, r in after.items()} == want
        elif name == "decontamination":
            assert not [d for d, r in after.items() if any(i in r.text for i in items)]
            clean = {d for d, r in before.items() if not any(set(zip(i.lower().split(), i.lower().split()[1:])) & set(zip(r.text.lower().split(), r.text.lower().split()[1:])) for i in items)}
            assert clean <= set(after)
        elif name == "mixing":
            assert Counter(r.doc_id for r in docs.collect()) == brute_mixing(list(before.values()))


def test_stages_take_awkward_rows(spark, make_docs, awkward):
    docs = make_docs(awkward).select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() >= 0, name


def test_stages_take_empty_tables(spark, make_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, make_docs([]).select(*COLUMNS), "/root/testdata/sf0.001")
        assert out.collect() == [] and set(COLUMNS) <= set(out.columns), name
