import corpus_pipeline


def shares(rows, at):
    total = sum(r[3] for r in rows)
    return {v: sum(r[3] for r in rows if r[at] == v) / total for v in {r[at] for r in rows}}


def test_sample_meets_the_targets(spark, make_docs):
    docs = []
    for k in range(6000):
        topic = "phone" if k % 61 == 0 else "license" if k % 23 == 0 else "words"
        docs.append((k, " ".join([topic, *["x"] * (k % 7)]), "en" if k % 10 else ("de", "es")[k % 20 // 10], "a" if k % 17 else "b"))
    before = [(r.source, r.lang, {"phone": "contact", "license": "legal", "words": "general"}[r.text.split()[0]], len(r.text.split())) for r in make_docs(docs).collect()]
    got = [(r.source, r.lang, r.mix_topic, r.mix_tokens) for r in corpus_pipeline.mixing(spark, make_docs(docs), "").collect()]
    assert abs(sum(r[3] for r in got) / sum(r[3] for r in before) - 0.8) < 0.03
    for at in range(3):
        raised = {v: s**0.7 for v, s in shares(before, at).items()}
        for v, share in shares(got, at).items():
            assert abs(share - raised[v] / sum(raised.values())) < 0.015, (v, share)
