from pyspark.sql import functions as F

from umbra.llm import langid


def test_a_rare_language_is_learnt(make_docs):
    common = [(k, f"the house and the garden number{k % 7} are over there", "en") for k in range(600)]
    rare = [(1000 + k, "şu ağaç çok güzel değil mi öyle görünüyor", "tr") for k in range(4)]
    docs = make_docs(common + rare)
    model = langid.train_languages(docs, F.lit(True), limit=60)
    assert model.languages == ["en", "tr"]
    got = langid.identify_languages(docs, model).collect()
    assert {r.doc_id for r in got if r.lang_pred == "tr"} == {1000, 1001, 1002, 1003}


def test_document_frequencies_count_all_rows(make_docs):
    docs = make_docs([(k, "aaa" if k else "zzz", "en") for k in range(300)])
    model = langid.train_languages(docs, F.lit(True), limit=20)
    idf = {c: model.idf[langid.grams(langid.np.array([ord(c)], langid.np.uint32))[0]] for c in "az"}
    assert abs(idf["a"] - 1 - langid.np.log(301 / 300)) < 1e-9 and abs(idf["z"] - 1 - langid.np.log(301 / 2)) < 1e-9
