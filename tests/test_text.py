"""Text weights and embeddings against numpy."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabflow.operators import text as TX
from tabflow.operators.pipeline import Preprocessor, PreprocessorConfig, PreprocessorModel


def _texts(n=200):
    r = random.Random(3)
    topics = [[f"w{t}{i}" for i in range(25)] for t in range(5)]
    return [(i, " ".join(r.choices(topics[i % 5], k=12) + r.choices(topics[(i // 5) % 5], k=3)) + ", Été 漢字!") for i in range(n)]


def _matrix(texts, names, idf):
    place = {t: i for i, t in enumerate(names)}
    a = np.zeros((len(texts), len(names)))
    for k, (_, t) in enumerate(texts):
        for w in t.lower().replace(",", " ").replace("!", " ").split():
            if w in place:
                a[k, place[w]] += 1
    a *= np.array(idf)
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1)


def test_weights_equal_the_formula(spark):
    docs = [(1, "a b B"), (2, "b c"), (3, "a, a-a d"), (4, None), (5, " . ")]
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    got = {(r["id"], r["term"]): r["tfidf"] for r in TX.term_weights(df, "text", "id").collect()}
    words = {1: "a b b", 2: "b c", 3: "a a a d"}
    seen = Counter(w for t in words.values() for w in set(t.split()))
    want = {(i, w): t.split().count(w) * math.log(6 / (seen[w] + 1)) for i, t in words.items() for w in set(t.split())}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_factors_equal_numpy(spark):
    texts = _texts()
    df = spark.createDataFrame(texts, "id int, text string").repartition(4)
    table, values = TX.fit_embedding(df, "text", 6)
    rows = table.collect()
    a = _matrix(texts, [r["term"] for r in rows], [r["idf"] for r in rows])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:6], rtol=2e-2) and np.allclose(values[:5], s[:5], rtol=1e-4)
    v = np.array([r["vec"] for r in rows])
    # the same five-dimensional space (the values in it lie close together)
    assert np.linalg.svd(vt[:5] @ v[:, :5])[1].min() > 0.999
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    out = {r["id"]: r["e"] for r in df.select("id", TX.embedding(table, "text", 6).alias("e")).collect()}
    assert np.allclose([out[i] for i, _ in texts], a @ v, atol=1e-12)


def test_vocabulary_is_exact_and_bounded(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "b c a"), (3, "c b")], "id int, text string")
    names, idf = TX.vocabulary(df, "text", max_terms=2)
    assert names == ["b", "a"] and np.allclose(idf, [math.log(4 / 4), math.log(4 / 3)])
    assert TX.fit_embedding(df.limit(0), "text", 3)[1] == []
    empty, values = TX.fit_embedding(spark.createDataFrame([(1, None), (2, "")], "id int, text string"), "text", 3)
    assert empty.count() == 0 and values == []


def test_stage_of_the_pipeline_survives_reload(spark, tmp_path):
    rows = [(i, t, float(i % 5)) for i, t in _texts()]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "id int, note string, y double")
    cfg = PreprocessorConfig(target="y", keep_columns=["id"], text_features=True, text_dims=4)
    model = Preprocessor(cfg).fit(df.where("id < 150"))
    assert [c for c in model.feature_columns if c.startswith("note_emb_")]
    out = model.transform(df)
    model.save(str(tmp_path / "pre"))
    again = PreprocessorModel.load(spark, str(tmp_path / "pre")).transform(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert set(out.where("id = 999").select(*[c for c in out.columns if "_emb_" in c]).first()) == {0.0}
    assert not [c for c in Preprocessor(PreprocessorConfig(target="y")).fit(df).feature_columns if "_emb_" in c]


def test_weights_of_terms_that_are_not_shipped_and_of_repeated_keys(spark, monkeypatch):
    docs = [(1, "a b B"), (1, "b c"), (2, "a, a-a d"), (3, "a b c e e"), (None, "b x"), (None, "x")]
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    words = {1: "a b b b c", 2: "a a a d", 3: "a b c e e", None: "b x x"}
    seen = Counter(w for t in words.values() for w in set(t.split()))
    want = {(i, w): (t.split().count(w), seen[w], t.split().count(w) * math.log(7 / (seen[w] + 1)))
            for i, t in words.items() for w in set(t.split())}
    for shipped in (0, 1, 2, 9):
        monkeypatch.setattr(TX, "BROADCAST_TERMS", shipped)
        got = [tuple(r) for r in TX.term_weights(df, "text", "id").collect()]
        assert len(got) == len(want)
        assert all(want[k, w][:2] == (tf, n) and abs(want[k, w][2] - x) < 1e-12 for k, w, tf, n, x in got)


def test_weights_are_counted_where_the_texts_lie(spark):
    df = spark.createDataFrame(_texts(), "id int, text string")
    plan = TX.term_weights(df, "text", "id").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    # the texts move once; before, the rows of (text, term) moved for their counts, for the lookup and by text
    assert plan.count("Exchange hashpartitioning") == 1


def test_steps_do_not_read_the_terms_again(spark, monkeypatch):
    kept = []
    cut = TX.cut_lineage
    monkeypatch.setattr(TX, "cut_lineage", lambda df: kept.append(df.dtypes) or cut(df))
    TX.fit_embedding(spark.createDataFrame(_texts(), "id int, text string"), "text", 3)
    assert not [t for t in kept[:-1] if "array<string>" in dict(t).values()]
