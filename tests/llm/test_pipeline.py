"""The pipeline's stages on a small corpus, and the registration of the queries."""

import re

import pytest

from conftest import SF001

from tabflow.llm import byte_bpe


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    import random
    r = random.Random(1)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t, toxic = text(60), i % 5 == 0
        if toxic:
            t = t.replace(" ", " idiot ", 2) + " moron scum"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(toxic)))
    item = text(30)
    first = docs[1][1]
    extra = [first, first + " tail", f"{text(5)} {item}", "write to jo.doe@mail.example.com now please", None, ""]
    docs += [(1000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(extra)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in docs}


def test_stages(spark, corpus):
    import corpus_pipeline
    folder, docs = corpus
    stage = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    a = stage["toxicity"](spark, df, folder)
    left = {r["doc_id"] for r in a.collect()}
    assert a.columns == df.columns
    assert {i for i in range(300) if i % 5} <= left and not {i for i in range(0, 300, 5)} & left
    b = stage["ngram_jaccard_join"](spark, df, folder)
    gone = set(docs) - {r["doc_id"] for r in b.collect()}
    assert b.columns == df.columns and gone == {1000, 1001}
    c = stage["benchmark_decontamination"](spark, df, folder)
    assert c.columns == df.columns and set(docs) - {r["doc_id"] for r in c.collect()} == {1002}
    d = {r["doc_id"]: r for r in stage["personal_data"](spark, df, folder).collect()}
    assert set(d) == set(docs) and d[1003]["text"] == "write to [EMAIL] now please" and d[1003]["n_chars"] == 27
    assert d[7] == df.where("doc_id = 7").first() and d[1004]["text"] is None
    e = {r["doc_id"]: r for r in stage["byte_bpe"](spark, df, folder).collect()}
    codec = byte_bpe.codec(byte_bpe.rank_path())
    assert all(codec.decode(e[i]["ids"]) == (docs[i][1] or "").encode() for i in docs)


def test_run(spark, corpus):
    import corpus_pipeline
    folder, docs = corpus
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids == (set(docs) - set(range(0, 300, 5)) - {1000, 1001, 1002})


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries
    names = set(queries())
    assert {f"op{i}" for i in range(1, 14)} == {m.group() for n in names if (m := re.match(r"op\d+(?=_)", n))}
    assert "pipeline" in names and set(oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op2_toxicity", "op5_token_counts", "op7_token_packing", "op9_byte_bpe"])
def test_queries_cover_every_row(spark, name):
    from __spark_entry__ import queries
    rows = queries()[name](spark, SF001).collect()
    ids = {i for r in rows for i in (r["doc_ids"] if name.startswith("op7") else [r["doc_id"]])}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id").collect()}
