import zlib

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import toxicity


def plain_score(model, text):
    z = model.intercept + sum(model.weights.get(g, 0.0) for g in toxicity.features(text))
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_scores_match_brute_force(spark, odd):
    model = toxicity.Model({"wo": 1.5, " w": -0.25, "ord ": 0.5, "é": 1.0, "xx": -2.0}, -1.0)
    texts = {r["text"] or "" for r in odd.collect()}
    got = {(r["text"] or "", round(r["score"], 9)) for r in toxicity.score_documents(odd, model).collect()}
    assert got == {(t, round(float(plain_score(model, t)), 9)) for t in texts}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels, per_class=600)
    rows = (toxicity.score_documents(docs.join(labels, "doc_id").filter(toxicity.held_out()), model)
            .select((F.col("score") >= 0.3).cast("int").alias("p"), "toxic").collect())
    toxic = [r["p"] for r in rows if r["toxic"] == 1]
    clean = [r["p"] for r in rows if r["toxic"] == 0]
    # 300 positive rows over four languages to learn from, some of them without any mark of their own
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.005


def test_held_out_rows_are_those_of_the_contract(spark):
    rows = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    docs = documents([(i, "bad word" if i % 2 else "good day") for i in range(200)])
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    schema = "doc_id long, toxic int"
    a = toxicity.fit(docs, spark.createDataFrame(labels, schema))
    b = toxicity.fit(docs, spark.createDataFrame(flipped, schema))
    assert a == b and a.weights


def test_long_and_missing_texts_do_not_shrink_the_sample(spark, documents):
    docs = documents([(i, ("bad word " if i % 2 else "good day ") * 300) for i in range(400)] + [(1, ""), (3, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id int, toxic int")
    model = toxicity.fit(docs, labels, per_class=50, longest=40)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(
        documents([(1, "bad word"), (2, "good day")]), model).collect()}
    assert scores[1] > 0.3 > scores[2]


def test_without_labels_or_one_class(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 1e-6 for r in toxicity.score_documents(odd, toxicity.fit(odd, none)).collect())
    clean = spark.createDataFrame([(i, 0) for i in range(9)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    assert all(r["score"] < 0.3 for r in toxicity.score_documents(odd, toxicity.fit(odd, clean)).collect())
    assert toxicity.score_documents(documents([]), toxicity.Model()).count() == 0
