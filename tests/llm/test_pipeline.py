import hashlib
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from pagemill.llm import bpe, simhash, toxicity
from pagemill.llm.common import read_table
from test_decontam import brute as contaminated
from test_simhash import classes, plain_fingerprint
from test_toxicity import plain_score

SMALL = "/root/testdata/sf0.001"


def plain_run(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in read_table(spark, sf_dir, "documents").collect()]
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    docs = [d for d in docs if plain_score(model, d[1]) < toxicity.THRESHOLD]
    best = {}
    for d in sorted(docs, key=lambda d: (-len(d[1]), d[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d[1]), d)
    docs = sorted(best.values())
    docs = [docs[i] for i in sorted(set(classes([plain_fingerprint(t) for _, t in docs], 2)))]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()]
    bad = {r[0] for r in contaminated(docs, items) if r[4]}
    path, pattern = bpe.default_vocabulary()
    enc = bpe.encoder(path, pattern)
    out = []
    for doc_id, text in docs:
        if doc_id not in bad:
            ids = enc.encode(text).tolist()
            out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_run_matches_brute_force(spark):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert rows == plain_run(spark, SMALL)
    assert 0 < len(rows) < read_table(spark, SMALL, "documents").count()


def test_stages_keep_columns_and_take_odd_rows(spark, odd, documents):
    from pyspark.sql import functions as F
    docs = odd.withColumn("toxicity_score", F.lit(1)).withColumn("bad_key", F.lit(2)).withColumn("keep_id", F.lit(3))
    for docs_in in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_in, SMALL)
            assert out.columns == docs_in.columns, name
            assert out.count() <= docs_in.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs_in, SMALL).count() == docs_in.count()


def rows_of_batches(df):
    sizes = df.coalesce(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    return [r["n"] for r in sizes.collect()]


@pytest.mark.parametrize("step", [
    lambda docs: toxicity.score_documents(docs, toxicity.Model()),
    lambda docs: simhash.fingerprints(docs),
    lambda docs: bpe.encode(docs, *bpe.default_vocabulary()),
], ids=["toxicity", "simhash", "bpe"])
def test_python_steps_bound_the_rows_of_a_batch(spark, step):
    """A session that says nothing gets the library's batches; one that does keeps its own."""
    for given, most in ((None, 500), (700, 700)):
        session = spark.newSession()
        if given:
            session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
        docs = session.range(1500).selectExpr("id AS doc_id", "'a text' AS text")
        step(docs)
        assert max(rows_of_batches(docs)) == most
