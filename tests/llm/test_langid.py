import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import langid


@pytest.fixture(scope="module")
def net():
    texts = ["the cat sat on the mat and the dog " * 5, "le chat est sur la table et le chien " * 5,
             "der hund und die katze sind nicht hier " * 5]
    return langid.train(texts, ["en", "fr", "de"], rounds=120)


def plain_pool(net, data):
    """One segment at a time, one byte at a time."""
    def states(side, ids):
        h, out, w = np.zeros(net.width), [], net.width
        for b in ids:
            x, u = net.by_byte[side][:, b], net.recurrent[side] @ h
            stay, use = (1 / (1 + np.exp(-(x[k * w:(k + 1) * w] + u[k * w:(k + 1) * w]))) for k in (0, 1))
            new = np.tanh(x[2 * w:] + use * u[2 * w:])
            h = new + stay * (h - new)
            out.append(h)
        return np.array(out)

    total = np.zeros(len(net.languages))
    for part in langid.segments(data, langid.SEGMENT):
        both = np.concatenate([states(0, part), states(1, part[::-1])[::-1]], 1)
        z = both @ net.out.T + net.bias
        p = np.exp(z - z.max(1, keepdims=True))
        total += (p / p.sum(1, keepdims=True)).sum(0)
    return total / len(data)


def test_pooling_matches_a_plain_pass(net):
    texts = [b"the cat", b"x", ("le chien " * 40).encode(), "der Hund \U0001f600".encode() * 30]
    means, marks = langid.pooled(net, texts)
    for text, m, k in zip(texts, means, marks):
        assert np.allclose(m, plain_pool(net, text), atol=1e-4)
        assert k.sum() == len(text)


def test_gradients_match_differences():
    net = langid.Network.new(["a", "b", "c"], 4, 1)
    net.by_byte, net.recurrent = ([x.astype(float) for x in part] for part in (net.by_byte, net.recurrent))
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    ids, inside = langid.pack([b"hello w", b"abc", b"xyzzyx"])
    target = np.array([0, 2, 1])
    _, grads = net.gradients(ids, inside, target)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, diff = p[at], []
        for e in (1e-4, -1e-4):
            p[at] = old + e
            diff.append(net.gradients(ids, inside, target)[0])
        p[at] = old
        assert abs((diff[0] - diff[1]) / 2e-4 - g[at]) < 1e-5


def test_odd_rows(spark, odd, documents, net):
    docs = odd.withColumn("score", F.lit(1)).unionByName(documents([(50, "12 34 !!")]).withColumn("score", F.lit(1)))
    rows = langid.identify(docs, net).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["found"]["lang"] != "und") == letters and 0 <= r["found"]["score"] <= 1
        if letters:
            assert sum(r["found"]["positions"].values()) == len(r["text"].encode())
    assert langid.identify(documents([]), net).count() == 0
    assert {r["found"]["lang"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.fit(odd.filter("lang IS NULL")) is None


def test_a_language_of_long_texts_only_is_learnt(documents):
    rows = [(i, "the house and the garden of the king " * 600, "en") for i in range(30)]
    rows += [(100 + i, "le chien et la maison du roi", "fr") for i in range(30)]
    rows += [(None, "un deux", "fr"), (5, "other text of the same id", "en")]
    net = langid.fit(documents(rows), per_language=20, longest=50)
    assert net.languages == ["en", "fr"]
    found = langid.identify(documents([(900, "the king of the house"), (901, "la maison et le chien")]), net).collect()
    assert {r["doc_id"]: r["found"]["lang"] for r in found} == {900: "en", 901: "fr"}


def test_samples_are_the_lowest_hashes_of_each_language(spark, documents):
    docs = documents([(i, "x", "en" if i % 4 else "fr") for i in range(3000)] + [(1, "x", "en"), (None, "x", "de")])
    got = langid.sample_ids(docs.select("lang", "doc_id"), 40)
    rank = {r["id"]: r["h"] for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect()}
    for lang, ids in (("en", [i for i in rank if i % 4]), ("fr", [i for i in rank if i % 4 == 0])):
        assert [d for name, d in got if name == lang] == sorted(ids, key=rank.get)[:40]
    assert [d for name, d in got if name == "de"] == [None] and len(got) == 81
    assert "Window" not in docs.select("lang")._jdf.queryExecution().toString()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, per_language=150)
    rows = langid.identify(docs.filter(langid.held_out()), net).select("lang", F.col("found.lang").alias("p")).collect()
    assert np.mean([r["lang"] == r["p"] for r in rows]) >= 0.97
