import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        ws, covered, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(window, len(iw))
            for j in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[j:j + n]:
                        covered |= set(range(p, p + n))
                        ids.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(ws), len(covered), tuple(sorted(ids)),
                    bool(covered) and 20 * len(covered) >= len(ws)))
    return sorted(out, key=repr)


def got(docs, bench):
    rows = decontam.contamination(docs, bench).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"])
                   for r in rows], key=repr)


@pytest.fixture(scope="module")
def bench(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, "short item, Two"), (3, None), (4, "... !!"), (5, "the " * 13), (None, "école École x"),
            (6, text), (7, "zero never anywhere")]
    return rows, spark.createDataFrame(rows, "item_id int, text string")


def test_matches_brute_force(spark, documents, bench):
    rows, table = bench
    w = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join(w)), (2, "x " * 300 + " ".join(w[:13])), (3, " ".join(w[:12])), (4, "SHORT item? two"),
            (5, "the " * 40), (6, "a école École x b"), (6, "a école École x b"), (7, None), (8, ""),
            (None, " ".join(w[3:18])), (9, "pre " + " ".join(w[5:]) + " mid " + " ".join(w[:14]) + " short item two"),
            (10, " ".join(w[:7] + ["gap"] + w[7:])), (11, "y " * 100_000), (12, "École école x")]
    assert got(documents(docs), table) == brute(docs, rows)


def test_proximity_counts_near_phrases(spark, documents, bench):
    w = [f"w{i}" for i in range(20)]
    docs = documents([(1, " ".join(w[:7] + ["gap"] + w[7:])), (2, "w1 nothing else")])
    near = {r["doc_id"]: r["n_near"] for r in decontam.contamination(docs, bench[1]).collect()}
    assert near[1] >= 1 and near[2] == 0


def near(docs, items, window=13, lists=2, slop=3):
    """The number of items of which some window's rarest present terms stand near where the phrase has them."""
    texts = [(doc_id, words(text)) for doc_id, text in docs]
    count = {}
    for _, ws in texts:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    out = []
    for doc_id, ws in texts:
        met = 0
        for iw in {(str(i), tuple(words(t))) for i, t in items}:
            iw, n = iw[1], min(window, len(iw[1]))
            for j in range(len(iw) - n + 1 if n else 0):
                rare = sorted((count[iw[a]], a) for a in range(j, j + n) if iw[a] in count)[:lists]
                if len(rare) < min(lists, n):
                    continue
                shifts = [{s for p, w in enumerate(ws) if w == iw[a] for s in range(p - a - slop, p - a + slop + 1)}
                          for _, a in rare]
                if set.intersection(*shifts):
                    met += 1
                    break
        out.append((doc_id, met))
    return sorted(out, key=repr)


def test_proximity_matches_brute_force(spark, documents, bench):
    import random
    r = random.Random(4)
    w = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:5] + ["new"] + w[6:])), (3, "short thing two"), (4, "item two short"),
            (5, None), (6, "never x zero"), (7, "never " + "x " * 9 + "zero"), (8, "the the x the"), (None, "two item")]
    for i in range(40):
        piece = w[r.randrange(10):][:r.randrange(2, 14)]
        for _ in range(r.randrange(3)):
            piece.insert(r.randrange(len(piece)), r.choice(["gap", "the", "item"]))
            piece.pop(r.randrange(len(piece)))
        docs.append((100 + i, " ".join(piece)))
    got = sorted([(x["doc_id"], x["n_near"]) for x in decontam.contamination(documents(docs), bench[1]).collect()], key=repr)
    assert got == near(docs, bench[0])
    # a changed word that no document has does not hide the copy
    changed = spark.createDataFrame([(1, " ".join(w[:6] + ["absent"] + w[7:13]))], "item_id int, text string")
    row = decontam.contamination(documents([(1, " ".join(w[:13]))]), changed).first()
    assert (row["n_hit"], row["n_near"]) == (0, 1)


def test_empty_benchmark_and_documents(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.contamination(documents([]), none).count() == 0
    assert decontam.survivors(documents([]), none).count() == 0


def test_survivors_keep_clean_whole_rows(spark, odd, bench):
    docs = odd.unionByName(odd.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.lit("short item two").alias(
        "text"), "lang", "source", "n_chars"))
    docs = docs.withColumn("bad_doc_id", F.lit(1)).withColumn("key", F.lit(2)).withColumn("term", F.lit(3))
    kept = decontam.survivors(docs, bench[1])
    assert kept.columns == docs.columns and kept.count() == odd.count()
    assert 99 not in {r["doc_id"] for r in kept.collect()}


def test_empty_tables(spark, odd, documents, bench):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.contamination(documents([]), bench[1]).count() == 0
    rows = decontam.contamination(odd, none).collect()
    assert len(rows) == odd.count() and not any(r["contaminated"] or r["n_hit"] for r in rows)


def test_no_python_on_the_main_path(spark, documents, bench):
    plan = decontam.contamination(documents([(1, "short item two")]), bench[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
