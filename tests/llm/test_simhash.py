import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash
from pagemill.llm.components import components


def plain_fingerprint(text, size=3):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, radius):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(points))]


def test_fingerprints_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["fp"] & (2 ** 64 - 1)) for r in simhash.fingerprints(odd).collect()}
    assert got == {(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()}


def test_spark_hashes_alike(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row["h"] & (2 ** 64 - 1) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    points = {0, 2 ** 64 - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):  # chains of small steps
            points.add(p)
            for _ in range(rng.choice([1, 2, 2, 3])):
                p ^= 1 << rng.randrange(64)
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = classes(points, 2)
    for blocks, tile in ((4, 1024), (2, 7), (8, 50)):
        found = {r["node"]: r["root"] for r in components(simhash.links(table, 2, blocks, tile)).collect()}
        got = [found.get(p, p) for p in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want)), (blocks, tile)


def test_near_duplicates_match_brute_force(spark, documents):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(4):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows += [(100, ""), (101, None), (102, rows[0][1].upper())]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(classes(fps, 2))}
    assert got == want
    assert len(set(want.values())) < len(rows)
    kept = sorted(r["doc_id"] for r in simhash.survivors(documents(rows)).collect())
    assert kept == sorted(set(want.values()))


def test_odd_rows_and_empty_table(spark, odd, documents):
    docs = odd.withColumn("row_key", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("root", F.lit(3))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == odd.count()
    by_fp = {}
    for r in found:
        by_fp.setdefault(r["fp"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in by_fp.values())
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["root"] for r in found})
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.survivors(documents([])).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (3, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1400)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
