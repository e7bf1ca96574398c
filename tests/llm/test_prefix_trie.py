import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.fixture(scope="session")
def conversations(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(convs.get(c - c % 100, [])[:h] + convs[c][h:])
    members, ends = {}, {}
    for c, path in paths.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {v: 0 for v in members}
    for v in members:
        if v:
            kids[v[:-1]] += 1
    below = {v: [0, 0] for v in members}
    for u in members:
        for d in range(len(u) + 1):
            below[u[:d]][0] += kids[u] == 0
            below[u[:d]][1] += (len(members[u]) - 1) * len(u[-1][1]) if u else 0
    return sorted([(min(m), len(v), min(members[v[:-1]]) if v else None, len(m), kids[v], *below[v],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest())
                   for v, m in members.items()], key=repr)


def result(table):
    return sorted([tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(table).collect()], key=repr)


def test_random_conversations_match_brute_force(conversations):
    r = random.Random(5)
    said = ["hi", "yes", "née \U0001f600", "", None]
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(said))
            for c in r.sample(range(260), 90) + [500, 1234567] for t in range(r.randrange(1, 12))]
    assert result(conversations(rows)) == brute(rows)


def test_long_equal_and_diverging_conversations(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)  # several rows of ids for one node
    base = [("user" if t % 2 else "bot", f"turn {t}") for t in range(45)]
    rows = []
    for c in range(100, 130):  # copies, some cut short, some with one turn changed
        own = base[:45 - (c % 7 == 0) * (c % 11)]
        if c % 5 == 0:
            own = [*own[:c % 40], ("user", f"other {c % 3}"), *own[c % 40 + 1:]]
        rows += [(c, t, *turn) for t, turn in enumerate(own)]
    assert result(conversations(rows)) == brute(rows)


def test_odd_rows(conversations):
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, None, None, None), (1, 5, "user", "tie"),
            (1, 5, "bot", "tie"), (1, 5, "bot", "tie"), (1, -3, "bot", "x" * 100_000), (200, 0, "u", "a"),
            (201, 0, "u", "b"), (203, 7, "u", "only"), (999, 0, "u", "no base"), (-5, 0, "u", "below zero"),
            (400, None, None, None)]
    table = conversations(rows)
    python = [r for r in rows if r[0] != -5]  # the remainder of a negative id has Spark's sign
    assert result(table.filter("conv_id is null or conv_id <> -5")) == brute(python)
    assert sum(r[1] == 0 for r in result(table)) == 1
    extra = table.withColumn("conv", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("nid", F.lit("n"))
    assert result(extra.filter("conv_id is null or conv_id <> -5")) == brute(python)


def test_no_conversations(conversations):
    assert result(conversations([])) == []
    assert result(conversations([(None, 0, "user", "a")])) == []


def test_texts_are_not_shuffled(conversations):
    plan = prefix_trie.turns(conversations([(1, 0, "u", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
