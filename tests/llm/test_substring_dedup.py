import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import substring_dedup, word_windows


def brute(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = {}
    for _, words in docs:
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            count[w] = count.get(w, 0) + 1
    out = []
    for d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if count[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(docs, *sizes):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
                   for r in substring_dedup.deduplicate(docs, *sizes).collect()], key=repr)


def plain_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_odd_rows_match_brute_force(odd, documents):
    assert result(odd) == brute(plain_rows(odd), 35)
    extra = odd.withColumn("key", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("runs", F.lit(3))
    assert result(extra) == brute(plain_rows(odd), 35)
    assert result(documents([])) == []


def passages(seed, n):
    """Texts of shared passages, some with one word changed, and of words of a small vocabulary."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "x" * 90, "naïve\U0001f600", "to", "a"]
    shared = [[r.choice(vocabulary) for _ in range(r.randrange(8, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(5)):
            piece = list(r.choice(shared))
            if r.random() < 0.4:
                piece[r.randrange(len(piece))] = r.choice(vocabulary)
            words += [r.choice(vocabulary) for _ in range(r.randrange(12))] + piece
            if r.random() < 0.2:
                words += ["to", "a"] * r.randrange(20)
        out.append((r.choice([i, 7]), r.choice([" ", "\n", "  ", "\t"]).join(words)))
    return out


def test_shared_passages_match_brute_force(documents):
    for window, size in ((35, 8), (12, 4), (5, 5), (3, 1)):
        rows = passages(window, 120)
        got = result(documents(rows), window, size)
        assert got == brute(rows, window)
        assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_groups_beyond_memory_are_cut_and_matched_across_parts(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    monkeypatch.setattr(substring_dedup, "BIN", 50)
    rows = passages(2, 150) + [(1000 + i, "one line that " * 3 + f"{i} " + " ".join(f"v{k}" for k in range(20)))
                               for i in range(60)]
    assert result(documents(rows), 12, 4) == brute(rows, 12)


def test_repeats_inside_one_text_and_at_its_ends(documents):
    line = " ".join(f"t{i}" for i in range(36))
    rows = [(1, f"{line} middle {line}"), (2, line.rsplit(" ", 2)[0]), (3, " ".join(line.split()[1:])), (4, "a " * 500)]
    got = result(documents(rows))
    assert got == brute(rows, 35)
    assert [r[2] for r in got] == [72, 0, 35, 500]


def test_words_of_a_batch():
    texts = [b"", b" one  two\n", "é\x85x \x0bthree".encode(), b"\t", b"y" * 200 + b" y"]
    words = word_windows.Words(texts)
    got = [bytes(words.data[a:b]) for a, b in zip(words.start, words.end)]
    assert got == [w for t in texts for w in t.split()]
    assert np.diff(words.first).tolist() == [len(t.split()) for t in texts]
    h = words.hashes()
    again = word_windows.Words([b" ".join(got)])
    assert (again.hashes() == h).all() and len(set(h.tolist())) == len(set(got))
    text, begin = words.joined(np.ones(len(h), bool))
    assert [text[a:max(a, b - 1)] for a, b in zip(begin[:-1], begin[1:])] == [b" ".join(t.split()) for t in texts]


def test_texts_are_shuffled_by_their_hash_alone(spark, documents):
    plan = substring_dedup.deduplicate(documents(passages(1, 20)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
