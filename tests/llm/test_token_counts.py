import collections
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from pagemill.llm import bpe, token_counts
from pagemill.llm.common import work_path

SCHEMA = "doc_id long, op string, text string, source string, lang string"


def ledger(spark, path=None, counters=None):
    return token_counts.Ledger(spark, path or work_path(spark, "ledger"), counters or {"words": token_counts.count_words})


def totals(book):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in book.totals().collect()}


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_inserts_deletes_and_revisions(spark):
    book = ledger(spark)
    assert totals(book) == {}
    assert book.apply("a", batch(spark, (1, "insert", "one two", "s", "en"), (2, "insert", "three", "s", "en"),
                                 (3, "insert", None, None, None), (4, "insert", "x y z", "t", "de"),
                                 (4, "insert", "x", "t", "de"), (None, "insert", "q q", "t", "de")))
    assert totals(book) == {("s", "en", "words"): (2, 3), (None, None, "words"): (1, 0), ("t", "de", "words"): (3, 6)}
    assert book.apply("b", batch(spark, (1, "revise", "one two three four", "u", "en"), (4, "delete", None, None, None),
                                 (77, "delete", None, None, None), (78, "revise", "new", "s", "en")))
    assert totals(book) == {("u", "en", "words"): (1, 4), ("s", "en", "words"): (2, 2),
                            (None, None, "words"): (1, 0), ("t", "de", "words"): (1, 2)}
    assert book.apply("c", batch(spark, (None, "delete", None, None, None), (3, "delete", None, None, None),
                                 (1, "revise", "one", "u", "en")))
    assert totals(book) == {("u", "en", "words"): (1, 1), ("s", "en", "words"): (2, 2)}


def test_a_committed_batch_is_not_applied_again(spark):
    book = ledger(spark)
    rows = batch(spark, (1, "insert", "one two", "s", "en"))
    assert book.apply("a", rows) and not book.apply("a", rows)
    other = ledger(spark, book.path)  # another process over the same files
    assert not other.apply("a", rows)
    assert totals(other) == {("s", "en", "words"): (1, 2)}


def test_a_batch_lost_before_its_commit_is_done_over(spark, monkeypatch):
    book = ledger(spark)
    book.apply("a", batch(spark, (1, "insert", "one two", "s", "en")))
    write = token_counts.Ledger._write

    def failing(self, df, *parts):
        if parts[0] == "commits":
            raise RuntimeError("lost")
        write(self, df, *parts)

    monkeypatch.setattr(token_counts.Ledger, "_write", failing)
    with pytest.raises(RuntimeError):
        book.apply("b", batch(spark, (2, "insert", "x", "s", "en")))
    monkeypatch.undo()
    again = ledger(spark, book.path)
    assert totals(again) == {("s", "en", "words"): (1, 2)}
    assert again.apply("b", batch(spark, (2, "insert", "x", "s", "en")))
    assert totals(again) == {("s", "en", "words"): (2, 3)}


def test_random_batches_match_brute_force(spark):
    rng = random.Random(4)
    book, state = ledger(spark), {}
    for n in range(5):
        rows = []
        for doc_id in rng.sample(range(12), 7):
            op = rng.choice(["insert", "delete", "revise"]) if n else "insert"
            text, source = " ".join("w" * rng.randrange(0, 6)), rng.choice(["s", "t", None])
            rows.append((doc_id, op, text, source, "en"))
        book.apply(f"b{n}", batch(spark, *rows))
        for doc_id, op, text, source, lang in rows:
            if op != "insert":
                state[doc_id] = []
            if op != "delete":
                state.setdefault(doc_id, []).append((source, lang, len(text.split())))
        want = collections.defaultdict(lambda: [0, 0])
        for source, lang, tokens in (x for held in state.values() for x in held):
            want[source, lang, "words"][0] += 1
            want[source, lang, "words"][1] += tokens
        assert totals(book) == {k: tuple(v) for k, v in want.items()}


def test_production_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"])
           for r in token_counts.op1_token_counts(spark, d).collect()}
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.encoder(path, pattern).ranks, special_tokens={})
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        mark, text = labels.get(r["doc_id"]), r["text"] or ""
        if mark and mark["toxic"] == 1:
            continue
        if mark and mark["quality"] == 0:
            text = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        for version, n in (("words", len(text.encode().split())), ("byte_bpe_multi_50k", len(enc.encode_ordinary(text)))):
            want[r["source"], r["lang"], version][0] += 1
            want[r["source"], r["lang"], version][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_odd_rows_and_empty_batches(spark, odd):
    book = ledger(spark)
    book.apply("none", batch(spark))
    assert totals(book) == {}
    book.apply("odd", odd.withColumn("op", F.lit("insert")).withColumn("version", F.lit("x")))
    assert sum(n for n, _ in totals(book).values()) == odd.count()
