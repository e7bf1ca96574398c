import hashlib
import re

from pagemill.llm import exact_dedup
from pagemill.llm.common import work_path


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for m in members:
            stays = m == best and not kept
            kept |= stays
            out.append((m[0], best[0], len(members), stays, digest))
    return sorted(out, key=repr)


def decided(spark, docs):
    rows = exact_dedup.deduplicate(docs, exact_dedup.new_index(spark, 4)).collect()
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["keeper"] and i == 0, bytes(r["digest"]).hex())
                   for r in rows for i in range(r["copies"])], key=repr)


def test_odd_rows_match_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert decided(spark, odd) == brute(rows)


def test_survivors_keep_whole_rows_with_clashing_columns(spark, odd):
    from pyspark.sql import functions as F
    docs = odd.withColumn("row_key", F.lit("k")).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    kept = exact_dedup.survivors(spark, docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted([r[0] for r in brute(rows) if r[3]], key=repr)
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == want
    assert {r["row_key"] for r in kept.collect()} == {"k"}


def test_later_batches_lose_to_the_index(spark, documents):
    path = work_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = exact_dedup.deduplicate(documents([(10, "one two"), (11, "three")]), index).collect()
    assert all(r["keeper"] for r in first)
    again = exact_dedup.DigestIndex(spark, path, 4)  # opened anew over the same files
    second = {r["doc_id"]: r for r in exact_dedup.deduplicate(
        documents([(1, "one  two"), (2, "four"), (3, "four")]), again).collect()}
    assert (second[1]["keep_id"], second[1]["keeper"]) == (10, False)
    assert second[2]["keeper"] and not second[3]["keeper"] and second[3]["keep_id"] == 2
    assert again.read().count() == 3
    other = exact_dedup.deduplicate(documents([(2, "four")]), again).collect()
    assert not other[0]["keeper"] and again.read().count() == 3


def whole(rows):
    return sorted(map(repr, (tuple(r) for r in rows.collect())))


def test_a_repeated_batch_gives_the_same_rows(spark, documents, odd, monkeypatch):
    index = exact_dedup.DigestIndex(spark, work_path(spark, "index"), 4)
    before = documents([(10, "one two"), (11, "word")])
    assert exact_dedup.survivors(spark, before, index, "first").count() == 2
    batch = odd.unionByName(documents([(20, "one two"), (21, "new"), (22, "n ew")]))

    class Broken(Exception):
        pass

    def append_and_break(rows, append=index.append):
        append(rows)
        raise Broken

    with monkeypatch.context() as m:  # ends after the append, before any decision is written
        m.setattr(index, "append", append_and_break)
        try:
            exact_dedup.survivors(spark, batch, index, "second")
        except Broken:
            pass
    size = index.read().count()
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    kept = exact_dedup.survivors(spark, batch, again, "second")
    fresh = exact_dedup.DigestIndex(spark, work_path(spark, "index"), 4)
    exact_dedup.deduplicate(before, fresh, "first")
    assert whole(kept) == whole(exact_dedup.survivors(spark, batch, fresh, "second"))
    assert again.read().count() == size == fresh.read().count()
    assert whole(exact_dedup.survivors(spark, batch, again, "second")) == whole(kept) and again.read().count() == size
    assert exact_dedup.survivors(spark, before, again, "first").count() == 2
    assert exact_dedup.survivors(spark, batch, again, "third").count() == 0


def test_merged_index_is_read_without_a_sort(spark, documents):
    index = exact_dedup.DigestIndex(spark, work_path(spark, "index"), 4)
    for i in range(3):
        exact_dedup.deduplicate(documents([(100 * i + k, f"text {i} {k}") for k in range(40)]), index, f"b{i}", most_files=99)
    assert index.files_a_bucket() == 3
    rows = sorted(map(repr, index.read().collect()))
    index.merge()
    assert index.files_a_bucket() == 1 and sorted(map(repr, index.read().collect())) == rows
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.generation == 1 and sorted(map(repr, again.read().collect())) == rows
    other = again.read().select("digest")
    plan = again.unseen(other)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan.replace("SortMergeJoin", "")
    late = exact_dedup.deduplicate(documents([(1, "text 0 0"), (2, "late")]), again, "late", most_files=0.5).collect()
    assert {r["doc_id"]: r["keeper"] for r in late} == {1: False, 2: True} and again.generation == 2


def test_nothing_is_left_in_the_catalogue(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.survivors(spark, documents([(1, "a"), (2, "a")])).count()
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_few_dropped_rows_move_no_text(spark, documents):
    kept = exact_dedup.survivors(spark, documents([(i, f"t{i % 9}") for i in range(20)]))
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 9


def test_empty_table(spark, documents):
    assert decided(spark, documents([])) == []
    assert exact_dedup.survivors(spark, documents([])).count() == 0


def test_anti_join_reads_the_index_without_a_shuffle(spark, documents):
    index = exact_dedup.new_index(spark, 4)
    exact_dedup.deduplicate(documents([(1, "a")]), index)
    other = index.read().select("digest")
    plan = index.unseen(other)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
