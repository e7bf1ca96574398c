"""Benchmark decontamination over a positional inverted index (operator 10).

For every window of a test item the ``lists`` rarest of its terms are chosen
by their frequency in the training text. The index stores the postings
``(term, document, position)`` of the chosen terms, sorted by term. A posting
at position ``p`` of the term at offset ``o`` of an item proposes the
*alignment* ``p - o``; intersecting the offset-adjusted lists of a window
leaves the alignments that all its chosen terms propose, and only those are
compared word by word with the document. All windows that share an alignment
share one row. Lists that agree within a few positions give proximity matches;
for these a window's terms are the rarest of those that the training text has,
so that a changed word does not hide a copy.

Everything runs as DataFrame and SQL functions. The passes over the text are:
term frequencies (of test terms only), postings, and the documents that hold
a candidate. Texts are not shuffled unless the candidates outgrow a broadcast
of a checked size.

Defined results: null or wordless texts and items have no words and never
match; an item below ``window`` words is one window; items are told apart by
item_id, a null one shown as empty text; repeated rows of a document each get
their row. A window with fewer present terms than are looked up has no match. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, lower_ascii, read_table, small_side, text_key, text_or_empty, work_path

BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Term under which the index keeps each document's length, as a posting behind its last word.
END = ""


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text_or_empty(text)), BETWEEN_WORDS), "")


@dataclass
class Index:
    """Postings ``term, doc_id, key, pos`` at ``path``; ``key`` tells rows of one doc_id apart."""

    spark: SparkSession
    path: str

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path).filter(F.col("term") != END)

    def lengths(self) -> DataFrame:
        """``doc_id, key, n_words``, a row for each row of the documents."""
        return (self.spark.read.parquet(self.path).filter(F.col("term") == END)
                .select("doc_id", "key", F.col("pos").cast("long").alias("n_words")))


def build_index(docs: DataFrame, terms: DataFrame | None = None, path: str | None = None) -> Index:
    """Write the positional index of ``docs(doc_id, text)``, of ``terms(term)`` only if they are given.

    Postings are dealt by ranges of (term, document, position), so a term with
    very many postings is spread over files.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "positional_index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.posexplode(F.array_append(words(F.col("text")), F.lit(END))).alias("pos", "term"))
    if terms is not None:
        wanted = checkpoint(terms.select("term").union(docs.sparkSession.createDataFrame([(END,)], "term string"))
                            .distinct())
        rows = rows.join(small_side(wanted), "term")
    (rows.select("term", "doc_id", "key", "pos").repartitionByRange("term", "doc_id", "pos")
         .sortWithinPartitions("term", "doc_id", "pos").write.parquet(path))
    return Index(spark, path)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms(term)`` stands in the documents; absent ones have 0."""
    found = (docs.select(F.explode(words(F.col("text"))).alias("term"))
             .join(small_side(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    return checkpoint(terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, words`` of the items that have words; ``item`` is a key of the item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                            words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return checkpoint(rows.distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words"))


def plan_windows(items: DataFrame, counts: DataFrame, window: int, lists: int) -> DataFrame:
    """``item, windows``: of each window its start, the positions of its rarest present terms, and ``whole``,
    whether all its terms are present.

    Windows that have fewer present terms than ``lists`` (or than words, if they have fewer) are left out.
    """
    ranked = (items.select("item", F.posexplode("words").alias("pos", "term")).join(counts, "term")
              .groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("at")))
    last = F.greatest(F.size("at") - window, F.lit(0))

    def rarest(start: Column) -> Column:
        part = F.transform(F.slice("at", start + 1, window), lambda x: F.struct(x["n"], x["pos"]))
        present = F.filter(part, lambda x: x["n"] > 0)
        return F.struct(start.alias("start"), F.slice(F.array_sort(present), 1, lists).alias("rare"),
                        (F.size(present) == F.size(part)).alias("whole"),
                        F.least(F.lit(lists), F.size(part)).alias("wanted"))

    planned = ranked.select("item", F.transform(F.sequence(F.lit(0), last), rarest).alias("windows"))
    possible = F.filter("windows", lambda w: F.size(w["rare"]) == w["wanted"])
    return checkpoint(planned.select("item", F.transform(
        possible, lambda w: F.struct(w["start"], F.transform(w["rare"], lambda x: x["pos"]).alias("anchors"), w["whole"]))
        .alias("windows")).filter(F.size("windows") > 0))


def _complete(found: str, exact: bool = False) -> Column:
    """The windows all of whose anchors are in the array column ``found``; with ``exact`` only those that can occur."""
    return F.filter("windows", lambda w: (w["whole"] | F.lit(not exact))
                    & (F.size(F.array_except(w["anchors"], F.col(found))) == 0))


def _alignments(index: Index, items: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, key, item, shift, pos`` for postings of anchors in documents that hold all
    anchors of some window of the item, wherever they stand."""
    anchors = checkpoint(
        windows.select("item", F.explode(F.array_distinct(F.flatten(F.transform("windows", lambda w: w["anchors"]))))
                       .alias("anchor"))
        .join(items, "item").select("item", "anchor", F.get("words", F.col("anchor")).alias("term")))
    all_of = checkpoint(index.postings().join(small_side(anchors), "term")
                        .select("doc_id", "key", "item", (F.col("pos") - F.col("anchor")).alias("shift"), "anchor"))
    together = (all_of.groupBy("doc_id", "key", "item").agg(F.collect_set("anchor").alias("found"))
                .join(small_side(windows), "item").filter(F.size(_complete("found")) > 0)
                .select("doc_id", "key", "item"))
    together = checkpoint(together)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "key", "item")]
    return checkpoint(all_of.alias("a").join(small_side(together).alias("t"), on, "left_semi"))


def candidates(index: Index, items: DataFrame, windows: DataFrame, slop: int):
    """Exact candidates ``doc_id, key, item, shift, starts`` and proximity matches ``doc_id, key, item``.

    A proximity match is an item with a window whose rarest terms all occur
    within ``slop`` positions of where the phrase has them.
    """
    found = _alignments(index, items, windows)

    def grouped(rows: DataFrame, exact: bool) -> DataFrame:
        return (rows.groupBy("doc_id", "key", "item", "shift").agg(F.collect_set("anchor").alias("found"))
                .join(small_side(windows), "item").withColumn("whole", _complete("found", exact))
                .filter(F.size("whole") > 0))

    exact = grouped(found, True).select("doc_id", "key", "item", "shift",
                                  F.transform("whole", lambda w: w["start"]).alias("starts"))
    moved = found.withColumn("shift", F.explode(F.sequence(F.col("shift") - slop, F.col("shift") + slop)))
    near = grouped(moved, False).select("doc_id", "key", "item").distinct()
    return checkpoint(exact), near


def verify(docs: DataFrame, exact: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``doc_id, key, n_hit, item_ids`` of documents that hold a window word by word."""
    rows = exact.join(small_side(items), "item")
    per_doc = checkpoint(rows.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("item_id", "words", "shift", "starts")).alias("tries")))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), "text", text_key(F.col("text")).alias("text_key"))
    near = small_side(per_doc)
    met = whole.join(near, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")))
    # a generator, so that the words are made once a document and not within each lambda below
    made = met.select("doc_id", "key", "tries", F.explode(F.array(F.struct(words(F.col("text")).alias("words"))))
                      .alias("doc")).select("doc_id", "key", "tries", F.col("doc.words").alias("doc_words"))
    hits = F.flatten(F.transform("tries", lambda t: F.transform(t["starts"], lambda s: F.struct(
        t["item_id"].alias("item_id"), (t["shift"] + s).alias("at"),
        F.slice(t["words"], s + 1, window).alias("phrase")))))
    true = F.filter(hits, lambda h: (h["at"] >= 0) & (
        F.slice(F.col("doc_words"), F.greatest(h["at"], F.lit(0)) + 1, F.size(h["phrase"])) == h["phrase"]))
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.size(h["phrase"]) - 1)))
    return (made.select("doc_id", "key", true.alias("hits")).filter(F.size("hits") > 0)
            .select("doc_id", "key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
                    F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("item_ids"))
            .dropDuplicates(["doc_id", "key"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, lists: int = 2,
                  slop: int = 3) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, key, n_words, n_hit, item_ids, n_near, contaminated``.

    ``n_hit`` counts the words inside an occurrence of any window, ``item_ids``
    the items with such windows, and ``n_near`` the items with proximity
    matches. A document is contaminated if hits make 5 % of its words or more.
    """
    items = items_of(benchmark)
    terms = checkpoint(items.select(F.explode("words").alias("term")).distinct())
    windows = plan_windows(items, term_counts(docs, terms), window, lists)
    wanted = (windows.select("item", F.explode("windows").alias("w"))
              .select("item", F.explode("w.anchors").alias("anchor")).distinct()
              .join(items, "item").select(F.get("words", F.col("anchor")).alias("term")))
    index = build_index(docs, wanted)
    exact, near = candidates(index, items, windows, slop)
    hit = verify(docs, exact, items, window).select("doc_id", "key", "n_hit", "item_ids")
    close = near.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_near"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "key")]
    marks = checkpoint(hit.alias("h").join(close.alias("c"), on, "full_outer").select(
        F.coalesce("h.doc_id", "c.doc_id").alias("hit_id"), F.coalesce("h.key", "c.key").alias("hit_key"),
        "n_hit", "item_ids", "n_near"))
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("key").eqNullSafe(F.col("hit_key"))
    out = index.lengths().join(small_side(marks), on, "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def survivors(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = checkpoint(contamination(docs, benchmark).filter("contaminated").select("doc_id", "key").distinct()
                     .select(F.col("doc_id").alias("bad_doc_id"), F.col("key").alias("bad_key")))
    names = {c.lower() for c in docs.columns}
    a, b = (n if n not in names else f"_{n}_" for n in ("bad_doc_id", "bad_key"))
    bad = bad.toDF(a, b)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (text_key(F.col("text")) == F.col(b))
    return docs.join(small_side(bad), on, "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated", "n_near")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, ws, least(13, len(ws)) AS n
      FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[j : j + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS j FROM b)),
dw AS (SELECT r, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g
       FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS p
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT r, p, n, item_id FROM dw JOIN bw USING (n, g)),
words_hit AS (SELECT r, count(DISTINCT q) AS n_hit
              FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items_hit AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r),
tok AS (SELECT r, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM d),
cnt AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
bi AS (SELECT row_number() OVER () AS item, ws FROM (SELECT DISTINCT item_id, ws FROM b)),
bt AS (SELECT item, pos, term, n
       FROM (SELECT item, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM bi) JOIN cnt USING (term)),
win AS (SELECT item, least(13, len(ws)) AS n_words, unnest(range(greatest(len(ws) - 13, 0) + 1)) AS j FROM bi),
rare AS (SELECT win.item, j, pos, term, n_words,
                row_number() OVER (PARTITION BY win.item, j ORDER BY n, pos) AS k
         FROM win JOIN bt ON bt.item = win.item AND pos >= j AND pos < j + 13),
pairs AS (SELECT DISTINCT x.item, x.pos AS a1, x.term AS t1, coalesce(y.pos, x.pos) AS a2, coalesce(y.term, x.term) AS t2
          FROM (SELECT * FROM rare WHERE k = 1) x LEFT JOIN (SELECT * FROM rare WHERE k = 2) y USING (item, j)
          WHERE y.pos IS NOT NULL OR x.n_words = 1),
near AS (SELECT p.r, count(DISTINCT item) AS n_near
         FROM pairs JOIN tok p ON p.term = t1 JOIN tok q ON q.term = t2 AND q.r = p.r
          AND abs((p.p - a1) - (q.p - a2)) <= 6 GROUP BY p.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r) LEFT JOIN near USING (r)
"""
