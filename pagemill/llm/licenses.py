"""Licence statements by a trained paragraph classifier (operator 7).

A paragraph is a run of lines that have words; blank lines and lines of other
signs only, such as an empty comment line, end it. It is read across its line
ends, so wrapped notices stay whole, in overlapping windows of ``WINDOW``
words; if it has several lines, each of them is also read alone, as notices of
two licences may follow each other. Windows overlap by more words than the
longest template has. The features of such a part are the word unigrams and
bigrams that occur in the templates below. A multinomial logistic regression with an
L1 penalty (Spark's own, which runs in the JVM) is trained on templates, alone and
within lines of the corpus, and on lines of the corpus as the class
``unknown``; the penalty leaves few features with weights. The least
probability at which a family is accepted is calibrated on all parts of the
corpus outside the sample. A predicted family is confirmed if the
part holds at least 0.8 of the five-word shingles of one of its templates
(a shorter template is one shingle). ``n_predicted`` and ``n_confirmed`` count
paragraphs, however many of their parts are found.

The corpus's share in training is a bounded sample: all parts of
``sample_docs`` documents chosen by the hash of their doc_id, at most
``sample_lines`` of them. Everything else reads every part of every text, once
and in its row: a paragraph is dropped before it is cut into parts if it has
none of the words without which the weights of its other features, all added
up, cannot lift a family over ``unknown``. What is left is scored and compared
with the templates there and then; only parts found move. Nothing but
DataFrame functions runs on the rows.

Defined results: null and empty texts have no paragraphs; ties go to the family listed first; repeated rows each get
their row; without documents there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, small_side, text_key, text_or_empty
from pagemill.operators.dom import settle

# Notices of public licences.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Licensed under the BSD 3-Clause License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.",
              "licensed under a Creative Commons Attribution 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved."],
}
UNKNOWN = "unknown"
FAMILIES = list(TEMPLATES)
CLASSES = [UNKNOWN, *FAMILIES]
SHINGLE, SIMILAR = 5, 0.8
#: Parts less similar to every template count as plain text.
UNLIKE = 0.2
#: Words of a window, and from one window's start to the next; each run of ``WINDOW - STRIDE`` words is whole in one.
WINDOW, STRIDE = 128, 96
WORDS = "[\\p{L}\\p{N}]"
#: Between paragraphs: one or more lines without words.
BREAK = "\n[^\\p{L}\\p{N}]*\n"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def grams(tokens: Column) -> Column:
    """The different unigrams and bigrams of an array of words."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    bigrams = F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.array_distinct(F.concat(tokens, bigrams))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, key, no, each`` of the paragraphs of each text: the words of each of its lines."""
    bodies = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                          F.posexplode(F.split(text_or_empty("text"), BREAK)).alias("no", "body"))
              .filter(F.col("body").rlike(WORDS)))
    each = F.filter(F.transform(F.split("body", "\n"), words), lambda x: F.size(x) > 0)
    return settle(bodies.select("doc_id", "key", "no", each.alias("each")), "each")


def n_parts() -> Column:
    """How many parts ``each`` is cut into."""
    n = F.aggregate("each", F.lit(0), lambda total, x: total + F.size(x))
    alone = F.when(F.size("each") > 1, F.size(F.filter("each", lambda x: F.size(x) <= WINDOW))).otherwise(0)
    return F.floor(F.greatest(n - WINDOW + STRIDE - 1, F.lit(0)) / STRIDE) + 1 + alone


def parts(paras: DataFrame) -> DataFrame:
    """``doc_id, key, para, tokens`` of the parts of paragraphs: the windows of each, and its single
    lines if there are several. The paragraph's number is in the upper 32 bits of ``para``."""
    told = paras.select("doc_id", "key", "no", "each", F.flatten("each").alias("tokens"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - WINDOW + STRIDE, F.lit(1)), F.lit(STRIDE))
    windows = F.transform(starts, lambda i: F.slice("tokens", i, WINDOW))
    alone = F.when(F.size("each") > 1, F.filter("each", lambda x: F.size(x) <= WINDOW)).otherwise(
        F.array().cast("array<array<string>>"))
    cut = told.select("doc_id", "key", "no", F.posexplode(F.concat(windows, alone)).alias("part", "tokens"))
    return cut.select("doc_id", "key", (F.shiftleft(F.col("no").cast("long"), 32) + F.col("part")).alias("para"), "tokens")


def lines(docs: DataFrame) -> DataFrame:
    """The parts of each text."""
    return parts(paragraphs(docs))


def templates(spark: SparkSession) -> DataFrame:
    """``template, family, tokens``."""
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    return spark.createDataFrame(rows, "template int, family string, line string").select(
        "template", "family", words(F.col("line")).alias("tokens"))


def shingles(tokens: Column, size: Column) -> Column:
    """The different runs of ``size`` words, joined; none if there are fewer words."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tokens, i, size))))


def similarity(tokens: Column, template: Column) -> Column:
    """Share of the template's shingles that the tokens hold."""
    size = F.least(F.lit(SHINGLE), F.size(template))
    own = shingles(template, size)
    return F.size(F.array_intersect(shingles(tokens, size), own)) / F.size(own)


@dataclass
class Model:
    """The features with a weight that is not zero, their weights by class, and by class the intercept and the
    least probability accepted; the ids of the documents in the sample; the share of parts over the least."""

    grams: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    least: list[float]
    sample: DataFrame
    tail: float


def needed_words(model: Model) -> list[str]:
    """Words of which a part must have one to be taken for a licence.

    A family's probability can be 0.5 only if its sum is not below that of
    ``unknown``. Features are left out, the lightest first, as long as all
    that are left out, added up, lift no family that far; each of the others is
    stood for by its longest word.
    """
    lead = [[max(0.0, w - row[0]) for w in row] for row in model.weights]
    room = [model.intercepts[0] - b - 1e-6 for b in model.intercepts]
    out: set[str] = set()
    full = False
    for row, gram in sorted(zip(lead, model.grams), key=lambda x: (max(x[0]), x[1])):
        rest = [r - w for r, w in zip(room, row)]
        full = full or any(r <= 0 for r in rest[1:])
        if full:
            out.add(max(gram.split(" "), key=len))
        else:
            room = rest
    return sorted(out)


def _sums(hits: Column, model: Model) -> Column:
    """By class, the intercept and the weights of the features ``hits`` added up, in the features' order."""
    ids = F.array_sort(F.transform(hits, lambda g: F.array_position(F.array(*map(F.lit, model.grams)), g).cast("int")))
    columns = list(zip(*model.weights)) or [()] * len(model.intercepts)

    def added(column: tuple[float, ...]) -> Column:
        values = F.array(F.lit(0.0), *map(F.lit, column))
        return F.aggregate(ids, F.lit(0.0), lambda total, i: total + F.get(values, i))

    return F.array(*[added(column) + F.lit(b) for column, b in zip(columns, model.intercepts)])


def candidates(docs: DataFrame, model: Model) -> tuple[DataFrame, int]:
    """The parts whose most probable class is a family with 0.5 or more, and the number of parts outside the sample.

    ``doc_id, key, para, best, probability, similarity, alike, seen``: ``best``
    counts the classes from 1, ``similarity`` is to the templates of the family
    and ``alike`` to all; ``seen`` marks documents of the sample.
    """
    spark = docs.sparkSession
    seen = F.broadcast(model.sample.select(F.col("doc_id").alias("seen_id"), F.lit(True).alias("seen")))
    paras = paragraphs(docs)
    paras = paras.join(seen, F.col("doc_id") == F.col("seen_id"), "left").drop("seen_id")
    counted = Observation()
    needed = F.array(*map(F.lit, needed_words(model))).cast("array<string>")
    told = (paras.observe(counted, F.sum(F.when(F.col("seen").isNull(), n_parts())).alias("n"))
            .filter(F.arrays_overlap(F.flatten("each"), needed)))
    cut = parts(told).filter(F.arrays_overlap(F.col("tokens"), needed))
    features = F.array(*map(F.lit, model.grams)).cast("array<string>")
    met = settle(cut.withColumn("hits", F.array_intersect(grams(F.col("tokens")), features)), "hits")
    summed = settle(met.filter(F.size("hits") > 0).withColumn("z", _sums(F.col("hits"), model)), "z")
    most = settle(summed.withColumn("most", F.array_max("z")), "most")
    share = F.aggregate("z", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("most")))
    scored = settle(most.select("doc_id", "key", "para", "tokens", F.array_position("z", F.col("most")).cast("int").alias("best"),
                                (1 / share).alias("probability")), "best", "probability")
    own = templates(spark).groupBy("family").agg(F.collect_list("tokens").alias("own"))
    of_class = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")).cast("int")
    own = own.select(of_class.alias("best"), "own")
    every = F.array(*[F.array(*map(F.lit, r["tokens"])) for r in templates(spark).collect()])
    like = lambda all_: F.array_max(F.transform(all_, lambda t: similarity(F.col("tokens"), t)))
    found = scored.filter((F.col("best") > 1) & (F.col("probability") >= 0.5)).join(F.broadcast(own), "best")
    ids = model.sample.select(F.col("doc_id").alias("seen_id"), F.lit(True).alias("seen"))
    out = found.select("doc_id", "key", "para", "best", "probability", like(F.col("own")).alias("similarity"),
                       like(every).alias("alike")).join(F.broadcast(ids), F.col("doc_id") == F.col("seen_id"), "left")
    out = checkpoint(out.select("doc_id", "key", "para", "best", "probability", "similarity", "alike",
                                F.coalesce("seen", F.lit(False)).alias("seen")))
    return out, counted.get["n"] or 0


def fit(docs: DataFrame, sample_docs: int = 400, sample_lines: int = 4000, around: int = 40,
        quantile: float = 0.999) -> Model:
    """Fit on templates, and on a bounded sample of parts as the unknown class. Families are accepted from 0.5 on."""
    spark = docs.sparkSession
    known = checkpoint(templates(spark))
    ids = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
                     .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    sample = lines(docs.join(F.broadcast(ids.select(F.col("doc_id").alias("of_doc"))),
                             F.col("doc_id").cast("long") == F.col("of_doc"), "left_semi"))
    sample = sample.orderBy(F.xxhash64("tokens"), "doc_id", "para").limit(sample_lines)
    every = F.array(*[F.array(*map(F.lit, r["tokens"])) for r in known.collect()])
    alike = F.array_max(F.transform(every, lambda t: similarity(F.col("tokens"), t)))
    plain = checkpoint(sample.filter(alike < UNLIKE).select("tokens")
                       .withColumn("no", F.row_number().over(Window.orderBy(F.xxhash64("tokens"), "tokens")) - 1))
    n = max(1, plain.count())
    # each template alone, and before and behind lines of the sample
    placed = known.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around)))).withColumn(
        "no", F.pmod(F.col("template") * around + F.col("i"), F.lit(n)))
    near = placed.join(plain.select("no", F.col("tokens").alias("noise")), "no", "left")
    noise = F.coalesce("noise", F.array().cast("array<string>"))
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")).cast("double") - 1
    positive = near.select(label.alias("label"), F.when(F.col("i") == 0, F.col("tokens")).when(
        F.col("i") % 2 == 0, F.concat("tokens", noise)).otherwise(F.concat(noise, F.col("tokens"))).alias("tokens"))
    negative = plain.select(F.lit(0.0).alias("label"), "tokens")
    blank = spark.createDataFrame([(0.0, [])], "label double, tokens array<string>")
    rows = positive.unionByName(negative).unionByName(blank).select("label", grams(F.col("tokens")).alias("grams"))
    vocabulary = sorted(r["g"] for r in known.select(F.explode(grams(F.col("tokens"))).alias("g")).distinct().collect())
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=1.0, maxIter=60,
                                standardization=False).fit(checkpoint(vectors.transform(rows).select("label", "features")))
    matrix, cut = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector.toArray()]
    used = [j for j in range(len(vocabulary)) if matrix[:, j].any()]
    weights = [[float(v) for v in matrix[:, j]] for j in used]
    return Model([vocabulary[j] for j in used], weights, cut, [0.5] * len(CLASSES), ids, 1 - quantile)


def calibrated(model: Model, found: DataFrame, n: int) -> Model:
    """The model with the least probabilities that a share ``tail`` of the ``n`` parts outside the sample reaches.

    Parts that resemble a template are not counted, as they may be licences.
    A family that fewer parts give 0.5 keeps that.
    """
    plain = found.filter(~F.col("seen") & (F.col("alike") < UNLIKE))
    sizes = {r["best"]: r["n"] for r in plain.groupBy("best").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = model.tail * n
    shares = {best: 1 - over / size for best, size in sizes.items() if size > over}
    if not shares:
        return model
    high = plain.groupBy("best").agg(F.percentile("probability", F.array(*[F.lit(s) for s in shares.values()])).alias("p"))
    at = {best: i for i, best in enumerate(shares)}
    least = {r["best"]: r["p"][at[r["best"]]] for r in high.collect() if r["best"] in at}
    return replace(model, least=[max(0.5, least.get(k + 1, 0.5)) for k in range(len(CLASSES))])


def train(docs: DataFrame, **limits) -> Model:
    """Fit, then calibrate over all parts outside the sample."""
    model = fit(docs, **limits)
    return calibrated(model, *candidates(docs, model))


def predict(docs: DataFrame, model: Model, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, key, para, family, probability, similarity, confirmed`` of parts predicted to be a licence."""
    found = found or candidates(docs, model)[0]
    least = F.array(*map(F.lit, model.least))
    family = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("best"))
    return (found.filter(F.col("probability") >= F.element_at(least, F.col("best")))
            .select("doc_id", "key", "para", family.alias("family"), "probability", "similarity",
                    (F.col("similarity") >= SIMILAR).alias("confirmed")).dropDuplicates(["doc_id", "key", "para"]))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each row of ``docs``: its paragraphs, those predicted and confirmed, and the families."""
    if model is None:
        model = fit(docs)
        parts_found, n = candidates(docs, model)
        found = predict(docs, calibrated(model, parts_found, n), parts_found)
    else:
        found = predict(docs, model)
    paragraph = F.shiftright("para", 32)
    per_doc = checkpoint(found.groupBy("doc_id", "key").agg(
        F.size(F.collect_set(paragraph)).cast("long").alias("n_predicted"),
        F.size(F.collect_set(F.when(F.col("confirmed"), paragraph))).cast("long").alias("n_confirmed"),
        F.max("probability").alias("probability"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("confirmed"), F.col("family")))), ",").alias("unconfirmed"))
        .select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), "n_predicted", "n_confirmed",
                "probability", "families", "unconfirmed"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                        F.size(F.filter(F.split(text_or_empty("text"), BREAK), lambda x: x.rlike(WORDS)))
                        .cast("long").alias("n_paragraphs"))
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    zero = F.lit(0).cast("long")
    return whole.join(small_side(per_doc), on, "left").select(
        "doc_id", "key", "n_paragraphs", F.coalesce("n_predicted", zero).alias("n_predicted"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"), "probability",
        F.coalesce("families", F.lit("")).alias("families"), F.coalesce("unconfirmed", F.lit("")).alias("unconfirmed"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("key")
