import math

import pytest
from pyspark.sql import functions as F

from pagemill.llm import licenses

PROSE = ["the dog of the house is in the garden", "a work of art under the sun", "public opinion and general ideas",
         "we use the form in the version of", "rights of the reader", "permission to enter the park is granted here"]


@pytest.fixture(scope="module")
def corpus(documents):
    rows = [(i, "\n".join(PROSE[j % 6] + f" word{i} more{j}" for j in range(i, i + 5))) for i in range(30)]
    rows += [(100, "intro line\nLicensed under the Apache License, Version 2.0.\nend"),
             (101, "All rights reserved."), (102, "x y\n\nReleased under the MIT License. extra words here\n"),
             (103, "This work is licensed under the GNU General Public License, version 3."),
             (104, "Licensed under CC BY-NC 4.0."), (105, "the license of the driver was public"),
             (106, None), (107, ""), (108, " \n\n!!\n"), (101, "All rights reserved."), (None, "ALL RIGHTS RESERVED"),
             (109, "Licensed under the " + "very " * 30_000)]
    return documents(rows)


@pytest.fixture(scope="module")
def model(spark, corpus):
    return licenses.train(corpus)


def test_families_are_found_and_prose_is_not(corpus, model):
    rows = {r["doc_id"]: r for r in licenses.scan(corpus, model).collect()}
    want = {100: "apache", 101: "proprietary", 102: "mit", 103: "gpl", 104: "cc-by-nc", None: "proprietary"}
    assert {k: r["families"] for k, r in rows.items() if r["families"]} == want
    assert licenses.scan(corpus, model).count() == corpus.count()
    assert rows[106]["n_paragraphs"] == rows[107]["n_paragraphs"] == rows[108]["n_paragraphs"] == 0
    assert rows[102]["n_paragraphs"] == 2


def test_probabilities_match_brute_force(corpus, model):
    weights = dict(zip(model.grams, model.weights))
    lines = licenses.lines(corpus).collect()
    want = {}
    for r in lines:
        t = r["tokens"]
        grams = set(t) | {f"{a} {b}" for a, b in zip(t, t[1:])}
        if not grams & weights.keys():
            continue
        z = [b + sum(weights[g][k] for g in grams & weights.keys()) for k, b in enumerate(model.intercepts)]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(p)), key=lambda k: (p[k], -k))
        if best and p[best] / sum(p) >= model.least[best]:
            want[r["doc_id"], r["key"], r["para"]] = (licenses.CLASSES[best], round(p[best] / sum(p), 9))
    got = {(r["doc_id"], r["key"], r["para"]): (r["family"], round(r["probability"], 9))
           for r in licenses.predict(corpus, model).collect()}
    assert got == want


def test_similarity_is_by_five_word_shingles(spark):
    df = spark.createDataFrame([("a b c d e f g".split(), "x a b c d e f q".split()),
                                ("all rights".split(), "all the rights".split()),
                                ("all rights".split(), "say all rights".split()), (["a"], [])],
                               "template array<string>, tokens array<string>")
    got = [r["s"] for r in df.select(licenses.similarity(F.col("tokens"), F.col("template")).alias("s")).collect()]
    assert [round(x, 4) for x in got] == [0.6667, 0.0, 1.0, 0.0]


def test_empty_table_and_clashing_columns(documents, corpus, model):
    assert licenses.scan(documents([]), model).count() == 0
    extra = corpus.withColumn("key", F.lit(1)).withColumn("para", F.lit(1)).withColumn("tokens", F.lit(1))
    assert licenses.scan(extra, model).count() == corpus.count()
    assert licenses.scan(documents([])).count() == 0


def test_no_python_on_the_main_path(corpus, model):
    plan = licenses.scan(corpus, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


WRAPPED = {
    "mit": "MIT License\n\nCopyright (c) 2020 Some One\n\n"
           "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction, including without limitation the rights\n"
           "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
           "copies of the Software, and to permit persons to whom the Software is\n"
           "furnished to do so, subject to the following conditions:\n",
    "bsd": "Copyright (c) 2020, Some One\n\n"
           "Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:\n\n"
           "1. Redistributions of source code must retain the above copyright notice, this\n"
           "   list of conditions and the following disclaimer.\n",
    "gpl": "/*\n * This program is free software: you can redistribute it and/or modify\n"
           " * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or\n"
           " * (at your option) any later version.\n *\n * This program is distributed in the hope\n */\n",
}


def test_wrapped_notices_are_whole(documents, model):
    narrow = "you may not use this file except in compliance with the License You may obtain a copy of the License at"
    rows = [(i, text) for i, text in enumerate(WRAPPED.values())]
    rows += [(10, "\n".join(narrow.split())), (11, "intro\r\n" + WRAPPED["bsd"].replace("\n", "\r\n")),
             (12, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.")]
    # at any place of a long paragraph
    rows += [(100 + n, "\n".join(["plain"] * n) + "\n" + WRAPPED["gpl"]) for n in range(0, 130, 13)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(rows), model).collect()}
    want = dict(enumerate(WRAPPED)) | {10: "apache", 11: "bsd", 12: "apache,mit"} | {i: "gpl" for i, _ in rows if i >= 100}
    assert {i: r["families"] for i, r in got.items()} == want
    assert [got[i]["n_paragraphs"] for i in (0, 1, 2, 12)] == [3, 3, 2, 1]
    assert all(r["n_confirmed"] == 1 for r in got.values())


def test_parts_cover_every_run_of_words(documents):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 63, 64, 65, 96, 97, 500)]
    longest = max(len(t.split()) for ts in licenses.TEMPLATES.values() for t in ts)
    assert longest <= licenses.WINDOW - licenses.STRIDE
    parts = {}
    for r in licenses.lines(documents([(i, t.replace(" ", "\n")) for i, t in enumerate(texts)])).collect():
        assert len(r["tokens"]) <= licenses.WINDOW
        parts.setdefault(r["doc_id"], []).append(" ".join(r["tokens"]) + " ")
    for i, t in enumerate(texts):
        run = t.split()
        for at in range(max(1, len(run) - longest + 1)):
            assert any(" ".join(run[at:at + longest]) + " " in p for p in parts[i])


def plain_parts(text):
    """The parts of each paragraph, by plain loops."""
    import re
    out = []
    for body in re.split(r"\n[\W_]*\n", text or ""):
        each = [t for t in ([w for w in re.split(r"[\W_]+", line.lower()) if w] for line in body.split("\n")) if t]
        tokens = [w for line in each for w in line]
        if tokens:
            starts = range(0, max(len(tokens) - licenses.WINDOW + licenses.STRIDE, 1), licenses.STRIDE)
            out.append([tokens[i:i + licenses.WINDOW] for i in starts]
                       + [t for t in each if len(each) > 1 and len(t) <= licenses.WINDOW])
    return out


def plain_similarity(tokens, template):
    size = min(licenses.SHINGLE, len(template))
    runs = lambda t: {tuple(t[i:i + size]) for i in range(len(t) - size + 1)}
    return len(runs(tokens) & runs(template)) / len(runs(template))


def plain_best(tokens, model):
    weights = dict(zip(model.grams, model.weights))
    met = (set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:])}) & weights.keys()
    z = [b + sum(weights[g][k] for g in met) for k, b in enumerate(model.intercepts)]
    p = [math.exp(x - max(z)) for x in z]
    best = max(range(len(p)), key=lambda k: (p[k], -k))
    return (best, p[best] / sum(p)) if met else (0, 1.0)


def notices():
    return {f: [[w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for t in ts]
            for f, ts in licenses.TEMPLATES.items()}


def test_scan_matches_plain_loops(documents, corpus, model):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    rows += [(200 + i, t) for i, t in enumerate(WRAPPED.values())]
    rows += [(300 + i, "under the public source license use " + " ".join(["of", "word"] * i)) for i in range(0, 200, 40)]
    want = []
    for doc_id, text in rows:
        predicted, confirmed, families = set(), set(), set()
        told = plain_parts(text)
        for no, each in enumerate(told):
            for tokens in each:
                best, p = plain_best(tokens, model)
                if best and p >= model.least[best]:
                    predicted.add(no)
                    family = licenses.CLASSES[best]
                    if max(plain_similarity(tokens, t) for t in notices()[family]) >= licenses.SIMILAR:
                        confirmed.add(no)
                        families.add(family)
        want.append((doc_id, len(told), len(predicted), len(confirmed), ",".join(sorted(families))))
    got = [(r["doc_id"], r["n_paragraphs"], r["n_predicted"], r["n_confirmed"], r["families"])
           for r in licenses.scan(documents(rows), model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_least_probabilities_are_over_all_parts_outside_the_sample(documents):
    import numpy as np
    rows = [(i, f"under the public use of word{i}\nsource license {i % 7}\n\nplain words {i}") for i in range(120)]
    rows += [(500 + i, "All rights reserved.") for i in range(20)]
    docs = documents(rows)
    base = licenses.fit(docs, sample_docs=30, quantile=0.9)
    found, n = licenses.candidates(docs, base)
    sample = {r["doc_id"] for r in base.sample.collect()}
    every = [tokens for d, t in rows if d not in sample for part in plain_parts(t) for tokens in part]
    assert len(sample) == 30 and n == len(every)
    high = {}
    for tokens in every:
        best, p = plain_best(tokens, base)
        if best and p >= 0.5 and max(plain_similarity(tokens, t) for ts in notices().values() for t in ts) < 0.2:
            high.setdefault(best, []).append(p)
    want = [0.5] * len(licenses.CLASSES)
    for best, values in high.items():
        if len(values) > base.tail * n:
            want[best] = max(0.5, float(np.quantile(values, 1 - base.tail * n / len(values))))
    assert licenses.calibrated(base, found, n).least == pytest.approx(want, abs=1e-9)


def test_parts_left_out_early_could_not_be_found(corpus, model):
    needed = set(licenses.needed_words(model))
    assert needed and needed < {w for g in model.grams for w in g.split()}
    for r in licenses.lines(corpus).collect():
        best, p = plain_best(r["tokens"], model)
        assert needed & set(r["tokens"]) or not (best and p >= 0.5)
