import hashlib
import random
import zlib

from pyspark.sql import functions as F

from pagemill.llm import merkle, ranks


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def reduce(nodes):
    """The root, and for each node its siblings level by level as (left, right)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % 3
            paths[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1:start + 3])))
            at[k] = i // 3
        nodes = [h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        plain = plain_leaf(doc_id, source, lang, n_chars, text)
        other = plain
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = plain_leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, plain, other, doc_id))
    if not groups:
        return []
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in sources:
        groups[s].sort(key=lambda r: r[:4])
        built.append(reduce([r[2] for r in groups[s]]))
    root, top = reduce([b[0] for b in built])
    out = []
    for k, s in enumerate(sources):
        for row, path in zip(groups[s], built[k][1]):
            path = path + top[k]
            folded = row[3]
            for left, right in path:
                folded = h(left + folded + right)
            out.append((row[4], row[2], built[k][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def result(docs):
    rows = merkle.manifest(docs).collect()
    return sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in rows], key=repr)


def plain_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]


def test_odd_rows_match_brute_force(odd):
    assert result(odd) == brute(plain_rows(odd))


def test_several_passes_and_many_sources(documents):
    r = random.Random(3)
    rows = [(r.choice([i, -i, i << 40]), f"line {i}\nnext", "en", "hot" if i % 3 else None) for i in range(900)]
    rows += [(1000 + i, "x\n", None, f"s{i:03d}é") for i in range(260)]
    docs = documents(rows + rows[:5] + [(None, "n\n", "en", "hot")] * 3)
    got = result(docs)
    assert got == brute(plain_rows(docs))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_no_rows_and_one_row_and_clashing_columns(documents):
    assert result(documents([])) == []
    one = documents([(7, "a\nb", "en", "s")])
    assert result(one) == brute(plain_rows(one))
    extra = one.withColumn("grp", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("pos", F.lit(3))
    assert result(extra) == brute(plain_rows(one))


def test_positions_match_a_sort(spark):
    r = random.Random(1)
    ids = [None, 1, 5, -7, 2 ** 63 - 1, -2 ** 63]
    rows = [(r.choice(["a", "b", None]), r.choice([*ids, r.randrange(300), r.randrange(-10 ** 18, 10 ** 18)]),
             hashlib.sha256(str(r.randrange(3)).encode()).digest()) for _ in range(300)]
    table = spark.createDataFrame(rows, "g string, i long, d binary").checkpoint()
    want = []
    for g in {x[0] for x in rows}:
        members = sorted([x for x in rows if x[0] == g], key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want += [(*x, p) for p, x in enumerate(members)]
    got = [(x.g, x.i, bytes(x.d), x.pos) for x in ranks.positions(table, ["g"], "i", "d").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ranks.positions(table.limit(0), ["g"], "i", "d").count() == 0


def test_texts_are_not_shuffled(documents):
    plan = merkle.leaves(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
