import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The rules as they are written, one after another."""
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"\D", "", m.group()) if kind != "email" else ""
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab1.@-+ ", max_size=40), st.text("0125. -+()", max_size=60),
                 st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 010-9999",
                                           "256.1.1.1", "é@x.y", "@", ".", " ", "4041894974608795", "+"]),
                          max_size=8).map("".join)))
def test_base_spans_match_the_written_rules(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.identifiers(text, [])


def texts():
    rows = [(i, f"note number{i} please write to person{i}@mail.example.com or else") for i in range(12)]
    rows += [(100 + i, f"please write to user{i}#at#host{i}555 or else") for i in range(2)]
    rows += [(200 + i, f"we saw item-{i}-000{i} there") for i in range(5)]
    return rows + [(300, None), (301, ""), (302, rows[0][1]), (0, rows[0][1])]


def brute(rows, rounds=3):
    """The same scores in plain loops."""
    seen = []
    for doc_id, text in rows:
        text = text or ""
        base = plain(text)
        spans = base + [(None, s, e) for s, e in pii.identifiers(text, [(s, e) for _, s, e in base])]
        seen += [(doc_id, k, s, e, text[s:e].lower(), p) for k, s, e in spans for p in pii.patterns(text, s, e)]
    edges = {(p, v) for *_, v, p in seen}
    seeds = {(v, k) for _, k, _, _, v, _ in seen if k}
    scores = {vk: 1.0 for vk in seeds}
    for _ in range(rounds):
        accepted = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            for kind in pii.KINDS:
                total = sum(scores.get((v, kind), 0) for v in values)
                if total >= 3 and total / len(values) >= 0.8:
                    accepted[p, kind] = total / len(values)
        found = {}
        for v in {v for _, v in edges} - {v for v, _ in seeds}:
            best = max(((c, -pii.KINDS.index(k)) for (p, k), c in accepted.items() if (p, v) in edges), default=None)
            if best:
                found[v, pii.KINDS[-best[1]]] = best[0]
        scores = {vk: 1.0 for vk in seeds} | found
    return {(d, k, s, e) for d, kind, s, e, v, p in seen if kind is None
            for k in pii.KINDS if (v, k) in found and (p, k) in accepted}


def test_discovery_matches_plain_loops(spark, documents):
    rows = texts()
    got = pii.extract(documents(rows)).collect()
    assert len(got) == len(rows)
    added = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in got for x in r["added"]}
    assert added == brute(rows) and {d for d, *_ in added} == {100, 101}
    for r in got:
        assert [tuple(x) for x in r["base"]] in [plain(t or "") for i, t in rows if i == r["doc_id"]]


def test_spans_are_ordered_text(spark, documents):
    row = pii.extract(documents([(1, "b@c.de 1.2.3.4 a@b.cd")])).select(pii.spans_text(F.col("base")).alias("t")).first()
    assert row["t"] == "email:0:6,email:15:21,ip:7:14"


def test_odd_rows_and_empty_table(spark, odd, documents):
    docs = odd.withColumn("key", F.lit(1)).withColumn("base", F.lit(2)).withColumn("kind", F.lit("x"))
    assert pii.extract(docs).count() == odd.count()
    assert pii.extract(documents([])).count() == 0


def test_identifiers_hold_spaces_and_have_no_length_limits():
    def found(text):
        return {text[a:b] for a, b in pii.identifiers(text, [])}
    assert "030 1234 5678" in found("call 030 1234 5678 now")
    assert "(555) 010-9999" in found("call (555) 010-9999, now")
    assert "4111 1111 1111 1112" in found("card: 4111 1111 1111 1112.")
    assert found("id " + "x9" * 100) == {"x9" * 100} and found("see 1234") == {"1234"}
    assert pii.identifiers("a 12 b", []) == [] and pii.identifiers("call 030 1234 5678", [(5, 8)]) == [(9, 13), (14, 18)]


def test_patterns_propose_spans_with_spaces(documents):
    rows = [(i, f"note{i} please write to person{i}@mail.example.com or else") for i in range(30)]
    rows += [(40 + i, f"please call +49 30 5555 01{i} now") for i in range(10, 40)]
    rows += [(100, "please write to jane at example.com or else"), (101, "please write to the nearest office or else"),
             (102, "please call 030 1234 5678 now"), (103, "please call (555) 010-9999 now"),
             (104, "please write to user#at#" + "host555" * 20 + " or else")]
    text = dict(rows)
    added = {(r["doc_id"], x["kind"], text[r["doc_id"]][x["start"]:x["end"]])
             for r in pii.extract(documents(rows)).collect() for x in r["added"]}
    assert added == {(100, "email", "jane at example.com"), (102, "phone", "030 1234 5678"),
                     (103, "phone", "(555) 010-9999"), (104, "email", "user#at#" + "host555" * 20)}


def test_proposals_take_linear_time():
    for text in ("a 1 b " * 50_000, "a " * 100_000 + "1 b", "a" + " 1" * 100_000):
        pii.proposals(text, {"a": {"b"}}, [])


def test_rounds_go_on_along_a_chain(spark):
    rows = [(f"seed{k}-{i}", "email", f"p{k}") for k in range(1, 8) for i in range(7)]
    rows += [(f"link{k}", None, f"p{k}") for k in range(1, 8)] + [(f"link{k - 1}", None, f"p{k}") for k in range(2, 8)]
    accepted, found = pii.score_graph(spark.createDataFrame(rows, "value string, kind string, pattern string"))
    assert {r["value"] for r in found.collect()} == {f"link{k}" for k in range(1, 8)}
    assert {r["pattern"] for r in accepted.collect()} == {f"p{k}" for k in range(1, 8)}
