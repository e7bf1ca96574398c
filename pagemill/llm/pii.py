"""Personal data by bootstrapped contextual extraction (operator 2).

Base entities (e-mail and IP addresses, card and phone numbers) are found by
exact rules and are the seeds. Every seed, and every other token or run of
digit groups that looks like an identifier, is an *instance*; the words around
its occurrences make lexical *patterns*. Spark scores the graph of patterns
and instances in rounds until nothing changes: the confidence of a pattern for
a kind is the summed score of its
instances of that kind over the number of its different instances, and an
instance that is no seed gets its score from the accepted patterns that it
occurs in. An accepted pattern with a word on either side also proposes
instances of its own: all text between the two words, if at least half of its
characters are in words with a digit, an ``@`` or an inner point. These enter the
graph, which is scored again until no such pattern is new. Occurrences of
accepted instances in accepted patterns are added to the base spans, which
always stay.

The graph has one row per different pattern and instance, so copies of a text
add nothing to it; a value of over ``LONG`` characters is named by its digest.
Texts are read once, and once more for each set of new patterns, and never
shuffled.

Defined results: a null text counts as empty; a text without any finding has
empty spans; kinds are looked for independently, so spans of two kinds may
overlap; added spans never overlap base spans, and of added spans of a kind
that lie within each other the longest stays; a token accepted for two kinds
belongs to the one with the higher score, then the one listed first. Repeated
rows each get their row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, read_table, text_key, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins where a run of digits does, so the look-behind only saves work
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]")
#: Signs of digit groups in seeds; groups are joined by blanks.
GROUP = re.compile(r"[0-9().+-]+")
WORD = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@]|[^\W_]\.[^\W_]")
LONG = 64
EDGES = "\"'`.,;:!?()[]{}<>"
#: Characters beside an occurrence in which its context words are looked for.
CONTEXT = 60

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text)
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base entities by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


def _bare(text: str, start: int, end: int) -> Span:
    """The span without the signs of ``EDGES`` at its ends."""
    while start < end and (text[start] in EDGES or text[start].isspace()):
        start += 1
    while end > start and (text[end - 1] in EDGES or text[end - 1].isspace()):
        end -= 1
    return start, end


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans``, ordered by start, that touch none of ``taken``."""
    out, taken, i, reach = [], sorted(taken), 0, 0
    for a, b in spans:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a < b:
            out.append((a, b))
    return out


def _run(text: str, start: int, end: int) -> Span:
    """The span of digit groups without points, signs and single brackets at its ends."""
    while end > start and text[end - 1] in ".(+-":
        end -= 1
    if text[end - 1] == ")" and text.find("(", start, end) < 0:
        end -= 1
    if text[start] == "(" and text.find(")", start, end) < 0:
        start += 1
    return start, end


def identifiers(text: str, taken: list[Span]) -> list[Span]:
    """Tokens and runs of digit groups that look like identifiers and touch none of ``taken``: three digits or
    more, or an ``@`` within."""
    tokens, groups, past = [], [], 0  # groups: start and end of runs, and whether they go on
    m = MARK.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > past and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        past = end
        a, b = _bare(text, start, end)
        if len(DIGIT.findall(text, a, b)) >= 3 or text.find("@", a + 1, b - 1) >= 0:
            tokens.append((a, b))
        token = text[start:end]
        left = len(token) - len(token.lstrip("\"'`[{<"))
        right = len(token.rstrip("\"'`.,;:!?]}>"))
        if GROUP.fullmatch(token, left, right):
            if groups and groups[-1][2] and not left and not text[groups[-1][1]:start].strip(" "):
                groups[-1] = (groups[-1][0], start + right, right == len(token))
            else:
                groups.append((start + left, start + right, right == len(token)))
        m = MARK.search(text, end)
    runs = [_run(text, a, b) for a, b, _ in groups if " " in text[a:b]]
    runs = [(a, b) for a, b in runs if len(DIGIT.findall(text, a, b)) >= 3]
    return sorted({*_free(tokens, taken), *_free(runs, taken)})


def marked(text: str) -> float:
    """Share of the characters of words that are in words with a digit, an ``@`` or an inner point."""
    found = [(len(w), bool(MARKED.search(w))) for w in text.split()]
    return sum(n for n, m in found if m) / max(1, sum(n for n, _ in found))


def proposals(text: str, frames: dict[str, set[str]], taken: list[Span]) -> list[Span]:
    """Texts between a left word and the next of its right words in ``frames``, from the last left word before it."""
    out, past, left, at = [], 0, None, 0
    for m in WORD.finditer(text):
        word = DIGIT.sub("0", m.group().lower())
        if left and past > at and word in frames[left]:
            out.append(_bare(text, at, past))
            left = None
        if word in frames:
            left, at = word, m.end()
            past = at
        else:
            past = m.end()
    return [(a, b) for a, b in _free(out, taken) if 2 * marked(text[a:b]) >= 1]


def name(value: str) -> str:
    """What stands for a value in the graph."""
    value = value.lower()
    return value if len(value) <= LONG else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: the two words before it, and the word on either side."""
    before = text[max(0, start - CONTEXT):start].lower().split()
    after = text[end:end + CONTEXT].lower().split()
    last, following = before[-1:], after[:1]
    out = []
    if len(before) > 1:
        out.append(" ".join(before[-2:]) + " _")
    if last and following:
        out.append(f"{last[0]} _ {following[0]}")
    return [DIGIT.sub("0", p) for p in out]


FOUND = ("doc_id long, key long, base array<struct<kind:string,start:int,end:int>>, "
         "seen array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>")
_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("base", pa.list_(pa.struct(_SPAN))),
                    ("seen", pa.list_(pa.struct([*_SPAN, ("value", pa.string()),
                                                 ("patterns", pa.list_(pa.string()))])))])
#: Documents for which rows are sent back at a time.
ROWS = 500


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            base = base_spans(text)
            taken = [(s, e) for _, s, e in base]
            seen = [(k, s, e) for k, s, e in base] + [(None, s, e) for s, e in identifiers(text, taken)]
            rows.append({"doc_id": doc_id, "key": key, "base": [dict(zip(("kind", "start", "end"), b)) for b in base],
                         "seen": [{"kind": k, "start": s, "end": e, "value": name(text[s:e]),
                                   "patterns": patterns(text, s, e)} for k, s, e in seen]})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_spans(docs: DataFrame) -> DataFrame:
    """Base spans of each row of ``docs``, and all occurrences of instances with their patterns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       text_or_empty("text").alias("text"))
    return rows.mapInArrow(_read, FOUND)


def propose_spans(docs: DataFrame, frames: dict[str, set[str]]) -> DataFrame:
    """The rows of ``docs`` like ``read_spans``, ``seen`` having what ``frames`` propose and identifiers are not."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                taken = [(s, e) for _, s, e in base_spans(text)]
                spans = proposals(text, frames, taken)
                known = set(identifiers(text, taken)) if spans else set()
                seen = [{"kind": None, "start": s, "end": e, "value": name(text[s:e]),
                         "patterns": patterns(text, s, e)} for s, e in spans if (s, e) not in known]
                if seen:
                    rows.append({"doc_id": doc_id, "key": key, "base": [], "seen": seen})
            for i in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_pylist(rows[i:i + ROWS], _ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       text_or_empty("text").alias("text"))
    return rows.mapInArrow(read, FOUND)


def _state(scored: DataFrame, item: str, score: str) -> tuple[int, int | None]:
    hashes = F.xxhash64(item, "kind", F.round(score, 3)).cast("decimal(38,0)")
    return tuple(scored.agg(F.count(F.lit(1)), F.sum(hashes)).first())


def score_graph(occurrences: DataFrame, support: float = 3.0, pattern_confidence: float = 0.8,
                instance_confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Accepted ``pattern, kind, confidence`` and discovered ``value, kind, score``.

    ``occurrences`` has ``value, kind, pattern``, the kind null for instances
    that are no seeds. A pattern is accepted for a kind with a summed score of
    at least ``support`` and a confidence of at least ``pattern_confidence``.
    The score of an instance is that of its best accepted pattern. Rounds end
    when patterns, instances and their scores to three decimals are as they
    were after some round before.
    """
    edges = checkpoint(occurrences.select("pattern", "value").distinct())
    seeds = checkpoint(occurrences.filter("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score"))
                       .distinct())
    sizes = checkpoint(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    scores, states = seeds, set()
    while True:
        sums = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        accepted = checkpoint(sums.join(sizes, "pattern").withColumn("confidence", F.col("sum") / F.col("n"))
                              .filter((F.col("sum") >= support) & (F.col("confidence") >= pattern_confidence))
                              .select("pattern", "kind", "confidence"))
        by_kind = (edges.join(accepted, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
                   .filter(F.col("score") >= instance_confidence))
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        best = by_kind.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("less"), rank.alias("rank"), "kind"))
                                            .alias("b"))
        found = checkpoint(best.select("value", F.col("b.kind").alias("kind"), (-F.col("b.less")).alias("score"))
                           .join(seeds.select("value").distinct(), "value", "left_anti"))
        state = (_state(accepted, "pattern", "confidence"), _state(found, "value", "score"))
        if state in states:
            return accepted, found
        states.add(state)
        scores = seeds.unionByName(found)


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, added`` for each row of ``docs``: base spans and those that patterns discovered."""
    rows = checkpoint(read_spans(docs))
    first = rows.select("doc_id", "key", F.explode("seen").alias("s"))
    seen, tried = first, set()
    while True:
        accepted, found = score_graph(seen.select("s.value", "s.kind", F.explode("s.patterns").alias("pattern")))
        both = accepted.filter(~F.endswith("pattern", F.lit(" _"))).select("pattern").distinct()
        now = {r["pattern"] for r in both.collect()}
        if now <= tried:
            break
        tried |= now
        frames: dict[str, set[str]] = {}
        for left, right in (p.split(" _ ") for p in tried if p.count(" _ ") == 1):
            frames.setdefault(left, set()).add(right)
        more = checkpoint(propose_spans(docs, frames)).select("doc_id", "key", F.explode("seen").alias("s"))
        seen = first.unionByName(more)
    # few instances are discovered, so their occurrences are looked up before their patterns
    places = (seen.filter("s.kind IS NULL").select("doc_id", "key", "s.value", "s.start", "s.end",
                                                   F.explode("s.patterns").alias("pattern"))
              .join(found.select("value", "kind"), "value").join(accepted, ["pattern", "kind"]))
    # of spans of a kind that lie within each other the longest stays
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("start", F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1)
    places = places.select("doc_id", "key", "kind", "start", "end").distinct().withColumn(
        "reach", F.max("end").over(before)).filter(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    added = checkpoint(places.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("kind", F.col("start"), F.col("end"))).alias("added"))
        .select(F.col("doc_id").alias("to_doc"), F.col("key").alias("to_key"), "added"))
    on = F.col("doc_id").eqNullSafe(F.col("to_doc")) & (F.col("key") == F.col("to_key"))
    return rows.join(added, on, "left").select(
        "doc_id", "key", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
        .alias("added"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by kind as listed, then start, joined by commas."""
    ordered = F.concat(*[F.array_sort(F.transform(of_kind(spans, k), lambda s: F.struct(s["start"], s["end"], s["kind"])))
                         for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
