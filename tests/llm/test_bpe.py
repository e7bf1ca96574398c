import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()
ENCODER = bpe.encoder(PATH, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ethaonis ", max_size=200),
                 st.builds(lambda s, n: s * n, st.sampled_from(["a", "the", "!!", "=-", "  ", "\n", "é", "1"]),
                           st.integers(0, 90))))
def test_ids_equal_the_public_library(text):
    ids = ENCODER.encode(text).tolist()
    assert ids == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 50_255), st.integers(0, 50_255))
def test_pairs_fit_exactly_if_merging_keeps_them(a, b):
    if ENCODER.made(a) and ENCODER.made(b):
        assert ENCODER.fit(a, b) == (ENCODER.merge(ENCODER.tokens[a] + ENCODER.tokens[b]) == [a, b])


def test_small_vocabulary_steps_back():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}
    small = bpe.Encoder(ranks, r"\w+|\W+")
    for text in ("abcd", "abc", "bcd", "abcabcd", "aabbccdd", "d" * 50):
        assert small.encode_bytes(text.encode()) == (
            [ranks[text.encode()]] if text.encode() in ranks else small.merge(text.encode()))


def test_documents_round_trip(spark, odd):
    rows = bpe.round_trip(odd).collect()
    assert len(rows) == odd.count()
    texts = {(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()}
    assert {(r["doc_id"], bytes(r["decoded"])) for r in rows} == texts
    for r in rows:
        assert r["ids"] == REFERENCE.encode_ordinary(bytes(r["decoded"]).decode())


def test_steps_apart_give_the_same_with_clashing_columns(spark, odd):
    from pyspark.sql import functions as F
    docs = odd.withColumn("rank", F.lit(1)).withColumn("Tokens", F.lit("x"))
    apart = bpe.decode(bpe.encode(docs, PATH, PATTERN, "n"), PATH, "n", "out")
    assert apart.columns == [*docs.columns, "n", "out"]
    once = bpe.round_trip(docs)
    key = lambda r: repr((r[0], r[1], bytes(r[2])))
    assert sorted(map(key, apart.select("doc_id", "n", "out").collect())) == sorted(map(key, once.collect()))


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    small = bpe.Encoder(ENCODER.ranks, PATTERN)
    texts = [f" word{i} zyxw{i * 7}" for i in range(200)]
    for text in texts + texts[::-1]:
        assert small.encode(text).tolist() == REFERENCE.encode_ordinary(text)
        assert len(small.pieces) + len(small.older) <= 2 * 3000 // bpe.MEMO_ROW and len(small.pairs) <= 20


def test_counts_equal_the_public_library_within_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    small = bpe.Encoder(ENCODER.ranks, PATTERN)
    texts = ["", "the  é", "x" * 300, *[f" word{i} zyxw{i * 7} the" for i in range(200)]]
    for text in texts + texts[::-1]:
        assert small.count(text) == len(REFERENCE.encode_ordinary(text))
        assert len(small.counts) + len(small.older_counts) <= 2 * 3000 // bpe.COUNT_ROW
    assert not small.pieces and not small.older


def test_search_asks_once_about_a_token(monkeypatch):
    asked, small = [], bpe.Encoder(ENCODER.ranks, PATTERN)
    monkeypatch.setattr(small, "made", lambda t, made=small.made: asked.append(t) or made(t))
    for text in (" thenining areerlyes", " denenkeitlichsch itrendwhor") * 3:
        assert small.encode(text).tolist() == REFERENCE.encode_ordinary(text)
        small.pieces.clear()
    known = [t for t in asked if small.whole[t]]
    assert known and len(known) == len(set(known))


class Asked:
    """An automaton that counts the matches taken from it."""

    def __init__(self, trie):
        self.trie, self.matches = trie, 0

    def _counted(self, found):
        for match in found:
            self.matches += 1
            yield match

    def iter(self, text):
        return self._counted(self.trie.iter(text))

    def iter_long(self, text, at):
        return self._counted(self.trie.iter_long(text, at))


def test_search_takes_few_matches_of_short_pieces():
    small, pieces = bpe.Encoder(ENCODER.ranks, PATTERN), [" thenining", " areerlyes", " denenkeitlichsch", " itrendwhor"]
    possible = sum(len(list(small.trie.iter(p))) for p in pieces)
    small.trie = Asked(small.trie)
    for piece in pieces:
        assert small.encode_bytes(piece.encode()) == REFERENCE.encode_ordinary(piece)
    assert small.trie.matches < possible / 2


@settings(max_examples=200, deadline=None)
@given(st.text("ethaonis\u00e9\u4e00", min_size=1, max_size=90), st.sampled_from([0, 8, 64, 1000]))
def test_short_and_long_pieces_are_searched_alike(piece, short):
    given_short, bpe.SHORT = bpe.SHORT, short
    try:
        assert ENCODER.encode_bytes(piece.encode()) == REFERENCE.encode_ordinary(piece)
    finally:
        bpe.SHORT = given_short


def test_search_without_some_single_bytes():
    ranks = {bytes([i]): i for i in range(256) if i not in b"ax"} | {b"ab": 256, b"abc": 257, b"bc": 258, b"bcxd": 259}
    small = bpe.Encoder(ranks, r"\w+|\W+")
    assert small.encode_bytes(b"d" * 3 + b"c" * 70) == [ranks[b"d"]] * 3 + [ranks[b"c"]] * 70
    assert small.encode_bytes(b"abce") == [ranks[b"abc"], ranks[b"e"]]
    for piece in (b"dxd", b"x" * 80):
        with pytest.raises(IndexError):
            small.encode_bytes(piece)


def test_batches_of_ids_decode_as_single_lists():
    tokens = bpe.by_id(ENCODER.tokens)
    lists = bpe.pa.array([[1, 2], None, [], [300, 4], None, [50_000] * 3, []], bpe.pa.list_(bpe.pa.int32()))
    for at in range(len(lists) + 1):
        part = lists.slice(at)
        out = bpe.joined(tokens, part)
        out.validate(full=True)
        assert out.to_pylist() == [None if ids is None else ENCODER.decode(ids) for ids in part.to_pylist()]
    with pytest.raises(LookupError):
        bpe.joined(bpe.by_id({0: b"a", 2: b"b"}), lists.slice(0, 1))
    with pytest.raises(LookupError):
        bpe.joined(tokens, bpe.pa.array([[10 ** 6]], lists.type))


def test_digests(spark, documents):
    row = bpe.round_trip(documents([(1, "hello world"), (2, "")])).select(
        "doc_id", bpe.digest_ids(bpe.F.col("ids")).alias("h")).collect()
    want = {1: ",".join(map(str, REFERENCE.encode_ordinary("hello world"))), 2: ""}
    assert {r["doc_id"]: r["h"] for r in row} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_empty_table(spark, documents):
    assert bpe.round_trip(documents([])).count() == 0


def test_missing_file_is_an_error():
    with pytest.raises(FileNotFoundError):
        bpe.encoder("/nowhere", PATTERN)
