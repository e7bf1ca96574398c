"""Byte-level BPE encoding and decoding (operator 9).

The vocabulary's byte strings are mapped to Latin-1, one character a byte, and
put into an Aho-Corasick automaton, which yields the longest token that starts
at a byte: for short pieces at the bytes that the search comes to, for others
at each byte in one pass. Encoding then goes from left to right, always
trying the longest token, and steps back to the next shorter one when the
token can't follow the one before it. Two tokens can stand side by side
exactly if merging their joined bytes gives the two tokens again; that answer
is found from the few tokens that meet at the border. What is memoised per pair
is the longest prefix of the second token that can follow the first. A sequence
whose neighbours all agree in this way is the one that the merges produce, so
the result is exact. A byte position that was given up is marked and never
entered again, which keeps the work linear.

Text is split by the tokenizer's pattern first and each match is encoded
separately; results of short matches are memoised up to a fixed number of bytes.
Decoding needs the table of tokens alone. A round trip does both in one Python
step, so that a task has one worker with one encoder.

Defined results: a null text counts as empty; an empty text gives no ids and
decodes to no bytes. Only ``text`` and, if asked, other named columns are read.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, read_table, slices

#: Bytes of pieces that a worker remembers in each of two generations, and the longest piece remembered in characters.
MEMO_BYTES, MEMO_LENGTH = 32 << 20, 48
#: Bytes that a remembered piece takes beside its characters and ids: two objects and a place in a dictionary.
MEMO_ROW = 190
#: The same of a remembered piece whose ids are only counted: one object and a place in a dictionary.
COUNT_ROW = 140
#: Pairs of tokens that a worker remembers.
PAIRS = 150_000
NEVER = 1 << 60
#: Longest piece in bytes whose longest tokens are looked up only where the search comes to.
SHORT = 64
#: Marks a byte at which no token was looked up yet.
UNKNOWN = -2


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its id on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        # The automaton asks a node's bytes in the order of arrival: those of the first merges come first.
        for token, rank in sorted(ranks.items(), key=lambda t: (len(t[0]) == 1, t[1])):
            self.trie.add_word(token.decode("latin-1"), (rank, len(token)))
        self.trie.make_automaton()
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, int] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.shorter: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = MEMO_BYTES
        self.counts: dict[str, int] = {}
        self.older_counts: dict[str, int] = {}
        self.count_room = MEMO_BYTES

    def merge(self, data: bytes, left: int = 1) -> list[int]:
        """Ids by the plain rule: join the neighbours of lowest rank until none can be joined or ``left`` remain."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > left:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank == NEVER:
                break
            at = ranks.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for single bytes and for tokens that no merge makes."""
        if token not in self.splits:
            data = self.tokens[token]
            halves = self.merge(data, 2) if len(data) > 1 else []
            self.splits[token] = tuple(halves) if len(halves) == 2 else None
        return self.splits[token]

    def made(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.sizes[token] == 1 or self.split_of(token) is not None
        return known

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while a token is made, from the
        byte on, each with the rank of the merge that takes it up."""
        if token not in self.edges[side]:
            steps, upper = [(self.tokens[token], NEVER)], token
            while (halves := self.split_of(upper)) is not None:
                steps.append((self.tokens[halves[side]], upper))
                upper = halves[side]
            self.edges[side][token] = steps[::-1]
        return self.edges[side][token]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two tokens.

        It does unless, at some time, what stands on the two sides of the
        border could merge before either is taken up by its own token. Of two
        merges of one rank the leftmost comes first.
        """
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.ranks.get(x + y, NEVER)
            if across < x_ends and across <= y_ends and across != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def first_fit(self, before: int, token: int) -> int:
        """The longest token, from ``token`` on down its prefixes, that can follow ``before`` (-1: begin a piece), or -1."""
        pair = before << 32 | token
        while token >= 0 and not ((self.whole.get(token) or self.made(token)) and (before < 0 or self.fit(before, token))):
            token = self.next_shorter(token)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = token
        return token

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1)
                                                if data[:n] in self.ranks), -1)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if data in self.ranks:
            return [self.ranks[data]]
        text, end, trie = data.decode("latin-1"), len(data), self.trie
        if end <= SHORT:
            longest = [UNKNOWN] * end
        else:
            longest = [-1] * end
            for last, (rank, length) in trie.iter(text):
                longest[last - length + 1] = rank  # ends come in rising order, so the last one is the longest
        sizes, pairs, shut = self.sizes, self.pairs, set()
        ids, before, at, token = [], -1, 0, longest[0]
        while at < end:
            if token == UNKNOWN:  # the longest token here, the one after it and so on, up to a byte that is known
                start = at
                for last, (rank, length) in trie.iter_long(text, at):
                    if last - length + 1 != start or longest[start] != UNKNOWN:
                        break
                    longest[start] = rank
                    start = last + 1
                token = longest[at]
            while token >= 0:
                known = pairs.get(before << 32 | token)
                token = self.first_fit(before, token) if known is None else known
                if not shut or token < 0 or at + sizes[token] not in shut:
                    break
                token = self.next_shorter(token)
            if token >= 0:
                ids.append(token)
                before = token
                at += sizes[token]
                token = longest[at] if at < end else -1
            else:  # nothing fits here: never come to this byte again, and shorten the token before it
                shut.add(at)
                token = ids.pop()
                before = ids[-1] if ids else -1
                at -= sizes[token]
                token = self.next_shorter(token)
        return ids

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as 4-byte numbers. A full memory becomes the older one, whose pieces come back when met."""
        ids = self.older.get(piece) or array("i", self.encode_bytes(piece.encode())).tobytes()
        if len(piece) <= MEMO_LENGTH:
            self.room -= MEMO_ROW + 2 * len(piece) + len(ids)
            if self.room < 0:
                self.older, self.pieces, self.room = self.pieces, {}, MEMO_BYTES
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        get, make = self.pieces.get, self.encode_piece
        return np.frombuffer(b"".join([get(p) or make(p) for p in self.split(text)]), "i4")

    def count_piece(self, piece: str) -> int:
        """The number of ids of one piece, remembered as the ids of ``encode_piece`` are."""
        n = self.older_counts.get(piece) or len(self.encode_bytes(piece.encode()))
        if len(piece) <= MEMO_LENGTH:
            self.count_room -= COUNT_ROW + 2 * len(piece)
            if self.count_room < 0:
                self.older_counts, self.counts, self.count_room = self.counts, {}, MEMO_BYTES
            self.counts[piece] = n
        return n

    def count(self, text: str) -> int:
        """The number of ids of a text."""
        get, make = self.counts.get, self.count_piece
        return sum([get(p) or make(p) for p in self.split(text)])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def by_id(tokens: dict[int, bytes]) -> pa.Array:
    """Tokens by id; null where there is none."""
    return pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.binary())


def joined(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of token ids; null for a null list."""
    parts, ends = tokens.take(lists.flatten()), np.zeros(len(lists) + 1, np.int32)
    if parts.null_count:
        raise KeyError("ids without a token")
    np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(), out=ends[1:])
    starts = np.cumsum(np.append(0, pc.binary_length(parts).to_numpy()), dtype=np.int32)
    data = parts.buffers()[2] if len(parts) else pa.py_buffer(b"")
    out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(starts[ends]), data])
    return pc.if_else(lists.is_valid(), out, None) if lists.null_count else out


def _kept(name: str, key: tuple, make):
    """What ``make()`` gives, made once a worker process.

    The library's code travels with each task and brings its own globals, so
    what is to outlive a task is kept in a module of the worker's own.
    """
    kept = sys.modules.setdefault("pagemill_worker", types.ModuleType("pagemill_worker")).__dict__.setdefault(name, {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return read_ranks(lines)


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, made once a worker process."""
    return _kept("encoders", (path, pattern), lambda: Encoder(_ranks(path), pattern))


def token_table(path: str) -> pa.Array:
    """The tokens of a rank file by id, made once a worker process."""
    return _kept("tokens", (path,), lambda: by_id({rank: token for token, rank in _ranks(path).items()}))


def default_vocabulary() -> tuple[str, str]:
    """Path of the multilingual rank file, and its pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def _adding(df: DataFrame, source: str, added: list[T.StructField], make, limit: int) -> DataFrame:
    """``df`` with the columns that ``make(column)`` gives from another, a bounded part of a batch at a time."""
    bound_batches(df.sparkSession)
    at, names = df.columns.index(source), [*df.columns, *[f.name for f in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column. The rank file must be on every executor."""
    def make(texts: pa.Array) -> list[pa.Array]:
        enc = encoder(path, pattern)
        return [_lists([enc.encode(t or "") for t in texts.to_pylist()])]

    return _adding(docs, "text", [_ids_field(ids)], make, 2 << 20)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its token ids in a new column."""
    def make(lists: pa.Array) -> list[pa.Array]:
        return [joined(token_table(path), lists)]

    return _adding(encoded, ids, [T.StructField(out, T.BinaryType())], make, 1 << 20)


def both(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of ``text`` and the bytes that the ids decode to, in one Python step."""
    def make(texts: pa.Array) -> list[pa.Array]:
        enc = encoder(path, pattern)
        encoded = _lists([enc.encode(t or "") for t in texts.to_pylist()])
        return [encoded, joined(token_table(path), encoded)]

    return _adding(docs, "text", [_ids_field(ids), T.StructField(out, T.BinaryType())], make, 1 << 20)


def digest_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of whole texts."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    return both(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids", "decoded")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest_ids(F.col("ids")).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
