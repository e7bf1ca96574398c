"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

Two gated recurrent layers read the UTF-8 bytes of a segment forwards and
backwards. Their joined states give a probability of each language at every
byte, so every position is labelled; a document's probabilities are the means
over all its positions. Texts are cut into segments of a fixed number of
bytes, which run through the network side by side as one numpy batch; together
the segments cover the whole text.

The network is trained in numpy by backpropagation through time on the driver,
from a bounded sample: ``per_language`` documents of each language, chosen by
the hash of their doc_id, and of a longer text a passage of ``longest``
characters at a place chosen by the same. Ids are chosen first, and only the
chosen texts are fetched. Prediction needs no shuffle; the weights are a few tens of kilobytes.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or if there was nothing to learn from; ties go to the language that sorts
first; rows without ``lang`` are not learnt from. Repeated rows each get
their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, held_out, passage, read_table

UNKNOWN = "und"
#: Bytes of a segment, and segments that run side by side.
SEGMENT, SIDE_BY_SIDE = 128, 1024


@dataclass
class Network:
    """Per direction: what each byte adds to the gates (3H x 256), and the recurrent weights (3H x H).

    Rows are, in threes of H: how much of the state stays, how much of it the
    new value uses, and the new value. Segments run along the last axis.
    """

    languages: list[str]
    by_byte: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], width: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(languages, [some(3 * width, 256, scale=0.3) for _ in "fb"],
                   [some(3 * width, width, scale=width ** -0.5) for _ in "fb"],
                   some(len(languages), 2 * width, scale=width ** -0.5), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.by_byte, *self.recurrent, self.out, self.bias]

    @property
    def width(self) -> int:
        return self.recurrent[0].shape[1]

    def run(self, side: int, ids: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, steps x H x segments; positions not ``inside`` a segment change nothing."""
        table, weights, width = self.by_byte[side], self.recurrent[side], self.width
        kind, count = table.dtype, ids.shape[1]
        states = np.empty((len(ids), width, count), kind)
        state = np.zeros((width, count), kind)
        given, past = np.empty((3 * width, count), kind), np.empty((3 * width, count), kind)
        full = inside.all(1)
        for t in range(len(ids)) if side == 0 else range(len(ids) - 1, -1, -1):
            np.take(table, ids[t], 1, given, "clip")
            np.matmul(weights, state, past)
            gates, new, old = given[:2 * width], given[2 * width:], past[2 * width:]
            gates += past[:2 * width]  # the logistic function, by tanh
            gates *= 0.5
            np.tanh(gates, gates)
            gates *= 0.5
            gates += 0.5
            stay, use = gates[:width], gates[width:]
            if keep is not None:
                keep.append((t, state, stay.copy(), use.copy(), old.copy()))
            old *= use
            new += old
            np.tanh(new, new)
            if keep is not None:
                keep[-1] += (new.copy(),)
            after = states[t]
            np.subtract(state, new, after)
            after *= stay
            after += new
            if not full[t]:
                np.copyto(after, state, where=~inside[t])
            state = after
        return states

    def _scores(self, forwards: np.ndarray, backwards: np.ndarray) -> np.ndarray:
        """Probability of each language at each position: steps x languages x segments."""
        z = self.out[:, :self.width] @ forwards
        z += self.out[:, self.width:] @ backwards
        z += self.bias[:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, z)
        z /= z.sum(1, keepdims=True)
        return z

    def label(self, ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return self._scores(self.run(0, ids, inside), self.run(1, ids, inside))

    def gradients(self, ids: np.ndarray, inside: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, backwards through time."""
        width, count = self.width, max(1, int(inside.sum()))
        kept: list[list] = [[], []]
        states = [self.run(side, ids, inside, kept[side]) for side in (0, 1)]
        p = self._scores(*states)
        segments = np.arange(ids.shape[1])
        loss = float(-(np.log(p[:, target, segments] + 1e-9) * inside).sum() / count)
        p[:, target, segments] -= 1
        p *= (inside[:, None, :] / count).astype(p.dtype)
        d_out = np.concatenate([np.einsum("tls,ths->lh", p, s) for s in states], 1)
        d_both = self.out.T @ p
        tables, recurrents = [], []
        for side in (0, 1):
            weights = self.recurrent[side]
            d_table, d_weights = np.zeros((256, 3 * width), weights.dtype), np.zeros_like(weights)
            d_state = np.zeros((width, ids.shape[1]), weights.dtype)
            for t, state, stay, use, past, new in reversed(kept[side]):
                d_after = d_state + d_both[t][side * width:(side + 1) * width]
                d = d_after * inside[t]
                d_new = d * (1 - stay) * (1 - new * new)
                d_stay = d * (state - new) * stay * (1 - stay)
                d_use = d_new * past * use * (1 - use)
                np.add.at(d_table, ids[t], np.concatenate([d_stay, d_use, d_new]).T)
                d_past = np.concatenate([d_stay, d_use, d_new * use])
                d_weights += d_past @ state.T
                d_state = d_after * ~inside[t] + d * stay + weights.T @ d_past
            tables.append(d_table.T)
            recurrents.append(d_weights)
        return loss, [*tables, *recurrents, d_out, p.sum((0, 2))]


def segments(data: bytes, size: int) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)]


def pack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as columns of byte ids, and which positions are inside a segment."""
    steps = max(map(len, parts))
    ids = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in parts), np.uint8).reshape(len(parts), steps).T
    lengths = np.array([len(p) for p in parts])
    return np.ascontiguousarray(ids), np.arange(steps)[:, None] < lengths[None, :]


def train(texts: list[str], langs: list[str], width: int = 8, steps: int = 64, batch: int = 128,
          rounds: int = 400, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Train on random segments of the texts, each language as often as any other."""
    names = sorted(set(langs))
    if not names:
        return None
    net = Network.new(names, width, seed)
    rng = np.random.default_rng(seed)
    by_language = [[t.encode() for t, lang in zip(texts, langs) if lang == name] for name in names]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in "12")
    for i in range(1, rounds + 1):
        target = rng.integers(len(names), size=batch)
        parts = []
        for k in target:
            data = by_language[k][rng.integers(len(by_language[k]))]
            at = rng.integers(max(1, len(data) - steps + 1))
            parts.append(data[at:at + steps])
        _, grads = net.gradients(*pack(parts), target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        speed = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            g = g * min(1.0, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (speed * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean probabilities over its positions, and how many positions each language labels."""
    parts, owner = [], []
    for i, data in enumerate(texts):
        cut = segments(data, SEGMENT)
        parts += cut
        owner += [i] * len(cut)
    order = np.argsort([len(p) for p in parts], kind="stable")
    total = np.zeros((len(texts), len(net.languages)))
    marks = np.zeros((len(texts), len(net.languages)), np.int64)
    owners = np.array(owner, int)
    for at in range(0, len(parts), SIDE_BY_SIDE):
        some = order[at:at + SIDE_BY_SIDE]
        ids, inside = pack([parts[i] for i in some])
        p = net.label(ids, inside)
        if not inside.all():
            p *= inside[:, None, :]
        best = p.argmax(1)
        for k in range(len(net.languages)):
            np.add.at(total[:, k], owners[some], p[:, k].sum(0))
            np.add.at(marks[:, k], owners[some], ((best == k) & inside).sum(0))
    lengths = np.array([max(1, len(t)) for t in texts])
    return total / lengths[:, None], marks


def sample_ids(known: DataFrame, per_language: int) -> list[tuple[str, int]]:
    """``(lang, doc_id)`` of ``known(lang, doc_id)``: of each language the ids with the lowest hashes.

    A threshold on the hash that some twice as many ids pass is known from the
    languages' counts; so no language, however common, goes through one task.
    """
    ids = checkpoint(known.select("lang", "doc_id").distinct())
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(2.0 * per_language + 100) / F.col("n")
    rank = (F.xxhash64("doc_id") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    near = ids.join(F.broadcast(counts), "lang").filter(rank < share).select("lang", "doc_id", rank.alias("rank"))
    taken: dict[str, int] = {}
    chosen = []
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["rank"], r["doc_id"] is not None, r["doc_id"] or 0)):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            chosen.append((r["lang"], r["doc_id"]))
    return chosen


def fit(docs: DataFrame, per_language: int = 600, longest: int = 10_000) -> Network | None:
    """Train on documents with a language that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}")).select(
        "lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = docs.sparkSession.createDataFrame(sample_ids(known, per_language), "of_lang string, of_doc long")
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("lang") == F.col("of_lang"))
    part = passage(F.col("text"), F.col("doc_id"), longest)
    rows = (known.join(F.broadcast(chosen), on).groupBy("lang", "doc_id")
            .agg(F.min(F.struct(F.xxhash64("text").alias("h"), part.alias("text"))).alias("t")).collect())
    rows = sorted(((r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, r["t"]["text"]) for r in rows))
    return train([r[3] for r in rows], [r[0] for r in rows])


SCHEMA = "struct<lang:string,score:double,positions:map<string,bigint>>"


def predict_column(net: Network):
    """A Column function: text to language, its mean probability, and positions labelled by language."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("positions", pa.map_(pa.string(), pa.int64()))])

    @F.arrow_udf(SCHEMA)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            means, marks = pooled(net, batch.to_pylist())
            best = means.argmax(1) if len(means) else []
            yield pa.array([{"lang": net.languages[k], "score": float(min(1.0, m[k])),
                             "positions": [(n, int(c)) for n, c in zip(net.languages, mark)]}
                            for k, m, mark in zip(best, means, marks)], kind)

    return predict


def identify(docs: DataFrame, net: Network | None, out: str = "found") -> DataFrame:
    """``docs`` with a struct ``lang, score, positions`` for each whole text in a new column."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                    F.create_map().cast("map<string,bigint>").alias("positions"))
    if net is None:
        return docs.withColumn(out, none)
    letters = F.col("text").isNotNull() & F.col("text").rlike("\\p{L}")
    data = F.when(letters, F.col("text")).otherwise(F.lit("")).cast("binary")
    return docs.withColumn(out, F.when(letters, predict_column(net)(data)).otherwise(none))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"))
