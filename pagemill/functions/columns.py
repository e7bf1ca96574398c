"""Columns over whole arrays: built once, bound once, and running values by blocks.

A Column of nested lambdas takes thousands of small calls to the JVM to build,
which can take longer than a job over a few thousand pages. It names its
inputs and is bound to no DataFrame, so it can serve every later query (and
every trigger) of the process.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of ``prefix_scan``.
BLOCK = 128


def built_once(build):
    """Keep what ``build(*args)`` returns, for hashable ``args``, as long as the same JVM is used."""
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        jvm = SparkContext._gateway
        if jvm is None:  # no JVM of this process behind the columns
            return build(*args)
        if kept.get("jvm") is not jvm:
            kept.clear()
            kept["jvm"] = jvm
        if args not in kept:
            kept[args] = build(*args)
        return kept[args]

    return get


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_scan(values: Column, start: Column, identity: Column, combine) -> Column:
    """Running values of an array: before each element what ``combine`` makes of ``start`` and all before it, and
    last what it makes of all.

    An append copies the array so far, so one fold would copy the square of
    its length. Here the blocks are folded alone first, then over the blocks,
    and then within each from what precedes it.
    """
    def step(acc, x):
        return F.array_append(acc, combine(F.element_at(acc, -1), x))

    def from_heads(blocks, heads):
        inside = F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.get(heads, i)), step), 1, F.size(b)))
        return F.concat(F.flatten(inside), F.array(F.element_at(heads, -1)))

    def from_blocks(blocks):
        heads = F.aggregate(blocks, F.array(start), lambda acc, b: step(acc, F.aggregate(b, identity, lambda m, x: combine(m, x))))
        return let(heads, lambda h: from_heads(blocks, h))

    def from_values(v):
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))), from_blocks)

    return let(values, from_values)
