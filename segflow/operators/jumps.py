"""Greedy groups of ordered rows whose rule needs the whole group so far, with one long item spread over many tasks.

Rows are cut into blocks by their index.  What a block does to a group that is open when it begins depends only on the row at which that group ends, and a group
that begins earlier never ends later, so these rows are the block's head: those up to the end of a group that begins with the block.  A block's
jump table says, for every row of its head, how many groups begin from there to the block's end and what the open one has come to.  Tables compose: one
pass over an item's tables (a row per block) carries the open group from block to block, and then every block numbers its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096


def jump_table(values: list[tuple], step: Callable) -> tuple[list[tuple], list[tuple]]:
    """The head of a block, and for each of its rows the state at the block's end and the number of groups from there, if a group begins with that row."""

    def follow(at: int):
        state = step(None, *values[at])[1]
        for j in range(at + 1, len(values)):
            new, after = step(state, *values[j])
            if new:
                return j, None
            state = after
        return len(values), state

    known: dict[int, tuple] = {}
    head = min(follow(0)[0] + 1, len(values))
    for begin in range(head):
        path, at = [], begin
        while at not in known:
            following, state = follow(at)
            if following == len(values):
                known[at] = (state, 1)
            else:
                path.append(at)
                at = following
        for back in reversed(path):
            known[back] = (known[at][0], known[at][1] + 1)
            at = back
    return values[:head], [known[k] for k in range(head)]


def after_block(state, head: list, ends: list, step: Callable):
    """State at a block's end and groups that begin in it, for the state of the group that is open before it (None: none is)."""
    if state is None:
        return ends[0]
    for k, values in enumerate(head):
        new, after = step(state, *values)
        if new:
            return ends[k]
        state = after
    return state, 0  # the group takes the whole block; a state that outlasts a fresh one's end never ends (a null sum)


def frozen(x):
    return tuple(x) if isinstance(x, list) else x


def grouped(rows: DataFrame, keys: list[str], index: str, values: list[str], step: Callable, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with a group number (from 0) per keys, in the order of index (whole numbers), then of the other columns.

    step(state, *values) says whether a row opens a new group, and the next state, a tuple; state is None before the first row.  A group that begins
    later must not end earlier.  A null index sorts first.
    """
    others = [c for c in rows.columns if c not in keys]
    n_keys, block, carried, before = len(keys), "_block", "_carried", "_before"
    typed = {f.name: f.dataType for f in rows.schema}
    kinds = [T.StructField(k, typed[k]) for k in keys]
    blocked = rows.select(*keys, F.coalesce(F.floor(F.col(index) / block_rows), F.lit(-(2**62))).cast("long").alias(block), *others).repartition(*keys, block)
    order = [index, *[c for c in others if c != index]]
    at = [blocked.columns.index(v) for v in values]

    def tables(batches):
        import pyarrow as pa

        open_key, held, out = None, [], []

        def close():
            if open_key is not None:
                head, ends = jump_table(held, step)
                out.append((*open_key, json.dumps(head), json.dumps(ends)))
                held.clear()

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * (n_keys + 3)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names)
            out.clear()
            return batch

        names = [*keys, block, "head", "ends"]
        arrow = None
        for b in batches:
            arrow = [*[b.schema.field(k).type for k in range(n_keys)], pa.int64(), pa.string(), pa.string()]
            for row in zip(*(b.column(k).to_pylist() for k in (*range(n_keys + 1), *at)), strict=True):
                if row[: n_keys + 1] != open_key:
                    close()
                    open_key = row[: n_keys + 1]
                held.append(row[n_keys + 1 :])
            yield flush()
        if arrow is not None:
            close()
            yield flush()

    # only items of several blocks need tables
    long = blocked.groupBy(*keys).agg(F.min(block).alias("_a"), F.max(block).alias("_b")).filter("_a < _b").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    mine = blocked.join(long, same, "left_semi").sortWithinPartitions(*keys, block, *order)
    tabled = mine.mapInArrow(tables, T.StructType([*kinds, T.StructField(block, T.LongType()), T.StructField("head", T.StringType()), T.StructField("ends", T.StringType())]))

    def compose(batches):
        import pyarrow as pa

        last, state, number = None, None, -1
        for b in batches:
            states, numbers = [], []
            for row in zip(*(b.column(k).to_pylist() for k in range(n_keys)), b.column(n_keys + 1).to_pylist(), b.column(n_keys + 2).to_pylist(), strict=True):
                if row[:n_keys] != last:
                    last, state, number = row[:n_keys], None, -1
                states.append(json.dumps(state))
                numbers.append(number)
                state, more = after_block(state, [frozen(x) for x in json.loads(row[-2])], [(frozen(s), n) for s, n in json.loads(row[-1])], step)
                number += more
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 1], pa.array(states, pa.string()), pa.array(numbers, pa.int64())], [*keys, block, carried, before])

    carry = tabled.repartition(*keys).sortWithinPartitions(*keys, block).mapInArrow(compose, T.StructType([*kinds, T.StructField(block, T.LongType()), T.StructField(carried, T.StringType()), T.StructField(before, T.LongType())]))

    def number(batches):
        import pyarrow as pa

        last, state, n = None, None, -1
        for b in batches:
            columns = [b.column(k).to_pylist() for k in (*range(n_keys + 1), b.num_columns - 2, b.num_columns - 1, *at)]
            numbers = []
            for row in zip(*columns, strict=True):
                if row[: n_keys + 1] != last:
                    last = row[: n_keys + 1]
                    state, n = (None, -1) if row[n_keys + 1] is None else (frozen(json.loads(row[n_keys + 1])), row[n_keys + 2])
                new, state = step(state, *row[n_keys + 3 :])
                n += bool(new)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(numbers, pa.int64()), *b.columns[n_keys + 1 : -2]], [*keys, group, *b.schema.names[n_keys + 1 : -2]])

    carry = carry.select(*[F.col(k).alias(f"_{k}") for k in (*keys, block)], carried, before)
    met = blocked.join(carry, [*same, F.col(block) == F.col(f"_{block}")], "left").select(*keys, block, *others, carried, before)
    fields = [*kinds, T.StructField(group, T.LongType()), *[T.StructField(c, typed[c]) for c in others]]
    return met.sortWithinPartitions(*keys, block, *order).mapInArrow(number, T.StructType(fields))
