"""Linear recurrences over sequences of any length: advantages, discounted returns and suffix sums as segmented parallel scans.

A step from one element to the next is a linear map of a small state (with a constant 1), so consecutive steps compose to
one map. Ranges of (sequence, position) compose theirs, one row a range says what it leaves to the next, and each range
then applies what it is handed: no sequence is one task's. Within a batch the states come from log2(n) rounds of
composition over whole arrays. Masked elements are identity maps, and the first element of a sequence forgets the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

#: Elements that are composed at a time.
STEP = 8192

Maps = Callable[..., np.ndarray]


def _identity(n: int, k: int) -> np.ndarray:
    return np.broadcast_to(np.eye(k), (n, k, k)).copy()


def gae_maps(gamma: float, lam: float) -> Maps:
    """State (next value, advantage, 1): masked elements pass both on."""

    def of(reward: np.ndarray, value: np.ndarray, mask: np.ndarray) -> np.ndarray:
        m = _identity(len(reward), 3)
        on = mask == 1
        m[on, 0] = 0.0
        m[on, 0, 2] = value[on]
        m[on, 1, 0], m[on, 1, 1], m[on, 1, 2] = gamma, gamma * lam, (reward - value)[on]
        return m

    return of


def return_maps(gamma: float) -> Maps:
    """State (return, what the element before gets of it, 1): nothing after a masked element."""

    def of(reward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        m = np.zeros((len(reward), 3, 3))
        m[:, 0, 1], m[:, 0, 2] = gamma, reward
        m[:, 1, 1], m[:, 1, 2] = gamma * mask, reward * mask
        m[:, 2, 2] = 1.0
        return m

    return of


def sum_maps() -> Maps:
    """State (sum, 1)."""

    def of(reward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        m = _identity(len(reward), 2)
        m[:, 0, 1] = reward * mask
        return m

    return of


def tally_maps() -> Maps:
    """State (number, sum, 1) of the elements that count."""

    def of(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = _identity(len(value), 3)
        m[:, 0, 2], m[:, 1, 2] = counts, value * counts
        return m

    return of


def prefix_products(maps: np.ndarray, longest: int | None = None) -> np.ndarray:
    """The composition of each map with all before it, or at least with those back to the start of its sequence if none is
    longer than `longest`: in round i each takes in the one 2 ** i places before."""
    out, shift, longest = maps.copy(), 1, len(maps) if longest is None else min(longest, len(maps))
    while shift < longest:
        out[shift:] = np.matmul(out[shift:], out[:-shift])
        shift *= 2
    return out


def forget(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """maps in which marked elements start from a state of zeros."""
    maps[first, :, :-1] = 0.0
    return maps


def longest_run(first: np.ndarray) -> int:
    """Elements of the longest sequence, the first and the last one as far as they are here."""
    return int(np.diff(np.concatenate(([0], np.flatnonzero(first), [len(first)]))).max(initial=1))


def states(maps: np.ndarray, state: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The state after each element, from the one before all of them, and the last one; see prefix_products."""
    out = np.empty((len(maps), len(state)))
    for at in range(0, len(maps), STEP):
        out[at : at + STEP] = prefix_products(maps[at : at + STEP], longest) @ state
        state = out[min(at + STEP, len(maps)) - 1]
    return out, state


def _start(k: int) -> np.ndarray:
    return np.append(np.zeros(k - 1), 1.0)


def _new(keys: list, before: object) -> np.ndarray:
    return np.array([k != b for k, b in zip(keys, [before, *keys[:-1]], strict=True)], bool)


_NOTHING = object()


def _edges(maps: Maps, k: int, inputs: int):
    """Rows (range, sequence, inputs...) in order to a row a range: its first and last sequence, the map over the first one's elements, and the state that the last leaves (null if it is the first)."""
    schema = pa.schema([("range", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()), ("map", pa.list_(pa.float64())), ("state", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ranges, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            m = maps(*[batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(inputs)])
            cut = np.flatnonzero(np.diff(ranges)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                r, mine = int(ranges[lo]), keys[lo:hi]
                e = held.setdefault(r, [mine[0], mine[0], np.eye(k), None])
                new = np.flatnonzero(_new(mine, e[1]))
                if e[3] is None:
                    end = lo + (int(new[0]) if len(new) else hi - lo)  # of the first sequence's rows
                    for at in range(lo, end, STEP):
                        e[2] = prefix_products(m[at : min(at + STEP, end)])[-1] @ e[2]
                if e[3] is not None or len(new):
                    first = np.zeros(hi - lo, bool)
                    first[new] = True
                    _, e[3] = states(forget(m[lo:hi].copy(), first), _start(k) if e[3] is None else e[3], longest_run(first))
                e[1] = mine[-1]
        rows = [(r, e[0], e[1], e[2].ravel().tolist(), None if e[3] is None else e[3].tolist()) for r, e in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _apply(maps: Maps, k: int, inputs: int, outputs: int, handed: dict[int, tuple[bytes, list[float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, state = None, None, _start(k)
        for batch in batches:
            ranges, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            m = maps(*[batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(inputs)])
            out = np.empty((len(keys), k))
            cut = np.flatnonzero(np.diff(ranges)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                if ranges[lo] != now:
                    now = int(ranges[lo])
                    key, state = handed[now]
                    state = np.array(state)
                first = _new(keys[lo:hi], key)
                out[lo:hi], state = states(forget(m[lo:hi], first), state, longest_run(first))
                key = keys[hi - 1]
            rest = batch.columns[2 + inputs :]
            made = [pa.array(out[:, i]) for i in range(outputs)]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*batch.schema.names[2 + inputs :], *[f"__scan_out{i}" for i in range(outputs)]])

    return run


def scan_rows(df: DataFrame, sequence: str, order: list, maps: Maps, k: int, inputs: list[Column], name: str | list[str], component: int = 0) -> DataFrame:
    """df with `name`: a component of the state after each row of its sequence (or names for the first ones), rows taken in the given order.

    `order` are columns or their descending forms. Rows are sorted into ranges of (sequence, order) and written once; the
    driver sees one row a range. Ranges are read by batches, so a range needs no more memory than one. Null inputs count
    as 0, null is a sequence like any other. The number of ranges is the session's number of shuffle partitions.
    """
    key = F.to_json(F.struct(F.col(sequence))).cast("binary")
    given = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__scan_in{i}") for i, c in enumerate(inputs)]
    sorted_rows = df.repartitionByRange(F.col(sequence).asc_nulls_first(), *order).withColumn("__scan_range", F.spark_partition_id())
    held = staged(sorted_rows, "ranges")
    plain = held.repartitionByRange("__scan_range").sortWithinPartitions(F.col("__scan_range"), F.col(sequence).asc_nulls_first(), *order)
    needed = plain.select("__scan_range", key.alias("__scan_key"), *given)
    edges = needed.mapInArrow(_edges(maps, k, len(inputs)), "range int, head binary, tail binary, map array<double>, state array<double>").orderBy("range").collect()
    handed, last, state = {}, _NOTHING, _start(k)
    for e in edges:
        if bytes(e["head"]) != last:
            state = _start(k)
        handed[e["range"]] = (bytes(e["head"]), state.tolist())
        state = np.array(e["map"]).reshape(k, k) @ state if e["state"] is None else np.array(e["state"])
        last = bytes(e["tail"])
    outputs = component + 1 if isinstance(name, str) else len(name)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"__scan_out{i}", T.DoubleType()) for i in range(outputs)]])
    rows = plain.select("__scan_range", key.alias("__scan_key"), *given, *df.columns).mapInArrow(_apply(maps, k, len(inputs), outputs, handed), schema)
    found = [F.col(f"__scan_out{component}").alias(name)] if isinstance(name, str) else [F.col(f"__scan_out{i}").alias(n) for i, n in enumerate(name)]
    return rows.select(*df.columns, *found)


def gae_rows(df: DataFrame, sequence: str, position: str, reward: str, value: str, mask: str, gamma: float, lam: float, name: str = "advantage") -> DataFrame:
    """df with generalised advantages before whitening; position is the place in the sequence."""
    return scan_rows(df, sequence, [F.desc(position)], gae_maps(gamma, lam), 3, [F.col(reward), F.col(value), F.col(mask)], name, 1)


def return_rows(df: DataFrame, sequence: str, position: str, reward: str, mask: str, gamma: float, name: str = "return") -> DataFrame:
    """df with reverse discounted sums that start again at 0 after (in place before) a masked row."""
    return scan_rows(df, sequence, [F.desc(position)], return_maps(gamma), 3, [F.col(reward), F.col(mask)], name)


def suffix_sum_rows(df: DataFrame, sequence: str, position: str, reward: str, mask: str, name: str = "suffix_sum") -> DataFrame:
    """df with the sum of the masked rewards from each row to the end of its sequence."""
    return scan_rows(df, sequence, [F.desc(position)], sum_maps(), 2, [F.col(reward), F.col(mask)], name)


def scan_arrays(maps: Maps, k: int, component: int, *arrays: Column) -> Column:
    """The same over array columns, from the end of each array: all arrays of a batch are one scan, linear in their elements.

    Null where one of a row's arrays is null; the arrays of a row are of one length.
    """

    def of(*columns: pa.Array) -> pa.Array:
        valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
        rows = pa.array(np.flatnonzero(valid))
        flat = [c.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
        lengths = np.where(valid, columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        n = lengths[valid]
        start = np.cumsum(n) - n
        back = np.repeat(2 * start + n - 1, n) - np.arange(len(flat[0]))  # the place of each element in its array reversed
        first = np.zeros(len(back), bool)
        first[start[n > 0]] = True
        made, _ = states(forget(maps(*[f[back] for f in flat]), first), _start(k), int(n.max(initial=1)))
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[back, component]), mask=pa.array(~valid))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return of(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return of(a, b, c)

    run = two if len(arrays) == 2 else three
    run.__annotations__ = dict.fromkeys(("a", "b", "c", "return") if run is three else ("a", "b", "return"), pa.Array)
    return F.arrow_udf(run, "array<double>")(*arrays)
