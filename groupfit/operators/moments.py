"""Mergeable per-group states: centred co-moments, and triangular factors.

A state never holds rows. Up to SQL_TERMS terms the co-moments are built-in
aggregates, which Spark computes before and after one exchange. Beyond that, and
for factors, each task reduces its rows to one state a group, some CHUNK bytes of
rows at a time and for all groups of them at once; it hands states on when they
take HELD bytes, however many groups there are. States are merged in two steps, so
a group that every task holds is not merged in one place from all of them at once,
and a group at a time, in the order of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms up to which built-in aggregates are used: beyond them their many buffers leave generated code, and Arrow batches are faster.
SQL_TERMS = 2
#: The same for a stream, whose state is kept by Spark as long as it is built in.
STREAM_TERMS = 8
#: Shares in which the states of one group are merged first.
SALTS = 32
#: Bytes of rows that are reduced at a time, and bytes of states that a task holds.
CHUNK, HELD = 16 << 20, 64 << 20

STATE = "group string, n long, bad long, mean array<double>, c array<double>, lo array<double>, hi array<double>, first long, part int"
FACTOR = STATE.replace("c array<double>", "c array<double>, r array<double>, norm array<double>")


def with_order(train: DataFrame) -> DataFrame:
    """Adds the place of each row as far as its source has an order; `first` of a group is the least."""
    if "row_id" in train.columns:
        return train
    # a stream has no order over its batches
    return train.withColumn("row_id", F.lit(0).cast("long") if train.isStreaming else F.monotonically_increasing_id())


def by_sql(train: DataFrame, p: int) -> DataFrame:
    """One aggregation over (group, y, x), for a few terms."""
    cols = [F.col("x")[i] for i in range(p)] + [F.col("y")]
    names = [f"v{i}" for i in range(p + 1)]
    flat = with_order(train).select("group", "row_id", *[c.alias(k) for c, k in zip(cols, names, strict=True)])
    good = F.lit(True)
    for k in names:
        good = good & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(F.col(k)) < float("inf"))
    aggs = [F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.min("row_id").alias("first")]
    for k in names:
        aggs += [F.avg(k).alias(f"mean_{k}"), F.min(k).alias(f"lo_{k}"), F.max(k).alias(f"hi_{k}")]
    pairs = list(combinations_with_replacement(range(p + 1), 2))
    aggs += [F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    agg = flat.groupBy("group").agg(*aggs)

    def product(i: int, j: int):
        i, j = min(i, j), max(i, j)
        still = (F.col(f"lo_{names[i]}") == F.col(f"hi_{names[i]}")) | (F.col(f"lo_{names[j]}") == F.col(f"hi_{names[j]}"))
        return F.when(still, 0.0).otherwise(F.col(f"c_{i}_{j}") * F.col("n"))

    square = [product(i, j) for i in range(p + 1) for j in range(p + 1)]
    arrays = [F.array(*[F.col(f"{w}_{k}") for k in names]).alias(w) for w in ("mean", "lo", "hi")]
    return agg.select("group", "n", "bad", arrays[0], F.array(*square).alias("c"), arrays[1], arrays[2], "first", F.lit(0).alias("part"))


@dataclass
class States:
    """States of groups, one after another: a group's number, and sums over its rows (terms, then the response)."""

    code: np.ndarray
    n: np.ndarray
    bad: np.ndarray
    first: np.ndarray
    mean: np.ndarray
    c: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    r: np.ndarray | None = None
    norm: np.ndarray | None = None

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in self.columns() if x is not None)

    def columns(self) -> list[np.ndarray | None]:
        return [getattr(self, f.name) for f in fields(self)]

    @classmethod
    def joined(cls, parts: list[States]) -> States:
        return cls(*[None if x[0] is None else np.concatenate(x) for x in zip(*[p.columns() for p in parts], strict=True)])

    def settled(self) -> States:
        """Columns that don't vary have exact means and sums of exactly 0."""
        still = (self.lo == self.hi) & (self.n > 0)[:, None]
        self.mean = np.where(still, self.lo, self.mean)
        self.c[still] = 0.0
        self.c.transpose(0, 2, 1)[still] = 0.0
        return self


def heads_of(code: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(code, prepend=code[0] - 1)) if len(code) else np.zeros(0, np.int64)


def reduced(code: np.ndarray, v: np.ndarray, at: np.ndarray, factor: bool) -> States:
    """One state for each group of rows v (terms, response), which stand at places `at`."""
    order = np.argsort(code, kind="stable")
    code, v, at = code[order], v[order], at[order]
    heads = heads_of(code)
    names, first = code[heads], np.minimum.reduceat(at, heads)
    rows = np.diff(np.append(heads, len(code)))
    fine = np.isfinite(v).all(axis=1)
    good = np.add.reduceat(fine, heads, dtype=np.int64)
    w = v.shape[1]
    out = States(names, good, rows - good, first, np.zeros((len(names), w)), np.zeros((len(names), w, w)), np.full((len(names), w), np.inf), np.full((len(names), w), -np.inf))
    if factor:
        out.r, out.norm = np.zeros((len(names), w + 1, w + 1)), np.zeros((len(names), w))
    if not fine.all():
        v = v[fine]
    full = np.flatnonzero(good)
    if not len(full):
        return out
    heads, n = np.concatenate([[0], np.cumsum(good[full])[:-1]]), good[full]
    with np.errstate(all="ignore"):
        # about the first row: a column that doesn't vary then has deviations of exactly 0
        d = v - np.repeat(v[heads], n, axis=0)
        shift = np.add.reduceat(d, heads, axis=0) / n[:, None]
        d -= np.repeat(shift, n, axis=0)
        out.mean[full] = v[heads] + shift
        out.lo[full], out.hi[full] = np.minimum.reduceat(v, heads, axis=0), np.maximum.reduceat(v, heads, axis=0)
        ends = heads + n
        if len(full) * w > len(v):  # few rows a group: products of rows, some at a time, added up by group
            step = max(1, (CHUNK // 8) // (w * w))
            lo = 0
            while lo < len(full):
                hi = max(lo + 1, int(np.searchsorted(ends, heads[lo] + step, "right")))
                if hi == lo + 1:
                    own = d[heads[lo] : ends[lo]]
                    out.c[full[lo]] = own.T @ own
                else:
                    own = d[heads[lo] : ends[hi - 1]]
                    out.c[full[lo:hi]] = np.add.reduceat(own[:, :, None] * own[:, None, :], heads[lo:hi] - heads[lo], axis=0)
                lo = hi
        else:
            for k, a, b in zip(full.tolist(), heads.tolist(), ends.tolist(), strict=True):
                out.c[k] = d[a:b].T @ d[a:b]
        if factor:
            for k, a, b in zip(full.tolist(), heads.tolist(), ends.tolist(), strict=True):
                r = np.linalg.qr(np.column_stack([np.ones(b - a), v[a:b]]), mode="r")
                out.r[k, : len(r)], out.norm[k] = r, np.hypot.reduce(v[a:b], axis=0)
    return out.settled()


def merged(s: States) -> States:
    """One state for each group; states of a group are merged in the order in which they stand."""
    order = np.lexsort((s.n == 0, s.code))
    s = States(*[None if x is None else x[order] for x in s.columns()])
    heads = heads_of(s.code)
    if len(heads) == len(s.code):
        return s
    times = np.diff(np.append(heads, len(s.code)))
    add = lambda x: np.add.reduceat(x, heads, axis=0)
    n = add(s.n)
    with np.errstate(all="ignore"):
        weight = (s.n / np.repeat(np.maximum(n, 1), times))[:, None]
        # states without rows have no mean; they come last, so a group's first mean is one of its rows'
        apart = np.where((s.n > 0)[:, None], s.mean - np.repeat(s.mean[heads], times, axis=0), 0.0)
        mean = s.mean[heads] + add(apart * weight)
        apart = np.where((s.n > 0)[:, None], s.mean - np.repeat(mean, times, axis=0), 0.0)
        c = add(s.c + s.n[:, None, None] * apart[:, :, None] * apart[:, None, :])
    out = States(s.code[heads], n, add(s.bad), np.minimum.reduceat(s.first, heads), mean, c, np.minimum.reduceat(s.lo, heads, axis=0), np.maximum.reduceat(s.hi, heads, axis=0))
    if s.r is not None:
        out.r, out.norm = s.r[heads].copy(), np.hypot.reduceat(s.norm, heads, axis=0)
        for k in np.flatnonzero(times > 1):
            r = np.linalg.qr(np.concatenate(s.r[heads[k] : heads[k] + times[k]]), mode="r")
            out.r[k, : len(r)] = r
    return out.settled()


class Names:
    """Groups by number."""

    def __init__(self):
        self.known: dict[str | None, int] = {}

    def codes(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The number of each entry."""
        seen = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(seen, pa.ChunkedArray):
            seen = pa.concat_arrays(seen.chunks)
        seen = seen.dictionary_encode("encode")
        number = np.array([self.known.setdefault(x, len(self.known)) for x in seen.dictionary.to_pylist()], np.int64)
        return number[seen.indices.to_numpy(zero_copy_only=False)]

    def batch(self, s: States, part: int, names: list[str]) -> pa.RecordBatch:
        told = list(self.known)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (x.size // max(1, len(x))), pa.array(x.ravel()))
        cols = {"group": pa.array([told[k] for k in s.code.tolist()], pa.string()), "n": pa.array(s.n), "bad": pa.array(s.bad), "first": pa.array(s.first), "part": pa.array([part] * len(s.n), pa.int32())}
        cols |= {k: lists(getattr(s, k)) for k in ("mean", "c", "lo", "hi", "r", "norm") if k in names}
        return pa.RecordBatch.from_arrays([cols[k] for k in names], names)


def names_of(kind: str) -> list[str]:
    return [f.split()[0] for f in kind.split(", ")]


def by_tasks(train: DataFrame, p: int, factor: bool = False) -> DataFrame:
    """States from Arrow batches, for many terms or with factors."""
    names = names_of(FACTOR if factor else STATE)
    placed = "row_id" in train.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, passed, rows, size = TaskContext.get().partitionId(), 0, [], 0
        groups, held = Names(), []

        def reduce_rows() -> None:
            nonlocal passed
            table = pa.Table.from_batches(rows)
            v = np.column_stack([table.column(k).to_numpy() for k in range(1, p + 2)]).astype(float, copy=False)
            # places as monotonically_increasing_id numbers them
            at = table.column(p + 2).to_numpy() if placed else (part << 33) + passed + np.arange(len(v))
            passed += len(v)
            held.append(reduced(groups.codes(table.column(0)), v, at, factor))

        for batch in batches:
            rows.append(batch)
            size += batch.num_rows * 8 * (p + 1)
            if size >= CHUNK:
                reduce_rows()
                rows, size = [], 0
                if sum(s.bytes for s in held) > HELD:
                    held = [merged(States.joined(held))]
                    if held[0].bytes > HELD // 2:
                        yield groups.batch(held[0], part, names)
                        groups, held = Names(), []
        if rows:
            reduce_rows()
        if held:
            yield groups.batch(merged(States.joined(held)), part, names)

    flat = train.select("group", *[F.col("x")[k].alias(f"v{k}") for k in range(p)], F.col("y").alias(f"v{p}"), *["row_id"] * placed)
    return merge(flat.mapInArrow(partial, FACTOR if factor else STATE), p, factor)


def merge(states: DataFrame, p: int, factor: bool = False) -> DataFrame:
    """One state a group from several, in the order of their parts: among some of them first, then over all."""
    kind = FACTOR if factor else STATE
    names, w = names_of(kind), p + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, part = Names(), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k) for k in names}
            flat = {k: col[k].flatten().to_numpy() for k in ("mean", "c", "lo", "hi", "r", "norm") if k in names}
            shape = {"c": (-1, w, w), "r": (-1, w + 1, w + 1)}
            flat = {k: x.reshape(shape.get(k, (-1, w))).copy() for k, x in flat.items()}
            part = col["part"][0].as_py()
            held.append(States(groups.codes(col["group"]), *[col[k].to_numpy() for k in ("n", "bad", "first")], **flat))
            if sum(s.bytes for s in held) > HELD:
                # rows come group by group, so all groups but the last are complete
                known = merged(States.joined(held))
                if len(known.code) > 1:
                    yield groups.batch(States(*[None if x is None else x[:-1] for x in known.columns()]), part, names)
                held = [States(*[None if x is None else x[-1:] for x in known.columns()])]
        if held:
            yield groups.batch(merged(States.joined(held)), part, names)

    some = states.repartition("group", F.pmod("part", F.lit(SALTS))).sortWithinPartitions("group", "part", "first").mapInArrow(run, kind)
    return some.repartition("group").sortWithinPartitions("group", "part", "first").mapInArrow(run, kind)


def states(train: DataFrame, p: int, solver: str = "normal", sql_terms: int = SQL_TERMS) -> DataFrame:
    """A row for each group of (group, y, x)."""
    if solver == "qr":
        return by_tasks(train, p, True)
    return by_sql(train, p) if p <= sql_terms else by_tasks(train, p)
