"""Exact top k by inner product, by aggregation of sorted lists without random access.

Vectors become whole numbers. Candidates stand in blocks; in a block each
dimension is a list of entries sorted by value, read from the top for a positive
and from the bottom for a negative component of the query. After each stretch of
entries a candidate's score lies between what was read of it plus the least, and
plus the next, entry of every list in which it was not yet seen. Reading stops
when no candidate outside the k best lower bounds, seen or not, can still reach
the k-th; the scores of those left are then resolved. Queries stand in blocks too,
and blocks of queries in groups of GROUP bytes. A cell of the grid is a group of
queries and a share of the candidates; a task reads the cell's candidates block by
block, with no more than the cell's queries beside them, and keeps the best of what
it has seen so far as the bar for the next block.

Cases: vectors or ids that are null take no part, nor do vectors with null or
non-finite components; only vectors of the query's length are candidates; ties go
to the smaller id; a row with the query's id is no candidate for it; of several
query rows with one id the least vector counts; repeated candidates are rows of
their own; sums that might leave 64 bits are made with whole numbers of any size, and
a component or a score among the best that does leave them is refused with an error,
as no row could hold it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

SCALE, K = 1024, 10
#: Vectors in a block of candidates and in a block of queries.
BLOCK, QUERIES = 1024, 256
#: Queries whose best rows a task holds before it hands them on.
HELD = 50_000
#: Bytes of queries in a cell.
GROUP = 64 << 20


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(dim, ids, values): up to `size` vectors of one length in bytes, as 64-bit whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, rows: list) -> pa.RecordBatch:
            ids, values = np.array([r[0] for r in rows], "<i8"), np.stack([r[1] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([values.astype("<i8").tobytes()])], ["dim", "ids", "values"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat = np.floor(lists.flatten().to_numpy() * scale)
            if (np.abs(flat) >= 2.0**63).any():
                raise OverflowError(f"a component beyond {2.0**63 / scale:g} is no 64-bit whole number after scaling")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for i in range(len(ids)):
                own = held.setdefault(int(at[i + 1] - at[i]), [])
                own.append((ids[i], flat[at[i] : at[i + 1]]))
                if len(own) == size:
                    yield out(int(at[i + 1] - at[i]), own)
                    own.clear()
        for dim, own in held.items():
            if own:
                yield out(dim, own)

    return rows.select("id", "v").mapInArrow(pack, "dim int, ids binary, values binary")


#: Shares of the lists after which bounds are drawn.
DEPTHS = (0.125, 0.5, 1.0)


class Lists:
    """Sorted lists of a block: for each dimension the values from the largest down, and whose they are."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.owner = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.owner, axis=0)
        self.depths = sorted({max(1, round(n * share)) for share in DEPTHS})
        self.read: dict = {}
        # no numpy here: the least 64-bit number has no absolute value in 64 bits
        self.largest = max(abs(int(values.max())), abs(int(values.min())))

    def stretch(self, side: int, begin: int, end: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(entries, seen) after the next stretch of all lists, from the top (side 0) or the bottom: a row for each candidate with what is read of it now, and whether it has been seen by now."""
        key = side, begin, kind
        if key not in self.read:
            n, dim = self.values.shape
            rows = slice(begin, end) if side == 0 else slice(n - end, n - begin)
            entries = np.zeros((n, dim), kind)
            np.put_along_axis(entries, self.owner[rows], self.sorted[rows].astype(kind), axis=0)
            before = [x for (s, b, t), x in self.read.items() if (s, t) == (side, kind) and b < begin]
            seen = before[-1][1].copy() if before else np.zeros((n, dim), kind)
            np.put_along_axis(seen, self.owner[rows], kind(1), axis=0)
            self.read[key] = entries, seen
        return self.read[key]

    def exact(self, query: np.ndarray) -> np.ndarray:
        return self.values.astype(object) @ query.astype(object)

    def best(self, queries: np.ndarray, k: int, bars: list[int | None], own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (candidates, scores) of all that can be among its k best and score its bar or more; own: candidates that are the query itself.

        All queries read the lists together, a stretch at a time: from the top where their component is positive, else from the bottom.
        """
        n, dim = self.values.shape
        out: list = [None] * len(queries)
        bound = self.largest * max((abs(int(f(queries))) for f in (np.max, np.min)), default=0) * dim
        if bound >= 2**62:
            for q in range(len(queries)):
                live = np.setdiff1d(np.arange(n), own[q])
                out[q] = live, self.exact(queries[q])[live]
            return out
        # doubles hold these sums exactly, or else whole numbers do
        kind = np.float64 if bound < 2**52 else np.int64
        least_ever = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        todo, part = np.arange(len(queries)), queries.astype(kind)
        # a row for each candidate: what was read of it for each query
        read, done = np.zeros((n, len(queries)), kind), 0
        for depth in self.depths:
            up, down = np.maximum(part, 0).T, np.minimum(part, 0).T
            (top, seen_top), (bottom, seen_bottom) = (self.stretch(side, done, depth, kind) for side in (0, 1))
            read += top @ up
            read += bottom @ down
            done = depth
            if depth < n:
                # what lists that a candidate was not seen in can still add: their next entry at most, their last one at least
                first, last = self.sorted[:, :, None][[depth - 1, n - depth]].astype(kind), self.sorted[:, :, None][[-1, 0]].astype(kind)
                most, least = (first[0] * up, first[1] * down), (last[0] * up, last[1] * down)
                upper = read + sum(x.sum(axis=0) - seen @ x for x, seen in zip(most, (seen_top, seen_bottom), strict=True))
                lower = read + sum(x.sum(axis=0) - seen @ x for x, seen in zip(least, (seen_top, seen_bottom), strict=True))
            else:
                upper = lower = read
            stay = np.zeros(len(todo), bool)
            for row, q in enumerate(todo.tolist()):
                low, high, bar = lower[:, row], upper[:, row], bars[q]
                if len(own[q]):
                    low = low.copy()
                    low[own[q]] = least_ever
                if n - len(own[q]) >= k:
                    kth = np.partition(low, n - k)[n - k]
                    bar = kth if bar is None else max(bar, kth)
                live = np.arange(n) if bar is None else np.flatnonzero(high >= bar)
                if depth == n or len(live) <= 4 * k:
                    live = live[~np.isin(live, own[q])] if len(own[q]) else live
                    out[q] = live, self.values[live] @ queries[q]
                else:
                    stay[row] = True
            todo, part, read = todo[stay], part[stay], read[:, stay]
            if not len(todo):
                break
        return out


def nra(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last: tuple[bytes, Lists] | None = None

        def out() -> pa.RecordBatch:
            n = [len(s) for s, _ in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), n)), pa.array(np.concatenate([i for _, i in held.values()])), pa.array(np.concatenate([s for s, _ in held.values()]))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                q_ids, q_values, ids, values = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in range(1, 5))
                name = ids.tobytes()
                if last is None or last[0] != name:
                    last = name, Lists(values.reshape(-1, dim))
                none = np.zeros(0, np.int64)
                asked = [held.get(q, (none, none)) for q in q_ids.tolist()]
                bars = [int(scores[-1]) if len(scores) == k else None for scores, _ in asked]
                own = [np.flatnonzero(ids == q) for q in q_ids.tolist()]
                found = last[1].best(q_values.reshape(-1, dim), k, bars, own)
                for q, (scores, known), (at, new) in zip(q_ids.tolist(), asked, found, strict=True):
                    if len(at):
                        known = np.concatenate([known, ids[at]])
                        scores = np.concatenate([scores, new])
                        # ~x falls as x rises, and stays in 64 bits
                        by = np.lexsort((known, ~scores))[:k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i, s=scores, v=known: (-s[i], v[i]))[:k])
                        scores, known = scores[by], known[by]
                        if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
                            raise OverflowError(f"a score of query {q} is beyond 64 bits")
                        scores = scores.astype(np.int64)
                    held[q] = scores, known
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each row of `queries`."""
    spark = vectors.sparkSession
    few = usable(queries, id_, vector).groupBy("id").agg(F.min("v").alias("v"))
    asked = keep(blocks(few, QUERIES, scale).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")), "queries")
    held = asked.agg(F.sum(F.octet_length("q_values"))).first()[0] or 0
    # groups of queries that a task can hold, and as many shares of the candidates as keep all tasks busy
    groups = -(-held // GROUP) or 1
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    count = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("q_ids"), F.lit(groups)).cast("int")).withColumn("h", count(shares))
    there = blocks(usable(vectors, id_, vector), BLOCK, scale).withColumn("h", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).withColumn("g", count(groups))
    # merged, so that a task holds the queries of one cell at a time
    met = there.join(asked.hint("merge"), (there.g == asked.g) & (there.h == asked.h) & (F.col("dim") == F.col("q_dim"))).select("dim", "q_ids", "q_values", "ids", "values")
    best = met.mapInArrow(nra(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the ten best of all vectors for every hundredth one, as the contract asks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""
