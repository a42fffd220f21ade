"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents with the same set of
sources form a pattern; the flow network has a node for each pattern and each
source, not for each document: pattern -> source arcs carry words, a pattern's
first use of its words costs nothing, each further use costs more (convex), and
a source takes words up to its target. The flow says how many words each
pattern gives each source. Within a pattern documents stand in a seeded random
order on a line of (sum of sizes) words, walked once for each use; the stretch
from 0 to the pattern's flow is what the mix takes, and the parts given to the
sources follow one another on it.

Places on that line need running sums over a pattern, which may hold a third of
all documents: a pattern is dealt into slices of some thousand documents by
ranges of the seeded hash, slices are summed first, and only a slice is ever
sorted in one task.

Cases: a null or empty text has size 0 and is taken as 0 words; a null source is
a source of its own, after the others; repeated rows are documents of their own,
but interchangeable: they are counted first, stand on the line as one and are told
apart by their number there; an empty table gives no rows;
other columns are dropped by `plan` and kept by `take`.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import by_key, documents, free_name, keep

#: Documents in one slice of a pattern, about, and slices whose sums are added up in one task.
SLICE, SLICES = 1000, 4096


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict[object, float]:
    """Split share * (all sizes) by weight; a target stops at most * size of its source and the excess goes to the others by weight, until none is above."""
    left, open_, out = share * sum(sizes.values()), list(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict[object, int], uses: int = 2, cost=lambda use: use * use) -> dict[tuple[tuple, object], int]:
    """Words that each pattern gives each of its sources, by successive shortest paths with potentials.

    patterns: words of each tuple of sources. A pattern can be used `uses` times; use k (from 0) costs cost(k) a word, which must not fall with k.
    The flow is as large as quotas and capacities allow, and the cheapest of that size. All numbers are whole.
    """
    names: list = ["from", "to"]
    arcs: list[list[int]] = []  # head, capacity left, cost; the arc with number ^ 1 runs back
    out_of: dict[int, list[int]] = defaultdict(list)

    def arc(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            out_of[x].append(len(arcs))
            arcs.append([y, c, p])
        return len(arcs) - 2

    node = {}
    for s, q in quotas.items():
        node[s] = len(names)
        names.append(s)
        arc(node[s], 1, int(q), 0)
    given = {}
    for key, words in patterns.items():
        at = len(names)
        names.append(key)
        for k in range(uses):
            arc(0, at, int(words), cost(k))
        for s in dict.fromkeys(key):
            given[key, s] = arc(at, node[s], uses * int(words), 0)
    height = [0] * len(names)
    while True:
        far: list[float] = [math.inf] * len(names)
        came, heap = [-1] * len(names), [(0, 0)]
        far[0] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out_of[a]:
                b, cap, price = arcs[e]
                if cap and (new := d + price + height[a] - height[b]) < far[b]:
                    far[b], came[b] = new, e
                    heapq.heappush(heap, (new, b))
        if far[1] == math.inf:
            return {k: arcs[e ^ 1][1] for k, e in given.items()}
        height = [h + (f if f < math.inf else far[1]) for h, f in zip(height, far, strict=True)]
        path, at = [], 1
        while at:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        much = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= much
            arcs[e ^ 1][1] += much


def flow_by_component(patterns: dict[tuple, int], quotas: dict[object, int], uses: int = 2) -> dict[tuple[tuple, object], int]:
    """`min_cost_flow` for each set of sources that patterns link, so disjoint sources cost no search over one another."""
    above = {s: s for s in quotas}

    def top(s):
        while above[s] != s:
            above[s] = s = above[above[s]]
        return s

    for key in patterns:
        for s in key:
            above[top(s)] = top(key[0])
    groups: dict[object, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    for key, words in patterns.items():
        groups[top(key[0])][0][key] = words
    for s, q in quotas.items():
        groups[top(s)][1][s] = q
    out: dict = {}
    for some, wanted in groups.values():
        out |= min_cost_flow(some, wanted, uses)
    return out


def on_line(docs: DataFrame, of: DataFrame, seed: int, slice_rows: int = SLICE) -> DataFrame:
    """`docs` (id, sources, size) joined to `of` (a row for each pattern: of, docs, whole, ...) with `before`: the words of the pattern's documents that stand earlier.

    Equal rows are one on the line, as often as they occur, so they don't meet in one slice. Two passes over the narrow table: slices are summed (and runs of slices before them), then each slice is ordered by itself.
    """
    h = F.xxhash64(F.lit(seed), F.col("id"), F.col("size"))
    slice_ = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("docs") / slice_rows)).cast("long")
    rows = docs.groupBy("id", "sources", "size").agg(F.count("*").alias("times"))
    dealt = rows.withColumn("h", h).join(of, F.col("sources") == F.col("of")).withColumn("slice", slice_)
    slices = dealt.groupBy("of", "slice").agg(F.sum(F.col("size") * F.col("times")).alias("words")).withColumn("run", F.floor(F.col("slice") / SLICES))

    def earlier(*by: str) -> Column:
        return F.sum("words").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("words")

    runs = slices.groupBy("of", "run").agg(F.sum("words").alias("words")).select(F.col("of").alias("r_of"), F.col("run").alias("r_run"), earlier("of", "run").alias("r_start"))
    in_run = slices.select("of", "run", "slice", earlier("of", "run", "slice").alias("r_inside"))
    slices = in_run.join(runs, (F.col("of") == F.col("r_of")) & (F.col("run") == F.col("r_run"))).select(F.col("of").alias("s_of"), F.col("slice").alias("s_slice"), (F.col("r_start") + F.col("r_inside")).alias("start"))
    inner = Window.partitionBy("of", "slice").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("size") * F.col("times")
    within = dealt.withColumn("inside", F.sum(whole).over(inner) - whole)
    placed = within.join(slices, (F.col("of") == F.col("s_of")) & (F.col("slice") == F.col("s_slice")))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    return placed.withColumn("nth", nth).withColumn("before", F.col("start") + F.col("inside") + F.col("nth") * F.col("size"))


#: Rows that a table made on the driver may have to be broadcast, and patterns that it may plan for.
SMALL, PATTERNS = 50_000, 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def plan(docs: DataFrame, weight_of, share: float = 1.5, uses: int = 2, seed: int = 7) -> tuple[DataFrame, dict]:
    """Words to take of each document.

    docs: id, sources (array of strings, null entries allowed; a null array counts as one null source), size. weight_of: maps the list of sources, by code point with null last, to their weights.
    Returns (id, sources, size, taken, parts: array of (source, words)) and a dict of source -> (size, target). The driver holds a row for each pattern and source, and refuses more than PATTERNS.
    """
    nothing = F.array(F.lit(None).cast("string"))
    docs = keep(docs.select("id", F.coalesce("sources", nothing).alias("sources"), F.col("size").cast("long").alias("size")), "mix-sizes")
    patterns_of = keep(docs.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-patterns")
    if (many := patterns_of.count()) > PATTERNS:
        raise ValueError(f"documents have {many} different sets of sources; flows are planned for up to {PATTERNS}")
    seen = {tuple(r["sources"]): (int(r["words"]), r["docs"]) for r in patterns_of.collect()}
    order = sorted({s for key in seen for s in key}, key=lambda s: (s is None, s or ""))
    place = {s: k for k, s in enumerate(order)}
    patterns = sorted(seen, key=lambda key: [place[s] for s in key])
    sizes = dict.fromkeys(order, 0)
    for key, (words, _) in seen.items():
        for s in set(key):
            sizes[s] += words
    goal = targets(sizes, dict(zip(order, weight_of(order), strict=True)), share, float(uses))
    flow = flow_by_component({key: seen[key][0] for key in patterns}, {s: round(t) for s, t in goal.items()}, uses)
    rows = []
    for key in patterns:
        cuts, at = [], 0
        for s in dict.fromkeys(key):
            cuts.append((at, at := at + flow[key, s], s))
        rows.append((list(key), seen[key][1], seen[key][0], cuts))
    of = docs.sparkSession.createDataFrame(rows, "of array<string>, docs long, whole long, cuts array<struct<lo:long,hi:long,source:string>>")
    placed = on_line(docs, small(of, len(rows)), seed)
    uses_of = F.sequence(F.lit(0), F.lit(uses - 1))

    def overlap(cut: Column) -> Column:
        def each(k: Column) -> Column:
            at = F.col("before") + k * F.col("whole")
            return F.greatest(F.lit(0), F.least(cut["hi"], at + F.col("size")) - F.greatest(cut["lo"], at))

        return F.aggregate(F.transform(uses_of, each), F.lit(0).cast("long"), lambda a, x: a + x)

    given = F.filter(F.transform("cuts", lambda c: F.struct(c["source"].alias("source"), overlap(c).alias("words"))), lambda g: g["words"] > 0)
    out = placed.select("id", "sources", "size", given.alias("parts")).withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda a, g: a + g["words"]))
    return out, {s: (sizes[s], goal[s]) for s in order}


def take(docs: DataFrame, weight_of, share: float = 1.5, uses: int = 2, seed: int = 7, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of `docs` as often as its words are taken, rounded to whole documents (a document without words once). Columns as in `docs`.

    A row is known by two 64-bit hashes of its columns, of whatever type. Equal rows share what is taken of them: evenly, and the rest as further copies of one.
    """
    names = [free_name(docs.columns, x) for x in ("key", "size", "id", "copies", "rows", "n", "times")]
    key, size, id_, copies, rows, n, times = names
    own = [docs[c] for c in docs.columns]
    told = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields]
    seeds = [F.xxhash64(F.lit(k), *told, F.concat(*[c.isNull().cast("string") for c in own])).alias(f"k{k}") for k in (0, 1)]
    wide = docs.withColumn(key, F.struct(*seeds)).withColumn(size, size_of(docs[text]))
    planned, _ = plan(wide.select(F.col(key).alias("id"), F.array(docs[source].cast("string")).alias("sources"), F.col(size).alias("size")), weight_of, share, uses, seed)
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("long")
    per_key = planned.withColumnRenamed("id", id_).groupBy(id_).agg(F.sum(whole).alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    counted = keep(per_key.withColumnRenamed(id_, key).withColumn(times, F.col(rows)), "mix-copies")
    joined = by_key(wide, counted, key, counted.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0], count=times)

    def repeat(df: DataFrame, times: Column) -> DataFrame:
        return df.where(times > 0).withColumn(n, F.explode(F.sequence(F.lit(1), times)))

    even = repeat(joined, F.floor(F.col(copies) / F.col(rows)))
    odd = joined.where(F.col(copies) % F.col(rows) > 0).groupBy(key).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(n), F.first(F.col(copies) % F.col(rows)).alias(copies))
    rest = odd.where(F.col(copies) > 0).select(n, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(rows)).select(f"{n}.*")
    return even.select(*docs.columns).unionByName(rest)


def weights_3_1_2(order: list) -> list[float]:
    return [(3.0, 1.0, 2.0)[k % 3] for k in range(len(order))]


def query(spark, sf_dir: str) -> DataFrame:
    """op1: each source's target and the words taken of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array("source").alias("sources"), size_of(F.col("text")).alias("size"))
    out, goals = plan(docs, weights_3_1_2)
    table = spark.createDataFrame([(s, n, float(t)) for s, (n, t) in goals.items()], "source string, source_size long, target double")
    return out.join(small(table, len(goals)), F.col("sources")[0].eqNullSafe(F.col("source"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")
