"""Nearest neighbours by stable projections in a kd-tree with a chi-square stop.

Vectors are projected on DIMS Gaussian directions. The Gaussian is 2-stable:
the squared projected distance of a pair, over its squared true distance, is
chi-square distributed with DIMS degrees of freedom. One kd-tree over the
projections holds all vectors: its top, from a bounded sample, deals them to
partitions, and a task builds the rest of its partition. A query first searches
the partition that it lies in: it takes points in the order of the projected
distance of their leaf, verifies them by their true distance, and stops once
the chi-square test holds: the next projected distance is so large against the
k-th best true distance that a nearer vector would have come already with
probability CERTAINTY. The same test between the query and the boxes of the
other partitions then says which of them it has to visit, with what it found so
far as its bound; it goes to no others.

Queries are a stated set (ids divisible by 100). Of equal vectors a search needs
the k + 1 smallest ids only, as ties go to the smaller id, so that a vector that
very many rows have fills no partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import record
from gridloom.session import drop, let_workers_import, written

DIMS = 16
CERTAINTY = 0.95
LEAF_ROWS = 64
#: Vectors in a partition, about.
PART_ROWS = 16_384
#: Vectors that the top of the tree is made from, about; chosen by the hash of id and vector.
SAMPLE_ROWS = 1 << 17
#: Sampled vectors of a partition at least: bounds the number of partitions.
LEAST_SAMPLED = 16
QUERY_BLOCK = 4096
#: Leaves verified before the first stopping test; then twice as many each time, up to MOST_STEP.
STEP, MOST_STEP = 8, 64

_PLACED = "width int, part int, vec_id long, v array<double>, low array<double>"
_OWN = "width int, part int, query_id long, v array<double>, ids array<long>, scores array<double>, read long"
_OWN_ARROW = pa.schema([("width", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("read", pa.int64())])


def chi_square_quantile(p: float, dims: int) -> float:
    """Inverse of the chi-square distribution for an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        half, term, total = x / 2, 1.0, 1.0
        for i in range(1, dims // 2):
            term *= half / i
            total += term
        return 1 - math.exp(-half) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS) -> np.ndarray:
    """The same Gaussian directions for all vectors of a width."""
    return np.random.default_rng([20140901, width]).standard_normal((width, dims))


def kd_leaves(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaf, bounds of the leaves in it, and the leaves' boxes (least, most)."""
    order, parts = np.arange(len(points)), [(0, len(points))]
    bounds = []
    while parts:
        a, b = parts.pop()
        if b - a <= leaf_rows:
            bounds.append((a, b))
            continue
        own = order[a:b]
        spread = np.ptp(points[own], axis=0)
        axis, mid = int(spread.argmax()), (b - a) // 2
        order[a:b] = own[np.argpartition(points[own, axis], mid)]
        parts += [(a, a + mid), (a + mid, b)]
    bounds.sort()
    low = np.stack([points[order[a:b]].min(axis=0) for a, b in bounds])
    high = np.stack([points[order[a:b]].max(axis=0) for a, b in bounds])
    return order, np.array(bounds), low, high


@dataclass
class Top:
    """The top of a kd-tree: node i splits at cut[i] of axis[i] into child[i]; an axis of -1 is a partition, child[i, 0] its number."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    @property
    def parts(self) -> int:
        return int((self.axis < 0).sum())

    def place(self, points: np.ndarray) -> np.ndarray:
        """Partition of each point."""
        at = np.zeros(len(points), np.int64)
        go = np.flatnonzero(self.axis[at] >= 0)
        while len(go):
            node = at[go]
            at[go] = self.child[node, (points[go, self.axis[node]] > self.cut[node]).astype(np.int64)]
            go = go[self.axis[at[go]] >= 0]
        return self.child[at, 0]


def top_of_tree(sample: np.ndarray, parts: int) -> Top:
    """Splits a sample at the median of its widest axis until there are as many partitions, or nothing is left to split."""
    axis, cut, child, leaves, whole = [-1], [0.0], [[0, 0]], [(len(sample), 0, np.arange(len(sample)))], []
    while leaves and len(leaves) + len(whole) < parts:
        leaves.sort(key=lambda x: x[0])
        size, node, rows = leaves.pop()
        spread = np.ptp(sample[rows], axis=0) if size else np.zeros(1)
        widest = int(spread.argmax())
        if not spread[widest] > 0:
            whole.append((size, node, rows))
            continue
        values = sample[rows, widest]
        middle = float(np.median(values))
        middle = middle if middle < values.max() else float(values[values < middle].max())
        axis[node], cut[node], child[node] = widest, middle, [len(axis), len(axis) + 1]
        for part in (rows[values <= middle], rows[values > middle]):
            leaves.append((len(part), len(axis), part))
            axis.append(-1), cut.append(0.0), child.append([0, 0])
    for number, (_, node, _) in enumerate(sorted(leaves + whole, key=lambda x: x[1])):
        child[node] = [number, number]
    return Top(np.array(axis), np.array(cut), np.array(child))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares would overflow or vanish."""
    apart = vectors - query
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
        if len(odd):
            scale = np.abs(apart[odd]).max(axis=1)
            use = (scale > 0) & np.isfinite(scale)
            part = apart[odd[use]] / scale[use, None]
            out[odd[use]] = scale[use] * np.sqrt((part * part).sum(axis=1))
    return out


def box_bounds(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    with np.errstate(over="ignore"):
        return (gap * gap).sum(axis=1)


def search(
    ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int, worst: np.ndarray | None = None, limit: float | None = None, leaf_rows: int = LEAF_ROWS
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and distances of its k nearest found in one partition, nearest first, and how many it read.

    projected, points: projections of vectors and queries. worst: distances
    beyond which a query needs nothing, where it has k neighbours already.
    """
    limit = chi_square_quantile(CERTAINTY, projected.shape[1]) if limit is None else limit
    order, bounds, low, high = kd_leaves(projected, leaf_rows)
    ids, vectors, projected, found = ids[order], vectors[order], projected[order], []
    for own, query, point, most in zip(query_ids, queries, points, np.full(len(queries), np.inf) if worst is None else worst):
        bound = box_bounds(low, high, point)
        near = np.argsort(bound, kind="stable")
        best_ids, best, read = np.empty(0, np.int64), np.empty(0), 0
        at, step = 0, STEP
        while at < len(near) and not bound[near[at]] > limit * most * most:
            rows = np.concatenate([np.arange(*bounds[leaf]) for leaf in near[at : at + step].tolist()])
            at, step = at + step, min(2 * step, MOST_STEP)
            rows = rows[ids[rows] != own]
            if np.isfinite(most):
                away = projected[rows] - point
                rows = rows[~(np.einsum("ij,ij->i", away, away) > limit * most * most)]
            apart = distances(vectors[rows], query)
            read += len(rows)
            best, best_ids = np.concatenate([best, apart]), np.concatenate([best_ids, ids[rows]])
            if len(best) > k:
                near_k = np.flatnonzero(best <= np.partition(best, k - 1)[k - 1])  # with all ties
                keep = near_k[np.lexsort((best_ids[near_k], best[near_k]))[:k]]
                best, best_ids = best[keep], best_ids[keep]
            if len(best) == k:
                most = min(most, best.max())
        keep = np.lexsort((best_ids, best))[:k]
        found.append((best_ids[keep], best[keep], read))
    return found


def _rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    certainty: float = CERTAINTY,
    part_rows: int = PART_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest found of each row whose id is divisible by every: query_id, rank, vec_id, score.

    Nearness is the Euclidean distance of the original vectors in double
    precision; ties go to the smaller id; fewer than k candidates give all of
    them, none gives no row. Vectors that are null, empty or zero or hold null
    or non-finite components take no part, nor do rows without an id. Vectors
    are compared with those of their own width only. Of rows repeated whole one
    counts; if an id comes with several vectors, a query's own id is never its
    neighbour, and the results of its vectors are ranked together. Other
    columns are not read.
    """
    found = searches(vectors, k, every, id_col, vector_col, dims, certainty, part_rows, query_block)
    pairs = found.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searches(vectors: DataFrame, k: int, every: int, id_col: str, vector_col: str, dims: int, certainty: float, part_rows: int, query_block: int) -> DataFrame:
    """What each query found in each partition that it visited, and how many vectors it read there; written."""
    spark = vectors.sparkSession
    let_workers_import(spark)
    limit = chi_square_quantile(certainty, dims)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"]).withColumn("width", F.size("v"))
    rows, rows_at = written(rows, "vectors")
    sizes = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.count("*").alias("n")).collect()}
    tops: dict[int, Top] = {}
    every_ = 1 << 30
    share = min(every_, SAMPLE_ROWS * every_ // max(1, sum(sizes.values())))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(every_)) < share).mapInArrow(_projected(dims), "width int, low array<double>").limit(2 * SAMPLE_ROWS).toArrow()
    sampled = sample.column("width").to_numpy()
    low = _rows(sample.column("low"), len(sampled)) if len(sampled) else np.zeros((0, dims))
    for width, n in sizes.items():
        own = low[sampled == width]
        tops[width] = top_of_tree(own, min(math.ceil(n / part_rows), max(1, len(own) // LEAST_SAMPLED)))
    del sample, sampled, low

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("width", pa.int32()), ("part", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
        for batch in batches:
            ids, widths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                v = batch.column(1).take(pa.array(at))
                low = _rows(v, len(at)) @ projection(width, dims)
                yield record(schema, np.full(len(at), width, np.int32), tops[width].place(low).astype(np.int32), ids[at], v, low.tolist())

    placed, placed_at = written(rows.select("vec_id", "v", "width").mapInArrow(place, _PLACED), "placed")
    wanted = F.col("vec_id") % every == 0
    of_axis = [f(F.col("low")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max))]
    boxes: dict[int, tuple] = {}
    for r in sorted(placed.groupBy("width", "part").agg(F.count_if(wanted).alias("asked"), *of_axis).collect(), key=lambda r: (r["width"], r["part"])):
        own = boxes.setdefault(r["width"], ([], [], []))
        own[0].append(r["part"]), own[1].append([r[f"low{i}"] for i in range(dims)]), own[2].append([r[f"high{i}"] for i in range(dims)])
    boxes = {w: tuple(map(np.array, own)) for w, own in boxes.items()}
    keys = ["width", "part", "chunk", "block"]
    # of equal vectors, the smallest ids are all that any search can return
    same = Window.partitionBy("width", "part", "v").orderBy("vec_id")
    data, data_at = written(placed.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place"), "data")

    # a partition that came out too large is searched in chunks
    chunks, chunks_at = written(data.groupBy("width", "part").agg(F.ceil(F.count("*") / (2 * part_rows)).cast("int").alias("chunks")), "chunks")

    def visit(asked: DataFrame) -> DataFrame:
        """asked: width, part, query_id, v, low, worst. A row for each query, partition and chunk of it."""
        blocks = asked.groupBy("width", "part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")).join(chunks, ["width", "part"])
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = asked.join(blocks, ["width", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int")).withColumn("chunk", each("chunks")).drop("blocks", "chunks")
        met = data.join(blocks, ["width", "part"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("block", each("blocks")).drop("blocks", "chunks")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            n, m = left.num_rows, right.num_rows
            if not n or not m:
                return _OWN_ARROW.empty_table()
            asked_ids, v = right.column("query_id").to_numpy(), right.column("v")
            found = search(left.column("vec_id").to_numpy(), _rows(left.column("v"), n), _rows(left.column("low"), n), asked_ids, _rows(v, m), _rows(right.column("low"), m), k, right.column("worst").to_numpy(), limit)
            columns = [right.column("width"), right.column("part"), right.column("query_id"), v, [x.tolist() for x, _, _ in found], [x.tolist() for _, x, _ in found], [x for _, _, x in found]]
            return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, _OWN_ARROW.types)], schema=_OWN_ARROW)

        return met.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, _OWN)

    first = placed.where(wanted).select("width", "part", F.col("vec_id").alias("query_id"), "v", "low", F.lit(float("inf")).alias("worst"))
    found, found_at = written(visit(first), "own-chunks")
    near = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("scores", "ids")))), 1, k)
    merged = found.groupBy("width", "part", "query_id", "v").agg(near.alias("near"), F.sum("read").alias("read"))
    own, _ = written(merged.select("width", "part", "query_id", "v", F.col("near.ids").alias("ids"), F.col("near.scores").alias("scores"), "read"), "own-partition")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other partitions whose boxes don't pass the stopping test, for each query."""
        schema = pa.schema([("width", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())), ("worst", pa.float64())])
        for batch in batches:
            out: list[tuple] = []
            for width, part, query_id, v, scores in zip(*(batch.column(c).to_pylist() for c in ("width", "part", "query_id", "v", "scores"))):
                parts, low, high = boxes[width]
                point, worst = np.array(v) @ projection(width, dims), scores[-1] if len(scores) == k else float("inf")
                for other in parts[~(box_bounds(low, high, point) > limit * worst * worst)].tolist():
                    if other != part:
                        out.append((width, other, query_id, v, point.tolist(), worst))
                if len(out) >= 2000:
                    yield record(schema, *zip(*out))
                    out = []
            if out:
                yield record(schema, *zip(*out))

    sent, sent_at = written(own.mapInArrow(others, "width int, part int, query_id long, v array<double>, low array<double>, worst double"), "visits")
    more, _ = written(visit(sent), "other-partitions")
    drop(spark, rows_at, placed_at, data_at, chunks_at, found_at, sent_at)
    return own.unionByName(more)


def _projected(dims: int):
    """Rows of (vec_id, v, width, ...) to width and projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("width", pa.int32()), ("low", pa.list_(pa.float64()))])
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                low = _rows(batch.column("v").take(pa.array(at)), len(at)) @ projection(width, dims)
                yield record(schema, np.full(len(at), width, np.int32), low.tolist())

    return run
