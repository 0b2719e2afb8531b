"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (distinct vectors that come first by a hash: `FIT` a part, 4,096 to 16,384 in all): the exact neighbour graph, a balanced
partition of it (median bisections, then moves towards a vector's neighbours while parts keep their bounds), and a small
classifier from vector to part, trained on where a vector's neighbours lie. Every vector is indexed under its most
probable part. A query goes to its most probable parts; how many is the least number that reaches `TARGET` recall on
the sample. There it is compared with every vector; scores are cosines in double precision on the original vectors.

Equal vectors collapse first: a vector stands for the `K`+1 smallest ids that have it, which is all a top `K` can need,
so groups of copies cost nothing. A part too large for a task is cut into blocks of rows and of queries.

Vectors that are null, zero, hold a null or non-finite component or are of another length than the sample's take no
part, neither as query nor as candidate. Ties go to the smaller id, whatever their number. Rows that repeat an id are
one vector each; a query never finds its own id. Further columns aren't read. Fewer than two vectors give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .neardup import groups

#: A part has some PART_ROWS rows, and FIT vectors of the sample, until there are MOST_PARTS of them.
PART_ROWS, FIT, MOST_PARTS, LEAST_SAMPLE, NEIGHBOURS = 1000, 64, 256, 4096, 10
HIDDEN, EPOCHS, RATE = 128, 30, 3e-3
TARGET = 0.98
ROWS, QUERIES = 20_000, 4_000  # of a block
MARGIN = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by cosine."""
    out = []
    for s in range(0, len(x), 256):  # small blocks: this runs on the driver
        near = x[s : s + 256] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2
        few = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, : k + 1]
        out.append(np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, axis=1), axis=1, kind="stable"), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of about equal size (a power of two of them) that cut few edges."""
    of = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(parts))):
        of *= 2
        for p in np.unique(of):
            rows = np.flatnonzero(of == p)
            y = x[rows] - x[rows].mean(axis=0)
            v = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ (v * np.sign(v[np.argmax(np.abs(v))])), kind="stable")
            of[rows[order[len(rows) // 2 :]]] += 1
    size = np.bincount(of, minlength=parts)
    most, least = int(np.ceil(1.1 * len(x) / parts)), int(0.9 * len(x) / parts)
    both = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        both[i] += row
        for j in row:
            both[j].append(i)
    for _ in range(6):
        moved = 0
        for i, near in enumerate(both):
            votes = np.bincount(of[near], minlength=parts)
            to, at = int(np.argmax(votes)), of[i]
            if to != at and votes[to] > votes[at] and size[to] < most and size[at] > least:
                of[i] = to
                size[to] += 1
                size[at] -= 1
                moved += 1
        if not moved:
            break
    return of


class Router:
    """One hidden layer, trained with Adam on cross-entropy against the parts of a vector and its neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(1))
        d, m = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, m)), np.zeros(m)]
        first, second, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        scale = np.sqrt(d)  # unit vectors have small components
        self.scale = scale
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                a, y = x[order[s : s + 256]] * scale, target[order[s : s + 256]]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (p / p.sum(axis=1, keepdims=True) - y) / len(a)
                dh = dz @ self.w[2].T * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        z = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def parts_for(rows: int) -> int:
    """The power of two that gives parts of some PART_ROWS rows."""
    parts = 1
    while parts < MOST_PARTS and 1.5 * parts * PART_ROWS < rows:
        parts *= 2
    return parts


class Index:
    def __init__(self, sample: np.ndarray, k: int, parts: int):
        x = _unit(sample)
        self.dim, self.parts, self.probes = x.shape[1], 1, 1
        while self.parts < parts and 2 * self.parts * FIT <= len(x):
            self.parts *= 2
        graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
        of = balanced_partition(x, graph, self.parts)
        target = np.zeros((len(x), self.parts))
        for part in (of, *of[graph].T):
            target[np.arange(len(x)), part] += 1
        self.router = Router(x, target / target.sum(axis=1, keepdims=True))
        order = self.router.order(x, self.parts)
        where = order[graph[:, :k], 0]  # the part each near neighbour is indexed under
        reached = np.zeros(where.shape, bool)
        for self.probes in range(1, self.parts + 1):
            reached |= where == order[:, self.probes - 1, None]
            if reached.mean() >= TARGET:
                break


def _router(index, probes: str, column: str):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = index.value
        n = m.probes if probes == "query" else 1
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(column).flatten().to_numpy().reshape(-1, m.dim).astype(np.float64))
                parts = pa.array(m.router.order(x, n).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, parts], names=[*b.schema.names, "parts"])

    return route


_FOUND = pa.schema([("rep", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> list:
            dim = len(b.column("vec")[0]) if b.num_rows else 1
            return list(zip(b.column("query").to_pylist(), b.column("rep").to_pylist(), b.column("ids").to_pylist(), b.column("vec").flatten().to_numpy().reshape(-1, dim)))

        for _, held in groups(batches, "gid", rows):
            ask, base = [r for r in held if r[0]], [r for r in held if not r[0]]
            if not ask or not base:
                continue
            q, x = (np.stack([r[3] for r in some]).astype(np.float64) for some in (ask, base))
            qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            xu = (x / xn[:, None]).T
            ids, counts = np.array([i for r in base for i in r[2]], np.int64), np.array([len(r[2]) for r in base], np.int64)
            first = np.cumsum(counts) - counts
            out: list[list] = [[], [], []]
            take = min(len(base), k + 1)
            for s in range(0, len(q), 256):
                near = (q[s : s + 256] / qn[s : s + 256, None]) @ xu
                # every vector at the (k+1)-th score or above, with a margin: the product depends on the block's shape in
                # its last bits; what is returned doesn't
                least = np.partition(near, len(base) - take, axis=1)[:, len(base) - take] - MARGIN
                for r in range(len(near)):
                    some = np.flatnonzero(near[r] >= least[r])
                    score = (x[some] * q[s + r]).sum(axis=1) / (xn[some] * qn[s + r])
                    many = counts[some]
                    cand = ids[np.repeat(first[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    score = np.repeat(score, many)
                    top = np.lexsort((cand, -score))[: k + 1]
                    out[0] += [ask[s + r][1]] * len(top)
                    out[1] += cand[top].tolist()
                    out[2] += score[top].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _FOUND)], schema=_FOUND)

    return search


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found of every row for which is_query holds."""
    spark = vectors.sparkSession
    x = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("q"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = rows.where(x.isNotNull() & F.col("id").isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0))
    parts = parts_for(rows.count())
    sample = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(max(LEAST_SAMPLE, FIT * parts)).toArrow()["vec"].combine_chunks()
    sizes = np.diff(sample.offsets.to_numpy()).tolist()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    sample = np.array([v.values.to_numpy() for v, n in zip(sample, sizes) if n == dim], np.float64)
    if len(sample) < 3:  # nothing to learn from: one part
        sample = np.concatenate([sample, np.eye(3, dim) if dim >= 3 else np.ones((3, dim)) * np.array([[1], [2], [3]])])
    rows = rows.where(F.size("vec") == dim)
    index = spark.sparkContext.broadcast(Index(sample, k, parts))

    order = Window.partitionBy("vec").orderBy("id")
    few = rows.select("vec", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    distinct = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ddl = "vec array<double>, ids array<long>, parts array<int>"
    base = materialise(distinct.mapInArrow(_router(index, "base", "vec"), ddl).select(F.col("ids")[0].alias("rep"), "ids", "vec", F.col("parts")[0].alias("part")), "ann")
    asked = materialise(rows.where("q").select("id", "vec").join(base.select("vec", "rep"), "vec").select("id", "rep"), "asked")
    queries = base.join(asked.select("rep").distinct(), "rep", "left_semi").select("vec", "rep").mapInArrow(_router(index, "query", "vec"), "vec array<double>, rep long, parts array<int>")
    queries = materialise(queries.select("rep", "vec", F.explode("parts").alias("part")), "routed")

    # a row a part: at most MOST_PARTS
    grid = base.groupBy("part").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("nb")).join(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "part")
    cell = F.xxhash64("part", "b", "c").alias("gid")
    left = base.join(F.broadcast(grid), "part").withColumn("b", F.pmod(F.xxhash64("rep"), "nb").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = queries.join(F.broadcast(grid), "part").withColumn("c", F.pmod(F.xxhash64("rep"), "nq").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    both = left.select(cell, F.lit(False).alias("query"), "rep", "ids", "vec").unionByName(right.select(cell, F.lit(True).alias("query"), "rep", F.array().cast("array<long>").alias("ids"), "vec"))
    found = both.repartition("gid").sortWithinPartitions("gid").mapInArrow(_searcher(k), "rep long, vec_id long, score double")
    top = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.join(found, "rep").where(F.col("id") != F.col("vec_id"))
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return pairs.select(F.col("id").alias("query_id"), F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
