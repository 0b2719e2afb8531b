"""MinHash near-dedup: a chosen-path set similarity join.

A document's set (5-word shingles) is drawn into `COORDS` minwise tokens. A tree branches the documents by `BRANCH`
selected coordinates a level: those with the same token there go to the same child. Nodes of at most `LEAF` documents
are compared exhaustively, larger ones branch on, `TREES` independent trees are grown. A pair of similarity s survives a
level of one tree with probability 1-(1-s)^BRANCH or more, so four trees miss a link that meets in a small node at once
with 3e-7 at 0.85 and 3e-6 at 0.8. A link all of whose nodes stay large down to the last level must survive each of them:
it is missed with 6e-5 at 0.85 and 5e-4 at 0.8, unless other links join its documents.

How work stays bounded whatever the groups are:
- equal sets collapse first to their smallest doc_id;
- inside a leaf the tokens (not the texts) and set sizes form clusters. Clusters of all leaves that share documents are
  merged to groups of at most `LEAF` documents, so a text is shipped to one group; what would be larger stays cluster by
  cluster. In a group every link is confirmed on full sets; it yields a spanning star;
- a large node is first looked at in chunks of `BLOCK` documents, each with the node's `PIVOTS` pivots, which joins
  groups of near copies in linear work; nodes, large or small, that lie in one component need nothing more, large ones else branch on;
- nodes still large after `LEVELS` levels are compared in full, block by block: exact, nothing is dropped.

Null or empty texts have the empty set and link with nothing. Equal sets have one component, the smallest id's. Rows
that repeat an id with the same text have the same result each; those that repeat it with another text are linked as one
document. A very long text is one set, held by one worker at a time; further columns of docs aren't read. An empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_above, materialise, release, salted_join, slices
from .graph import components
from .shingles import shingle_sets

TREES, BRANCH, LEVELS = 4, 2, 4
COORDS = TREES * BRANCH * LEVELS
LEAF, PIVOTS, BLOCK = 1024, 8, 512
GROUP_SHINGLES = 8_000_000  # of a merged group
CELLS = 1 << 18  # of the filter of documents that groups need



def least_shared(percent: int) -> int:
    """Of COORDS tokens, linked pairs share fewer than this with a probability below 10^-6."""
    s, tail = percent / 100, 0.0
    for m in range(COORDS):
        tail += math.comb(COORDS, m) * s**m * (1 - s) ** (COORDS - m)
        if tail >= 1e-6:
            return m
    return COORDS


_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(1 << 63, size=COORDS, dtype=np.uint64)
_MUL = _RNG.integers(1 << 62, size=COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int32()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 21):
        sets = shingle_sets(b.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        tokens = np.zeros((len(sets), COORDS), np.int32)
        if len(full):
            flat = np.concatenate(sets)
            at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            for c in range(COORDS):
                low = np.minimum.reduceat((flat ^ _XOR[c]) * _MUL[c], at)
                tokens[full, c] = (low >> np.uint64(8)).astype(np.uint32).view(np.int32)
        digest = [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
        cols = [b.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.array(list(tokens), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, schema=_SKETCH)


def _clusters(ids: np.ndarray, tokens: np.ndarray, size: np.ndarray, percent: int) -> list[list[int]]:
    """Documents joined by pairs that share enough tokens and are of like size, as sorted lists of ids."""
    order, least = np.argsort(ids, kind="stable"), least_shared(percent)
    ids, tokens, size = ids[order], tokens[order], size[order]
    found, free = [], np.ones(len(ids), bool)
    for i in range(len(ids)):
        if free[i]:
            free[i] = False
            member, todo = [i], [i]
            while todo and free.any():
                j = todo.pop()
                alike = 100 * np.minimum(size, size[j]) >= percent * np.maximum(size, size[j])
                near = np.flatnonzero(free & alike)
                near = near[(tokens[near] == tokens[j]).sum(axis=1) >= least]
                free[near] = False
                member += near.tolist()
                todo += near.tolist()
            if len(member) > 1:
                found.append(ids[np.sort(member)].tolist())
    return found


def link_stars(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(least member, member) for the components of the exact link graph among sets: one set meets all others at once."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    to = np.concatenate([[0], np.cumsum(size)])
    has = np.zeros(int(code.max()) + 1, bool)
    free, out = np.ones(n, bool), []
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        todo = [i]
        while todo and free.any():
            j = todo.pop()
            mine = code[to[j] : to[j + 1]]
            has[mine] = True
            left = np.flatnonzero(free & (100 * np.minimum(size, size[j]) >= percent * np.maximum(size, size[j])))
            if len(left):
                if 2 * len(left) < n:
                    take = np.concatenate([code[to[k] : to[k + 1]] for k in left.tolist()])
                    both = np.add.reduceat(has[take].astype(np.int64), np.cumsum(size[left]) - size[left])
                else:
                    both = np.add.reduceat(has[code].astype(np.int64), to[:-1])[left]
                near = left[100 * both >= percent * (size[left] + size[j] - both)]
                free[near] = False
                todo += near.tolist()
                out += [(i, k) for k in near.tolist()]
            has[mine] = False
    return out


def _leaves(percent: int):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.column("members"):
                rows = m.values
                out += _clusters(rows.field("doc_id").to_numpy(), rows.field("sketch").flatten().to_numpy().reshape(-1, COORDS), rows.field("n_shingles").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["cluster"])

    return leaves


def groups(batches: Iterator[pa.RecordBatch], key: str, value) -> Iterator[tuple[object, list]]:
    """Consecutive rows of one key, across batches, as (key, values); value(batch) gives a list, one item a row."""
    last, held = None, []
    for b in batches:
        for k, v in zip(b.column(key).to_pylist(), value(b)):
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(v)
    if held:
        yield last, held


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for _, rows in groups(slices(batches, "text", 1 << 21), "gid", lambda b: list(zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"))))):
            rows.sort(key=lambda r: r[0])
            for r, i in link_stars([x for _, x in rows], percent):
                us.append(rows[r][0])
                vs.append(rows[i][0])
            if len(us) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_EDGE)
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_EDGE)

    return confirm


def _maybe_in(docs: DataFrame, some: DataFrame) -> DataFrame:
    """docs whose doc_id is in `some`, and a few more: a filter of CELLS words of 64 bits keeps texts that no group needs
    from being shuffled. It loses none; a full one lets more through."""
    cell, bit = F.expr(f"pmod(shiftright(xxhash64(doc_id), 6), {CELLS})"), "cast(pmod(xxhash64(doc_id), 64) AS int)"
    cells = some.groupBy(cell.alias("_sl_cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_sl_bits"))
    near = docs.withColumn("_sl_cell", cell).join(F.broadcast(cells), "_sl_cell")  # CELLS rows at most
    return near.where(F.expr(f"(shiftright(_sl_bits, {bit}) & 1) = 1")).select(docs.columns)


def _confirm(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Edges of groups (gid, doc_id), at most a leaf's documents each; each link is confirmed on the full sets."""
    # a text meets the list of its groups; a merge hint: the same plan at every size
    lists = materialise(rows.groupBy("doc_id").agg(F.collect_set("gid").alias("gids")), "lists")
    held = lists.join(_maybe_in(docs, lists).hint("merge"), "doc_id").select(F.explode("gids").alias("gid"), "doc_id", "text")
    return held.repartition("gid").sortWithinPartitions("gid").mapInArrow(_confirmer(percent), "u long, v long")


def _seats(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.xxhash64("cluster").alias("gid"), F.explode("cluster").alias("doc_id"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of nodes that don't lie in one of the components found so far: only these can join more."""
    of = rows.join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    nodes = of.groupBy("node").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("node")
    return rows.join(nodes, "node", "left_semi")


def _groups(clusters: DataFrame, sketches: DataFrame) -> DataFrame:
    """(gid, doc_id): clusters that share documents as one group, so that each document is in one; where that would be
    larger than a leaf (or GROUP_SHINGLES in all), the clusters themselves."""
    stars = clusters.select(F.col("cluster")[0].alias("u"), F.explode("cluster").alias("v")).where("u <> v")
    if stars.isEmpty():
        return _seats(clusters)
    label = components(stars)
    weighed = label.join(sketches.select(F.col("doc_id").alias("v"), "n_shingles"), "v")
    sizes = materialise(weighed.groupBy("c").agg(((F.count("*") <= LEAF) & (F.sum("n_shingles") <= GROUP_SHINGLES)).alias("fits")), "sizes")
    fit = sizes.where("fits").select("c")
    whole = label.join(fit, "c", "left_semi").select(F.col("c").alias("gid"), F.col("v").alias("doc_id"))
    wide = label.join(sizes.where("NOT fits").select("c"), "c", "left_semi").select(F.col("v").alias("first"))
    rest = clusters.withColumn("first", F.col("cluster")[0]).join(wide, "first", "left_semi").select("cluster").distinct()
    return whole.unionByName(_seats(rest))


def _chunks(large: DataFrame) -> DataFrame:
    """Clusters of large nodes: their documents in chunks, each with the node's pivots."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    seats = large.select("node", "doc_id", n.alias("n"))
    pivots = seats.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS))).groupBy("node", "p").agg(F.min_by("doc_id", F.xxhash64("doc_id", "node")).alias("x")).groupBy("node").agg(F.collect_list("x").alias("pivots"))
    chunks = seats.groupBy("node", F.pmod(F.xxhash64("doc_id", F.lit(1)), "n").alias("chunk")).agg(F.collect_list("doc_id").alias("ids"))
    return chunks.join(pivots, "node").select(F.array_sort(F.array_union("ids", "pivots")).alias("cluster"))


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """Children of every row's node: one for each coordinate of this level; trees are told apart at level 0."""
    if level == 0:
        picks = [F.struct(F.xxhash64(F.lit(c), F.col("sketch")[c]).alias("node"), F.lit(c // BRANCH).alias("tree")) for c in range(TREES * BRANCH)]
    else:
        at = lambda k: F.col("tree") * BRANCH + F.lit(level * TREES * BRANCH + k)
        picks = [F.struct(F.xxhash64("node", at(k), F.element_at("sketch", (at(k) + 1).cast("int"))).alias("node"), F.col("tree").alias("tree")) for k in range(BRANCH)]
    return rows.select("doc_id", F.explode(F.array(*picks)).alias("x")).select("doc_id", "x.node", "x.tree")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two documents or more, with the node's size."""
    rows = materialise(rows, "seats")
    sizes = materialise(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    above = hot_above(sizes.agg(F.sum("size").alias("t")).first()["t"] or 0)
    out = materialise(salted_join(rows, sizes, ["node"], "size", sizes.where(F.col("size") > above), above), "nodes")
    release(rows)
    release(sizes)
    return out


def _drawn(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """rows (doc_id, node, tree) with each document's sketch, which is joined to the list of its nodes."""
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct("node", "tree")).alias("at"))
    return lists.join(sketches.hint("merge"), "doc_id").select("doc_id", "sketch", "n_shingles", F.explode("at").alias("x")).select("doc_id", "sketch", "n_shingles", "x.node", "x.tree")


def _leaf_clusters(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Clusters of small nodes; equal clusters of several nodes are kept once."""
    held = _drawn(rows, sketches)
    members = held.groupBy("node").agg(F.collect_list(F.struct("doc_id", "sketch", "n_shingles")).alias("members")).select("members")
    return materialise(members.mapInArrow(_leaves(percent), "cluster array<bigint>").distinct(), "clusters")


def _blocks(rows: DataFrame) -> DataFrame:
    """Clusters of nodes that stayed large: all pairs of their blocks."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    dealt = rows.select("node", "doc_id", n.alias("n")).withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = dealt.groupBy("node", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).agg(F.array_sort(F.collect_list("doc_id")).alias("cluster"))
    return pairs.select("cluster")


def links(sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """(v, c): the component of every document that links with another; None if there are none."""
    level = _sized(_branch(sketches, 0))
    small = [level.where(F.col("size") <= LEAF)]
    large = level.where(F.col("size") > LEAF)
    edges = blocks = labels = None
    if not large.isEmpty():
        edges = materialise(_confirm(_seats(_chunks(large)), docs, percent), "links")
        labels = components(edges)
        large = materialise(_mixed(large, labels), "nodes")
        for depth in range(1, LEVELS):
            if large.isEmpty():
                break
            level = _sized(_branch(_drawn(large, sketches), depth))
            small.append(level.where(F.col("size") <= LEAF))
            large = level.where(F.col("size") > LEAF)
        if not large.isEmpty():
            blocks = _blocks(large)
    leaves = reduce(DataFrame.unionByName, small)
    clusters = _leaf_clusters(leaves if labels is None else _mixed(leaves, labels), sketches, percent)
    seats = _groups(clusters, sketches)
    found = materialise(_confirm(seats if blocks is None else seats.unionByName(_seats(blocks)), docs, percent), "links")
    edges = found if edges is None else found.unionByName(edges)
    return components(edges) if not edges.isEmpty() else None


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with 100 * intersection >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, n_shingles long, digest binary, sketch array<int>"
    drawn = materialise(docs.mapInArrow(_sketch, ddl), "sketches")
    # a sketch follows from the set, so equal sets have one
    classes = materialise(drawn.where("digest is not null AND doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("n_shingles")), "reps")
    own = drawn.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    labels = links(classes.select(F.col("rep").alias("doc_id"), "sketch", "n_shingles"), docs, percent)
    if labels is not None:
        own = own.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left")
    else:
        own = own.withColumn("c", F.lit(None).cast("long"))
    return own.select("doc_id", "n_shingles", F.coalesce("c", "rep").alias("component_id")).withColumn("kept", F.col("component_id") == F.col("doc_id"))
