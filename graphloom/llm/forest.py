"""Embedding near-duplicates by a forest of random-projection trees.

Trees are fitted on a bounded sample (FIT_ROWS vectors) and index every vector.  A node splits at
the median projection on a random direction; vectors within a margin of the split go to both
sides (spill), so close vectors often stay together.  Where the sample is used up before leaves are
small, further splits take directions by level and medians of the leaf's sample, so leaves stay small at any number of
vectors.  A node that spilling doesn't make smaller (a dense cloud) is a leaf.  The number of trees is
measured, not guessed: trees are added until of pairs that are just similar enough (each made of a vector of the
sample and one at that angle in a random direction) a share of TARGET meets in some leaf.

Vectors within half the angle of a common centre are all linked, since angles obey the triangle inequality.  So the
centres of dense clouds are taken from the sample, every vector close enough to one belongs to the core of
the nearest, and what links inside a core is counted from the core's size, in linear work, without comparing.

All other pairs are compared within leaves, in double precision; a leaf of more than BLOCK vectors is compared block
by block, so that no leaf needs more memory than two blocks.  Blocks hold vectors of one core or of none,
blocks of the same core don't meet, and leaves with one core only are left out.  Every vector carries the names
of its earlier leaves, and a pair counts only in the first leaf where it meets.  What leaves a comparison
is a row a vector: how many new links it has there and the smallest vector it is connected to there.  So the output
grows with the vectors that were compared, not with their pairs, and no link is lost.

Equal vectors are one vector with a multiplicity, so copies are neither shuffled nor paired.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components link with nothing;
vectors of different dimensions don't link with each other, each dimension has its own forest; every input row returns one
row.  Ids may be of any type that has an order; rows that repeat an id are separate vectors, each with its own links; a null
id counts as a linked vector but never as the smallest id, and isn't kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import components, frozen, partitions, table
from .wordarrays import mix

FIT_ROWS = 20_000
#: The share of pairs just similar enough that has to meet, and the most trees that are made for it.
TARGET = 0.97
MOST_TREES = 64
LEAF = 512
BLOCK = 2048
LEAST_FIT = 32
#: A core has so many vectors of the sample at least; centres are looked for around so many vectors of the sample.
LEAST_CORE = 16
STARTS = 4000
#: Of the standard deviation of the projected difference of two vectors just similar enough.
MARGIN = 0.3
#: So many leaves larger than a block are told to all tasks; more of them are joined.
MOST_LARGE = 10_000


class Forest:
    """Fitted trees.  Node k of a tree splits on direction[k] at split[k] into child[k] and child[k] + 1; leaves have child -1."""

    def __init__(self, sample: np.ndarray, total: int, similarity: float, target: float = TARGET, leaf: int = LEAF, seed: int = 7):
        self.margin = MARGIN * math.sqrt(max(0.0, 2 - 2 * similarity) / max(1, sample.shape[1]))
        self.dim = sample.shape[1]
        depth = max(0, math.ceil(math.log2(max(1, total) / leaf)))
        one, other = just_similar(sample[:2000], similarity, np.random.default_rng([seed, MOST_TREES]))
        met = np.zeros(len(one), bool)
        self.trees = []
        while not self.trees or (met.mean() < target and len(self.trees) < MOST_TREES):
            self.trees.append(self._fit(sample, depth, np.random.default_rng([seed, len(self.trees)])))
            met |= self._meet(one, other, len(self.trees) - 1)
        #: The measured share of such pairs that meet.
        self.recall = float(met.mean())
        self.half = math.sqrt((1 + similarity) / 2) + 1e-9
        self.centres = self._dense(sample, similarity)

    def _dense(self, sample: np.ndarray, similarity: float) -> np.ndarray:
        """Centres of clouds, unit vectors with at least LEAST_CORE vectors of the sample within half the angle, densest first."""
        starts = sample[:STARTS]
        near = np.concatenate([np.zeros(0, np.int64), *((starts[i : i + 500] @ sample.T >= similarity).sum(1) for i in range(0, len(starts), 500))])
        free, todo = np.ones(len(sample), bool), near >= LEAST_CORE
        found = []
        for i in np.argsort(-near, kind="stable"):
            if not todo[i]:
                continue
            rows = np.flatnonzero(free)
            members = around = rows[sample[rows] @ sample[i] >= similarity]
            centre = sample[i]
            for _ in range(2):
                if len(members):
                    mean = sample[members].mean(0)
                    centre = mean / max(np.sqrt(mean @ mean), 1e-12)
                    members = rows[sample[rows] @ centre >= self.half]
            if len(members) >= LEAST_CORE:
                found.append(centre)
                free[members] = False
            for gone in (around, members, [i]):
                gone = np.asarray(gone)
                todo[gone[gone < len(todo)]] = False
        return np.array(found).reshape(-1, self.dim)

    def core(self, x: np.ndarray) -> np.ndarray:
        """The core that each row of x belongs to, or -1."""
        out = np.full(len(x), -1, np.int32)
        if len(self.centres):
            for i in range(0, len(x), 4096):
                cosine = x[i : i + 4096] @ self.centres.T
                best = cosine.argmax(1)
                out[i : i + 4096] = np.where(cosine[np.arange(len(best)), best] >= self.half, best, -1)
        return out

    def _fit(self, sample, depth, rng):
        direction, split, child, more = [], [], [], []
        todo = [(np.arange(len(sample)), 0)]
        extra = rng.standard_normal((max(depth, 1), self.dim)) / math.sqrt(self.dim)
        at = 0
        while at < len(todo):
            rows, level = todo[at]
            at += 1
            r = rng.standard_normal(self.dim) / math.sqrt(self.dim)
            place = sample[rows] @ r
            middle = float(np.median(place)) if len(rows) else 0.0
            left, right = rows[place <= middle + self.margin], rows[place >= middle - self.margin]
            dense = len(rows) > 0 and max(len(left), len(right)) > 0.85 * len(rows)
            direction.append(r)
            split.append(middle)
            if level < depth and len(rows) >= LEAST_FIT and not dense:
                child.append(len(todo))
                more.append(np.zeros(0))
                todo += [(left, level + 1), (right, level + 1)]
            else:
                child.append(-1)
                places = sample[rows] @ extra[level:depth].T if len(rows) and depth > level else np.zeros((1, 0))
                thin = dense or places.std(0).mean() < 1.5 * self.margin if places.shape[1] else True
                more.append(np.zeros(0) if thin else np.median(places, axis=0))
        levels = np.array([len(m) for m in more])
        splits = np.zeros((len(more), max(1, levels.max())))
        for i, m in enumerate(more):
            splits[i, : len(m)] = m
        return np.array(direction), np.array(split), np.array(child), levels, splits, extra[::-1] if depth else extra

    def _meet(self, one: np.ndarray, other: np.ndarray, tree: int) -> np.ndarray:
        """Whether one[i] and other[i] share a leaf of the tree."""
        (i, a), (j, b) = self.leaves(one, tree), self.leaves(other, tree)
        pairs = np.unique(np.stack([i, a], 1), axis=0)
        both, n = np.unique(np.concatenate([pairs, np.unique(np.stack([j, b], 1), axis=0)]), axis=0, return_counts=True)
        out = np.zeros(len(one), bool)
        out[both[n > 1, 0]] = True
        return out

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x (repeated as they spill) and their leaves' codes."""
        direction, split, child, levels, splits, extra = self.trees[tree]
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, nodes = [], []
        while len(row):
            ends = child[node] < 0
            rows.append(row[ends])
            nodes.append(node[ends])
            row, node = row[~ends], node[~ends]
            off = np.einsum("ij,ij->i", x[row], direction[node]) - split[node]
            left, right = off <= self.margin, off >= -self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([child[node[left]], child[node[right]] + 1])
        row, leaf = np.concatenate(rows), np.concatenate(nodes)
        code = leaf.copy()
        for j in range(int(levels.max(initial=0))):
            go = levels[leaf] > j
            n = levels[leaf[go]] - 1 - j
            off = np.einsum("ij,ij->i", x[row[go]], extra[n]) - splits[leaf[go], j]
            left, right = off <= self.margin, off >= -self.margin
            row_go, leaf_go, code_go = row[go], leaf[go], code[go]
            row = np.concatenate([row[~go], row_go[left], row_go[right]])
            code = np.concatenate([code[~go], code_go[left] * 2 + (1 << 40), code_go[right] * 2 + 1 + (1 << 40)])
            leaf = np.concatenate([leaf[~go], leaf_go[left], leaf_go[right]])
        return row, code


def just_similar(x: np.ndarray, similarity: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """x and, for each row of it, a unit vector whose cosine with it is similarity, in a random direction."""
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-12)
    return x, similarity * x + math.sqrt(max(0.0, 1 - similarity * similarity)) * off


def unit(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def _leaves(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x with tree and leaf, for all trees."""
    found = [forest.leaves(x, t) for t in range(len(forest.trees))]
    tree = np.repeat(np.arange(len(found), dtype=np.int32), [len(r) for r, _ in found])
    return np.concatenate([r for r, _ in found]), tree, np.concatenate([c for _, c in found])


def _sizes(forest: Forest):
    """tree, leaf, core, n: how many of a batch's vectors of a core (-1: none) are in a leaf."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch, 0)
            row, tree, code = _leaves(forest, x)
            found, n = np.unique(np.stack([tree, code, forest.core(x)[row]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32)), pa.array(n)], ["tree", "leaf", "core", "n"])

    return run


def _members(forest: Forest):
    """rep, copies and core of the vectors that belong to a core."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                core = forest.core(unit(batch, 2))
                inside = pa.array(core >= 0)
                yield pa.RecordBatch.from_arrays([c.filter(inside) for c in (batch.column(0), batch.column(1), pa.array(core))], ["rep", "copies", "core"])

    return run


def _assign(forest: Forest):
    """A row per vector and leaf: with the vector, its core, its copies and the names of those of its leaves that come earlier."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch, 2)
            core = forest.core(x)
            row, tree, code = _leaves(forest, x)
            # A leaf's name in the order in which leaves of all trees come.
            name = mix(code.astype(np.uint64) ^ mix(tree.astype(np.uint64), 3)).view(np.int64)
            order = np.lexsort((name, row))
            row, code, tree, name = row[order], code[order], tree[order], name[order]
            begin = np.searchsorted(row, row)
            for s in range(0, len(row), 8192):
                e = min(len(row), s + 8192)
                earlier = np.arange(s, e) - begin[s:e]
                ends = np.cumsum(earlier)
                at = np.arange(int(ends[-1])) + np.repeat(begin[s:e] - (ends - earlier), earlier)
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(name[at]))
                take = pa.array(row[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(tree[s:e]), pa.array(code[s:e]), pa.array(core[row[s:e]]), *(batch.column(i).take(take) for i in range(3)), codes], ["tree", "leaf", "core", "rep", "copies", "v", "codes"])

    return run


def _met_before(codes: pa.ListArray, chosen: np.ndarray) -> np.ndarray:
    """Which pairs of the chosen rows share an earlier leaf, where they have been compared already."""
    out = np.zeros((len(chosen), len(chosen)), bool)
    codes = codes.take(pa.array(chosen))
    name = codes.flatten().to_numpy()
    row = np.repeat(np.arange(len(chosen)), pc.list_value_length(codes).to_numpy())
    order = np.argsort(name, kind="stable")
    name, row = name[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    size = np.diff([*begin, len(name)]) if len(name) else begin
    for s, n in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        out[np.ix_(row[s : s + n], row[s : s + n])] = True
    return out


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links a[i], b[i] connect it with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(similarity: float):
    """Rows sorted by tree, leaf, pair of blocks, block: for each vector with links the number of new ones (links that meet in no
    earlier leaf, so each counts once, and aren't inside a core; copies count each) and a vector it is connected to."""

    def work(group: list[pa.RecordBatch]):
        part = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        if part.num_rows < 2:
            return
        x, rep, copies, block = unit(part, 7), part.column(5).to_numpy(), part.column(6).to_numpy(), part.column(4).to_numpy()
        core = part.column(9).to_numpy()
        one = part.column(2)[0].as_py() == part.column(3)[0].as_py()
        cut = len(x) if one else int(np.searchsorted(block, block[0], side="right"))
        right = 0 if one else cut
        if right == len(x):
            return
        n, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for i in range(0, cut, 512):
            a, b = np.nonzero(x[i : min(cut, i + 512)] @ x[right:].T >= similarity)
            a, b = a + i, b + right
            other = (a < b) & ((core[a] < 0) | (core[a] != core[b]))
            a, b = a[other], b[other]
            if not len(a):
                continue
            chosen, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            new = ~_met_before(part.column(8), chosen)[at[: len(a)], at[len(a) :]]
            a, b = a[new], b[new]
            n += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
            root = connected(len(x), np.concatenate([np.arange(len(x)), a]), np.concatenate([root, b]))
        linked = np.flatnonzero(n)
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(n[linked]), pa.array(rep[root[linked]])], ["rep", "n", "root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for s, e in zip([0, *new], [*new, len(keys)], strict=True):
                if key is not None and tuple(keys[s]) != key:
                    yield from work(held)
                    held = []
                key = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from work(held)

    return run


def links(distinct: DataFrame, similarity: float = 0.9, fit_rows: int = FIT_ROWS, block: int = BLOCK, most_large: int = MOST_LARGE) -> DataFrame:
    """For distinct vectors of one dimension (rep, a long; copies; v): rows of rep, n and root.

    The sum of n over a rep's rows is the number of its links, each row of a linked vector counted; links from each rep to
    each of its roots connect what the similar pairs connect.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    fit = distinct.orderBy(F.xxhash64("v"), "rep").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    if len(fit) < 2:
        return distinct.select("rep", F.lit(0).cast("long").alias("n"), F.col("rep").alias("root")).limit(0)
    sample = fit.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
    forest = Forest(sample / np.sqrt((sample**2).sum(1, keepdims=True)), total, similarity)
    kind = dict(distinct.dtypes)["v"]
    sizes = distinct.select("v").mapInArrow(_sizes(forest), "tree int, leaf long, core int, n long").groupBy("tree", "leaf", "core").agg(F.sum("n").alias("n"))
    leaf = Window.partitionBy("tree", "leaf")  # a row a core
    own = F.ceil(F.col("n") / block).cast("int")
    parts = sizes.select("tree", "leaf", "core", own.alias("own"), F.sum("n").over(leaf).alias("all"), F.count("*").over(leaf).alias("cores"))
    parts = parts.where((F.col("all") > block) | ((F.col("cores") == 1) & (F.col("core") >= 0)))
    parts = frozen(parts.select("tree", "leaf", "core", "own", F.sum("own").over(leaf).cast("int").alias("blocks"), (F.sum("own").over(leaf.orderBy("core")) - F.col("own")).cast("int").alias("first")))
    rows = distinct.select("rep", "copies", "v").mapInArrow(_assign(forest), f"tree int, leaf long, core int, rep long, copies long, v {kind}, codes array<long>")
    rows = rows.join(F.broadcast(parts) if parts.count() <= most_large else parts, ["tree", "leaf", "core"], "left")
    rows = rows.withColumn("mine", F.coalesce(F.col("first") + F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"), F.lit(0)))
    # All blocks of the leaf but those of the own core; leaves that aren't in parts are one block.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    foreign = F.filter(every, lambda i: (F.col("core") < 0) | (i < F.col("first")) | (i >= F.col("first") + F.col("own")))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(foreign)))
    rows = rows.select("tree", "leaf", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep", "copies", "v", "codes", "core")
    rows = rows.repartition(partitions(spark), "tree", "leaf", "p", "q").sortWithinPartitions("tree", "leaf", "p", "q", "mine")
    found = rows.mapInArrow(_compare(similarity), "rep long, n long, root long")
    if not len(forest.centres):
        return found
    members = frozen(distinct.select("rep", "copies", "v").mapInArrow(_members(forest), "rep long, copies long, core int"))
    totals = members.groupBy("core").agg(F.sum("copies").alias("all"), F.min("rep").alias("root"))  # a row a centre, at most STARTS
    inside = members.join(F.broadcast(totals), "core").select("rep", (F.col("all") - F.col("copies")).alias("n"), "root").where("n > 0")
    return found.union(inside)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.9) -> DataFrame:
    """id, n_links, component (smallest id reachable) of each row of vectors."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    plain = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = frozen(rows.withColumn("ok", F.coalesce(plain, F.lit(False))))
    # A distinct vector's number is fixed when the table is written.
    distinct = frozen(marked.where("ok").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = distinct.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row a dimension
    found = marked.sparkSession.createDataFrame([], "rep long, n long, root long")
    for d in (r.d for r in sizes if r["count"] > 1):
        some = distinct if len(sizes) == 1 else distinct.where(F.size("v") == d)
        found = found.union(links(some.select("rep", "copies", "v"), similarity))
    found = frozen(found)
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep").withColumnRenamed("root", "top")
    rooted = distinct.join(roots, "rep", "left").withColumn("top", F.coalesce("top", "rep"))
    least = rooted.groupBy("top").agg(F.min("least").alias("component"))
    named = rooted.join(least, "top").join(linked, "rep", "left").select("v", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.where("ok").join(named, "v").select("id", "n_links", "component")
    rest = marked.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.union(rest).withColumnRenamed("id", id_col)


def op5_forest(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


#: All pairs, for the small scale of the check.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.n),
c AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
