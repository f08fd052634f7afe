"""Embedding near-duplicates (method: random-projection tree forest with spill overlap).

Each of TREES trees splits the vectors by random directions at sample medians until a node is small or tight; vectors
near a threshold go both ways, to two leaves of a tree at most. Vectors are compared within leaves, in double precision,
and what the trees find is united. A pair that several leaves share counts in the first of them alone, which both
vectors' lists of leaves tell, so links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import components, hold, read, written

THRESHOLD, TREES, SPILL = 0.95, 12, 0.04
#: Vectors that the trees are fitted on at most; vectors aimed at in a leaf; rows of a leaf that one task compares with its other blocks.
SAMPLE, LEAF, BLOCK = 20_000, 256, 4096
#: No leaf's number reaches this, so that a dimension and a leaf make one key.
LEAVES = 1 << 32


class Forest:
    """Trees as arrays: of each inner node its direction, threshold and margin; children; leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.leaves = [], 0
        least = max(4, int(LEAF * len(sample) / max(rows, 1)))
        tight = np.cos(np.arccos(THRESHOLD) / 2)

        def grow(index: np.ndarray, nodes: list) -> int:
            me = len(nodes)
            nodes.append(None)
            part = sample[index]
            centre = part.mean(0) if len(part) else np.zeros(sample.shape[1])
            size = np.linalg.norm(centre)
            if len(index) <= least or size > 0 and (part @ centre / size).min() > tight:
                nodes[me] = self.leaves
                self.leaves += 1
                return me
            way = rng.normal(size=sample.shape[1])
            way /= np.linalg.norm(way)
            at = part @ way
            # between the largest gap near the median, so that groups of near copies stay together
            order = np.sort(at)
            lo, hi = len(order) // 3, max(len(order) // 3 + 2, 2 * len(order) // 3)
            gaps = np.diff(order[lo:hi])
            cut = (order[lo + gaps.argmax()] + order[lo + gaps.argmax() + 1]) / 2 if len(gaps) and gaps.max() > 0.02 else float(np.median(at))
            left, right = index[at <= cut], index[at > cut]
            if not len(left) or not len(right):
                nodes[me] = self.leaves
                self.leaves += 1
                return me
            nodes[me] = (way, cut, grow(left, nodes), grow(right, nodes))
            return me

        for _ in range(trees):
            nodes: list = []
            grow(np.arange(len(sample)), nodes)
            self.trees.append(nodes)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaves of each vector: for every tree its own leaf, and the one across the nearest threshold if that is within SPILL (else -1)."""
        out = np.full((len(x), 2 * len(self.trees)), -1, "i4")
        for t, nodes in enumerate(self.trees):
            near = np.full(len(x), np.inf)
            other = np.zeros(len(x), "i8")  # the node to enter on the other side of the nearest threshold
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if isinstance(nodes[node], int):
                    out[rows, 2 * t] = nodes[node]
                    continue
                way, cut, left, right = nodes[node]
                at = x[rows] @ way - cut
                closer = np.abs(at) < np.minimum(near[rows], SPILL)
                near[rows[closer]] = np.abs(at[closer])
                other[rows[closer]] = np.where(at[closer] <= 0, right, left)
                todo += [(left, rows[at <= 0]), (right, rows[at > 0])]
            spilled = np.nonzero(other > 0)[0]
            todo = [(int(n), spilled[other[spilled] == n]) for n in np.unique(other[spilled])]
            while todo:
                node, rows = todo.pop()
                if isinstance(nodes[node], int):
                    out[rows, 2 * t + 1] = nodes[node]
                    continue
                way, cut, left, right = nodes[node]
                at = x[rows] @ way - cut
                todo += [(left, rows[at <= 0]), (right, rows[at > 0])]
        return out


def _unit(column) -> np.ndarray:
    x = np.array(column, "f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that can link: not null, without null or non-finite components, not zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where("size(embedding) > 0").where(finite & F.exists(e, lambda v: v != 0))


def found(classes: DataFrame, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """From classes (rep, copies, embedding): links (rep, n: vectors of other classes linked), written, and edges (a, b).

    Each dimension has a forest of its own, fitted on its part of the sample; one that the sample lacks is one leaf a tree.
    """
    spark = classes.sparkSession
    hold(spark)
    rows = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column(0).to_pylist()
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    # some thousand directions, bounded by SAMPLE and trees
    forests = {dim: Forest(_unit(vs), max(len(vs), rows * len(vs) // len(sample)), trees) for dim, vs in by_size.items()}
    forest = spark.sparkContext.broadcast(forests)
    schema = pa.schema([("leaf", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("x", pa.binary()), ("places", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(sizes).tolist():
                yield from dealt_out(dim, batch.filter(pa.array(sizes == dim)))

    def dealt_out(dim: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _unit(batch.column(2).to_pylist())
        known = forest.value.get(dim)
        places = known.assign(x) if known else np.tile(np.array([0, -1], "i4"), (len(x), 1))
        rep, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        xs, ps = [v.tobytes() for v in x], [p.tobytes() for p in places]
        r, k = np.nonzero(places >= 0)
        for at in range(0, len(r), 4000):
            i, leaf = r[at : at + 4000], places[r[at : at + 4000], k[at : at + 4000]].astype("i8") + dim * LEAVES
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(rep[i]), pa.array(copies[i]), pa.array([xs[j] for j in i], pa.binary()), pa.array([ps[j] for j in i], pa.binary())], schema=schema)

    dealt = written(classes.select("rep", "copies", "embedding").mapInArrow(deal, "leaf long, rep long, copies long, x binary, places binary"), "leaves")
    # a leaf of more than BLOCK rows is compared block by block: each row goes to its block with every other one
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = dealt.join(sizes, "leaf").withColumn("own", own)
    tasks = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("lo"), F.greatest(b, F.col("own")).alias("hi"))))
    keyed = placed.select("leaf", "own", "rep", "copies", "x", "places", tasks.alias("task")).select("leaf", "task.lo", "task.hi", "own", "rep", "copies", "x", "places")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])

        def one(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            _, lo, hi = key
            leaf = key[0] % LEAVES
            own = np.concatenate([b.column("own").to_numpy() for b in held])
            if len(own) < 2:
                return None
            rep, copies = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("rep", "copies"))
            x = np.stack([np.frombuffer(v, "f8") for b in held for v in b.column("x").to_pylist()])
            places = np.stack([np.frombuffer(v, "i4") for b in held for v in b.column("places").to_pylist()])
            mine = int(np.nonzero((places == leaf).any(0))[0][0]) // 2  # the tree of this leaf
            n, root = np.zeros(len(rep), "i8"), np.arange(len(rep))
            for at in range(0, len(rep), 512):
                i, j = np.nonzero(x[at : at + 512] @ x.T >= THRESHOLD)
                i += at
                keep = (i < j) & ((own[i] != own[j]) if lo != hi else True)
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 100_000):
                    a, b = i[k : k + 100_000], j[k : k + 100_000]
                    p, q = places[a], places[b]
                    earlier = np.zeros(len(a), bool)
                    for t in range(mine + 1):
                        for u in (0, 1):
                            for v in (0, 1):
                                same = (p[:, 2 * t + u] == q[:, 2 * t + v]) & (p[:, 2 * t + u] >= 0)
                                earlier |= same if t < mine else same & (p[:, 2 * t + u] < leaf)
                    a, b = a[~earlier], b[~earlier]
                    n += np.bincount(a, copies[b], len(rep)).astype("i8") + np.bincount(b, copies[a], len(rep)).astype("i8")
                    while True:  # join the trees of linked rows until all agree
                        lower = np.minimum(root[a], root[b])
                        before = root.copy()
                        np.minimum.at(root, root[a], lower)
                        np.minimum.at(root, root[b], lower)
                        while (root[root] != root).any():
                            root = root[root]
                        if (root == before).all():
                            break
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[root[some]])], schema=kind) if some.any() else None

        key, held = None, []
        for batch in batches:
            ks = np.stack([batch.column(c).to_numpy().astype("i8") for c in ("leaf", "lo", "hi")], 1)
            for part in np.split(np.arange(len(ks)), np.nonzero((np.diff(ks, axis=0) != 0).any(1))[0] + 1):
                if not len(part):
                    continue
                now = tuple(ks[part[0]])
                if now != key:
                    if held and (done := one(key, held)):
                        yield done
                    key, held = now, []
                held.append(batch.slice(int(part[0]), len(part)))
        if held and (done := one(key, held)):
            yield done

    parts = keyed.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi").mapInArrow(compare, "rep long, n long, least long")
    kept = written(parts, "links")
    return kept.groupBy("rep").agg(F.sum("n").alias("n")), kept.select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def clusters(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, its own included), kept; one row for each row of vectors.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Equal vectors are one class,
    linked among themselves; classes are compared within leaves. Vectors of different dimensions are never linked: each
    dimension has its own forest. Repeated rows count as vectors of their own. A row without vec_id links like any other
    but names no component: component_id is the smallest vec_id that there is, or null if there is none, and kept then
    true. Other columns are ignored; no rows give no rows.
    """
    good = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = written(good.groupBy("embedding").agg(F.min("row").alias("rep"), F.min("vec_id").alias("first"), F.count("*").alias("copies")), "vector-classes")
    links, edges = found(classes.select("rep", "copies", "embedding"), trees)
    joined = components(edges)
    of_class = classes.join(links.withColumnRenamed("n", "others"), "rep", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = written(of_class.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first", F.coalesce("component", "rep").alias("component")), "vector-components")
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of_class.select("embedding", "n_links", "component").join(least, "component")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = rest.join(named, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))
