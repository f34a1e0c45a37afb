"""Near-duplicate embeddings by an epsilon grid order join.

On the unit sphere a cosine of at least t is a distance of at most eps = sqrt(2 - 2 t).  A vector is
turned onto principal axes, and stands for a point: its leading coordinates and the length of what is
left of it.  By Cauchy and Schwarz two vectors' product is at most that of their points, and their
distance at least that of their points; so points that are eps apart need no look at the vectors.

Vectors are sorted by the cells of width eps that their leading coordinates lie in, and the sequence
is cut into blocks, which are intervals of a tree.  From its top, pairs of intervals whose boxes may
be eps apart are split into pairs of their children, level by level down to blocks (Spark joins), and
within a task down to leaves; there one product of the points finds the pairs that may be near,
whose cosines are then computed in double precision.  Equal vectors are compared once, with their number.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .batches import column, filesystem, lean
from .components import components, forest
from .shared import scratch, ship, stored

THRESHOLD = 0.9
#: Axes are fitted for so many lengths, on at most so many vectors and values of each; any axes give the same links.
FITTED_LENGTHS, FITTED, FITTED_VALUES = 8, 10_000, 4_000_000
#: Leading axes that the order goes by, and that a point keeps.
AXES = 24
BLOCK, LEAF, SPLIT, FAN_OUT_BITS = 4096, 128, 4, 4
#: Rounding of points, which are in single precision.
SLACK = 1e-5
MOST_PARTS = 100_000


def usable(c: str) -> Column:
    """Vectors that can link: without null, NaN or infinite components, not zero, not empty."""
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _scaled(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length, in double precision, and their square norms; scaled by powers of two, which rounds nothing."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, (x * x).sum(1)


def _points(x: np.ndarray, square: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """AXES leading coordinates, the length of the rest, and a coordinate that keeps vectors of different lengths apart."""
    unit = x / np.sqrt(square)[:, None]
    lead = unit[:, :AXES] if axes is None else unit @ axes
    out = np.zeros((len(x), AXES + 2))
    out[:, : lead.shape[1]] = lead
    out[:, AXES] = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1)))
    out[:, AXES + 1] = 10 * x.shape[1]
    return out


class _Block:
    """A stored block: nodes, weights, square norms and points, and the vectors when they are needed."""

    def __init__(self, path: str, n: int):
        self.path, self.n = path, n
        fs, p = filesystem(path)
        with fs.open_input_file(p) as f:
            raw = f.read_at(n * (24 + 4 * (AXES + 2)), 0)
        self.nodes, self.weights, self.square = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.float64, n, 16 * n)
        self.points = np.frombuffer(raw, np.float32, offset=24 * n).reshape(n, -1)
        self.bound = np.ascontiguousarray(self.points[:, : AXES + 1])
        self._vectors = None
        self._boxes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def boxes(self, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, most) of the points of each interval: of ``leaf`` points, of SPLIT of those, and so on up to one."""
        if leaf not in self._boxes:
            at = np.arange(0, self.n, leaf)
            levels = [(np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at))]
            while len(levels[-1][0]) > 1:
                lo, hi = levels[-1]
                at = np.arange(0, len(lo), SPLIT)
                levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
            self._boxes[leaf] = levels
        return self._boxes[leaf]

    @property
    def vectors(self) -> np.ndarray:
        if self._vectors is None:
            fs, p = filesystem(self.path)
            at = self.n * (24 + 4 * (AXES + 2))
            with fs.open_input_file(p) as f:
                self._vectors = np.frombuffer(f.read_at(f.size() - at, at), np.float64).reshape(self.n, -1)
        return self._vectors


@lru_cache(6)
def _load(path: str, n: int) -> _Block:
    return _Block(path, n)


def _apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least square distances of boxes (least, most), row by row."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return np.einsum("ij,ij->i", gap, gap)


class Join:
    """Links between two blocks (or within one): numbers of links and a forest of them."""

    def __init__(self, a: _Block, b: _Block, threshold: float, leaf: int = LEAF):
        self.a, self.b, self.same, self.t, self.leaf_size = a, b, a is b, threshold, leaf
        self.limit = 2 - 2 * threshold + SLACK
        self.left, self.right = np.zeros(a.n, np.int64), np.zeros(b.n, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.tested = self.computed = 0

    def run(self) -> "Join":
        """From the whole blocks down, pairs of intervals that may be near are split into pairs of their parts."""
        a, b = self.a.boxes(self.leaf_size), self.b.boxes(self.leaf_size)
        top = max(len(a), len(b))
        i = j = np.zeros(1, np.int64)
        for level in range(top - 1, -1, -1):
            (a_lo, a_hi), (b_lo, b_hi) = (x[min(level, len(x) - 1)] for x in (a, b))
            near = _apart((a_lo[i], a_hi[i]), (b_lo[j], b_hi[j])) <= self.limit
            if self.same:
                near &= i <= j
            i, j = i[near], j[near]
            if level:
                i, j = self._parts(i, level < len(a), a[min(level, len(a)) - 1], j, level < len(b), b[min(level, len(b)) - 1])
        size = self.leaf_size
        for k in np.unique(i).tolist():
            runs = np.sort(j[i == k])
            cuts = np.flatnonzero(np.diff(runs) > 1) + 1
            for run in np.split(runs, cuts):
                self.leaf(k * size, min((k + 1) * size, self.a.n), int(run[0]) * size, min((int(run[-1]) + 1) * size, self.b.n))
        return self

    @staticmethod
    def _parts(i, split_i: bool, a, j, split_j: bool, b) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the parts of intervals i and j, those that aren't split yet as they are."""
        x = np.arange(SPLIT) if split_i else np.zeros(1, np.int64)
        y = np.arange(SPLIT) if split_j else np.zeros(1, np.int64)
        ci = (i * (SPLIT if split_i else 1))[:, None, None] + x[None, :, None]
        cj = (j * (SPLIT if split_j else 1))[:, None, None] + y[None, None, :]
        ci, cj = (z.ravel() for z in np.broadcast_arrays(ci, cj))
        ok = (ci < len(a[0])) & (cj < len(b[0]))
        return ci[ok], cj[ok]

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        a, b = self.a, self.b
        self.tested += (a1 - a0) * (b1 - b0)
        i, j = np.nonzero(a.bound[a0:a1] @ b.bound[b0:b1].T >= self.t - SLACK)
        if self.same:
            ahead = i + a0 < j + b0
            i, j = i[ahead], j[ahead]
        if not len(i):
            return
        self.computed += len(i)
        if 8 * len(i) > (a1 - a0) * (b1 - b0):
            dot = (a.vectors[a0:a1] @ b.vectors[b0:b1].T)[i, j]
        else:
            dot = np.einsum("ij,ij->i", a.vectors[a0:a1][i], b.vectors[b0:b1][j])
        i, j = i + a0, j + b0
        ok = dot / np.sqrt(a.square[i] * b.square[j]) >= self.t
        i, j = i[ok], j[ok]
        if len(i):
            self.left += np.bincount(i, b.weights[j], a.n).astype(np.int64)
            self.right += np.bincount(j, a.weights[i], b.n).astype(np.int64)
            self.links.append(forest(a.nodes[i], b.nodes[j]))


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent lengths, orthonormal axes, the principal one first, from a bounded sample chosen by hash."""
    lengths = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(FITTED_LENGTHS).collect()
    out = {}
    for dims in (r["dims"] for r in lengths):
        rows = classes.filter(F.col("dims") == dims).orderBy(F.xxhash64("v"), "h2").limit(max(1, min(FITTED, FITTED_VALUES // dims)))
        x, square = _scaled(rows.select("v").toArrow()["v"].combine_chunks())
        x /= np.sqrt(square)[:, None]
        q = np.linalg.qr(np.random.default_rng(5).normal(size=(dims, min(dims, AXES + 8))))[0]
        for _ in range(8):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        turn = np.linalg.eigh((x @ q).T @ (x @ q))[1][:, ::-1]
        out[dims] = (q @ turn)[:, :AXES]
    return out


def _sequence(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, block: int) -> DataFrame:
    """(place, node, w, v), sorted in partitions of ranges: place has the length and the cells of the leading coordinates."""

    @lean
    def cells(batches):
        for batch in batches:
            dims = column(batch, "dims").to_numpy()
            place = np.empty(len(batch), object)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                lead = _points(*_scaled(column(batch, "v").take(pa.array(at))), axes.get(d))[:, :AXES]
                cell = np.clip(np.floor(lead / eps) + 32768, 0, 65535).astype(">u2")
                head = np.array([d], ">u4").tobytes()
                place[at] = [head + c.tobytes() for c in cell]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.binary()), column(batch, "node"), column(batch, "w"), column(batch, "v")], names=["place", "node", "w", "v"])

    spec = f"place binary, node long, w long, v {classes.schema['v'].dataType.simpleString()}"
    sequence = stored(classes.select("node", "w", "v", "dims").mapInArrow(cells, spec), "vector-cells")
    parts = min(MOST_PARTS, -(-sequence.count() // (2 * block)))
    return sequence.repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node")


def _write_blocks(sequence: DataFrame, axes: dict[int, np.ndarray], block: int) -> DataFrame:
    """(part, k, path, n, lo, hi) of the stored blocks: consecutive vectors of one length, and the box of their points."""
    folder = scratch(sequence.sparkSession, "vector-blocks")

    @lean
    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, k, held, dims = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, square = _scaled(column(rows, "v"))
            points = _points(x, square, axes.get(x.shape[1])).astype(np.float32)
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{root}/{name}") as f:
                for values in (column(rows, "node").to_numpy(), column(rows, "w").to_numpy(), square, points, x):
                    f.write(np.ascontiguousarray(values).tobytes())
            box = (pa.array([points.min(0).tolist()], pa.list_(pa.float32())), pa.array([points.max(0).tolist()], pa.list_(pa.float32())))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(x)], pa.int64()), *box], names=["part", "k", "path", "n", "lo", "hi"])

        for batch in batches:
            lengths = column(batch, "v").value_lengths().to_numpy(zero_copy_only=False)
            i = 0
            while i < len(batch):
                size = sum(map(len, held))
                if held and (size >= block or lengths[i] != dims):
                    yield flush()
                    held, k, size = [], k + 1, 0
                dims = lengths[i]
                other = np.flatnonzero(lengths[i:] != dims)
                j = min(i + block - size, i + int(other[0]) if len(other) else len(batch))
                held.append(batch.slice(i, j - i))
                i = j
        if held:
            yield flush()

    return stored(sequence.mapInArrow(write, "part long, k long, path string, n long, lo array<float>, hi array<float>"), "vector-boxes")


def _near(limit: float) -> Column:
    """Boxes (lo, hi) and (lo2, hi2) may hold points within the limit."""
    gap = F.zip_with(F.zip_with("lo2", "hi", lambda a, b: a - b), F.zip_with("lo", "hi2", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= limit


def block_pairs(blocks: DataFrame, limit: float) -> DataFrame:
    """(path, n, path2, n2) of the blocks whose boxes may be near, each pair once, a block with itself included.

    Blocks are the leaves of a tree of intervals of their sequence; at its top there are at most
    2 ** FAN_OUT_BITS, and each level's pairs are joined with the children of both intervals.
    """
    per_part, parts = blocks.agg(F.max("k") + 1, F.max("part") + 1).first()
    leaves = blocks.withColumn("id", F.col("part") * per_part + F.col("k"))
    last, levels = per_part * parts - 1, 0
    while last >> (FAN_OUT_BITS * levels) >> FAN_OUT_BITS:
        levels += 1
    width = AXES + 2

    def nodes(level: int) -> DataFrame:
        if not level:
            return leaves.select("id", "lo", "hi")
        each = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)
        return stored(leaves.groupBy(F.shiftright("id", FAN_OUT_BITS * level).alias("id")).agg(each(F.min, "lo"), each(F.max, "hi")), "vector-intervals")

    second = lambda t: t.select(*(F.col(c).alias(f"{c}2") for c in t.columns))
    top = nodes(levels)
    pairs = top.select("*", F.explode(F.sequence(F.col("id"), F.lit(last >> (FAN_OUT_BITS * levels)))).alias("id2"))
    pairs = stored(pairs.join(second(top), "id2").filter(_near(limit)).select("id", "id2"), "vector-pairs")
    for level in range(levels - 1, -1, -1):
        below = nodes(level)
        children = below.withColumn("up", F.shiftright("id", FAN_OUT_BITS))
        pairs = pairs.select(F.col("id").alias("up"), F.col("id2").alias("up2")).join(children, "up").join(second(children), "up2")
        pairs = stored(pairs.filter((F.col("id") <= F.col("id2")) & _near(limit)).select("id", "id2"), "vector-pairs")
    named = leaves.select("id", "path", "n")
    return stored(pairs.join(named, "id").join(second(named), "id2").select("path", "n", "path2", "n2"), "vector-pairs")


def links_and_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; cosines are computed in double precision, as the product over the root of the product of the square norms.

    Vectors that are null, empty, zero, or that hold null, NaN or infinite components link with
    nothing: n_links 0, component_id their own id.  Vectors of different lengths don't link with each
    other.  Repeated rows link with one another.  component_id is the smallest id that is not null;
    kept: the id equals it (a null id is kept if no other id is in its component).  An empty table
    gives no rows.  Other columns of the input are not looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    block, leaf = BLOCK, LEAF
    limit = 2 - 2 * threshold + SLACK
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    v = stored(v.withColumn("ok", usable("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v")), "vectors")
    classes = v.filter("ok").groupBy("h1", "h2", "v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "vector-classes")
    singles = v.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not classes.head(1):
        out = singles
    else:
        axes = _axes(classes)
        blocks = _write_blocks(_sequence(classes, axes, float(np.sqrt(2 - 2 * threshold)), block), axes, block)
        pairs = block_pairs(blocks, limit)
        n = pairs.count()
        tasks = max(1, min(n, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64)))

        @lean
        def compare(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    a = _load(r["path"], r["n"])
                    j = Join(a, a if r["path"] == r["path2"] else _load(r["path2"], r["n2"]), threshold, leaf).run()
                    if j.links:
                        u, w = forest(*map(np.concatenate, zip(*j.links)))
                        counts = [(a.nodes, j.left + j.right)] if j.same else [(a.nodes, j.left), (j.b.nodes, j.right)]
                        for nodes, c in counts:
                            yield pa.RecordBatch.from_arrays([pa.array(nodes[c > 0]), pa.nulls(int((c > 0).sum()), pa.int64()), pa.array(c[c > 0])], names=["u", "v", "n"])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.nulls(len(u), pa.int64())], names=["u", "v", "n"])

        found = stored(pairs.repartition(tasks).mapInArrow(compare, "u long, v long, n long"), "vector-links")
        counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
        roots = components(found.filter("v is not null").select("u", "v"))
        c = classes.select("h1", "h2", "v", "node", "w", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        c = stored(c, "vector-roots")
        c = c.join(stored(c.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least"), "root")
        c = c.select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.col("v").alias("x"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
        out = v.filter("ok").join(c, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")) & (F.col("v") == F.col("x")))
        out = out.select("vec_id", "n_links", "component_id").unionByName(singles)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
