"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its 5-word shingles.  Its signature has SYMBOLS b-bit minima, and similar
sets have signatures at a small Hamming distance: of two with similarity 0.85, one in 10^5 pairs
differs in more than RADIUS symbols (with 0.8, one in 10^3).  The signature is cut into CHUNKS
chunks.  If two signatures differ in at most RADIUS = 2 * CHUNKS - 1 symbols, then in some chunk they
differ in at most one (pigeonhole); so for each chunk and each of its symbols a key of the others is
made, and any pair within RADIUS shares a key.

Of the keys those that two signatures have are found first; they make groups, and groups with the
same members are one.  Within groups the signatures' distances are computed, and pairs over RADIUS
are dropped.  What is left, closed transitively, are candidate groups, in which pairs are confirmed
on the full sets, by matrix products.  What leaves a task is a forest of links, never pairs.

Both kinds of groups are compared in cells of bounded size.  A group of several cells is first
compared within each cell, one member, the lead, being in all of them.  Only members that this
doesn't connect with the lead are then compared with the whole group, so that a large group of copies of
one text costs its size, not its square.

Equal sets are one class, found by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .batches import column, for_a_task, lean, rows_at
from .blocks import ASKED, STRETCH, answer, answered, ask, distinct, rows_of, write_blocks
from .bpe import Ragged, spread
from .components import components, forest
from .shared import scratch, ship, stored
from .words import hash_slices, lower_ascii, mix64, split, utf8, windows

SHINGLE = 5
SIMILARITY = 85  # in hundredths; what op10's contract says, and the default
SYMBOLS, CHUNKS = 50, 10
RADIUS = 2 * CHUNKS - 1
#: A cell of a group has about so many shingles, and documents, at most; where a whole group is compared, ACROSS cells are one.
CELL_SHINGLES, CELL_SETS, ACROSS = 1 << 17, 128, 8
#: Up to so many holders of a shingle, their pairs are counted one by one; above, by matrix products.
SPARSE = 24
#: Classes in a block of signatures; and classes for one bucket of keys.
PACK, CLASSES_A_BUCKET = 20_000, 10_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> Ragged:
    """Hashes of the distinct shingles of each text (A-Z lower-cased), ascending.

    With fewer words than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    data = lower_ascii(data)
    starts, ends, first = split(data, offsets)
    keys = hash_slices(data, starts, ends)
    h, _ = windows(keys, first, width)
    out = []
    at = first.tolist()
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            x = h[a : b - width + 1].copy()
            x.sort()
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(windows(keys[a:b], np.array([0, b - a]), b - a)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return Ragged(np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64))


@lru_cache(1)
def _factors() -> np.ndarray:
    return mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def signatures(sets: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16-bit minima of each set, and two hashes of the set).  Empty sets have zeros."""
    n = len(sets.offsets) - 1
    sig, h1, h2 = np.zeros((n, SYMBOLS), np.uint16), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(sets.offsets))
    if len(full):
        at, x = sets.offsets[full], sets.values
        for k, a in enumerate(_factors()):
            v = x * a
            v ^= v >> np.uint64(31)
            v *= np.uint64(0x9E3779B97F4A7C15)
            sig[full, k] = mix64(np.minimum.reduceat(v, at)).astype(np.uint16)
        h1[full] = np.add.reduceat(mix64(x), at)
        h2[full] = np.add.reduceat(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), at)
    return sig, h1, h2


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature, keys of its chunks with each symbol left out in turn: SYMBOLS in all."""
    cuts = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]
    out = np.empty((len(sig), SYMBOLS), np.uint64)
    wide = sig.astype(np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        for skip in range(a, b):
            h = np.full(len(sig), skip + 1, np.uint64)
            for k in range(a, b):
                if k != skip:
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, k])
            out[:, skip] = h
    return out


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _packed(classes: DataFrame) -> DataFrame:
    """(part, block, nodes, sigs): the classes' signatures in stored blocks."""
    most = PACK

    @lean
    def pack(batches):
        part, block, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nodes = b"".join(column(x, "node").to_numpy().tobytes() for x in held)
            sigs = b"".join(y for x in held for y in column(x, "sig").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([nodes], pa.binary()), pa.array([sigs], pa.binary())], names=["part", "block", "nodes", "sigs"])

        for batch in batches:
            for i in range(0, len(batch), most):
                held.append(batch.slice(i, most))
                if sum(map(len, held)) >= most:
                    yield flush()
                    held, block = [], block + 1
        if held:
            yield flush()

    return stored(classes.select("node", "sig").mapInArrow(pack, "part int, block int, nodes binary, sigs binary"), "dup-packed", rows_a_group=1)


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, node): the keys that two or more classes (node, sig) have, and those that have them."""
    buckets = max(8, -(-classes.count() // CLASSES_A_BUCKET))
    packed = _packed(classes)

    def keys_of(batches):
        for batch in batches:
            for part, block, nodes, sigs in zip(*(column(batch, c).to_pylist() for c in ("part", "block", "nodes", "sigs"))):
                keys = chunk_keys(np.frombuffer(sigs, np.uint16).reshape(-1, SYMBOLS)).ravel()
                yield part, block, np.frombuffer(nodes, np.int64), keys, *distinct(keys)

    @lean
    def asks(batches):
        for part, block, _, _, unique, _, counts in keys_of(batches):
            yield ask(part, block, unique, counts > 1, buckets)

    found = answer(packed.mapInArrow(asks, ASKED), buckets)

    @lean
    def holders(batches):
        for part, block, nodes, keys, unique, at, _ in keys_of(batches):
            k = np.flatnonzero(answered(found, part, block, unique, buckets)[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys[k].view(np.int64)), pa.array(nodes[k // SYMBOLS])], names=["key", "node"])

    return stored(packed.mapInArrow(holders, "key long, node long"), "dup-keys")


def close_signatures(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (or both of ``a``) within RADIUS."""
    other = a if b is None else b
    if a.size * len(other) <= 1 << 16:
        apart = (a[:, None, :] != other[None, :, :]).sum(2)
    else:
        apart = np.zeros((len(a), len(other)), np.uint8)
        for k in range(SYMBOLS):
            apart += a[:, k, None] != other[None, :, k]
    ok = apart <= RADIUS
    return np.nonzero(np.triu(ok, 1) if b is None else ok)


def _close(a: list[bytes], b: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    both = [None if x is None else np.frombuffer(b"".join(x), np.uint16).reshape(-1, SYMBOLS) for x in (a, b)]
    return close_signatures(*both)


def _ragged(sets: list[bytes]) -> Ragged:
    return Ragged(np.frombuffer(b"".join(sets), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in sets])]).astype(np.int64))


def _similar(hundredths: int):
    return lambda a, b: linked(_ragged(a), None if b is None else _ragged(b), hundredths)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root) of the classes (node, sig) that pairs within RADIUS connect with a smaller one."""
    held = shared_keys(classes)
    groups = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("n > 1")
    groups = stored(groups.groupBy("n", "lead", "x").agg(F.min("key").alias("key")).select("key", "lead", F.ceil(F.col("n") / CELL_SETS).cast("int").alias("n_cells"), "n"), "dup-key-groups")
    members = stored(held.join(groups, "key").withColumnRenamed("key", "grp"), "dup-key-members")

    def send(m: DataFrame) -> DataFrame:
        m = m.join(classes.select("node", F.col("sig").alias("payload")), "node")
        return m.select("grp", F.explode("cells").alias("c"), "node", "payload").select("grp", "c.*", "node", "payload")

    return connected(members, send, _close)


def connected(members: DataFrame, send: Callable[[DataFrame], DataFrame], compare: Callable) -> DataFrame:
    """(node, root): components of the links that ``compare`` finds between members of a group.

    members: (grp, node, lead, n, n_cells, ...), lead being a node of the group, n the number of its
    members.  send: of members with cells, an array of (i, j, side), to (grp, i, j, side, node,
    payload), one row for each.  compare: two lists of payloads (or one) to the rows that link.
    """
    k = F.pmod(F.xxhash64("node"), F.col("n_cells")).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.when(F.col("node") == F.col("lead"), every("n_cells", lambda x: cell(x, x, 0))).otherwise(F.array(cell(k, k, 0)))
    kind = "u long, v long"

    def compared(m: DataFrame, across: bool) -> DataFrame:
        cells = send(m).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return cells.mapInArrow(_confirm(compare, across), kind)

    roots = components(compared(members.withColumn("cells", own), False))
    large = members.filter("n_cells > 1")
    if not large.head(1):
        return roots
    # Whatever hangs together with the lead is settled; the others of a group meet all of it.
    large = stored(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dup-large")
    leads = stored(large.filter("node = lead").select("grp", F.col("root").alias("lead_root")), "dup-leads")
    large = large.join(leads, "grp").withColumn("apart", F.col("root") != F.col("lead_root"))
    rest = stored(large.filter("apart").groupBy("grp").agg(F.count(F.lit(1)).alias("n_apart")), "dup-rest")
    if not rest.head(1):
        return roots
    large = large.join(rest, "grp").withColumn("wide", F.ceil(F.col("n_cells") / ACROSS).cast("int")).withColumn("a_cells", F.ceil(F.col("n_apart") * F.col("wide") / F.col("n")).cast("int"))
    a = F.pmod(F.xxhash64("node", F.lit(1)), F.col("a_cells")).cast("int")
    other = every("a_cells", lambda x: cell(x, F.floor(k / ACROSS), 1))
    cells = F.when(F.col("apart"), F.concat(every("wide", lambda x: cell(a, x, 0)), other)).otherwise(other)
    more = compared(large.withColumn("cells", cells), True)
    return components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def linked(a: Ragged, b: Ragged | None, hundredths: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (or both of ``a``) whose sets are that similar, by the exact sizes of all intersections."""
    na = len(a.offsets) - 1
    nb = na if b is None else len(b.offsets) - 1
    sizes_a = np.diff(a.offsets)
    sizes_b = sizes_a if b is None else np.diff(b.offsets)
    values = a.values if b is None else np.concatenate([a.values, b.values])
    rows = np.repeat(np.arange(na), sizes_a)
    if b is not None:
        rows = np.concatenate([rows, na + np.repeat(np.arange(nb), sizes_b)])
    order = np.argsort(values, kind="stable")  # rows of a shingle ascend
    v, r = values[order], rows[order]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(v)))
    n = na if b is None else na + nb
    common = np.zeros(na * nb, np.int64)
    for c in range(2, SPARSE + 1):
        at = head[count == c]
        if len(at):
            m = r[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            x, y = m[:, i].ravel(), m[:, j].ravel()
            if b is not None:
                across = (x < na) & (y >= na)
                x, y = x[across], y[across] - na
            common += np.bincount(x * nb + y, minlength=na * nb)
    often = np.flatnonzero(count > SPARSE)
    common = common.reshape(na, nb)
    for k in range(0, len(often), 1024):
        cols = often[k : k + 1024]
        hold = np.zeros((n, len(cols)), np.float32)
        c = count[cols]
        hold[r[spread(head[cols], c)], np.repeat(np.arange(len(cols)), c)] = 1
        common += (hold[:na] @ (hold.T if b is None else hold[na:].T)).astype(np.int64)
    union = sizes_a[:, None] + sizes_b[None, :] - common
    ok = 100 * common >= hundredths * union
    return np.nonzero(np.triu(ok, 1) if b is None else ok)


def _confirm(compare: Callable, across: bool):
    """Of rows (grp, i, j, side, node, payload), sorted by cell: a forest of the links of each cell."""

    @lean
    def run(batches):
        held, cell = [], None
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            sides = [[(x[1], x[2]) for x in held if x[0] == s] for s in (0, 1)]
            if across and not (sides[0] and sides[1]) or not across and len(sides[0]) < 2:
                return
            u, w = (np.array([n for n, _ in side], np.int64) for side in sides)
            i, j = compare([p for _, p in sides[0]], [p for _, p in sides[1]] if across else None)
            if len(i):
                links.append(forest(u[i], (w if across else u)[j]))

        for batch in batches:
            columns = [column(batch, c).to_pylist() for c in ("grp", "i", "j", "side", "node", "payload")]
            for g, i, j, side, node, payload in zip(*columns):
                if (g, i, j) != cell:
                    if held:
                        close()
                    held, cell = [], (g, i, j)
                held.append((side, node, payload))
            if sum(len(u) for u, _ in links) > 100_000:
                yield _edges(*map(np.concatenate, zip(*links)))
                links = []
        if held:
            close()
        if links:
            yield _edges(*map(np.concatenate, zip(*links)))

    return run


@for_a_task(1)
def _side(path: str, part: int) -> dict[int, list[dict]]:
    """Rows of a table stored by part, for one part, by block."""
    out: dict[int, list[dict]] = {}
    for r in rows_at(f"{path}/part={part}", "rows"):
        of_block = out.setdefault(r["block"], [])
        if r["at"] >= 0:
            of_block.append(r)
    return out


def _by_part(df: DataFrame, blocks: DataFrame, what: str) -> str:
    """Path of ``df`` (part, block, at, ...) stored by stretch of blocks and part; every block has a row (with ``at`` -1), so that a missing one is an error."""
    path = scratch(df.sparkSession, what)
    df = df.unionByName(blocks.select("part", "block", F.lit(-1).alias("at")), allowMissingColumns=True)
    df = df.withColumn("stretch", F.floor(F.col("block") / STRETCH).cast("int"))
    df.repartition("part", "stretch").write.option("compression", "zstd").partitionBy("stretch", "part").parquet(path)
    return path


def _beside(path: str, part: int, block: int) -> list[dict]:
    """Rows of a table written by _by_part, for one block."""
    return _side(f"{path}/stretch={block // STRETCH}", part)[block]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(blocks, rows): the written blocks of ``docs``; and for each row its place (part, block, at), doc_id,
    n_shingles, component_id, kept and leads.

    component_id: the smallest id in the row's component, nulls aside (null if all are); kept: the id
    equals it.  leads: true for exactly one row of each component, one that is kept.  Null texts and
    those without words have no shingles, and are components of their own, each row by itself.
    similarity is in hundredths; the signatures are made for 80 and more.
    """
    ship(docs.sparkSession)
    blocks = write_blocks(docs, text_col)

    @lean
    def sign(batches):
        for batch in batches:
            for part, block, rows in rows_of(batch):
                for i in range(0, len(rows), 1000):
                    some = rows.slice(i, 1000)
                    sets = shingle_sets(*utf8(column(some, text_col)))
                    sig, h1, h2 = signatures(sets)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, block), pa.int32()), pa.array(np.arange(i, i + n), pa.int32()), column(some, id_col).cast(pa.int64()),
                        pa.array(np.diff(sets.offsets), pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()),
                    ], names=["part", "block", "at", "doc_id", "n_shingles", "h1", "h2", "sig"])

    signed = stored(blocks.mapInArrow(sign, "part int, block int, at int, doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "dup-signed")
    place = F.struct("part", "block", "at")
    classes = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "dup-classes")
    groups = candidate_groups(classes)
    groups = stored(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "dup-groups")
    members = stored(classes.select("node", "place.*", F.col("n").alias("size")).join(groups, "node"), "dup-members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.sum("size") / CELL_SHINGLES), F.ceil(F.count(F.lit(1)) / CELL_SETS)).cast("int").alias("n_cells"))
    members = members.join(stored(sizes, "dup-sizes"), "root").withColumnRenamed("root", "grp").withColumn("lead", F.col("grp"))

    def send(m: DataFrame) -> DataFrame:
        side = _by_part(m.select("part", "block", "at", "grp", "node", "cells"), blocks, "dup-places")

        @lean
        def gather(batches):
            for batch in batches:
                for part, block, rows in rows_of(batch):
                    wanted = sorted(_beside(side, part, block), key=lambda r: r["at"])
                    for k in range(0, len(wanted), 500):
                        some = wanted[k : k + 500]
                        sets = shingle_sets(*utf8(column(rows, text_col).take(pa.array([r["at"] for r in some]))))
                        out: list[tuple] = []
                        held = 0
                        for x, r in enumerate(some):
                            raw = sets.values[sets.offsets[x] : sets.offsets[x + 1]].tobytes()
                            for c in r["cells"]:
                                out.append((r["grp"], c["i"], c["j"], c["side"], r["node"], raw))
                                held += len(raw)
                                if held > 4 << 20:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                                    out, held = [], 0
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        names = ["grp", "i", "j", "side", "node", "payload"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return blocks.mapInArrow(gather, "grp long, i int, j int, side int, node long, payload binary")

    roots = connected(members, send, _similar(similarity))
    c = classes.select("h1", "h2", "node").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    rows = stored(signed.drop("sig").join(c, ["h1", "h2"], "left").drop("h1", "h2"), "dup-rows")  # equal hashes of empty sets have no class
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", place.alias("place"))
    # Stored, so that the join has shuffles of its own, which Spark can split where a group is large.
    least = stored(rows.filter("root is not null").groupBy("root").agg(F.min(first).alias("first")), "dup-least")
    rows = rows.join(least, "root", "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    rows = rows.select("part", "block", "at", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), (alone | (place == F.col("first.place"))).alias("leads"))
    return blocks, rows


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id."""
    blocks, rows = near_duplicates(docs, id_col, text_col, similarity)
    path = _by_part(rows.filter(~F.col("leads")).select("part", "block", "at"), blocks, "dup-dropped")

    @lean
    def keep(batches):
        for batch in batches:
            for part, block, rows in rows_of(batch):
                ok = np.ones(len(rows), bool)
                ok[[r["at"] for r in _beside(path, part, block)]] = False
                yield rows.filter(pa.array(ok))

    return blocks.mapInArrow(keep, docs.schema)
