"""Embedding near-dedup: exact threshold pairs by a dual traversal of cover trees.

Unit vectors are compared by chord distance d, where cosine = 1 - d^2 / 2. Each label has a tree
of nested nodes with a centre and a covering radius, which is measured, so bounds are exact. A
pair of nodes is dropped when their centres are farther apart than the threshold distance and
both radii.

The upper levels are tables. A node with too many vectors is divided among centres picked
farthest-first from a bounded sample of it, and the node pairs of a level are joined to their
children and pruned. Outliers can take all centres level after level, so below `BY_CENTRE` levels a
node keeps one centre and is divided by hash. A leaf never has more than `LEAF` vectors or `LEAF_BYTES`: a
task carries the tree on with halving radii, as far as nodes hold several vectors each, and descends both sides
at once, a block of nodes against all that may be near it. Cosines of a block are one matrix product in single
precision; what its rounding leaves open is decided in double precision. What a task returns is, for each vector,
how many links it found, and a spanning forest of them, so no group is written out as pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import mixed, settled
from scoreloom.llm.components import connected_components

THRESHOLD = 0.98
# A vector is sent once for each leaf its own is compared with, so few large leaves move the least.
LEAF = 32_768
# Of a leaf's vectors in double precision.
LEAF_BYTES = 32 << 20
FAN = 32
SAMPLE = 512
# Above what rounding adds to the distance of two vectors that are nearly equal.
SLACK = 1e-6
# Levels divided among centres; where that left a node too large, the next ones divide it by hash.
BY_CENTRE = 8
# Node numbers of this many levels fit 64 bits.
DEEPEST = 11
# Tasks for pairs of leaves; a task takes several pairs beyond that.
TASKS = 20_000

_POINT = "label string, node long, id long, copies long, vec binary"

# Vectors that fit a leaf, by the length in the label.
_ROOM = "greatest(2, least({}, {} div (8 * cast(substring_index(label, '/', -1) as long))))"


def usable(vectors: DataFrame) -> DataFrame:
    """(label, id, copies, vec) for every distinct usable vector of a label, and its members' class.

    label includes the vector's length, as vectors of different lengths have no cosine. Components
    keep single precision where they come in it.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    named = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return named.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(
        finite
    ).select(
        F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("label"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )


def _units(blobs, kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    # Scaled first, so that huge and tiny components keep their squares.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _parts(size: int, room: int) -> int:
    """Children of a node that is too large."""
    return int(min(FAN, max(2, -(-2 * size // room))))


def _centres(kind: type):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        """Farthest-first centres of a node's sample; a node that does not spread gets one."""
        x = _units(group["vec"], kind)
        wanted = _parts(group["size"].iloc[0], group["room"].iloc[0])
        picked = [0]
        near = _distances(x, x[:1])[:, 0]
        while len(picked) < wanted and near.max() > 1e-6:
            picked.append(int(near.argmax()))
            near = np.minimum(near, _distances(x, x[picked[-1:]])[:, 0])
        first = group.iloc[:1]
        return first[["label", "node", "size", "room"]].assign(centres=[[x[k].tobytes() for k in picked]])

    return work


def _assign(kind: type):
    def work(batches):
        """Each vector to its nearest centre; where there is but one centre, by hash into equal parts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.select(["label", "node", "id", "copies", "vec", "size", "room"]).to_pandas()
            centres = batch.column("centres")
            child, far = np.zeros(len(frame), np.int64), np.zeros(len(frame))
            for (_, node), rows in frame.groupby(["label", "node"]).indices.items():
                c = np.stack([np.frombuffer(v) for v in centres[int(rows[0])].as_py()])
                d = _distances(_units(frame["vec"].iloc[rows], kind), c)
                at = d.argmin(axis=1)
                far[rows] = d[np.arange(len(rows)), at]
                if len(c) == 1:
                    parts = _parts(frame["size"].iloc[rows[0]], frame["room"].iloc[rows[0]])
                    ids = frame["id"].to_numpy(np.int64)[rows].view(np.uint64)
                    at = (mixed(ids, int(node)) % np.uint64(parts)).astype(np.int64)
                child[rows] = at
            placed = frame[["label", "id", "copies", "vec"]].assign(node=frame["node"] * FAN + child + 1, far=far)
            yield pa.RecordBatch.from_pandas(placed[["label", "node", "id", "copies", "vec", "far"]], preserve_index=False)

    return work


def _near(pairs: DataFrame, reach: float) -> DataFrame:
    """Node pairs whose members may lie within reach."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series, radii: pd.Series) -> pd.Series:
        out = [
            r > 4 or float(np.sqrt(((np.frombuffer(p) - np.frombuffer(q)) ** 2).sum())) <= r + reach
            for p, q, r in zip(a, b, radii)
        ]
        return pd.Series(out, dtype=bool)

    return pairs.where(close("a_centre", "b_centre", F.col("a_radius") + F.col("b_radius")))


# Rows and columns of the matrices of cosines inside a task.
_ROWS, _COLS = 128, 4096
# A node is divided if its children hold so many vectors on average; below that, comparing vectors is cheaper.
CROWD = 8


def _net(v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres within about rho of all vectors, and the centre of each; None if they hold under CROWD on average."""
    near = 1 - rho * rho / 2
    owner, centres, left = np.full(len(v), -1, np.int64), np.empty(0, np.int64), np.arange(len(v))
    while len(left):
        some, left = left[:_ROWS], left[_ROWS:]
        dots = v[some] @ v[some].T
        free, picked = np.ones(len(some), bool), []
        for at in range(len(some)):
            if free[at]:
                mine = free & (dots[at] >= near)
                mine[at] = True
                owner[some[mine]] = len(centres) + len(picked)
                free &= ~mine
                picked.append(at)
        for k in range(0, len(left), _COLS):
            part = left[k : k + _COLS]
            dots = v[part] @ v[some[picked]].T
            best = dots.argmax(axis=1)
            got = dots[np.arange(len(part)), best] >= near
            owner[part[got]] = len(centres) + best[got]
        centres = np.concatenate([centres, some[picked]])
        left = left[owner[left] < 0]
        # Centres found early have the most vectors.
        if len(v) - len(left) < CROWD * len(centres):
            return None
    return centres, owner


def _levels(x: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nested nodes of a leaf's vectors, radii halving: (centre, radius, parent) per level, members last.

    The children of a node stand together, in the order of the nodes. A radius that no node exceeds makes
    no level, and a node that does not divide well stays as it is down to its members.
    """
    n, single = len(x), x.astype(np.float32)

    def radii(centre: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
        away = x[order] - x[np.repeat(centre, sizes)]
        return np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), np.cumsum(sizes) - sizes))

    order, sizes, centre = np.arange(n), np.array([n]), np.array([0])
    levels = [(centre, radii(centre, sizes, order), np.array([0]))]
    whole, rho = np.zeros(1, bool), 1.0
    while rho > reach / 4:
        ends, pieces, found = np.cumsum(sizes), [], False
        large = (levels[-1][1] > rho) & ~whole
        for k in range(len(sizes)):
            members = order[ends[k] - sizes[k] : ends[k]]
            net = _net(single[members], rho) if large[k] else None
            if net is None:
                pieces.append((centre[k : k + 1], sizes[k : k + 1], members, [k], [whole[k] or large[k]]))
                continue
            at, owner = net
            pieces.append((members[at], np.bincount(owner), members[np.argsort(owner, kind="stable")], [k] * len(at), [False] * len(at)))
            found = True
        centre, sizes, order, parents, whole = (np.concatenate(p) for p in zip(*pieces))
        if found:
            levels.append((centre, radii(centre, sizes, order), parents))
        rho /= 2
    levels.append((order, np.zeros(n), np.repeat(np.arange(len(sizes)), sizes)))
    return levels


def _descend(a: np.ndarray, b: np.ndarray, same: bool, threshold: float):
    """Links between two leaves: vectors of each side that link, in pieces (i, j arrays)."""
    reach = float(np.sqrt(2 - 2 * threshold))
    # Twice what rounding can change in a cosine taken in single precision.
    slack = (a.shape[1] + 8) * 2.0**-23
    la = _levels(a, reach)
    lb = la if same else _levels(b, reach)
    depth = max(len(la), len(lb))
    # The shallower tree waits at its last level but one.
    la = la[:-1] + [(la[-2][0], la[-2][1], np.arange(len(la[-2][0])))] * (depth - len(la)) + la[-1:]
    lb = lb[:-1] + [(lb[-2][0], lb[-2][1], np.arange(len(lb[-2][0])))] * (depth - len(lb)) + lb[-1:]
    va = [a[level[0]].astype(np.float32) for level in la]
    vb = va if same else [b[level[0]].astype(np.float32) for level in lb]
    first = lambda tree, k: np.searchsorted(tree[k + 1][2], np.arange(len(tree[k][0]) + 1))
    fa = [first(la, k) for k in range(depth - 1)]
    fb = fa if same else [first(lb, k) for k in range(depth - 1)]
    stack = [(0, 0, 1, np.array([0]))]
    while stack:
        # Nodes low to high of the left tree, and the nodes of the right tree that may be near any of them.
        level, low, high, right = stack.pop()
        (ca, ra, _), (cb, rb, _) = la[level], lb[level]
        for at in range(low, high, _ROWS):
            end = min(at + _ROWS, high)
            # One tree against itself: each pair once.
            cols = right[np.searchsorted(right, at) :] if same else right
            near = []
            for k in range(0, len(cols), _COLS):
                part = cols[k : k + _COLS]
                run = part[-1] - part[0] + 1 == len(part)
                dots = va[level][at:end] @ vb[level][slice(part[0], part[-1] + 1) if run else part].T
                if level < depth - 1:
                    far = reach + SLACK + ra[at:end, None] + rb[part]
                    near.append(dots >= 1 - far * far / 2 - slack)
                    continue
                # Far faster than nonzero() of two dimensions.
                i, j = np.divmod(np.flatnonzero(dots >= threshold - slack), len(part))
                sure = dots[i, j] >= threshold + slack
                i, j = i + at, part[j]
                if same:
                    one = i < j
                    i, j, sure = i[one], j[one], sure[one]
                i, j, open_ = ca[i], cb[j], np.flatnonzero(~sure)
                sure[open_] = np.einsum("ij,ij->i", a[i[open_]], b[j[open_]]) >= threshold
                pairs = np.column_stack([i[sure], j[sure]])
                yield np.sort(pairs, axis=1) if same else pairs
            if not near:
                continue
            near, bound = np.concatenate(near, axis=1), fa[level]
            while at < end:
                # Nodes of a block's rows below, one at least.
                stop = min(end, max(at + 1, int(np.searchsorted(bound, bound[at] + _ROWS, "right")) - 1))
                kept = cols[near[at - end : stop - end if stop < end else None].any(axis=0)]
                if len(kept):
                    each = fb[level][kept + 1] - fb[level][kept]
                    below = np.repeat(fb[level][kept] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    stack.append((level + 1, int(bound[at]), int(bound[stop]), below))
                at = stop


def _forest(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Pairs that join trees of a forest; root, the root of every node's tree, is updated."""
    kept, last = [np.empty((0, 2), np.int64)], np.empty(len(root), np.int64)
    while True:
        i, j = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = i != j
        if not apart.any():
            return np.concatenate(kept)
        pairs, high, low = pairs[apart], np.maximum(i, j)[apart], np.minimum(i, j)[apart]
        # Each root is tied to one smaller root, so no ring can close.
        last[high] = np.arange(len(high))
        tied = np.zeros(len(root), bool)
        tied[high] = True
        one = last[tied]
        root[high[one]] = low[one]
        kept.append(pairs[one])
        while (root[root] != root).any():
            root[:] = root[root]


def _links(threshold: float, kind: type):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        same = bool((group["a"] == group["b"]).iloc[0])
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if same:
            right = left
        ids = np.concatenate([left["id"], [] if same else right["id"]]).astype(np.int64)
        shift = 0 if same else len(left)
        ca, cb = left["copies"].to_numpy(np.int64), right["copies"].to_numpy(np.int64)
        count = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        edges = [np.empty((0, 2), np.int64)]
        if len(left) and len(right):
            a = _units(left["vec"], kind)
            for i, j in (p.T for p in _descend(a, a if same else _units(right["vec"], kind), same, threshold) if len(p)):
                count[: len(ca)] += np.bincount(i, cb[j], len(ca)).astype(np.int64)
                count[shift : shift + len(cb)] += np.bincount(j, ca[i], len(cb)).astype(np.int64)
                edges.append(_forest(np.column_stack([i, j + shift]), root))
        edge = np.concatenate(edges)
        counted = np.flatnonzero(count)
        return pd.DataFrame(
            {
                "id": np.concatenate([ids[counted], ids[edge[:, 0]]]),
                "n": np.concatenate([count[counted], np.zeros(len(edge), np.int64)]),
                "other": pd.array(
                    np.concatenate([ids[counted], ids[edge[:, 1]]]), "Int64"
                ),
            }
        )

    return work


def _divide(points: DataFrame, kind: type) -> tuple[DataFrame, DataFrame, int]:
    """Upper levels of the trees: vectors by leaf, all nodes with centre and radius, and the depth.

    The root of a label is node 0, with no centre and a radius that bounds everything; the
    children of node k are FAN k + 1 and so on.
    """
    placed = points
    nodes = placed.select("label").distinct().select(
        "label", F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("parent"),
        F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("radius"),
    )
    levels = [nodes]
    while True:
        sizes = placed.groupBy("label", "node").agg(F.count(F.lit(1)).alias("size"))
        large = settled(sizes.withColumn("room", F.expr(_ROOM.format(LEAF, LEAF_BYTES))).where("size > room"))
        if large.isEmpty():
            break
        if len(levels) > DEEPEST:
            raise RuntimeError(f"vectors too many for {DEEPEST} levels of {FAN} children")
        wanted = SAMPLE if len(levels) <= BY_CENTRE else 1
        some = Window.partitionBy("label", "node").orderBy(F.xxhash64("id"), "id")
        open_ = placed.join(F.broadcast(large), ["label", "node"])
        sample = open_.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= wanted)
        centres = settled(
            sample.select("label", "node", "size", "room", "vec")
            .groupBy("label", "node")
            .applyInPandas(_centres(kind), "label string, node long, size long, room long, centres array<binary>")
        )
        moved = settled(placed.join(centres, ["label", "node"]).mapInArrow(_assign(kind), f"{_POINT}, far double"))
        # The numbers of a node's children follow from its own.
        children = moved.groupBy("label", "node").agg((F.max("far") + SLACK).alias("radius"))
        children = children.withColumn("parent", F.expr(f"(node - 1) div {FAN}"))
        levels.append(
            children.join(centres.withColumnRenamed("node", "parent"), ["label", "parent"]).select(
                "label", "node", "parent",
                F.expr(f"centres[if(size(centres) = 1, 0, cast((node - 1) % {FAN} as int))]").alias("centre"), "radius",
            )
        )
        placed = placed.join(F.broadcast(large), ["label", "node"], "left_anti").unionByName(moved.drop("far"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return placed, settled(nodes), len(levels) - 1


def _leaf_pairs(nodes: DataFrame, depth: int, reach: float) -> DataFrame:
    """(label, a, b) of leaves that may hold linked vectors, a <= b: from the roots down, a level at a time."""
    child = nodes.where("parent >= 0")
    inner = child.select("label", F.col("parent").alias("node")).distinct()
    # A leaf stands for itself on the levels below it.
    waits = nodes.join(inner, ["label", "node"], "left_anti").withColumn("parent", F.col("node"))
    below = settled(child.unionByName(waits))
    frontier = nodes.where("node = 0").select("label", F.col("node").alias("a"), F.col("node").alias("b"))
    for _ in range(depth):
        side = lambda s: below.select(
            "label", F.col("parent").alias(s), F.col("node").alias(f"{s}_node"),
            F.col("centre").alias(f"{s}_centre"), F.col("radius").alias(f"{s}_radius"),
        )
        joined = frontier.join(side("a"), ["label", "a"]).join(side("b"), ["label", "b"])
        pairs = joined.where("a <> b OR a_node <= b_node")
        kept = _near(pairs.where("a_node <> b_node"), reach).unionByName(pairs.where("a_node = b_node"))
        frontier = settled(
            kept.select("label", F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        )
    return frontier


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors has vec_id, label and embedding. Only vectors of one label (not null) and one length
    are compared, by cosine in double precision. Null, empty and zero vectors, and such with
    null or non-finite components, link with nothing: no links, a component of their own; so do rows without vec_id. Equal
    vectors are one point of the trees with a number of copies; each copy links with the others.
    Rows that repeat a vec_id count as vectors of their own but get one row each with the links
    of all their vectors. An empty table gives no rows; other columns are not read.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    sound = usable(vectors)
    classes = settled(
        sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )

    kind = np.float32 if classes.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64

    def pack(batches):
        for batch in batches:
            vecs = batch.column(3)
            flat, bounds = vecs.flatten().to_numpy(), vecs.offsets.to_numpy().astype(np.int64)
            bounds = pa.py_buffer(((bounds - bounds[0]) * flat.itemsize).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, bounds, pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(1), batch.column(2), packed],
                names=["label", "node", "id", "copies", "vec"],
            )

    points = settled(classes.select("label", "id", "copies", "embedding").mapInArrow(pack, _POINT))
    placed, nodes, depth = _divide(points, kind)
    pairs = settled(_leaf_pairs(nodes, depth, reach))
    first = pairs.join(placed.withColumnRenamed("node", "a"), ["label", "a"]).withColumn("side", F.lit(0))
    second = pairs.where("a <> b").join(placed.withColumnRenamed("node", "b"), ["label", "b"]).withColumn("side", F.lit(1))
    # Work grows with the product of two leaves, not with their bytes: no fewer tasks than pairs, up to a limit.
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * pairs.count(), TASKS))
    found = settled(
        first.unionByName(second)
        .select("label", "a", "b", "side", "id", "copies", "vec")
        .repartition(tasks, "label", "a", "b")
        .groupBy("label", "a", "b")
        .applyInPandas(_links(threshold, kind), "id long, n long, other long")
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    reached = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    hashed = F.xxhash64("embedding")
    known = (
        classes.join(counts, "id", "left")
        .join(reached.withColumnRenamed("node", "id"), "id", "left")
        .select(
            hashed.alias("hash"), "label", "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    # Sorted by a hash first, or whole vectors would be compared.
    members = sound.withColumn("hash", hashed).join(known, ["hash", "label", "embedding"]).groupBy(F.col("vec_id").alias("__id")).agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return named.join(members, F.col("vec_id") == F.col("__id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
