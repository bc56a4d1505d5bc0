"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one node. A tree halves a bounded sample of nodes again and again at the median of a random projection;
what lies near the cut goes to both sides, so that neighbours across a cut still meet. All nodes descend all trees and are
compared within leaves by cosine in double precision; what verifies is united. A pair that meets in several leaves is
counted in the first of them only, so links are counted without writing pairs down. Leaves below one inner node go to a task
together, as a node lies in many more leaves than such buckets.

A worker holds a bounded piece of what it makes of its rows: products of vectors, copies for buckets, pairs that link.

Dense groups need no comparisons. Nodes within half the linking angle of a sampled pivot all link with each other; such
balls are kept when they are large. A node links with all of a ball, or none, when its angle to the pivot says so for
every member; only the nodes in between are compared with members.

Groups of near copies that spread further have wide balls of up to the linking angle, around pivots chosen until none has
many other nodes left within that angle. Members are compared with each other and with the nodes in between, slice by
slice in tasks of their own, so all links of a node in a ball are found. The forest holds the nodes outside balls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import stored

TREES = 6
SPILL = 0.12  # share of a node's sample, on either side of a cut, that goes to both sides
LEAF = 384  # nodes of the most frequent label in a leaf
SAMPLE = 30_000  # nodes that the trees are fitted on
PIVOTS = 2048  # sampled nodes that balls form around
LEAST_BALL = 64  # nodes in a ball, or left within the linking angle of a pivot that becomes the centre of a wide one
BLOCK = 1024  # least nodes in a slice of a ball; slices grow from 64 of them on
BUCKET = 16_384  # nodes of the most frequent label in the leaves that are compared together, as the sample has it
CELLS = 1 << 21  # numbers in a product of vectors
ROWS = 4096  # rows handed on at once


def _unit(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(label: str | None, values: pa.Scalar) -> np.ndarray | None:
    """The components of a vector that may link."""
    if label is None or not values.is_valid or values.values.null_count:
        return None
    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All vectors as bytes, with a hash over label and components as their node; no node where a vector cannot link."""
    for batch in batches:
        dims, vectors, nodes = [], [], []
        labels = batch.column("label")
        for label, values in zip(labels.to_pylist(), batch.column("embedding"), strict=True):
            x = _usable(label, values)
            dims.append(None if x is None else len(x))
            vectors.append(None if x is None else x.tobytes())
            nodes.append(None if x is None else int(np.uint64(xxhash.xxh3_64_intdigest(label.encode() + b"\0" + vectors[-1])).astype(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), labels, pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(nodes, pa.int64())],
            ["vec_id", "label", "dim", "v", "node"],
        )


def _products(rows: list[bytes], dim: int, p: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The cosines of vectors and unit vectors ``p``, a piece of the rows at a time."""
    step = max(1, CELLS // max(1, len(p)))
    for at in range(0, len(rows), step):
        yield slice(at, at + step), _unit(rows[at : at + step], dim) @ p.T


def _near_pivots(pivots: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], half: float):
    """Adds to nodes the pivot (a number, or -1) within ``half`` that is nearest, and the angle to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["ball"], frame["angle"] = np.int32(-1), 0.0
            for key, rows in frame.groupby(["label", "dim"]).indices.items():
                if key in pivots:
                    numbers, p = pivots[key]
                    for piece, cosines in _products(frame["v"].iloc[rows].tolist(), key[1], p):
                        angles = np.arccos(np.clip(cosines, -1, 1))
                        best = angles.argmin(axis=1)
                        least = angles[np.arange(len(best)), best]
                        frame.iloc[rows[piece], frame.columns.get_loc("ball")] = np.where(least <= half, numbers[best], -1).astype(np.int32)
                        frame.iloc[rows[piece], frame.columns.get_loc("angle")] = least
            yield frame[["node", "label", "dim", "v", "m", "ball", "angle"]]

    return run


def _against_balls(balls: pd.DataFrame, pivots: dict, whole: float):
    """Nodes against kept balls that come before their own: (node, m, v, ball, all) where some or all members may link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for key, rows in frame.groupby(["label", "dim"]).indices.items():
                if key not in pivots:
                    continue
                numbers, p = pivots[key]
                own = balls[balls["ball"].isin(numbers)]
                if not len(own):
                    continue
                p = p[np.searchsorted(numbers, own["ball"].to_numpy())]
                radius, ball, own_ball = own["radius"].to_numpy(), own["ball"].to_numpy(), frame["ball"].to_numpy()[rows]
                for piece, cosines in _products(frame["v"].iloc[rows].tolist(), key[1], p):
                    angles, mine = np.arccos(np.clip(cosines, -1, 1)), own_ball[piece]
                    may = (angles - radius <= whole + 1e-9) & ((mine[:, None] < 0) | (ball[None, :] < mine[:, None]))
                    met = np.nonzero(may)
                    for at in range(0, len(met[0]), ROWS):
                        i, j = met[0][at : at + ROWS], met[1][at : at + ROWS]
                        surely = angles[i, j] + radius[j] <= whole - 1e-9
                        some = frame.iloc[rows[piece][i]]
                        yield pd.DataFrame({"node": some["node"].to_numpy(), "m": some["m"].to_numpy(), "v": some["v"].to_numpy(), "ball": ball[j], "surely": surely})

    return run


def _left(pivots: dict, leaders: set[int], cosine: float):
    """Per pivot, the nodes that link with it and with none of ``leaders``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for key, rows in frame.groupby(["label", "dim"]).indices.items():
                if key in pivots:
                    numbers, p = pivots[key]
                    led, n = np.array([n in leaders for n in numbers.tolist()]), np.zeros(len(numbers), np.int64)
                    for _, cosines in _products(frame["v"].iloc[rows].tolist(), key[1], p):
                        near = cosines >= cosine
                        n += near[~near[:, led].any(axis=1)].sum(axis=0)
                    yield pd.DataFrame({"ball": numbers, "n": n})

    return run


def _spread_out(pivots: dict, counts: dict[int, int], cosine: float) -> set[int]:
    """Pivots with many nodes left, those with most first, none of which links with another."""
    chosen: set[int] = set()
    for numbers, p in pivots.values():
        taken: list[int] = []
        for i in sorted(range(len(numbers)), key=lambda i: -counts.get(int(numbers[i]), 0)):
            if counts.get(int(numbers[i]), 0) < LEAST_BALL:
                break
            if not taken or (p[taken] @ p[i]).max() < cosine:
                taken.append(i)
        chosen |= set(numbers[taken].tolist())
    return chosen


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first place of each place's component, when ``i`` and ``j`` are linked as well."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while ((up := root[root]) != root).any():
            root = up


def _met(least: float):
    """One slice of a ball's members (kind 0) against another, or against nodes that may link with some of them (kind 1), or itself."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        itself = frame["one"].iloc[0] == frame["other"].iloc[0]
        members, others = frame[frame["kind"] == 0], frame[frame["kind"] == 1]
        n, more = len(members), 0 if itself else len(others)
        if not n or not (itself or more):
            return pd.DataFrame({"a": [], "links": [], "b": []}).astype("int64")
        if itself:
            others = members
        dim = len(members["v"].iloc[0]) // 8
        x, m = _unit(members["v"].tolist(), dim), members["m"].to_numpy()
        root, gain, place = np.arange(n + more), np.zeros(n + more, np.int64), 0 if itself else n
        step = max(1, CELLS // n)
        for at in range(0, len(others), step):
            some = others.iloc[at : at + step]
            near = _unit(some["v"].tolist(), dim) @ x.T >= least
            own = place + at + np.arange(len(some))
            if itself:
                near[np.arange(len(some)), own] = False
            else:
                gain[:n] += some["m"].to_numpy() @ near
            gain[own] += near @ m
            found = near.any(axis=1)
            root = _united(root, own[found], near.argmax(axis=1)[found])
            i, j = np.nonzero(near & (root[own][:, None] != root[:n]))
            root = _united(root, own[i], j)
        nodes = members["node"].to_numpy() if itself else np.concatenate([members["node"], others["node"]])
        return pd.DataFrame({"a": nodes, "links": gain, "b": nodes[root]})[gain > 0]

    return run


def fit(x: np.ndarray, depth: int, seed: int, spill: float = SPILL) -> list:
    """A tree over sample ``x``: (direction, low, high, left, right) per inner node, None for a leaf.

    Projections of at least ``low`` go right and those of at most ``high`` left: between the two, both.
    """
    if depth == 0 or len(x) < 8:
        return None
    rng = np.random.default_rng(seed)
    direction = rng.standard_normal(x.shape[1])
    at = x @ (direction / np.linalg.norm(direction))
    low, high = np.quantile(at, [0.5 - spill, 0.5 + spill])
    left, right = x[at <= high], x[at >= low]
    if len(left) == len(x) or len(right) == len(x):
        return None
    return [direction / np.linalg.norm(direction), low, high, fit(left, depth - 1, 2 * seed + 1, spill), fit(right, depth - 1, 2 * seed + 2, spill)]


def leaves(tree: list | None, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaf numbers) of all leaves that rows of ``x`` fall into."""
    out, todo, number = [], [(tree, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        if node is None:
            out.append((rows, np.full(len(rows), number)))
            number += 1
            continue
        at = x[rows] @ node[0]
        todo += [(node[3], rows[at <= node[2]]), (node[4], rows[at >= node[1]])]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def buckets(tree: list | None, x: np.ndarray, kinds: np.ndarray, most: float) -> np.ndarray:
    """For each leaf number the number of its bucket: the widest part of the tree around it in which no kind has more than
    ``most`` rows of the sample ``x``, or the leaf alone."""
    out, todo, number = [], [(tree, np.arange(len(x)), None)], 0
    while todo:
        node, rows, bucket = todo.pop()
        if bucket is None and (node is None or np.bincount(kinds[rows], minlength=1).max() <= most):
            bucket, number, rows = number, number + 1, rows[:0]
        if node is None:
            out.append(bucket)
            continue
        at = x[rows] @ node[0]
        todo += [(node[3], rows[at <= node[2]], bucket), (node[4], rows[at >= node[1]], bucket)]
    return np.array(out)


def _descended(trees: dict[int, list]):
    """One row per node and bucket, with the node's leaves up to the last of the bucket; ``own`` of them are in the bucket.

    ``trees`` has pairs of a tree and its buckets. Leaves and buckets are numbered through all trees.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, rows in frame.groupby("dim").indices.items():
                some = frame.iloc[rows]
                x = _unit(some["v"].tolist(), int(dim))
                grown = trees.get(int(dim), [(None, np.zeros(1, np.int64))])
                first = np.cumsum([0] + [len(of) for _, of in grown])
                of = np.concatenate([own + at for (_, own), at in zip(grown, first, strict=False)])
                found = [leaves(tree, x) for tree, _ in grown]
                row = np.concatenate([r for r, _ in found])
                leaf = np.concatenate([number + at for (_, number), at in zip(found, first, strict=False)]).astype(np.int32)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                starts, bucket = np.searchsorted(row, np.arange(len(x))), of[leaf]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                ends = np.append(new[1:], len(row))
                for at in range(0, len(new), ROWS):
                    begin, end = new[at : at + ROWS], ends[at : at + ROWS]
                    out = some.iloc[row[begin]][["label", "dim", "node", "m", "v"]].copy()
                    out["bucket"], out["own"] = bucket[begin], (end - begin).astype(np.int32)
                    out["leaves"] = [leaf[a:b].tobytes() for a, b in zip(starts[row[begin]], end, strict=True)]
                    yield out

    return run


def _met_before(lists: list[np.ndarray], leaf: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the ascending lists ``i`` and ``j`` have a value below ``leaf`` in common, for each pair of them."""
    seen = np.zeros(len(lists), np.int64)
    seen[i] = seen[j] = 1
    place, used = np.cumsum(seen) - 1, np.flatnonzero(seen)
    i, j = place[i], place[j]
    lists = [lists[u][: np.searchsorted(lists[u], leaf)] for u in used.tolist()]
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # places of values that two lists or more have
    kept = times[column] > 1
    owner, column = np.repeat(np.arange(len(used)), [len(x) for x in lists])[kept], shared[column[kept]]
    met, words = np.zeros(len(i), bool), max(1, CELLS // len(used))
    for low in range(0, int(column.max(initial=-1)) + 1, 64 * words):
        now = (column >= low) & (column < low + 64 * words)
        at = column[now] - low
        bits = np.zeros((len(used), int(at.max(initial=0)) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (owner[now], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        step = max(1, CELLS // bits.shape[1])
        for begin in range(0, len(i), step):
            piece = slice(begin, begin + step)
            met[piece] |= (bits[i[piece]] & bits[j[piece]]).any(axis=1)
    return met


def _compared(least: float):
    """Links within the leaves of a bucket, without the pairs that met in an earlier leaf; b: the smallest node reachable there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        n = len(frame)
        x, m, nodes = _unit(frame["v"].tolist(), int(frame["dim"].iloc[0])), frame["m"].to_numpy(), frame["node"].to_numpy()
        lists, own = [np.frombuffer(b, np.int32) for b in frame["leaves"]], frame["own"].to_numpy()
        leaf, member = np.concatenate([a[-k:] for a, k in zip(lists, own, strict=True)]), np.repeat(np.arange(n), own)
        order = np.argsort(leaf, kind="stable")
        leaf, member = leaf[order], member[order]
        root, gain = np.arange(n), np.zeros(n, np.int64)
        for at in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            members, number = member[at], leaf[at[0]]
            y, step = x[members], max(1, CELLS // 8 // len(members))  # all may link
            for begin in range(0, len(members), step):
                i, j = np.nonzero(y[begin : begin + step] @ y[begin:].T >= least)
                i, j = members[begin + i[i < j]], members[begin + j[i < j]]
                if not len(i):
                    continue
                met = _met_before(lists, number, i, j)
                np.add.at(gain, i[~met], m[j[~met]])
                np.add.at(gain, j[~met], m[i[~met]])
                root = _united(root, i, j)
        kept = (gain > 0) | (root != np.arange(n))
        return pd.DataFrame({"a": nodes[kept], "links": gain[kept], "b": nodes[root[kept]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors with equal labels (not null) and equal length link from ``cosine`` on. Those that are null, empty, zero or
    hold null or non-finite components link with nothing. A vector with a null id takes part; if its whole component has
    no id, its component_id is null, and ``kept`` is null where vec_id is.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = stored(vectors.mapInArrow(_nodes, "vec_id long, label string, dim int, v binary, node long"), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("v").alias("v"), F.count("*").alias("m"))
    nodes = stored(nodes, "nodes")
    whole, result = float(np.arccos(cosine)), "a long, links long, b long"

    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).select("label", "dim", "v").toPandas()
    centres: dict = {}
    for key, at in drawn.groupby(["label", "dim"]).indices.items():
        centres[key[0], int(key[1])] = (at.astype(np.int32), _unit(drawn["v"].iloc[at].tolist(), int(key[1])))
    schema = "node long, label string, dim int, v binary, m long, ball int, angle double"
    near = stored(nodes.select("node", "label", "dim", "v", "m").mapInPandas(_near_pivots(centres, whole / 2), schema), "near")
    # At most as many balls as pivots, and as many wide ones.
    ends = [F.count("*").alias("nodes"), F.sum("m").alias("m"), F.max("angle").alias("radius"), F.min("node").alias("head")]
    kept = near.where("ball >= 0").groupBy("ball").agg(*ends).where(F.col("nodes") >= LEAST_BALL).toPandas()
    tight = F.broadcast(spark.createDataFrame(kept[["ball"]], "ball int"))
    inside = near.join(tight, "ball", "left_semi").select("node", "label", "dim", "v", "m", "ball")
    sparse = near.join(tight, "ball", "left_anti").select("node", "label", "dim", "v", "m")

    leaders: set[int] = set()
    while True:
        counts = sparse.mapInPandas(_left(centres, leaders, cosine), "ball int, n long").groupBy("ball").agg(F.sum("n").alias("n"))
        counts = {r.ball: r.n for r in counts.where(F.col("n") >= LEAST_BALL).collect() if r.ball not in leaders}
        if not counts:
            break
        leaders |= _spread_out(centres, counts, cosine)
    if leaders:
        wide: dict = {}
        for key, (numbers, p) in centres.items():
            own = np.isin(numbers, list(leaders))
            if own.any():
                wide[key] = (numbers[own] + np.int32(pivots), p[own])
                centres[key] = (np.concatenate([numbers, wide[key][0]]), np.concatenate([p, p[own]]))
        # A pivot links with what is at the angle, whichever way that is rounded.
        around = stored(sparse.mapInPandas(_near_pivots(wide, whole + 1e-9), schema), "wide")
        kept = pd.concat([kept, around.where("ball >= 0").groupBy("ball").agg(*ends).toPandas()])
        inside = inside.unionByName(around.where("ball >= 0").select("node", "label", "dim", "v", "m", "ball"))
        sparse = around.where("ball < 0").select("node", "label", "dim", "v", "m")

    parts = []
    if len(kept):
        kept = kept.sort_values("ball", ignore_index=True)
        frame = spark.createDataFrame(kept, "ball int, nodes long, m long, radius double, head long")
        alike = inside.join(F.broadcast(frame.where(F.col("radius") <= whole / 2).selectExpr("ball", "m AS ball_m", "head")), "ball")
        parts.append(alike.selectExpr("node AS a", "ball_m - m AS links", "head AS b"))
        own = inside.unionByName(sparse.withColumn("ball", F.lit(-1)))
        asked = stored(own.mapInPandas(_against_balls(kept, centres, whole), "node long, m long, v binary, ball int, surely boolean"), "asked")
        sure = asked.where("surely").select("node", "m", "ball")
        heads = F.broadcast(frame.selectExpr("ball", "m AS ball_m", "head"))
        parts.append(sure.join(heads, "ball").selectExpr("node AS a", "ball_m AS links", "head AS b"))
        to_all = sure.groupBy("ball").agg(F.sum("m").alias("links"))
        parts.append(inside.join(to_all, "ball").join(heads, "ball").selectExpr("node AS a", "links", "head AS b"))
        # Slices of members, each against itself and later ones where the ball is wide, and against all nodes in between.
        met = kept.merge(asked.where("NOT surely").groupBy("ball").count().toPandas(), "left", "ball").fillna({"count": 0})
        cut = lambda n: np.ceil(n / np.clip(n / 64, BLOCK, 16 * BLOCK)).astype(int)
        met = pd.DataFrame({"ball": met["ball"], "slices": cut(met["nodes"]), "beyond": cut(met["count"]), "wide": met["radius"] > whole / 2})
        met = F.broadcast(spark.createDataFrame(met, "ball int, slices int, beyond int, wide boolean"))
        dealt = lambda df, n: df.join(met, "ball").withColumn("at", F.pmod(F.xxhash64("node"), F.expr(n)).cast("int"))
        pair = lambda df, one, other, kind: df.selectExpr("ball", one, other, "node", "m", "v", f"{kind} AS kind")
        members = dealt(inside, "slices")
        first = members.withColumn("first", F.expr("IF(wide, at, slices)")).where("first < slices + beyond")
        second = members.where("wide AND at > 0")
        between = dealt(asked.where("NOT surely"), "beyond")
        pairs = pair(first, "at AS one", "explode(sequence(first, slices + beyond - 1)) AS other", 0)
        pairs = pairs.unionByName(pair(second, "explode(sequence(0, at - 1)) AS one", "at AS other", 1))
        pairs = pairs.unionByName(pair(between, "explode(sequence(0, slices - 1)) AS one", "slices + at AS other", 1))
        parts.append(pairs.groupBy("ball", "one", "other").applyInPandas(_met(cosine), result))

    left = sparse.groupBy("label", "dim").count().agg(F.max("count").alias("most"), F.sum("count").alias("nodes")).first()
    depth = max(0, int(np.ceil(np.log2(max(1, left.most or 0) / LEAF) / np.log2(2 / (1 + 2 * SPILL)))))
    drawn = sparse.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).select("label", "dim", "v").toPandas()
    forest = {}
    for dim, at in drawn.groupby("dim").indices.items():
        x, kinds = _unit(drawn["v"].iloc[at].tolist(), int(dim)), pd.factorize(drawn["label"].iloc[at])[0]
        grown = [fit(x, depth, 1_000_003 * (t + 1)) for t in range(trees if depth else 1)]
        forest[int(dim)] = [(tree, buckets(tree, x, kinds, BUCKET * len(drawn) / left.nodes)) for tree in grown]
    fallen = sparse.mapInPandas(_descended(forest), "label string, dim int, node long, m long, v binary, bucket long, own int, leaves binary")
    parts.append(fallen.groupBy("label", "dim", "bucket").applyInPandas(_compared(cosine), result))

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = stored(found, "links")
    united = components(found.select("a", "b"), "vectors-united")
    smallest = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("m"), F.min("vec_id").alias("vec_id"))
    smallest = smallest.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = smallest.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    sums = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    answer = smallest.join(first, "component").join(sums, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")
    )
    linked = rows.select("vec_id", "node").join(answer, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))
