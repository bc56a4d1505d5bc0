"""Word-shingle Jaccard join with adaptive multi-match prefixes.

Every document's distinct shingles are put into one global order: frequent ones last, by their count over all documents,
the others by hash. If two sets link, each of the first ``n - ceil(t * n) + m`` shingles of both share at least m
(t: the threshold). m is chosen per document from the estimated cost of its candidates: the sum of the counts of the
prefix, plus the share of those candidates that can reach m matches, each to be verified. A pair needs the smaller m of
both. Equal sets are joined first and stand as one node.

Groups of copies are never paired out. First each shared shingle links its members to one of them, the one with fewest
rarer shingles; what verifies is united. Then only members of different components are paired, by the multi-match rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import drop, shuffles_freed, stored, width
from ledgerloom.llm.words import Words, frugal, mix, slices

FREQUENT = 16  # shingles in fewer documents are ordered by hash alone
LISTED = 1 << 20  # frequent shingles whose counts every task knows, most frequent first; bounds the broadcast to 16 MB
MOST_MATCHES = 8
VERIFY_COST = 20.0  # of verifying a candidate, in list entries
BUFFER = 1 << 20  # shingles a task holds before it combines them
SLICE = 1 << 20  # bytes of text shingled at a time
PARTS = 8  # of a task's range of hashes, counted one after the other
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each row's distinct shingles."""
    split = Words(text)
    hashes = split.hashes()[split.index]
    n = len(hashes)
    joined = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        joined += hashes[k : k + len(joined)] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    joined, out = mix(joined), []
    for a, b in zip(split.bounds[:-1].tolist(), split.bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _pieces(values: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted 40-bit values: which of equal ranges each non-empty run belongs to, and the runs' bounds."""
    owner = (values * np.uint64(ranges)) >> np.uint64(40)
    starts = np.flatnonzero(np.diff(owner, prepend=np.uint64(ranges + 1)))
    return owner[starts].astype(np.int32), np.append(starts, len(values))


def _counted(words: int, ranges: int):
    """Map side of the shingle counts: sorted distinct hashes (40 bits, byte by byte, so they compress) and counts above 1."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()
        values >>= np.uint64(24)
        values.sort()
        starts = np.flatnonzero(np.diff(values, prepend=np.uint64(1 << 41)))
        counts = np.diff(starts, append=len(values))
        values = values[starts]
        part, bounds = _pieces(values, ranges * PARTS)
        planes, more = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            planes.append(np.ascontiguousarray(values[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T).tobytes())
            often = np.flatnonzero(counts[a:b] > 1)
            more.append(np.stack([often, counts[a:b][often]]).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(planes, pa.binary()), pa.array(more, pa.binary())], ["part", "planes", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                held += shingle_sets(part.column("text"), words)
                size += sum(map(len, held[-part.num_rows :]))
                if size > BUFFER:
                    yield flush(held)
                    size = 0
                    pa.default_memory_pool().release_unused()
        if size:
            yield flush(held)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that stand in ``FREQUENT`` documents, from runs in the order of ``part``: one part is held at a time."""
    held, values, counts = None, [], []

    def flush() -> pa.RecordBatch:
        value, count = np.concatenate(values), np.concatenate(counts)
        values.clear(), counts.clear()
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        starts = np.flatnonzero(np.diff(value, prepend=np.uint64(1 << 41)))
        sums = np.add.reduceat(count, starts, dtype=np.int64)
        kept = sums >= FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(value[starts][kept].astype(np.int64)), pa.array(sums[kept])], ["value", "df"])

    for batch in batches:
        for i in range(batch.num_rows):
            part, planes, more = (batch.column(c)[i].as_py() for c in ("part", "planes", "more"))
            if part != held and values:
                yield flush()
                pa.default_memory_pool().release_unused()
            held = part
            bytes_ = np.frombuffer(planes, np.uint8).reshape(5, -1)
            value = np.zeros(bytes_.shape[1], np.uint64)
            for plane in bytes_:
                value = (value << np.uint64(8)) | plane
            count = np.ones(len(value), np.uint32)
            often = np.frombuffer(more, np.uint32).reshape(2, -1)
            count[often[0]] = often[1]
            values.append(value)
            counts.append(count)
    if values:
        yield flush()


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 40-bit hashes, counts) of the most frequent shingles over all documents, at most ``LISTED`` of them."""
    n = width(docs.sparkSession)
    found = docs.select("text").mapInArrow(frugal(_counted(words, n)), "part int, planes binary, more binary")
    found = found.repartitionById(n, F.floor(F.col("part") / PARTS).cast("int")).sortWithinPartitions("part")
    with shuffles_freed(docs.sparkSession):
        found = found.mapInArrow(frugal(_frequent), "value long, df long").orderBy(F.desc("df"), "value").limit(LISTED).toPandas()
    found = found.sort_values("value")
    return found["value"].to_numpy(np.uint64), found["df"].to_numpy(np.float64)


def _prefix(tokens: np.ndarray, values: np.ndarray, dfs: np.ndarray, percent: int) -> tuple[int, int, np.ndarray]:
    """(matches m, number of light shingles in the prefix, the prefix in global order)."""
    n = len(tokens)
    least = -(-percent * n // 100)
    df = np.zeros(n)
    if len(values):
        short = tokens >> np.uint64(24)
        at = np.minimum(np.searchsorted(values, short), len(values) - 1)
        df = np.where(values[at] == short, dfs[at], 0.0)
    light, most = int((df == 0).sum()), min(MOST_MATCHES, least)
    longest = n - least + most
    if light >= longest:
        return 1, n - least + 1, tokens[df == 0][: n - least + 1]
    order = np.argsort(df, kind="stable")[:longest]
    costs = np.cumsum(np.maximum(df[order], 1.0))
    # A set of about this size that links shares its m-th shingle within the first n - T + m: only those lists are met.
    matches = np.arange(1, most + 1)
    met = np.minimum(n - -(-2 * percent * n // (100 + percent)) + matches, longest)
    m = int(np.argmin(costs[met - 1] * (1.0 + VERIFY_COST / matches))) + 1
    return m, min(light, n - least + m), tokens[order[: n - least + m]]


# Shingles per range of hashes: the sum of the smaller counts bounds the intersection of two sets.
RANGES = 128
_PROFILE = "doc_id long, node long, n int, m int, light int, prefix binary, spread binary"


def _spread(tokens: np.ndarray) -> bytes:
    counts = np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint16 if len(tokens) < 1 << 16 else np.uint32).tobytes()


def _possible(percent: int):
    """Pairs whose counts by range allow a link."""

    def counts(column: pa.Array) -> np.ndarray:
        rows = column.to_pylist()
        if not rows:
            return np.zeros((0, RANGES), np.int64)
        return np.stack([np.frombuffer(r, np.uint16 if len(r) == 2 * RANGES else np.uint32) for r in rows]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = counts(batch.column("x")), counts(batch.column("y"))
            common = np.minimum(x, y).sum(axis=1)
            kept = 100 * common >= percent * (x.sum(axis=1) + y.sum(axis=1) - common)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _profiled(words: int, percent: int, values: np.ndarray, dfs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                sets = shingle_sets(part.column("text"), words)
                found = [_prefix(s, values, dfs, percent) if len(s) else (0, 0, s) for s in sets]
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.array(nodes, np.uint64).astype(np.int64)),
                        pa.array(np.array(list(map(len, sets)), np.int32)),
                        pa.array(np.array([f[0] for f in found], np.int32)),
                        pa.array(np.array([f[1] for f in found], np.int32)),
                        pa.array([f[2].tobytes() for f in found], pa.binary()),
                        pa.array([_spread(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "node", "n", "m", "light", "prefix", "spread"],
                )

    return run


_POSTING = "token long, node long, n int, m int, pos int"
_KINDS = (np.uint64, np.int64, np.int32, np.int32, np.int32)


def _posted(ranges: int):
    """Prefixes to lists: entries of frequent shingles as rows, those of others in blocks by range of their hash. The rows
    are dealt over the ranges by shingle and node, so the longest list goes to all of them."""

    def block(held: list[tuple]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else tuple(np.zeros(0, k) for k in _KINDS)

    def flush(light: list[tuple], heavy: list[tuple]) -> pa.RecordBatch:
        columns = block(light)
        order = np.argsort(columns[0], kind="stable")
        columns = tuple(c[order] for c in columns)
        owner, bounds = _pieces(columns[0] >> np.uint64(24), ranges)
        blocks = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows = block(heavy)
        ours, theirs = len(blocks), len(rows[0])
        dealt = (mix(rows[0] ^ rows[1].view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
        arrays = [
            pa.concat_arrays([pa.array(owner), pa.array(dealt)]),
            pa.concat_arrays([pa.array(blocks, pa.binary()), pa.nulls(theirs, pa.binary())]),
        ]
        for c, kind in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True):
            arrays.append(pa.concat_arrays([pa.nulls(ours, kind), pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kind)]))
        return pa.RecordBatch.from_arrays(arrays, ["range", "block", "token", "node", "n", "m", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light, heavy, size = [], [], 0
        for batch in batches:
            for node, n, m, few, prefix in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "m", "light", "prefix")), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                k = len(tokens)
                columns = (tokens, np.full(k, node, np.int64), np.full(k, n, np.int32), np.full(k, m, np.int32), np.arange(k, dtype=np.int32))
                light.append(tuple(c[:few] for c in columns))
                heavy.append(tuple(c[few:] for c in columns))
                size += k
                if size > BUFFER // 2:
                    yield flush(light, heavy)
                    light, heavy, size = [], [], 0
        if size:
            yield flush(light, heavy)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of shingles that stand in two prefixes at least; those of frequent ones as they come."""
    held: list[list[np.ndarray]] = [[] for _ in _KINDS]
    for batch in batches:
        rows = batch.filter(pc.is_null(batch.column("block")))
        if rows.num_rows:
            yield rows.select(["token", "node", "n", "m", "pos"])
        for block in batch.column("block").drop_null().to_pylist():
            n, at = len(block) // sum(np.dtype(k).itemsize for k in _KINDS), 0
            for column, kind in zip(held, _KINDS, strict=True):
                column.append(np.frombuffer(block, kind, n, at))
                at += column[-1].nbytes
    if held[0]:
        columns = [np.concatenate(c) for c in held]
        order = np.argsort(columns[0], kind="stable")
        token = columns[0][order]
        same = token[1:] == token[:-1]
        kept = order[np.append(same, False) | np.insert(same, 0, False)]
        arrays = [pa.array(c[kept].view(np.int64) if c.dtype == np.uint64 else c[kept]) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["token", "node", "n", "m", "pos"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                nodes = part.column("node").to_pylist()
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                # Rows of one id may have different texts: only the one whose set is the node's counts.
                own = [(v, s) for v, s in zip(nodes, sets, strict=True) if xxhash.xxh3_64_intdigest(s) == v % (1 << 64)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["node", "tokens"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", SLICE):
                kept = []
                for i, (x, y) in enumerate(zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate([a, b]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        kept.append(i)
                yield part.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _verified(pairs: DataFrame, single: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets link. Only texts of pairs that the counts by range allow are shingled again.

    The nodes wanted are a written table, so Spark knows their size when it joins them to the texts: few are broadcast.
    """
    spread = single.select("node", "spread")
    both = pairs.join(spread.selectExpr("node AS a", "spread AS x"), "a").join(spread.selectExpr("node AS b", "spread AS y"), "b")
    pairs = stored(both.select("a", "b", "x", "y").mapInArrow(frugal(_possible(percent)), "a long, b long").distinct(), "possible")
    nodes = pairs.selectExpr("explode(array(a, b)) AS node").distinct()
    wanted = stored(single.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first")), "wanted")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first"])).select("node", "text")
    # Repeated nodes go in the shuffle that the joins need anyway, when that of the texts has been freed.
    written = stored(texts.mapInArrow(frugal(_sets(words)), "node long, tokens binary"), "sets")
    sets = written.dropDuplicates(["node"])
    first = pairs.join(sets.selectExpr("node AS a", "tokens AS x"), "a")
    both = first.join(sets.selectExpr("node AS b", "tokens AS y"), "b").select("a", "b", "x", "y")
    linked = stored(both.mapInArrow(frugal(_linked(percent)), "a long, b long"), "linked")
    for done in (pairs, wanted, written):
        drop(done)
    return linked


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are stretches without ASCII white space, A-Z lower-cased; a text of fewer than ``words`` words is one shingle,
    one without words (or null) has none and links with nothing. Two documents link when
    100 * |intersection| >= percent * |union|. Shingles and sets are compared by 64-bit hashes. A row with a null
    doc_id takes part; if its whole component has no id, its component_id is null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    values, dfs = frequent_shingles(docs, words)
    profiles = stored(docs.mapInArrow(frugal(_profiled(words, percent, values, dfs)), _PROFILE), "profiles")
    classes = profiles.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # One row per node; rows repeated under one id may leave a few more, which later steps tolerate.
    single = profiles.where("n > 0").join(classes.withColumnRenamed("doc_id", "first"), "node").where("doc_id <=> first").drop("first")

    n = width(spark)
    posted = single.select("node", "n", "m", "light", "prefix").mapInArrow(frugal(_posted(n)), f"range int, block binary, {_POSTING}")
    lists = stored(posted.repartitionById(n, F.col("range")).mapInArrow(frugal(_shared), _POSTING).distinct(), "lists")

    # Stars: every entry of a list against the one with the fewest rarer shingles.
    heads = lists.groupBy("token").agg(F.count("*").alias("entries"), F.min(F.struct("pos", "n", "node")).alias("head")).where("entries > 1")
    stars = lists.join(heads, "token").where(
        f"node != head.node AND 100 * least(n, head.n) >= {percent} * greatest(n, head.n)"
    )
    stars = stored(stars.selectExpr("least(node, head.node) AS a", "greatest(node, head.node) AS b").distinct(), "stars")
    linked = _verified(stars, single, docs, words, percent)
    united = components(linked, "united")

    # Pairs between different components. T is the least intersection of a linked pair; the m-th shared shingle of the
    # smaller set stands within its first n - T + m, and so it does in the larger.
    own = lists.join(united.withColumnRenamed("component", "united"), "node", "left").withColumn("united", F.coalesce("united", "node"))
    mixed = own.groupBy("token").agg(F.min("united").alias("low"), F.max("united").alias("high")).where("low < high")
    own = own.join(mixed.select("token"), "token", "left_semi")
    t = F.expr(f"CAST(CEIL(({percent} * (CAST(n AS LONG) + n2)) / (100.0 + {percent})) AS INT)")
    small = own.where(f"pos <= n - CEIL(2.0 * {percent} * n / (100 + {percent})) + m - 1")
    large = own.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "m", "pos", "united")])
    pairs = small.join(
        large,
        (small["token"] == large["token"])
        & (F.col("united") != F.col("united2"))
        & ((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2"))))
        & (100 * F.col("n") >= percent * F.col("n2"))
        & (F.col("pos") <= F.col("n") - t + F.least("m", "m2") - 1)
        & (F.col("pos2") <= F.col("n2") - t + F.least("m", "m2") - 1),
    )
    pairs = pairs.groupBy("node", "node2").agg(F.count("*").alias("shared"), F.min(F.least("m", "m2")).alias("needed")).where("shared >= needed")
    pairs = pairs.selectExpr("least(node, node2) AS a", "greatest(node, node2) AS b").join(stars, ["a", "b"], "left_anti")
    bridges = _verified(pairs, single, docs, words, percent)
    drop(lists), drop(stars)
    links = united.selectExpr("node AS a", "component AS b").unionByName(bridges)
    final = components(links, "final")

    named = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    rows = profiles.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return rows.join(nodes, "node", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
