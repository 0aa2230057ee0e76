"""Near-duplicate groups with SetSketch registers.

Every document becomes the set of its word shingles and a SetSketch of it: register i holds the exponentially spaced,
truncated minimum floor(1 - log_b(min x)) of exponential hash values x. Registers of a union are the maxima of the parts',
and equal registers tell similar sets, so bands of registers are bucket keys. Documents with the same set form one
class; only classes go on. Pairs of classes that share a bucket are screened by the maximum-likelihood estimate of their
similarity from the registers, and what passes is confirmed on the full sets.

Pairs of a bucket are not all tried. Each class is first compared with the smallest class it meets in any bucket, then
with the smallest class of each of its buckets, and last with classes of its buckets that are still in other components.
Pairs whose classes are already connected need no comparison, so a large group costs about one comparison a member; no link
between components is left out. Components come from contracting the links until none is left.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, staged, text_or_empty, with_place

#: Registers of a sketch; fewer are too few for the estimate, more cost time. Bands take as many of them as `banding` says.
REGISTERS = 180
#: Probability that a link of exactly the threshold shares no band.
MISS = 1e-6
#: SetSketch parameters: base, rate, and the largest register value.
BASE, RATE, LIMIT = 1.02, 20.0, 4095
#: Pairs go to the full sets unless their estimate is this many standard errors below the threshold: that loses a link of exactly
#: the threshold with a probability of 2e-8.
MARGIN = 5.5
#: Further comparisons with one class of each bucket before all that are left are compared.
TURNS = 2
#: Classes of a bucket up to which all its pairs are joined; larger buckets are compared in blocks of `BLOCK`.
SMALL, BLOCK = 16, 256
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

PRIME = np.uint64(0x9E3779B97F4A7C15)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): as many registers in a band as leave the probability `MISS` with `REGISTERS` in all; one register, and
    more bands, where no number does."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    found = []
    for rows in range(REGISTERS, 0, -1):
        equal = (percent / 100) ** rows
        bands = 1 if equal == 1 else int(np.ceil(np.log(MISS) / np.log1p(-equal))) if equal > 1e-12 else REGISTERS + 1
        found.append((bands, rows))
    return next(((bands, rows) for bands, rows in found if bands * rows <= REGISTERS), found[-1])


@cache
def _sketch_hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and even offsets of `count` registers."""
    factors, offsets = (np.random.Generator(np.random.PCG64(20240501 + k)).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) for k in (0, 1))
    return factors + np.uint64(1), offsets


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """xxh3 hashes (64 bits) of the words of a text (A-Z lowered, cut at ASCII white space).

    Two given words share one with a probability of 2**-64; some pair of a million distinct words with 3e-8.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both know ASCII only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; a shorter text is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total * PRIME + words[k : len(words) - width + 1 + k])
    return np.unique(total)


def sketch(found: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of a set of hashes."""
    factors, offsets = _sketch_hashes(registers)
    most = np.zeros(registers, np.uint64)
    for start in range(0, len(found), 1024):
        np.maximum(most, (np.multiply.outer(found[start : start + 1024], factors) + offsets).max(0), out=most)
    # 1 - most / 2**64 is the smallest of the uniform values; its exponential is the smallest too.
    smallest = -np.log1p(-(((~most).astype(np.float64) + 0.5) / 2.0**64)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT).astype("<u2")


def _tail(x):
    """Probability that one register exceeds the other, from the share of its own elements."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs (one per row) from how many registers are larger, smaller and equal."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (sizes_a / (sizes_a + sizes_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    up, down = _tail(u - v * grid), _tail(v - u * grid)
    tiny = 1e-12
    likelihood = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(grid, likelihood.argmax(1)[:, None], 1)[:, 0]


def sketch_table(docs: DataFrame, size: int, key: str, text: str, registers: int = REGISTERS, row: Column | None = None) -> DataFrame:
    """`id`, `row` (as given), `n`, `node` (128-bit hash of the set; null for an empty set), `registers`."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), (F.lit(None).cast("long") if row is None else row).alias("row"), text_or_empty(text).alias("text"))

    def run(batches):
        for batch in rows_of(batches):
            n, node, sketches = [], [], []
            for t in batch.column("text").to_pylist():
                found = shingles(t, size)
                n.append(len(found))
                node.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketches.append(sketch(found, registers).tobytes() if len(found) else None)
            columns = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *columns], ["id", "row", "n", "node", "registers"])

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"id long, row {kind}, n long, node binary, registers binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """`node`, `found` (binary): the whole shingle set of one document of each wanted class (`node`, `id`)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("text"))
    ids = wanted.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in rows_of(batches):
            made = [shingles(t, size) for t in batch.column("text").to_pylist()]
            node = [xxhash.xxh3_128_digest(m.tobytes()) if len(m) else None for m in made]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([m.tobytes() for m in made], pa.binary())], ["node", "found"])

    # Ids need not be unique: the class is told by the set itself.
    held = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").mapInArrow(run, "node binary, found binary")
    return held.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _screened(pairs: DataFrame, classes: DataFrame, percent: int, registers: int) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and estimate allow the similarity."""
    side = classes.select("node", "n", "registers")
    sized = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
    sized = sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / registers) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, registers) for c in ("r_a", "r_b"))
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            keep = pa.array(np.concatenate([estimate(a[i : i + 1024], b[i : i + 1024], sizes[0][i : i + 1024], sizes[1][i : i + 1024]) >= least for i in range(0, len(a), 1024)]))
            yield batch.select(["a", "b"]).filter(keep)

    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in rows_of(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, "a binary, b binary")


def connected(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (a, b), the root being one node of the component.

    Each round sends every node to its smallest neighbour and contracts the links by that. Node keys are hashes, so a
    round leaves a fixed share of the nodes at most; tables are staged, lineage stays short.
    """
    links = staged(links.select("a", "b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    labels = None
    while True:
        step = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "roots")
        if labels is None:
            labels = step
        else:
            moved = labels.join(step.toDF("root", "next"), "root", "left")
            labels = staged(moved.select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = links.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").filter("x <> y")
        links = staged(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
        both = links.union(links.select("b", "a"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: the roots they connect are contracted."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    between = staged(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), "between")
    moved = connected(between)
    new = moved.join(labels, "node", "left_anti")
    old = labels.join(moved.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return staged(old.union(new.select("node", "root")), "labels")


def _mixed_buckets(entries: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Rows (bucket, node, root, pivot) of buckets with more than one component; the pivot is a row drawn by hash."""
    named = staged(entries.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "named")
    pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("place"), "node", "root")).alias("pivot")
    stats = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot)
    return named.join(staged(stats.filter("low <> high").select("bucket", "pivot"), "mixed"), "bucket")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the classes of each bucket, by comparing blocks of about `BLOCK` classes.

    Every pair of a bucket meets in one pair of blocks, where full sets are compared; a task holds two blocks, and gives
    back only the links that join components in it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")

    def compare(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(f.as_py(), np.uint64) for f in table.column("found")]
        node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
        sizes = np.array([len(f) for f in found])
        values, of = np.unique(np.concatenate(found), return_inverse=True)
        owner = np.repeat(np.arange(len(found)), sizes)
        common = np.zeros((len(found), len(found)), np.float32)
        order = np.argsort(of, kind="stable")
        of, owner = of[order], owner[order]
        edges = np.searchsorted(of, np.arange(0, len(values) + 4096, 4096))
        for start, (a, b) in enumerate(zip(edges, edges[1:])):
            has = np.zeros((len(found), 4096), np.float32)
            has[owner[a:b], of[a:b] - start * 4096] = 1
            common += has @ has.T
        linked = 100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - common.astype(np.int64))
        top = {r: r for r in root}

        def head(r):
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        out = []
        for x, y in zip(*np.nonzero(np.triu(linked, 1))):
            p, q = head(root[x]), head(root[y])
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((node[x], node[y]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})

    full = dealt.join(sets, "node").select("bucket", "i", "j", "node", "root", "found")
    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are not in one component yet."""
    known = pairs.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    return known.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int, row: Column | None = None) -> DataFrame:
    """`id`, `row`, `n`, `node` (null without words), `root` (one node of the component), `component_id`."""
    bands, rows = banding(percent)
    registers = max(REGISTERS, bands * rows)
    sketches = staged(sketch_table(docs, size, key, text, registers, row), "sketches")
    filled = sketches.filter("node IS NOT NULL")
    # One row per distinct set, pre-aggregated in each task; a struct of (is null, id) puts null ids last.
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "registers"))
    classes = staged(filled.groupBy("node").agg(best.alias("best")).select("node", "best.id", "best.n", "best.registers"), "classes")

    keys = [F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * rows * k, 2 * rows)) for k in range(bands)]
    entries = classes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    shared = staged(entries.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "buckets")
    members = staged(entries.join(shared, "bucket"), "members")  # bucket, node, pivot
    sets = staged(_sets(docs, members.select("node").distinct().join(classes.select("node", "id"), "node"), size, key, text), "sets")

    def links_of(pairs, name):
        return staged(_confirmed(_screened(pairs, classes, percent, registers), sets, percent), name)

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = connected(links_of(first, "first"))
    labels = _merged(labels, links_of(_apart(stars.distinct(), labels), "second"))
    entries = members.select("bucket", "node")
    for turn in range(TURNS):
        mixed = _mixed_buckets(entries, labels, turn)
        tried = mixed.filter(F.col("root") != F.col("pivot.root")).select(
            F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")
        )
        found = links_of(tried.distinct(), f"turn-{turn}")
        if found.isEmpty():
            break
        labels = _merged(labels, found)

    # What is left: classes of one bucket that no comparison has connected are compared with one another, those of
    # small buckets by a join, those of large ones block by block.
    rest = _mixed_buckets(entries, labels, 0).join(classes.select("node", "n"), "node").select("bucket", "node", "root", "n")
    sizes = staged(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "sizes")
    rest = staged(rest.join(sizes, "bucket"), "rest")
    small = rest.filter(F.col("size") <= SMALL).drop("size")
    left, right = small.toDF("bucket", "a", "x", "n_a"), small.toDF("bucket", "b", "y", "n_b")
    alike = (F.col("x") < F.col("y")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    tried = left.join(right, "bucket").filter(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_block = staged(_block_links(rest.filter(F.col("size") > SMALL), sets, percent), "blocks")
    labels = _merged(labels, links_of(tried, "last").union(by_block))

    order = F.struct(F.col("id").isNull().alias("no_id"), "id")
    lowest = labels.join(classes, "node").groupBy("root").agg(F.min(order).alias("low"))
    joined = labels.join(lowest, "root").select("node", "root", F.col("low.id").alias("component_id"))
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    of_node = staged(classes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), component), "components")
    out = sketches.select("id", "row", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "row", "n", "node", "root", component.alias("component_id"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: `doc_id`, `n_shingles`, `component_id` (smallest id of its component), `kept`.

    Documents are linked when 100 * |A n B| >= percent * |A u B| for their sets of `size`-word shingles. Documents without
    words (null or empty text) are linked with nothing. Null ids rank behind all others, so a component's id is null only if
    all its ids are. `kept` marks the rows that bear their component's id; rows repeated with that id are all marked.
    """
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, key, text, size, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of `near_groups`, all columns, and every row without words.

    Rows are told by their place in the table, so ids may repeat or be null. Of a group the row with the smallest id stays (null
    ids behind all others), of several with that id the first in the table.
    """
    rows, place = with_place(docs)
    grouped = staged(_grouped(rows, key, text, size, percent, place).filter("root IS NOT NULL").select("root", "id", "row"), "grouped")
    order = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    stays = grouped.groupBy("root").agg(order, F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", F.col("best.row").alias("stay"))
    gone = staged(grouped.join(stays, "root").filter("row <> stay").select(F.col("row").alias("gone")), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, place == gone["gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
