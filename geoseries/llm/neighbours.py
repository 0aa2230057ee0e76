"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one priority queue.

The trees are fitted on a bounded sample and sent to the executors; every vector gets a leaf (cell) in every tree. A query's
queue holds the unvisited branches of all trees by how far they lie beyond the splits crossed, and hands out cells until their
number reaches the budget that the wanted recall took on the sample. The vectors of the cells found are compared exactly: cells
are packed into shards, queries into blocks, and each pair of block and shard that a query asks for is one matrix product.

Vectors that occur more than once are one entry with the smallest ids, so copies fill no cell. Nearness by inner product becomes
nearness by distance with one more coordinate that gives all entries the same length, and queries zero in it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, staged

TREES = 4
#: Sampled entries in a leaf, and bounds of the sample that fits the trees and the budget: entries, and numbers in them.
LEAF, SAMPLE_ROWS, SAMPLE_VALUES = 16, 16_384, 1 << 22
#: Sampled queries whose true neighbours set the budget.
PROBES = 128
#: Entries of a shard and queries of a block: the most that a task multiplies at once.
SHARD_ROWS, BLOCK_ROWS = 2048, 8192
#: Lists of one query merged at once, and queries of a merging task.
FAN, MERGE_QUERIES = 256, 64
#: Products may lose this share of their size before the exact score decides.
TOLERANCE = 1e-12


class Forest:
    """Complete binary trees in heap order; cell = tree * leaves + leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, seed: int = 12):
        self.scale = max(float(np.abs(sample).max(initial=0.0)), 1e-300)
        self.dim = sample.shape[1]
        self.length = float(((sample / self.scale) ** 2).sum(1).max(initial=0.0))
        self.depth = max(0, int(np.log2(max(len(sample), 1) / LEAF)))
        self.leaves, self.trees = 1 << self.depth, trees
        rng = np.random.default_rng(seed)
        points = self.entries(sample)
        self.splits = [self._grow(points, rng) for _ in range(trees)]

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        return vectors[:, : self.dim] / self.scale

    def entries(self, vectors: np.ndarray) -> np.ndarray:
        """Entries with the coordinate that makes them equally long (0 where one is longer than all of the sample)."""
        v = self._padded(vectors)
        return np.column_stack([v, np.sqrt(np.maximum(self.length - (v * v).sum(1), 0))])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        v = self._padded(vectors)
        norms = np.sqrt((v * v).sum(1, keepdims=True))
        return np.column_stack([v * (np.sqrt(self.length) / np.maximum(norms, 1e-300)), np.zeros(len(v))])

    def _grow(self, points: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """(directions, cuts): each split is the median along a random direction at right angles to those above it."""
        inner = self.leaves - 1
        directions, cuts = np.zeros((inner, points.shape[1])), np.zeros(inner)
        held = {0: np.arange(len(points))}
        for node in range(inner):
            mine = held.pop(node)
            d = rng.normal(size=points.shape[1])
            above = node
            while above:
                above = (above - 1) // 2
                d -= directions[above] * (directions[above] @ d)
            d /= max(float(np.linalg.norm(d)), 1e-300)
            along = points[mine] @ d
            directions[node], cuts[node] = d, np.median(along) if len(mine) else 0.0
            held[2 * node + 1], held[2 * node + 2] = mine[along < cuts[node]], mine[along >= cuts[node]]
        return directions, cuts

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell of each vector in each tree (rows x trees)."""
        points, out = self.entries(vectors), np.zeros((len(vectors), self.trees), np.int32)
        for t, (directions, cuts) in enumerate(self.splits):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                right = np.einsum("nd,nd->n", points, directions[node]) >= cuts[node]
                node = 2 * node + 1 + right
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def search(self, vectors: np.ndarray, sizes: np.ndarray, budget: int, least: int):
        """Cells of each query, nearest first: `budget` of them, and more until one tree has given `least` entries."""
        points, inner = self.queries(vectors), self.leaves - 1
        margins = [points @ directions.T - cuts for directions, cuts in self.splits]
        for row in range(len(points)):
            across = [m[row].tolist() for m in margins]
            queue = [(0.0, t, 0) for t in range(self.trees)]
            found, given = [], [0] * self.trees
            while queue and (len(found) < budget or max(given) < least):
                beyond, t, node = heapq.heappop(queue)
                while node < inner:
                    m = across[t][node]
                    near = 2 * node + 1 + (m >= 0)
                    heapq.heappush(queue, (beyond + m * m, t, 4 * node + 3 - near))
                    node = near
                found.append(t * self.leaves + node - inner)
                given[t] += sizes[found[-1]]
            yield found

    def budget(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Cells that a query must visit so that sampled queries find the share `recall` of their `k` nearest in the sample."""
        cells = self.cells(sample)
        all_cells = self.trees * self.leaves
        probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)
        places = []
        orders = self.search(sample[probes], np.zeros(all_cells), all_cells, 0)
        for probe, order in zip(probes, orders):
            products = sample @ (sample[probe] / max(float(np.abs(sample[probe]).max()), 1e-300))
            products[probe] = -np.inf
            nearest = np.argsort(-products, kind="stable")[: min(k, len(sample) - 1)]
            at = np.zeros(all_cells, np.int64)
            at[order] = np.arange(len(order))
            places.append(at[cells[nearest]].min(1))
        places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        return int(places[int(np.ceil(recall * len(places))) - 1]) + 1 if len(places) else 1


def _packed(sizes: np.ndarray, most: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, bins) of each entry of `sizes`: neighbours share a bin up to `most`; a larger one has several of its own.

    No bin holds entries of two stretches of `apart`: in a shard of one tree every vector is there once.
    """
    first, bins = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now, held = 0, 0
    for k, size in enumerate(sizes):
        if k and (k % apart == 0 or held and held + size > most) and not (held == 0 and bins[k - 1] > 1):
            now, held = now + 1, 0
        first[k] = now
        held += size
        if size > most:
            bins[k] = -(-size // most)
            now, held = now + bins[k], 0
    return first, bins


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(counts) and (counts == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(counts), dim))
    rows = np.repeat(np.arange(len(counts)), counts)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """`id`, `vec`: rows with an id whose vector is not null or zero and holds only finite numbers."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    vec = F.col(f"`{vector}`") if kind in ("float", "double") else F.col(f"`{vector}`").cast("array<double>")
    named = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.filter(~odd & F.exists("vec", lambda x: x != 0))


def _best(table: pa.Table, groups: np.ndarray, k: int):
    """Rows of (group, id, score) arrays reduced to the `k` largest of each group, ties to the smaller id, repeats once."""
    ids, scores = table.column("id").to_numpy(), table.column("score").to_numpy()
    order = np.lexsort((ids, -scores, groups))
    g, i, s = groups[order], ids[order], scores[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    g, i, s = g[fresh], i[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return g[rank < k], i[rank < k], s[rank < k]


def _lists(groups: np.ndarray, ids: np.ndarray, scores: np.ndarray, count: int) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=count))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (ids, scores)]


def _scored(queries: pa.Table, shard: pa.Table, dim: int, k: int) -> pa.Table:
    """Per query the `k` nearest rows of the cells that it visits in one shard."""
    wanted, held = _matrix(queries.column("vec").combine_chunks(), dim), _matrix(shard.column("vec").combine_chunks(), dim)
    members = shard.column("ids").combine_chunks()
    counts, flat = members.value_lengths().to_numpy(), members.flatten().to_numpy()
    starts = np.cumsum(counts) - counts
    cells, cell = np.unique(shard.column("cell").to_numpy(), return_inverse=True)
    visits = [np.frombuffer(c, "<i4") for c in queries.column("cells").to_pylist()]
    norms = np.sqrt((held * held).sum(1)).max(initial=0.0)
    parts = []
    for low in range(0, len(wanted), 256):
        q = wanted[low : low + 256]
        seen = np.array([np.isin(cells, v) for v in visits[low : low + 256]])
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.where(seen[:, cell], q @ held.T, -np.inf)
            last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
            slack = TOLERANCE * dim * np.sqrt((q * q).sum(1)) * norms
            row, entry = np.nonzero((near >= (last - slack)[:, None]) & seen[:, cell])
            # Exact products: the order of their terms cannot show, so equal scores are equal wherever they are computed.
            score = np.concatenate([np.zeros(0)] + [
                (q[row[a : a + 8192]].astype(np.longdouble) * held[entry[a : a + 8192]]).sum(1).astype(np.float64) for a in range(0, len(row), 8192)
            ])
        order = np.lexsort((flat[starts[entry]], -score, row))
        row, entry, score = row[order], entry[order], score[order]
        first = np.searchsorted(row, np.arange(len(q)))
        top = np.arange(len(row)) - first[row] < k
        row, entry, score = row[top], entry[top], score[top]
        size = counts[entry]
        at = np.repeat(starts[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        table = pa.table({"id": flat[at], "score": np.repeat(score, size)})
        g, i, s = _best(table, np.repeat(row, size), k)
        parts.append(pa.Table.from_arrays([queries.column("vec").slice(low, 256).combine_chunks(), *_lists(g, i, s, len(q))], ["vec", "ids", "scores"]))
    return pa.concat_tables(parts)


def _merged(lists: DataFrame, queries: int, shards: int, k: int) -> DataFrame:
    """One list for each query from its lists of all shards, `FAN` at a time."""
    kind = lists.schema["vec"].dataType.simpleString()
    tasks = max(1, -(-queries // MERGE_QUERIES))
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("vec"), F.lit(tasks)).cast("int"))

    def joined(table: pa.Table) -> pa.Table:
        keys = table.column("vec").combine_chunks()
        of: dict[bytes, int] = {}
        raw, ends = keys.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])
        number = np.array([of.setdefault(raw[a:b].tobytes(), len(of)) for a, b in zip(ends, ends[1:])], np.int64)
        ids = table.column("ids").combine_chunks()
        rows = pa.table({"id": ids.flatten(), "score": table.column("scores").combine_chunks().flatten()})
        g, i, s = _best(rows, np.repeat(number, ids.value_lengths().to_numpy()), k)
        first = np.unique(number, return_index=True)[1]
        columns = [table.column(c).combine_chunks().take(pa.array(first)) for c in ("bucket", "shard", "vec")]
        return pa.Table.from_arrays([*columns, *_lists(g, i, s, len(of))], ["bucket", "shard", "vec", "ids", "scores"])

    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN)).select("bucket", "shard", "vec", "ids", "scores")
        shards = -(-shards // FAN)
        lists = lists.groupBy("bucket", "shard").applyInArrow(joined, f"bucket int, shard long, vec {kind}, ids array<long>, scores array<double>")
        if shards <= 1:
            return lists


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.96, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` nearest rows found of each row whose id `every` divides.

    Nearness is the inner product of the original vectors in double precision, ties go to the smaller id. Rows without an id and
    vectors that are null, zero or hold null or non-finite numbers take no part; of vectors of different lengths the shorter end
    in zeros. Rows that repeat an id and its vector are one row. An id with several vectors asks with the smallest of them, and
    none of them is found for it; it is found once at each score. With fewer candidates than `k` all are returned.

    The trees and the number of cells to visit are fitted on about `sample_rows` distinct vectors (fewer where these are long):
    as many cells as give sampled queries the share `recall` of their neighbours in the sample. Among more rows the neighbours lie
    nearer, so the share does not fall.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    kind = rows.schema["vec"].dataType.simpleString()
    result = "query_id long, rank int, vec_id long, score double"
    # Distinct vectors with their smallest ids; the limit of the window holds in each task before the shuffle too.
    ranked = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("place") <= k + 1)
    entries = staged(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = staged(rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec")), "asked")
    count, dim = entries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not count:
        return spark.createDataFrame([], result)

    share = min(1.0, max(2, min(sample_rows, SAMPLE_VALUES // dim)) / count)
    drawn = entries if share == 1 else entries.filter(F.xxhash64("vec") < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    sample = _matrix(drawn.select("vec").toArrow().column("vec").combine_chunks(), dim)
    forest = Forest(sample)
    budget = forest.budget(sample, k, recall)

    def assign(batches):
        for batch in rows_of(batches, 4096):
            cells = forest.cells(_matrix(batch.column("vec"), dim))
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, forest.trees, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), column], ["vec", "ids", "cells"])

    placed = staged(entries.select("vec", "ids").mapInArrow(assign, f"vec {kind}, ids array<long>, cells array<int>"), "cells")
    sizes = np.zeros(forest.trees * forest.leaves, np.int64)
    for cell, size in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # a row for each cell
        sizes[cell] = size
    first_shard, shard_bins = _packed(sizes, SHARD_ROWS, forest.leaves)
    shards = int((first_shard + shard_bins).max())

    def aim(batches):
        for batch in rows_of(batches, 256):
            v = _matrix(batch.column("vec"), dim)
            cells = [np.array(c, "<i4").tobytes() for c in forest.search(v, sizes, budget, k + 1)]
            home = pa.array(forest.cells(v)[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("vec"), home, pa.array(cells, pa.binary())], ["vec", "home", "cells"])

    aimed = staged(asked.select("vec").distinct().mapInArrow(aim, f"vec {kind}, home int, cells binary"), "aimed")
    homes = np.zeros(forest.leaves, np.int64)
    for cell, size in aimed.groupBy("home").count().collect():  # a row for each leaf of a tree
        homes[cell] = size
    first_block, block_bins = _packed(homes, BLOCK_ROWS, forest.leaves)

    def visit(batches):
        """A row for each query and shard that holds cells of it."""
        for batch in rows_of(batches, 64):
            out = []
            for k_row, (home, cells) in enumerate(zip(batch.column("home").to_pylist(), batch.column("cells").to_pylist())):
                cells = np.frombuffer(cells, "<i4")
                block = int(first_block[home]) + (zlib.crc32(cells.tobytes()) % int(block_bins[home]))
                bins = shard_bins[cells]
                shard = np.repeat(first_shard[cells] - (np.cumsum(bins) - bins), bins) + np.arange(bins.sum())
                order = np.argsort(shard, kind="stable")
                shard, cells = shard[order], np.repeat(cells, bins)[order]
                at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                out += [(k_row, block, int(shard[a]), cells[a:b].tobytes()) for a, b in zip(at, np.append(at[1:], len(shard)))]
            row, block, shard, cells = zip(*out) if out else ((), (), (), ())
            columns = [pa.array(block, pa.int64()), pa.array(shard, pa.int64()), batch.column("vec").take(pa.array(row, pa.int64())), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "vec", "cells"])

    visits = staged(aimed.mapInArrow(visit, f"block long, shard long, vec {kind}, cells binary"), "visits")

    def spread(batches):
        """Entries by shard: a row for each tree."""
        for batch in rows_of(batches, 4096):
            cells = batch.column("cells").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), forest.trees)
            lengths = batch.column("ids").value_lengths().to_numpy()
            lowest = batch.column("ids").flatten().to_numpy()[np.cumsum(lengths) - lengths]
            shard = first_shard[cells] + lowest[row] % shard_bins[cells]
            columns = [pa.array(shard), pa.array(cells), *[batch.column(c).take(pa.array(row)) for c in ("vec", "ids")]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "cell", "vec", "ids"])

    pairs = visits.groupBy(F.col("block").alias("of_block"), F.col("shard").alias("of_shard")).count().drop("count")
    held = placed.mapInArrow(spread, f"shard long, cell int, vec {kind}, ids array<long>").join(pairs, F.col("shard") == F.col("of_shard"))

    def compare(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "vec": queries.column("vec").slice(0, 0), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        found = _scored(queries, shard, dim, k + 1)
        return found.add_column(0, "shard", pa.array(np.full(found.num_rows, queries.column("shard")[0].as_py())))

    lists = visits.groupBy("block", "shard").cogroup(held.groupBy("of_block", "of_shard")).applyInArrow(compare, f"shard long, vec {kind}, ids array<long>, scores array<double>")
    merged = _merged(lists, int(homes.sum()), shards, k + 1)
    near = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("id"))
    found = asked.join(merged, "vec").select("id", F.posexplode(F.slice(near, 1, k)).alias("place", "near"))
    return found.select(F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("near.ids").alias("vec_id"), F.col("near.scores").alias("score"))
