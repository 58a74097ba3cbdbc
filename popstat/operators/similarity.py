"""Pairwise similarity of haplotypes by the mutations they share.

Every unordered pair of haplotypes counts, so the work is that of a sparse matrix
times its transpose. Haplotypes are hashed into blocks and numbered in them; a tile is a
pair of blocks. A mutation of few copies reaches the tiles as its pairs, many mutations to
a row, and a tile merges equal pairs, so its work and memory are those of the pairs, not of
all the haplotypes two by two. Common mutations are hashed into chunks and reach tiles as
bits, one row of bits per haplotype and chunk, so that a task counts the ones of two rows'
conjunction in one matrix of shared counts. A mutation on one haplotype only reaches no
tile. A tile takes its chunks one after the other, so it holds one matrix and one chunk of
two blocks, however many mutations there are; means are summed in the tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popstat.functions.scalars import SIMILARITY_METRICS, set_similarity
from popstat.operators.filters import segregating
from popstat.operators.groups import By, attach, hash_bucket
from popstat.operators.statistics import copy_counts, site_counts
from popstat.session import cut_lineage

BLOCK = 4096  # haplotypes of a block, at most about
LEAST_BLOCK = 256  # and at least, where many mutations call for smaller tiles
CHUNK = 8192  # common mutations of a chunk, about
TILE_WORK = 2**40  # haplotypes of a block squared times common mutations, about
WIDEST = 1 << 15  # haplotypes of a block on average, at most: numbers in a block fit 16 bits
TILE_PAIRS = 1 << 21  # pairs of rare mutations of a tile, about
SLICE = 16  # haplotypes whose bits are one row
PIECE = 8192  # pairs of rare mutations that are one row
STEP = 1 << 21  # pairs that are listed or merged at once, about
PART = 1 << 17  # pairs of a tile that are one batch of the result


def segregating_carriers(carriers: DataFrame, haplotypes: DataFrame, by: By = ()) -> DataFrame:
    """Carrier rows of segregating mutations."""
    sites = segregating(site_counts(carriers, haplotypes, by)).select(*by, "mutation_id")
    return carriers.join(sites, [*by, "mutation_id"], "left_semi")


def _beside(df: DataFrame, groups: DataFrame, by: By) -> DataFrame:
    """``df`` with the columns of its group, NULL where the group has none."""
    return df.join(groups, list(by), "left") if by else attach(df, groups, by)


def _numbered(
    sizes: DataFrame, sites: DataFrame, by: By, block: int, chunk: int
) -> tuple[DataFrame, DataFrame]:
    """Haplotypes with block and number in it; mutations of two copies or more with their chunk and bit.

    ``sizes`` has the set ``_size`` of each haplotype, ``sites`` the ``copies`` of each mutation.
    A mutation is rare if its pairs are less work than its bits in all tiles would be, with
    blocks of 4,096 one that fewer than a haplotype in 64 carries. Where all mutations are rare, no tile holds a matrix, so there are only as many blocks as
    keep the pairs of a tile at about ``TILE_PAIRS`` and its numbers below 2^16.
    """
    by = list(by)
    copies = F.col("copies").cast("double")
    common = (F.col("copies") > 1) & (copies * copies * block > F.col("_n") * F.col("_n"))
    loaded = sizes.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    spectrum = _beside(sites.groupBy(*by, "copies").agg(F.count(F.lit(1)).alias("_sites")), loaded, by)
    listed = F.when(~common, F.col("_sites") * copies * (copies - 1) / 2).otherwise(0)
    groups = spectrum.groupBy(*by, "_n").agg(
        F.sum(F.when(common, F.col("_sites")).otherwise(0)).alias("_sites"), F.sum(listed).alias("_listed"))
    wide = F.greatest(F.lit(min(block, LEAST_BLOCK)), F.least(F.lit(min(block, WIDEST)), F.sqrt(TILE_WORK / F.greatest(F.lit(1), F.col("_sites")))))
    wide = F.when(F.col("_sites") > 0, wide).otherwise(F.lit(min(block * 8, WIDEST)))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size))
    blocks = F.greatest(parts(F.col("_n"), wide), F.ceil(F.sqrt(2 * F.col("_listed") / TILE_PAIRS)))
    groups = groups.select(*by, "_n", blocks.alias("_blocks"), parts(F.col("_sites"), chunk).alias("_chunks"))
    groups = cut_lineage(groups)
    placed = _beside(sizes, groups.drop("_n", "_chunks"), by)
    placed = placed.withColumn("_block", hash_bucket(["haplotype_id"], F.col("_blocks")).cast("int"))
    haplotypes = cut_lineage(placed.select(*_counted(by, "_block", "haplotype_id", "_at", "_rows")))
    chunk_of = F.when(common, hash_bucket(["mutation_id"], F.col("_chunks")).cast("int"))
    placed = _beside(sites.where("copies > 1"), groups.drop("_blocks"), by)
    placed = placed.select(*by, "mutation_id", common.alias("_common"), chunk_of.alias("_chunk"))
    bits = cut_lineage(placed.where("_common").select(*_counted(by, "_chunk", "mutation_id", "_bit", "_bits")))
    # only the few common ones are written: _tiles takes all others as rare
    rare = placed.where("not _common").withColumn("_common", F.lit(False))
    return haplotypes, bits.withColumn("_common", F.lit(True)).unionByName(rare, allowMissingColumns=True)


def _counted(by: By, part: str, order: str, number: str, total: str) -> list[Column | str]:
    """All columns, a number from 0 within a part, and the rows of the part; parts are of bounded size."""
    inside = Window.partitionBy(*by, part)
    number_of = (F.row_number().over(inside.orderBy(order)) - 1).cast("int")
    return ["*", number_of.alias(number), F.count(F.lit(1)).over(inside).cast("int").alias(total)]


def _bit_rows(placed: DataFrame, by: By) -> DataFrame:
    """Bits of common mutations: per block and chunk, rows of ``SLICE`` haplotypes from ``_first`` on."""
    keys = [*by, "_block", "_blocks", "_chunk"]
    names = [*keys, "_first", "_held"]
    schema = T.StructType([placed.schema[k] for k in keys] + [T.StructField("_first", T.IntegerType()), T.StructField("_held", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, key = None, []
        for batch in batches:
            if ones is None:
                key = [batch.column(k).slice(0, 1) for k in keys]
                n, bits = (batch.column(k)[0].as_py() for k in ("_rows", "_bits"))
                ones = np.zeros((n, -(-bits // 64) * 64), bool)
            ones[batch.column("_at").to_numpy(), batch.column("_bit").to_numpy()] = True
        if ones is None:
            return
        first = np.arange(0, len(ones), SLICE, dtype=np.int32)
        held = [np.packbits(ones[i : i + SLICE], axis=1).tobytes() for i in first]
        same = [pa.concat_arrays([k] * len(first)) for k in key]
        yield pa.RecordBatch.from_arrays([*same, pa.array(first), pa.array(held, pa.binary())], names=names)

    return placed.select(*keys, "_at", "_bit", "_rows", "_bits").groupBy(*keys).applyInArrow(pack, schema)


def _listed_pairs(ends: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """List number and both ends of all pairs within lists, which lie one after the other in ``ends``; about ``STEP`` pairs at once."""
    row = np.repeat(np.arange(len(length)), length)
    after = np.repeat(np.cumsum(length), length) - np.arange(len(ends)) - 1  # pairs that begin here
    upto = np.cumsum(after)
    borders = [0, *(np.flatnonzero(np.diff(upto // STEP)) + 1).tolist(), len(ends)]
    for i, j in zip(borders, borders[1:]):
        n = after[i:j]
        first = np.repeat(np.arange(i, j), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        if len(first):
            yield row[first], ends[first], ends[second]


def _rare_pairs(placed: DataFrame, by: By) -> DataFrame:
    """Pairs of haplotypes on a rare mutation, for each pair of blocks, as 32-bit numbers ``place * 2^16 + place``.

    A task gets its rows in the order of mutations, so that it lists pairs of many mutations at once without a list of each.
    """
    keys = list(by)
    pair = [T.StructField(n, T.IntegerType()) for n in ("_lo", "_hi")]
    schema = T.StructType([placed.schema[k] for k in keys] + pair + [T.StructField("_pairs", T.ArrayType(T.IntegerType()))])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.diff(starts(batch), append=batch.num_rows)
            held.append(batch)
            waiting += batch.num_rows + int((length * (length - 1) // 2).sum())
            if waiting > STEP:
                whole = pa.concat_batches(held)
                first = starts(whole)
                yield from listed(whole.slice(0, first[-1]), first[:-1])
                held, waiting = [whole.slice(first[-1])], 0  # its mutation may go on
        if held:
            whole = pa.concat_batches(held)
            yield from listed(whole, starts(whole))

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """Rows at which a mutation begins."""
        new = np.arange(batch.num_rows) == 0
        for k in [*keys, "mutation_id"]:
            new[1:] |= np.diff(pc.dictionary_encode(batch.column(k)).indices.to_numpy()) != 0
        return np.flatnonzero(new)

    def listed(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = batch.column("_end").to_numpy()
        once = np.diff(ends, prepend=-1) != 0
        once[first] = True
        ends, length = ends[once], np.add.reduceat(once, first, dtype=np.int64) if len(first) else first
        batch = batch.take(pa.array(first))
        group, named = np.zeros(batch.num_rows, np.int64), np.zeros(1, np.int64)
        for k in keys:  # numbers of the groups, and a row of each
            group = group << 32 | pc.dictionary_encode(batch.column(k)).indices.to_numpy()
            _, named, group = np.unique(group, return_index=True, return_inverse=True)
        for row, a, b in _listed_pairs(ends, length):
            tile = group[row] << 40 | a >> 32 << 20 | b >> 32
            order = np.argsort(tile)
            tile, code = tile[order], ((a & 0xFFFF) << 16 | b & 0xFFFF).astype(np.uint32)[order]
            new = np.flatnonzero(np.diff(tile, prepend=-1))
            cuts = [(x, y) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(tile)]) for x, y in _pieces(i, j)]
            start = np.array([x for x, _ in cuts])
            at = pa.array(named[tile[start] >> 40])
            lo, hi = (pa.array((tile[start] >> n & 0xFFFFF).astype(np.int32)) for n in (20, 0))
            pairs = pa.ListArray.from_arrays(pa.array([*start, len(code)], pa.int32()), pa.array(code.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], lo, hi, pairs], names=schema.fieldNames())

    end = F.shiftleft(F.col("_block").cast("long"), 32) + F.col("_at")
    mutation = [*keys, "mutation_id"]
    ends = placed.select(*mutation, end.alias("_end")).repartition(*mutation).sortWithinPartitions(*mutation, "_end")
    return ends.mapInArrow(expand, schema)


def _pieces(i: int, j: int) -> list[tuple[int, int]]:
    return [(k, min(k + PIECE, j)) for k in range(i, j, PIECE)]


def _tiles(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By) -> DataFrame:
    """All that a pair of blocks needs, in order: sizes of both, pairs of rare mutations, bits of one chunk after the other."""
    by = list(by)
    places = haplotypes.drop("_size")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)).alias("_other")
    tile = [F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi")]
    whole = F.array_sort(F.collect_list(F.struct("_at", "haplotype_id", "_size")))
    sizes = haplotypes.groupBy(*by, "_block", "_blocks").agg(whole.alias("_all")).select("*", other)
    sizes = sizes.select(
        *by, *tile, F.lit(-2).alias("_chunk"), "_block", F.lit(0).alias("_first"),
        F.col("_all.haplotype_id").alias("_ids"), F.col("_all._size").alias("_sizes"), F.lit(None).cast("binary").alias("_held"),
    )
    common = cut_lineage(mutations.where("_common"))  # so that its size is known, where there are none, too
    rare = carriers.dropna(subset=[*by, "mutation_id"]).join(common, [*by, "mutation_id"], "left_anti")
    rare = rare.join(places.select(*by, "haplotype_id", "_block", "_at"), [*by, "haplotype_id"])
    rare = _rare_pairs(rare, by).withColumns({"_chunk": F.lit(-1), "_block": F.lit(-1), "_first": F.lit(0)})
    placed = carriers.join(common, [*by, "mutation_id"]).join(places, [*by, "haplotype_id"])
    bits = _bit_rows(placed, by).select("*", other).select(*by, *tile, "_chunk", "_block", "_first", "_held")
    every = sizes.unionByName(rare, allowMissingColumns=True).unionByName(bits, allowMissingColumns=True)
    key = [*by, "_lo", "_hi"]
    return every.repartition(*key).sortWithinPartitions(*key, "_chunk", "_block", "_first")


class _Tile:
    """Shared counts of the haplotypes of two blocks; of one block with itself only those above the diagonal count.

    Pairs of rare mutations are merged to one count each; a matrix is made if bits come, or if it is smaller.
    """

    def __init__(self, key: tuple, group: list[pa.Array]) -> None:
        self.key, self.group = key, group
        self.lo, self.hi = key[-2:]
        self.ids: dict[int, pa.Array] = {}
        self.sizes = {k: np.zeros(0, np.int64) for k in (self.lo, self.hi)}  # a block may be empty
        self.pairs, self.shared = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.pending, self.waiting = [], 0
        self.counts: np.ndarray | None = None
        self.chunk, self.bits = -2, {}

    def take(self, chunk: int, block: int, batch: pa.RecordBatch, i: int) -> None:
        if chunk == -2:
            self.ids[block] = batch.column("_ids")[i].values
            self.sizes[block] = batch.column("_sizes")[i].values.to_numpy()
            return
        if chunk == -1:
            self.pending.append(batch.column("_pairs")[i].values.to_numpy().view(np.uint32))
            self.waiting += len(self.pending[-1])
            if self.waiting > max(STEP, 2 * len(self.pairs)):
                self.merge()
            return
        if chunk != self.chunk:
            self.multiply()
            self.chunk, self.bits = chunk, {}
        self.bits.setdefault(block, []).append(batch.column("_held")[i].as_py())

    def merge(self) -> None:
        """Add the pending pairs to the counts."""
        if not self.pending:
            return
        pairs, shared = np.unique(np.concatenate(self.pending), return_counts=True)
        self.pending, self.waiting = [], 0
        if self.counts is not None:
            self.counts[pairs >> 16, pairs & 0xFFFF] += shared.astype(np.int32)
            return
        if len(self.pairs):
            pairs, shared = np.concatenate((self.pairs, pairs)), np.concatenate((self.shared, shared))
            order = np.argsort(pairs)
            pairs, shared = pairs[order], shared[order]
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            pairs, shared = pairs[first], np.add.reduceat(shared, first)
        self.pairs, self.shared = pairs, shared
        if len(pairs) * 4 > len(self.sizes[self.lo]) * len(self.sizes[self.hi]):
            self.widen()

    def widen(self) -> None:
        """From pairs to a matrix."""
        self.merge()
        if self.counts is None:
            self.counts = np.zeros((len(self.sizes[self.lo]), len(self.sizes[self.hi])), np.int32)
            self.counts[self.pairs >> 16, self.pairs & 0xFFFF] = self.shared
            self.pairs, self.shared = self.pairs[:0], self.shared[:0]

    def multiply(self) -> None:
        if self.lo not in self.bits or self.hi not in self.bits:
            return
        self.widen()
        left, right = (np.frombuffer(b"".join(self.bits[k]), np.uint64).reshape(len(self.sizes[k]), -1) for k in (self.lo, self.hi))
        for i, row in enumerate(left):
            after = i + 1 if self.lo == self.hi else 0
            self.counts[i, after:] += np.bitwise_count(right[after:] & row).sum(axis=1, dtype=np.int32)
        self.bits = {}

    def shared_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places left and right and shared count of the pairs that share a mutation, some at a time."""
        self.multiply()
        self.merge()
        if self.counts is None:
            for i, j in zip(range(0, len(self.pairs), PART), [*range(PART, len(self.pairs), PART), len(self.pairs)]):
                yield (self.pairs[i:j] >> 16).astype(np.int64), (self.pairs[i:j] & 0xFFFF).astype(np.int64), self.shared[i:j]
            return
        for i in range(0, len(self.counts), 64):
            r, c = np.nonzero(self.counts[i : i + 64])
            if len(r):
                yield r + i, c, self.counts[r + i, c].astype(np.int64)


def _each_tile(tiles: DataFrame, by: By, schema: T.StructType, finish: Callable[[_Tile], Iterator[list[pa.Array]]]) -> DataFrame:
    keys, names = [*by, "_lo", "_hi"], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            key_columns = [batch.column(k).to_pylist() for k in keys]
            chunks, blocks = batch.column("_chunk").to_pylist(), batch.column("_block").to_pylist()
            for i, key in enumerate(zip(*key_columns, strict=True)):
                if tile is None or key != tile.key:
                    if tile is not None:
                        yield from (pa.RecordBatch.from_arrays(x, names=names) for x in finish(tile))
                    tile = _Tile(key, [batch.column(k).slice(i, 1) for k in by])
                tile.take(chunks[i], blocks[i], batch, i)
        if tile is not None:
            yield from (pa.RecordBatch.from_arrays(x, names=names) for x in finish(tile))

    return tiles.mapInArrow(run, schema)


def pair_set_sizes(carriers: DataFrame, by: By = (), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Pairs a < b with a shared mutation: size of either set, intersection and union."""
    by = list(by)
    carriers = cut_lineage(carriers.select(*by, "haplotype_id", "mutation_id"))
    sizes = cut_lineage(carriers.groupBy(*by, "haplotype_id").agg(F.count(F.lit(1)).alias("_size")))
    haplotypes, mutations = _numbered(sizes, cut_lineage(copy_counts(carriers, by)), by, block, chunk)
    group_fields = [carriers.schema[name] for name in by]
    ends = [T.StructField(n, carriers.schema["haplotype_id"].dataType) for n in ("haplotype_a", "haplotype_b")]
    names = ["size_a", "size_b", "shared", "union_size"]
    schema = T.StructType(group_fields + ends + [T.StructField(n, T.LongType()) for n in names])

    def finish(tile: _Tile) -> Iterator[list[pa.Array]]:
        for r, c, shared in tile.shared_pairs():
            a, b = tile.ids[tile.lo].take(pa.array(r)), tile.ids[tile.hi].take(pa.array(c))
            n, m = tile.sizes[tile.lo][r], tile.sizes[tile.hi][c]
            straight = pc.less(a, b)
            order = straight.to_numpy(zero_copy_only=False)
            group = [g.take(pa.array(np.zeros(len(r), np.int64))) for g in tile.group]
            low, high = np.where(order, n, m), np.where(order, m, n)
            numbers = [pa.array(x) for x in (low, high, shared, n + m - shared)]
            yield [*group, pc.if_else(straight, a, b), pc.if_else(straight, b, a), *numbers]

    return _each_tile(_tiles(carriers, haplotypes, mutations, by), by, schema, finish)


def _sums(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[float]:
    """Jaccard, Dice and overlap summed over pairs of sets of these sizes, which are not empty."""
    shared, a, b = (x.astype(np.float64) for x in (shared, a, b))
    return [float(x.sum()) for x in (shared / (a + b - shared), 2 * shared / (a + b), shared / np.minimum(a, b))]


def _similarity_sums(tiles: DataFrame, by: By) -> DataFrame:
    """Each metric summed over the pairs of a group that share a mutation; no pair leaves its tile."""
    numbers = [T.StructField(m, T.DoubleType()) for m in SIMILARITY_METRICS]
    schema = T.StructType([tiles.schema[name] for name in by] + numbers)

    def finish(tile: _Tile) -> Iterator[list[pa.Array]]:
        total = [0.0] * len(SIMILARITY_METRICS)
        for r, c, shared in tile.shared_pairs():
            part = _sums(shared, tile.sizes[tile.lo][r], tile.sizes[tile.hi][c])
            total = [x + y for x, y in zip(total, part, strict=True)]
        yield [*tile.group, *[pa.array([x]) for x in total]]

    made = _each_tile(tiles, by, schema, finish)
    return made.groupBy(*by).agg(*[F.sum(m).alias(m) for m in SIMILARITY_METRICS])


def haplotype_overlaps(carriers: DataFrame, by: By = (), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Shared-mutation count of each pair a < b; a pair without a row shares nothing."""
    return pair_set_sizes(carriers, by, block, chunk).select(*by, "haplotype_a", "haplotype_b", "shared")


def pairwise_similarities(
    carriers: DataFrame, haplotypes: DataFrame, by: By = (), block: int = BLOCK, chunk: int = CHUNK,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Mean Jaccard, Dice and overlap over all unordered pairs, from one pass.

    Only segregating mutations count. A pair that shares nothing adds 0, or 1 if
    both sets are empty; a group with fewer than two haplotypes has similarity 1.
    ``sites`` are the ``site_counts`` of written carriers; without them carriers are written first.
    """
    by = list(by)
    carriers = carriers.select(*by, "haplotype_id", "mutation_id")
    if sites is None:
        carriers = cut_lineage(carriers)
        sites = cut_lineage(site_counts(carriers, haplotypes, by))
    # what does not segregate is the smaller table as a rule, so carriers need no shuffle
    others = cut_lineage(sites.where("copies >= n_hap").select(*by, "mutation_id"))
    held = carriers.dropna(subset=[*by, "mutation_id"]).join(others, [*by, "mutation_id"], "left_anti")
    if by:
        held = held.join(cut_lineage(haplotypes.select(*by).distinct()), by, "left_semi")
    held = cut_lineage(held)
    sites = segregating(sites).select(*by, "mutation_id", "copies")
    sizes = cut_lineage(held.groupBy(*by, "haplotype_id").agg(F.count(F.lit(1)).alias("_size")))
    placed, mutations = _numbered(sizes, sites, by, block, chunk)
    sums = _similarity_sums(_tiles(held, placed, mutations, by), by)
    loaded = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_loaded"))
    totals = haplotypes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hap"))
    whole = _beside(_beside(totals, loaded, by), sums, by).na.fill(0, ["_loaded", *SIMILARITY_METRICS])
    n = F.col("n_hap").cast("double")
    empty = n - F.col("_loaded")
    n_pairs, empty_pairs = n * (n - 1) / 2, empty * (empty - 1) / 2
    mean = lambda m: F.when(n < 2, F.lit(1.0)).otherwise(F.try_divide(F.col(m) + empty_pairs, n_pairs))
    return whole.select(*by, *[mean(m).alias(m) for m in SIMILARITY_METRICS])


def mean_pairwise_similarity(
    carriers: DataFrame, haplotypes: DataFrame, metric: str, by: By = (), block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    if metric not in SIMILARITY_METRICS:
        raise ValueError(f"unknown similarity metric: {metric}")
    return pairwise_similarities(carriers, haplotypes, by, block, chunk).select(
        *by, F.col(metric).alias("mean_similarity")
    )


def sampled_pairwise_similarity(carriers: DataFrame, pairs: DataFrame, metric: str, by: By = ()) -> DataFrame:
    """Mean similarity over the given pairs (haplotype_a, haplotype_b), repeats counted each time.

    ``carriers`` should hold segregating mutations only. Each distinct pair is matched
    on its mutations by equi-joins, so no haplotype is gathered into one row.
    """
    by = list(by)
    ends = ["haplotype_a", "haplotype_b"]
    wanted = pairs.groupBy(*by, *ends).agg(F.count(F.lit(1)).alias("_times"))
    named = lambda end: carriers.select(*by, F.col("haplotype_id").alias(end), "mutation_id")
    shared = (
        wanted.join(named("haplotype_a"), [*by, "haplotype_a"])
        .join(named("haplotype_b"), [*by, "haplotype_b", "mutation_id"])
        .groupBy(*by, *ends)
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    sizes = carriers.groupBy(*by, "haplotype_id").agg(F.count(F.lit(1)).alias("_size"))
    size_of = lambda end, name: sizes.select(*by, F.col("haplotype_id").alias(end), F.col("_size").alias(name))
    full = (
        wanted.join(shared, [*by, *ends], "left")
        .join(size_of("haplotype_a", "size_a"), [*by, "haplotype_a"], "left")
        .join(size_of("haplotype_b", "size_b"), [*by, "haplotype_b"], "left")
        .na.fill(0, ["shared", "size_a", "size_b"])
    )
    weighted = F.sum(set_similarity("size_a", "size_b", "shared", metric) * F.col("_times"))
    return full.groupBy(*by).agg((weighted / F.sum("_times")).alias("mean_similarity"))
