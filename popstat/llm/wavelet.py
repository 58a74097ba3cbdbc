"""Packed populations as wavelet matrices: one compressed row per shard, read without unpacking it.

A packed population is the concatenation of the mutation ids of all haplotypes with the
number of ids of each, in ascending haplotype order. A shard holds consecutive whole
haplotypes. Its ids are numbered among the ids that occur in it, and the bits of those
numbers are stored as one plane per bit, the highest first; each plane orders the ids by
the planes above it. Ones counted at every BLOCK bits answer rank, from which access,
counting and the place of the k-th occurrence follow in as many steps as there are planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.operators.ordered import running_totals

BLOCK = 512
SHARD = 1 << 20


class WaveletMatrix:
    """Rank, select and access over a sequence of non-negative ids."""

    def __init__(self, n: int, symbols: np.ndarray, planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.symbols, self.planes = n, symbols, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        if top < 1 << 24:  # a table is faster than a sort
            present = np.zeros(top + 1, bool)
            present[ids] = True
            symbols = np.flatnonzero(present[: top + 1]).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
            number = (np.cumsum(present) - 1)[ids] if len(ids) else np.zeros(0, np.int64)
        else:
            symbols, number = np.unique(ids, return_inverse=True)
        codes = number.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        planes, ranks = [], []
        for level in range(max(len(symbols) - 1, 0).bit_length() - 1, -1, -1):
            bits = (codes & codes.dtype.type(1 << level)).astype(bool)
            plane = np.packbits(bits, bitorder="little")
            planes.append(plane.tobytes())
            ranks.append(_counts(plane).tobytes())
            codes = np.concatenate((codes[~bits], codes[bits]))
        return cls(len(ids), symbols, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty_like(codes)
            above[~bits] = codes[:zeros]
            above[bits] = codes[zeros:] | codes.dtype.type(1 << level)
            codes = above
        return self.symbols[codes] if self.n else self.symbols[:0]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        block = i // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        plane = self.planes[level]
        for k in range(BLOCK // 8):
            byte = block * (BLOCK // 8) + k
            left = np.clip(i - byte * 8, 0, 8)
            value = plane[np.minimum(byte, len(plane) - 1)] & ((1 << left) - 1).astype(np.uint8)
            out += np.bitwise_count(value)
        return out

    def access(self, places: Sequence[int]) -> np.ndarray:
        """Ids at the given places."""
        i = np.asarray(places, np.int64)
        code = np.zeros(len(i), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][i // 8] >> (i % 8).astype(np.uint8)) & 1
            ones = self._ones(level, i)
            i = np.where(bit, zeros + ones, i - ones)
            code = 2 * code + bit
        return self.symbols[code]

    def _range(self, symbol: int, before: int) -> tuple[int, int] | None:
        """Where the occurrences of an id before a place stand below the last plane."""
        code = int(np.searchsorted(self.symbols, symbol))
        if code == len(self.symbols) or int(self.symbols[code]) != symbol:
            return None
        edges = np.array([0, before])
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, edges)
            edges = zeros + ones if code >> (len(self.planes) - 1 - level) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def count(self, symbol: int, before: int | None = None) -> int:
        """Occurrences of an id ahead of a place, or in all."""
        found = self._range(symbol, self.n if before is None else before)
        return found[1] - found[0] if found else 0

    def locate(self, symbol: int) -> np.ndarray:
        """Places of all occurrences of an id, ascending: select for every one."""
        found = self._range(symbol, self.n)
        places = np.arange(*found) if found else np.zeros(0, np.int64)
        for level in range(len(self.planes) - 1, -1, -1):
            if not len(places):
                break
            zeros = self.zeros[level]
            wanted = bool(places[0] >= zeros)
            places = self._select(level, places - zeros if wanted else places, wanted)
        return places

    def _select(self, level: int, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not ones:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = np.searchsorted(ranks, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            plane = self.planes[level][b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)]
            bits = np.unpackbits(plane, bitorder="little")[: self.n - b * BLOCK]
            own = block == b
            out[own] = b * BLOCK + np.flatnonzero(bits == ones)[k[own] - ranks[b]]
        return out


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones ahead of each block, and of all."""
    padded = np.zeros(-(-max(len(plane), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(plane)] = plane
    each = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(each))).astype("<u4")


def _listed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each haplotype of an array column; NULL is none."""
    for ids in batch.column("_payload"):
        yield np.array(ids.as_py() or [], np.uint32)


def _row(shard: int, keys: list, key_type: pa.DataType, parts: list[np.ndarray]) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
    columns = {
        "shard": pa.array([shard], pa.int64()),
        "n_ids": pa.array([matrix.n], pa.int64()),
        "keys": pa.array([keys], pa.list_(key_type)),
        "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
        "symbols": pa.array([matrix.symbols], pa.list_(pa.int64())),
        "planes": pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
        "ranks": pa.array([[r.tobytes() for r in matrix.ranks]], pa.list_(pa.binary())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def write_packed_population(
    haplotypes: DataFrame, path: str, haplotype_id: str = "haplotype_id", mutation_ids: str = "mutation_ids",
    ids_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _listed, shard_size: int = SHARD,
) -> None:
    """Write the ids of all haplotypes as wavelet-matrix shards below ``path``.

    ``haplotypes`` has ``haplotype_id`` and an array ``mutation_ids`` of ids below 2**32;
    ``ids_of`` may turn another column into ids instead, haplotype by haplotype. Rows are
    dealt by ranges of haplotype_id, repeated ids by content, and sorted; a NULL id comes
    first. A shard is closed at ``shard_size`` ids or more and holds whole haplotypes, so it
    grows beyond that only with a single longer one. A NULL or empty list has no ids; an empty
    table writes no shard. Other columns are ignored.
    """
    named = haplotypes.select(F.col(haplotype_id).alias("_key"), F.col(mutation_ids).alias("_payload"))
    ranked = named.withColumn("_tie", F.xxhash64("_payload"))
    dealt = ranked.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").select("_key", "_payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, parts, held, kind = TaskContext.get().partitionId() << 32, [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("_key").type
            for key, ids in zip(batch.column("_key").to_pylist(), ids_of(batch), strict=True):
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= shard_size:
                    yield _row(number, keys, kind, parts)
                    number, keys, parts, held = number + 1, [], [], 0
        if keys:
            yield _row(number, keys, kind, parts)

    kind = named.schema["_key"].dataType.simpleString()
    schema = (
        f"shard long, n_ids long, keys array<{kind}>, sizes array<int>, symbols array<long>, "
        "planes array<binary>, ranks array<binary>"
    )
    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_packed_population(spark: SparkSession, path: str) -> DataFrame:
    """The shards below ``path``."""
    return spark.read.parquet(path)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, WaveletMatrix]]:
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(name)[i]
            symbols = get("symbols").values.to_numpy(zero_copy_only=False).astype(np.uint32)
            planes, ranks = ([x.as_buffer() for x in get(c).values] for c in ("planes", "ranks"))
            yield get("shard").as_py(), i, batch, WaveletMatrix(get("n_ids").as_py(), symbols, planes, ranks)


def with_starts(shards: DataFrame) -> DataFrame:
    """``shard`` and ``base``, the ids of all shards before it; shard numbers ascend with haplotypes."""
    return running_totals(shards.select("shard", "n_ids"), {"upto": F.col("n_ids")}, ["shard"], before={"upto": "base"}).select(
        "shard", "base"
    )


def unpack_population(shards: DataFrame, digest_only: bool = False) -> DataFrame:
    """``haplotype_id``, ``start``, ``n_ids``, ``ids_crc32`` and ``mutation_ids`` of every haplotype, read from its shard.

    ``start`` is the offset in the packed population: the ids of all haplotypes before.
    ``ids_crc32`` is of the ids as little-endian 32-bit numbers. ``digest_only`` leaves
    the ids themselves out.
    """
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, i, batch, matrix in _matrices(batches):
            sizes = batch.column("sizes")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(sizes)
            raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)]
            columns = {
                "haplotype_id": batch.column("keys")[i].values, "_shard": pa.array([shard] * len(sizes), pa.int64()),
                "_offset": pa.array(ends - sizes), "n_ids": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64()),
            }
            if not digest_only:
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                columns["mutation_ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"haplotype_id {kind}, _shard long, _offset long, n_ids long, ids_crc32 long"
    rows = shards.mapInArrow(run, schema + ("" if digest_only else ", mutation_ids array<long>"))
    placed = rows.join(with_starts(shards).withColumnRenamed("shard", "_shard"), "_shard")
    names = ["n_ids", "ids_crc32", *([] if digest_only else ["mutation_ids"])]
    return placed.select("haplotype_id", (F.col("base") + F.col("_offset")).alias("start"), *names)


def count_mutations(shards: DataFrame, mutation_ids: Sequence[int]) -> DataFrame:
    """``mutation_id`` and ``n``: occurrences of each given id in all shards, by rank alone."""
    wanted = sorted(set(mutation_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, matrix in _matrices(batches):
            yield pa.RecordBatch.from_pydict({"mutation_id": wanted, "n": [matrix.count(m) for m in wanted]}, schema=_COUNTS)

    return shards.mapInArrow(run, "mutation_id long, n long").groupBy("mutation_id").agg(F.sum("n").alias("n"))


_COUNTS = pa.schema([("mutation_id", pa.int64()), ("n", pa.int64())])


def locate_mutation(shards: DataFrame, mutation_id: int) -> DataFrame:
    """``position`` of each occurrence of an id in the packed population, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, matrix in _matrices(batches):
            places = matrix.locate(mutation_id)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(places), pa.int64()), pa.array(places)], names=["shard", "at"])

    found = shards.mapInArrow(run, "shard long, at long")
    return found.join(with_starts(shards), "shard").select((F.col("base") + F.col("at")).alias("position"))


def mutations_at(shards: DataFrame, positions: Sequence[int]) -> DataFrame:
    """``position`` and ``mutation_id`` of each given place of the packed population; places beyond it give no row."""
    asked = np.array(sorted(set(positions)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, batch, matrix in _matrices(batches):
            base = batch.column("base")[i].as_py()
            own = asked[(asked >= base) & (asked < base + matrix.n)]
            ids = matrix.access(own - base) if len(own) else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids.astype(np.int64))], names=["position", "mutation_id"])

    return shards.join(with_starts(shards), "shard").mapInArrow(run, "position long, mutation_id long")


def texts_as_ids(model: str, end: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """Ids of texts by the byte-level vocabulary at ``model``, with an ``end`` id; NULL is an empty text."""

    def ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        from popstat.llm.encoding import encoder

        last = np.array([end], np.uint32)
        for ids in encoder(model).encode(batch.column("_payload")):
            yield np.concatenate((ids, last))

    return ids_of
