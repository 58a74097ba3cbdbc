"""Near-duplicate run logs by SimHash fingerprints that meet in the middle of their Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popstat.llm.components import connected_components
from popstat.session import cut_lineage

SEED = 42
CHUNK = 1 << 16
HALF = 32


def fingerprint(log: str | None, words_per_shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the log's word shingles, as a signed 64-bit number."""
    words = (log or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    width = min(words_per_shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = words[i : min(i + CHUNK, n) + width - 1]
        shingles = zip(*(part[j:] for j in range(width)))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > n, bitorder="little").view("<i8")
    return int(value[0])


def log_fingerprints(logs: DataFrame, words: int = 3, run_id: str = "run_id", log: str = "log") -> DataFrame:
    """``run_id`` and ``fingerprint`` of every row of ``logs``; a NULL or wordless log has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["_run", "_print"])

    texts = logs.select(F.col(run_id).alias("_run"), F.col(log).cast("string").alias("_log"))
    kind = texts.schema["_run"].dataType.simpleString()
    return texts.mapInArrow(run, f"_run {kind}, _print long").toDF(run_id, "fingerprint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[list[int]]) -> Column:
    masks = [_signed(sum(1 << b for b in chosen)) for chosen in bits]
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))


def _half(fingerprint: Column, side: int) -> Column:
    return F.shiftrightunsigned(fingerprint, HALF) if side else fingerprint.bitwiseAND(F.lit((1 << HALF) - 1))


def fingerprint_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (one column ``p``) that connect all at most ``radius`` bits apart.

    Every fingerprint emits its variants of at most one flipped bit, which brings together
    those one or two bits apart. Three bits apart means one fingerprint has an even and
    one an odd number of ones, and two of the three bits lie in one half of the word; so
    only even ones emit variants of two flipped bits, only within a half, and only if an
    odd one's other half is equal or one bit off, which a semi-join on halves tells
    beforehand. All that share a variant with one that reaches it by one flip lie within
    the radius of it, so each is linked to the smallest such and no pairs are listed. A
    variant has at most 2081 fingerprints around it whatever the data. Each link is
    verified by its bit count.
    """
    if radius not in (2, 3):
        raise ValueError("radius is 2 or 3")
    near = prints.select("p", _flips([[], *[[b] for b in range(64)]]).alias("m")).select(
        "p", F.col("m").bitwiseXOR(F.col("p")).alias("v"), F.lit(True).alias("near")
    )
    variants = near
    if radius == 3:
        odd = F.bit_count("p") % 2 == 1
        for side in (0, 1):
            # the half that keeps its bits in the even one's variant, and at most one bit of the odd one off
            flips = [[], *[[b] for b in range(HALF)]]
            kept = prints.where(odd).select(_half(F.col("p"), side).alias("h"), _flips(flips).alias("m"))
            kept = kept.select(F.col("h").bitwiseXOR(F.col("m")).alias("h")).distinct()
            even = prints.where(~odd).select("p", _half(F.col("p"), side).alias("h")).join(kept, "h", "left_semi")
            first = 0 if side else HALF
            pairs = [[i, j] for i in range(first, first + HALF) for j in range(i + 1, first + HALF)]
            far = even.select("p", _flips(pairs).alias("m"))
            variants = variants.unionByName(
                far.select("p", F.col("m").bitwiseXOR(F.col("p")).alias("v"), F.lit(False).alias("near"))
            )
    hub = F.min(F.when(F.col("near"), F.col("p"))).over(Window.partitionBy("v"))
    met = variants.select("p", hub.alias("hub")).where("p != hub")
    return met.where(F.bit_count(F.col("p").bitwiseXOR(F.col("hub"))) <= radius).select(
        F.col("p").alias("a"), F.col("hub").alias("b")
    ).distinct()


def near_duplicate_logs(
    logs: DataFrame, radius: int = 3, words: int = 3, run_id: str = "run_id", log: str = "log"
) -> DataFrame:
    """Class of near-duplicate logs of every run.

    ``logs`` has ``run_id`` and the whole text ``log``. Result, one row per input row:
    ``run_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest
    run_id that chains of fingerprints at most ``radius`` bits apart reach, itself included.
    Logs are lower-cased in A-Z and cut at ASCII white space; a log shorter than a shingle
    is one shingle; NULL, empty and wordless logs have fingerprint zero and are linked like
    any other. Repeated rows stay; a NULL run_id never is a component id unless its class
    has no other. Other columns are ignored; an empty table gives an empty result.

    Equal fingerprints are one node, so copies are never compared with each other.
    """
    prints = cut_lineage(log_fingerprints(logs, words, run_id, log).toDF("_run", "p"))
    nodes = cut_lineage(prints.groupBy("p").agg(F.min("_run").alias("_first")))
    links = fingerprint_links(nodes.select("p"), radius)
    classes = connected_components(nodes.select("p"), links, "p", "a", "b")
    named = nodes.join(classes, "p")
    smallest = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    answer = named.select("p", "component").join(smallest, "component").select("p", "component_id")
    digits = F.lpad(F.lower(F.hex("p")), 16, "0").alias("fingerprint")
    return prints.join(answer, "p").select(F.col("_run").alias(run_id), digits, "component_id")
