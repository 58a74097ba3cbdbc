"""Haplotypes of populations repeated to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import dense_range
from popstat.session import cut_lineage

#: A mean is split into equal parts of at most this, each drawn on its own: their sum has the same distribution.
LARGEST_MEAN = 16.0
#: With a mean of at most 16, larger counts have a probability below one in 2**60.
LARGEST_COUNT = 80


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in any engine; NULL parts are empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Distribution function at 0, 1, .. LARGEST_COUNT of a Poisson variable with a mean of at most LARGEST_MEAN."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST_COUNT)), start, step, lambda state: state["all"])


def repetition_rates(haplotypes: DataFrame, targets: DataFrame, total: int | None, population: str) -> DataFrame:
    """``_population``, the number of ``parts`` and the table ``cdf`` of each; populations without a positive weight are missing."""
    sizes = haplotypes.groupBy(F.col(population).alias("_population")).agg(F.count(F.lit(1)).alias("n"))
    weights = targets.groupBy(F.col(population).alias("_target")).agg(F.sum("weight").alias("weight"))
    sizes, weights = cut_lineage(sizes), weights.where("weight > 0 and weight < double('infinity')")
    known = sizes.join(weights, sizes["_population"].eqNullSafe(weights["_target"]))
    known = cut_lineage(known.select("_population", "n", F.col("weight").cast("double").alias("weight")))
    all_ = known.agg(F.sum("weight")).first()[0] or 1.0
    rows = total if total is not None else (sizes.agg(F.sum("n")).first()[0] or 0)
    mean = F.col("weight") / F.lit(float(all_)) * F.lit(float(rows)) / F.col("n")
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN), F.lit(1)).cast("long")
    drawn = known.select("_population", mean.alias("mean"), parts.alias("parts"))
    return cut_lineage(drawn.select("_population", "mean", "parts", poisson_table(F.col("mean") / F.col("parts")).alias("cdf")))


def replicate_haplotypes(
    haplotypes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42,
    population: str = "population", haplotype_id: str = "haplotype_id",
) -> DataFrame:
    """``haplotypes`` repeated so that populations have shares proportional to ``targets``, in shuffled order.

    ``targets`` has ``population`` and ``weight``; weights of one population add up. The
    expected number of rows is ``total``, by default that of the input. A haplotype of a
    population with n rows and share w is repeated k times, k Poisson with mean
    w * total / n, by inversion at a hash of ``haplotype_id`` and ``seed``: the same k at any
    number of partitions and after lost executors. Every copy keeps all columns and gets
    ``replicate`` (0 .. k-1) and ``shuffle_key``; rows are dealt to partitions by the hash
    of that key and ordered by it, so neighbours are unrelated.

    Populations without a positive, finite weight give no rows. NULL is a population of its
    own; NULL ids count as one id; repeated rows and ids share their k and each is repeated.
    Columns named ``replicate`` or ``shuffle_key`` are replaced; empty tables give no rows.
    """
    rates = repetition_rates(haplotypes, targets, total, population)
    named = haplotypes.drop("replicate", "shuffle_key")
    joined = named.join(rates, named[population].eqNullSafe(rates["_population"])).drop("_population")
    uniform = lambda part: hashed_uniform(F.lit(seed), F.col(haplotype_id), part)
    drawn = lambda part: F.size(F.filter("cdf", lambda c: c <= uniform(part))).cast("long")
    parts = F.sequence(F.lit(1).cast("long"), F.col("parts"))
    copies = F.when(F.col("parts") == 1, drawn(F.lit(1))).otherwise(
        F.aggregate(parts, F.lit(0).cast("long"), lambda k, part: k + drawn(part))
    )
    repeated = dense_range(joined.withColumn("_last", copies - 1).where("_last >= 0").drop("cdf", "parts", "mean"), "replicate", "_last")
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(haplotype_id).cast("string"), F.lit("")), F.col("replicate"))
    mixed = repeated.drop("_last").withColumn("shuffle_key", key)
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def tempered_weights(haplotypes: DataFrame, power: float, population: str = "population") -> DataFrame:
    """Targets proportional to population sizes to a power below one, which lifts small populations."""
    return haplotypes.groupBy(population).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))
