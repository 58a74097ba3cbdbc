"""Random draws and synthetic tables, repeatable at any number of partitions.

A draw depends on the id of its row and the seed only: uniforms come from a hash
of both, so neither the layout of the data nor a lost executor changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popstat.functions.scalars import clamp, dominance_coefficient, mutation_effects
from popstat.operators.groups import By, attach, dense_range
from popstat.operators.intervals import cdf_lookup
from popstat.operators.joins import placed_regions, type_shares
from popstat.operators.windows import cumulative_cdf
from popstat.session import cut_lineage


def uniform(key: str | Column, seed: int, stream: int = 0) -> Column:
    """Uniform draw in [0, 1) of a row, 53 bits of a hash."""
    key = F.col(key) if isinstance(key, str) else key
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(stream)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def uniform_position(start, end, u) -> Column:
    """start + floor(u * width) in [start, end)."""
    start, end, u = (F.col(c) if isinstance(c, str) else c for c in (start, end, u))
    return start + F.floor(u * (end - start))


def weighted_pick(
    items: DataFrame, weight: str, draws: DataFrame, order: Sequence[str], u: str = "u", by: By = ()
) -> DataFrame:
    """One item per draw with probability proportional to its weight.

    Where all weights of a group are equal or their sum is not positive, the pick
    is uniform: item number floor(u * n).
    """
    by = list(by)
    w = F.col(weight).cast("double")
    shape = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_items"),
        ((F.sum(w) <= 0.0) | (F.min(w) == F.max(w))).alias("_flat"),
    )
    cdf = cumulative_cdf(items, weight, order, by)
    typed = attach(draws, shape, by)
    weighted = cdf_lookup(typed.where(~F.col("_flat")), cdf, u, by)
    number = F.least(F.col("_items") - 1, F.floor(F.col(u) * F.col("_items")))
    flat = typed.where("_flat").withColumn("position", number).join(cdf, [*by, "position"])
    helpers = ["_items", "_flat", "cdf", "prev_cdf", "position"]
    return weighted.drop(*helpers).unionByName(flat.drop(*helpers))


# ---- random numbers of a row, vectorised over an Arrow batch --------------------


def _bits(seeds: np.ndarray, step: int) -> np.ndarray:
    """64 mixed bits per seed and step (the public-domain splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = seeds + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _open_uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Uniforms strictly between 0 and 1."""
    return ((_bits(seeds, step) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _gamma(seeds: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Gamma(shape, 1) by Marsaglia and Tsang (2000); rejected rows try again with fresh bits."""
    out = np.zeros(len(seeds))
    lifted = np.where(shape < 1.0, shape + 1.0, shape)
    d = lifted - 1.0 / 3.0
    left, step = np.arange(len(seeds)), 1
    while len(left):
        s = seeds[left]
        u1, u2, u3 = (_open_uniform(s, step + k) for k in range(3))
        z = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
        v = (1.0 + z / np.sqrt(9.0 * d[left])) ** 3
        good = v > 0.0
        bound = 0.5 * z**2 + d[left] * (1.0 - v + np.log(np.where(good, v, 1.0)))
        good &= np.log(u3) < bound
        out[left[good]] = d[left[good]] * v[good]
        left, step = left[~good], step + 3
    small = shape < 1.0
    out[small] *= _open_uniform(seeds[small], 0) ** (1.0 / shape[small])
    return out


def _poisson(seeds: np.ndarray, rate: np.ndarray, part: float = 400.0) -> np.ndarray:
    """Poisson counts by inversion; a large rate is drawn as a sum of parts."""
    counts = np.zeros(len(seeds), dtype=np.int64)
    parts = np.maximum(1, np.ceil(rate / part)).astype(np.int64)
    for step in range(int(parts.max(initial=0))):
        active = np.nonzero(parts > step)[0]
        mean = rate[active] / parts[active]
        u = _open_uniform(seeds[active], step)
        p = np.exp(-mean)
        total, k = p.copy(), np.zeros(len(active), dtype=np.int64)
        open_rows = (u > total) & (mean > 0)
        while open_rows.any():
            k[open_rows] += 1
            p[open_rows] *= mean[open_rows] / k[open_rows]
            grown = total + np.where(open_rows, p, 0.0)
            open_rows &= (u > grown) & ((grown > total) | (k < mean))
            total = grown
        counts[active] += k
    return counts


@F.pandas_udf(T.DoubleType())
def _gamma_or_beta(seed: pd.Series, kind: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
    seeds = seed.to_numpy().astype(np.int64).view(np.uint64)
    a, b = p1.to_numpy(dtype=float), p2.to_numpy(dtype=float)
    out = np.full(len(seed), np.nan)
    gamma = (kind == "gamma").to_numpy()
    drawn = gamma & (a != 0.0) & (b > 0.0)
    out[gamma] = 0.0
    out[drawn] = a[drawn] / b[drawn] * _gamma(seeds[drawn], b[drawn])
    beta = (kind == "beta").to_numpy()
    x = _gamma(seeds[beta], a[beta])
    y = _gamma(_bits(seeds[beta], 7), b[beta])
    out[beta] = x / np.where(x + y > 0.0, x + y, 1.0)
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def _poisson_udf(seed: pd.Series, rate: pd.Series) -> pd.Series:
    seeds = seed.to_numpy().astype(np.int64).view(np.uint64)
    return pd.Series(_poisson(seeds, rate.to_numpy(dtype=float)))


def draw(key, kind, p1, p2, low, high, seed: int, stream: int = 0) -> Column:
    """One draw per row from the distribution of the row, clamped after drawing.

    constant(p1); uniform(p1, p2); normal(mean, sd); exponential(mean); gamma(mean,
    shape), where a negative mean mirrors the draw; beta(alpha, beta).
    """
    key, kind, p1, p2 = (F.col(c) if isinstance(c, str) else c for c in (key, kind, p1, p2))
    u = uniform(key, seed, 4 * stream)
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * np.pi) * uniform(key, seed, 4 * stream + 1))
    row_seed = F.xxhash64(key, F.lit(seed), F.lit(4 * stream + 2))
    value = (
        F.when(kind == "constant", p1)
        .when(kind == "uniform", p1 + u * (p2 - p1))
        .when(kind == "normal", p1 + p2 * z)
        .when(kind == "exponential", -p1 * F.log(F.lit(1.0) - u))
        .when(kind.isin("gamma", "beta"), _gamma_or_beta(row_seed, kind, p1, p2))
    )
    return clamp(value, low, high)


def poisson_counts(df: DataFrame, rate: str, key: str, seed: int, name: str = "n_events") -> DataFrame:
    """A Poisson count per row."""
    row_seed = F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn(name, _poisson_udf(row_seed, F.col(rate).cast("double")))


def expand_counts(df: DataFrame, count: str, name: str = "event_index") -> DataFrame:
    """As many rows as the count says, numbered from 1."""
    some = df.where(F.col(count) > 0).withColumn("_last", F.col(count) - 1)
    return dense_range(some, name, "_last").drop("_last").withColumn(name, F.col(name) + 1)


def synthesize_mutations(
    ids: DataFrame,
    regions: DataFrame,
    region_types: DataFrame,
    region_weights: DataFrame,
    mutation_types: DataFrame,
    seed: int,
    key: str = "mutation_id",
    chromosomes: DataFrame | None = None,
    default_type: str | None = None,
) -> DataFrame:
    """A mutation per id: region by mass, type by weight, uniform position, drawn effects.

    ``default_type`` is the first declared mutation type, which a region type without
    weights has; by default the first name of ``mutation_types``. ``chromosomes`` give the
    regions of a genome in which none is placed.
    """
    mass = F.col("mutation_scale") * (F.col("end") - F.col("start"))
    placed = placed_regions(regions, region_types, chromosomes)
    if default_type is None:
        default_type = mutation_types.agg(F.min("type")).first()[0]
    weights = cut_lineage(type_shares(placed, region_weights, default_type))
    placed = cut_lineage(placed.select("chrom", "start", "end", "region_type", mass.alias("mutation_mass")))
    region_cdf = cumulative_cdf(placed, "mutation_mass", ["chrom", "start"]).drop("mutation_mass")
    type_cdf = cumulative_cdf(weights, "weight", ["type"], ["region_type"]).drop("weight")
    drawn = ids.select(key, uniform(key, seed, 100).alias("_u_region"), uniform(key, seed, 101).alias("_u_type"))
    helpers = ("cdf", "prev_cdf", "position")
    in_region = cdf_lookup(drawn, region_cdf, "_u_region").drop(*helpers)
    typed = cdf_lookup(in_region, type_cdf, "_u_type", ["region_type"]).drop(*helpers)
    c = F.col
    full = typed.join(mutation_types, "type").withColumn(
        "pos", uniform_position("start", "end", uniform(key, seed, 102))
    )
    raw_s = draw(key, "sel_kind", "sel_p1", "sel_p2", "sel_min", "sel_max", seed, 30)
    dist = c("dom_dist")
    h_draw = draw(key, dist["kind"], dist["p1"], dist["p2"], dist["min_value"], dist["max_value"], seed, 40)
    full = full.withColumn("_s", raw_s).withColumn("_draw", h_draw)
    h = dominance_coefficient("dom_kind", "dom_p1", "dom_p2", "dom_p3", "dom_p4", "_s", "_draw")
    full = full.withColumn("h", h)
    full = full.withColumn("_e", mutation_effects("_s", "h", c("dom_kind") == "additive"))
    return full.select(key, "chrom", "pos", "type", "_e.s", "h", "_e.hom_factor", "_e.het_factor", "_e.masking")


# ---- run grids -----------------------------------------------------------------


def seed_list(df: DataFrame, replicates: str = "replicates") -> DataFrame:
    """Numbered seeds 101, 202, 303, ... for the replicates of each row."""
    numbered = expand_counts(df, replicates, "replicate")
    return numbered.withColumn("seed", F.col("replicate") * F.lit(101))


def expand_run_grid(
    cases: DataFrame, builders: Sequence[str], threads: Sequence[int], overrides: DataFrame | None = None
) -> DataFrame:
    """Case x builder x threads x seed; ``overrides`` (case_label, threads array) replaces the thread list.

    The lists are short and are exploded from each case row.
    """
    default = F.array(*[F.lit(t).cast("long") for t in threads])
    listed = cases.withColumn("_threads", default)
    if overrides is not None:
        own = overrides.select("case_label", F.col("threads").cast("array<bigint>").alias("_own"))
        listed = cases.join(own, "case_label", "left").withColumn("_threads", F.coalesce("_own", default)).drop("_own")
    gridded = listed.withColumn("alias_builder", F.explode(F.array(*[F.lit(b) for b in builders])))
    gridded = gridded.withColumn("threads", F.explode("_threads")).drop("_threads")
    return seed_list(gridded)
