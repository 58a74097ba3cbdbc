"""Column functions over genotypes, selection effects, distributions and run metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "pack_locus", "locus_chrom", "locus_pos", "clamp", "dominance_coefficient", "mutation_effects",
    "expected_draw", "recover_dominance", "heterozygosity", "minor_allele_count", "individual_of",
    "hap_index", "rel_diff", "error_band", "kb_to_gib", "finite", "set_similarity", "per_generation",
    "copies_from_frequency", "mutation_rate", "recombination_rate", "inclusive_end",
    "LOWEST_SELECTION", "SIMILARITY_METRICS",
]

# Fixed values
LOWEST_SELECTION = -0.999999999  # selection coefficients at or below -1 are raised to this
ADDITIVE_DOMINANCE = 0.5
ZERO_SELECTION = 1e-15
SMALL_REFERENCE = 1e-12
SIMILARITY_METRICS = ("jaccard", "dice", "overlap")


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _value(value) -> Column:
    """A column as is, a name as a column, a number (or None) as a DOUBLE literal."""
    if isinstance(value, (Column, str)):
        return _col(value)
    return F.lit(value).cast("double")


def pack_locus(chrom, pos) -> Column:
    """Chromosome in the high 32 bits, position in the low 32; a position beyond them is an error."""
    pos = _col(pos).cast("long")
    packed = F.shiftleft(_col(chrom).cast("long"), 32).bitwiseOR(pos)
    beyond = (pos < 0) | (pos > 4294967295)
    return F.when(beyond, F.raise_error(F.lit("position outside 32 bits")).cast("long")).otherwise(packed)


def locus_chrom(locus) -> Column:
    return F.shiftrightunsigned(_col(locus), 32).cast("int")


def locus_pos(locus) -> Column:
    return _col(locus).bitwiseAND(F.lit(4294967295))


def clamp(x, low, high) -> Column:
    """``x`` limited to [low, high]; a NULL bound is open and NaN stays NaN.

    NaN is tested first because Spark orders it above every number.
    """
    x, low, high = _value(x), _value(low), _value(high)
    return F.when(F.isnan(x), x).when(x < low, low).when(x > high, high).otherwise(x)


def dominance_coefficient(kind, p1, p2, p3, p4, s, draw) -> Column:
    """h by model: additive; fixed(p1); linear p1 + p2*s kept in [p3, p4]; distributed = ``draw``."""
    kind = _col(kind)
    return (
        F.when(kind == "additive", F.lit(ADDITIVE_DOMINANCE))
        .when(kind == "fixed", _value(p1))
        .when(kind == "linear", clamp(_value(p1) + _value(p2) * _value(s), p3, p4))
        .when(kind == "distributed", _value(draw))
    )


def mutation_effects(s, h, additive) -> Column:
    """STRUCT<s, hom_factor, het_factor, masking> of a mutation."""
    raw, h = _value(s), _value(h)
    s = F.when(raw <= -1.0, F.lit(LOWEST_SELECTION)).otherwise(raw)
    masking = F.when(_col(additive), F.lit(0.0)).otherwise(s * (F.lit(0.5) - h))
    return F.struct(
        s.alias("s"),
        (F.lit(1.0) + s).alias("hom_factor"),
        (F.lit(1.0) + h * s).alias("het_factor"),
        masking.alias("masking"),
    )


def expected_draw(kind, p1, p2, low=None, high=None) -> Column:
    """Mean of a distribution, kept within its clamp."""
    kind, p1, p2 = _col(kind), _value(p1), _value(p2)
    beta = F.when(p1 + p2 > 0.0, p1 / (p1 + p2)).otherwise(F.lit(0.5))
    mean = (
        F.when(kind == "uniform", F.lit(0.5) * (p1 + p2))
        .when(kind == "beta", beta)
        .when(kind.isin("constant", "normal", "exponential", "gamma"), p1)
    )
    return clamp(mean, low, high)


def recover_dominance(kind, p1, p2, p3, p4, s, het_factor, fallback) -> Column:
    """STRUCT<h, used_fallback>: dominance recovered from the stored effects.

    The declared rule wins; otherwise h = (het - 1) / s, and ``fallback`` (the
    mean of the dominance distribution) where s is too close to zero.
    """
    kind, s = _col(kind), _value(s)
    neutral = (kind == "distributed") & (F.abs(s) <= ZERO_SELECTION)
    ratio = F.try_divide(_value(het_factor) - F.lit(1.0), s)
    h = dominance_coefficient(kind, p1, p2, p3, p4, s, F.when(neutral, _value(fallback)).otherwise(ratio))
    return F.struct(h.alias("h"), F.coalesce(neutral, F.lit(False)).alias("used_fallback"))


def heterozygosity(copies, n_hap) -> Column:
    """2q(1-q) with q = copies / n_hap."""
    q = _col(copies).cast("double") / _col(n_hap).cast("double")
    return F.lit(2.0) * q * (F.lit(1.0) - q)


def minor_allele_count(copies, n_hap) -> Column:
    return F.least(_col(copies), _col(n_hap) - _col(copies))


def individual_of(hap) -> Column:
    return F.shiftright(_col(hap).cast("long"), 1)


def hap_index(hap) -> Column:
    return F.pmod(_col(hap), F.lit(2)).cast("long")


def rel_diff(a, b) -> Column:
    """|a-b| relative to |b|, or absolute where b is practically zero."""
    a, b = _value(a), _value(b)
    return F.abs(a - b) / F.when(F.abs(b) > SMALL_REFERENCE, F.abs(b)).otherwise(F.lit(1.0))


def error_band(x) -> Column:
    """0 below 1 %, 1 below 5 %, 2 below 10 %, else 3; a missing error is band 0."""
    x = F.coalesce(_value(x), F.lit(0.0))
    return F.when(x >= 0.10, 3).when(x >= 0.05, 2).when(x >= 0.01, 1).otherwise(0)


def finite(x) -> Column:
    """True for a number that is not NULL, NaN or infinite."""
    x = _value(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def kb_to_gib(text) -> Column:
    """Kilobytes as text to GiB; NULL where the text is not a number."""
    return _col(text).try_cast("double") / F.lit(1024.0 * 1024.0)


def set_similarity(size_a, size_b, shared, metric: str) -> Column:
    """Jaccard, Dice or overlap of two sets; 1 if both are empty, 0 if one is."""
    a, b, i = (_col(c).cast("double") for c in (size_a, size_b, shared))
    if metric == "jaccard":
        ratio = i / (a + b - i)
    elif metric == "dice":
        ratio = F.lit(2.0) * i / (a + b)
    elif metric == "overlap":
        ratio = i / F.least(a, b)
    else:
        raise ValueError(f"unknown similarity metric: {metric}")
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(ratio)


def per_generation(total_sec, generations) -> Column:
    """STRUCT<avg_sec_per_gen, ms_per_gen>."""
    average = _value(total_sec) / _col(generations).cast("double")
    return F.struct(average.alias("avg_sec_per_gen"), (average * F.lit(1000.0)).alias("ms_per_gen"))


def copies_from_frequency(freq, n_hap) -> Column:
    return F.round(_value(freq) * _col(n_hap).cast("double")).cast("long")


def mutation_rate(mu, scale) -> Column:
    """Per-base mutation rate of a region."""
    return _value(mu) * _value(scale)


def recombination_rate(rho, scale, total_mass) -> Column:
    """Per-base recombination rate of an interval; 0 where the map has no mass."""
    mass = _value(total_mass)
    return F.when(mass > 0.0, _value(rho) * _value(scale) / mass).otherwise(F.lit(0.0))


def inclusive_end(end) -> Column:
    """Last base of a half-open interval."""
    return _col(end) - F.lit(1)
