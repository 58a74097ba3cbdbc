"""Queries of the population statistics, fitness, similarity and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from popstat.operators import statistics as st
from popstat.operators.filters import classify, fixed, segregating
from popstat.operators.joins import attach_mutations, distinct_carried, merge_sources, zero_fill, zygosity
from popstat.operators.schedules import expand_schedules
from popstat.operators.similarity import (
    haplotype_overlaps,
    mean_pairwise_similarity,
    pair_set_sizes,
    pairwise_similarities,
    sampled_pairwise_similarity,
    segregating_carriers,
)
from popstat.operators.windows import cumulative_fixed
from popstat.plans.panel import stat_panel
from workload.registry import query, r6
from workload.views import POPULATION, Views

P = POPULATION


def _pop(v: Views):
    return v.carriers, v.haplotypes


@query("copy_counts", "SELECT population, mutation_id, count(*) AS copies FROM carriers GROUP BY 1, 2")
def _(v):
    return st.copy_counts(v.carriers, P)


@query("segregating", "SELECT population, mutation_id, copies, n_hap FROM segregating")
def _(v):
    return segregating(v.sites)


@query("fixed", "SELECT population, mutation_id, copies, n_hap FROM sites WHERE copies = n_hap")
def _(v):
    return fixed(v.sites)


@query("classify", """
SELECT g.generation, m.mutation_id, coalesce(c.copies, 0) AS copies,
       CASE WHEN coalesce(c.copies, 0) = 0 THEN 'lost' WHEN c.copies = g.n_hap THEN 'fixed'
            ELSE 'segregating' END AS status
FROM (SELECT generation, count(*) AS n_hap FROM haplotypes_g GROUP BY 1) g
JOIN mutations_raw m ON true
LEFT JOIN (SELECT generation, mutation_id, count(*) AS copies FROM carriers_g GROUP BY 1, 2) c
     ON c.generation = g.generation AND c.mutation_id = m.mutation_id""")
def _(v):
    by = ["generation"]
    counts = st.copy_counts(v.carriers_g, by)
    totals = st.haplotype_totals(v.haplotypes_g, by)
    return classify(v.mutations.select("mutation_id"), counts, totals, by).select(
        "generation", "mutation_id", "copies", "status"
    )


@query("n_seg", """SELECT t.population, count(s.copies) AS n_seg FROM totals t
LEFT JOIN segregating s ON t.population = s.population GROUP BY 1""")
def _(v):
    return st.n_seg(*_pop(v), P)


@query("n_fixed", """SELECT t.population, count(s.copies) AS n_fixed FROM totals t
LEFT JOIN sites s ON t.population = s.population AND s.copies = s.n_hap GROUP BY 1""")
def _(v):
    return st.n_fixed(*_pop(v), P)


@query("genome_words", """SELECT t.population, count(c.mutation_id) AS genome_words FROM totals t
LEFT JOIN carriers c ON t.population = c.population GROUP BY 1""")
def _(v):
    return st.genome_words(*_pop(v), P)


@query("zygosity", """SELECT population, individual_id, mutation_id, dose,
CASE WHEN dose > 1 THEN 'hom' ELSE 'het' END AS zygosity FROM doses""")
def _(v):
    return zygosity(v.carriers, P)


@query("distinct_carried", "SELECT DISTINCT haplotype_id // 2 AS individual_id, mutation_id FROM carriers")
def _(v):
    return distinct_carried(v.carriers)


@query("attach_mutations", """SELECT c.haplotype_id, c.mutation_id, m.chrom, m.pos, m.type,
round(m.hom_factor, 6) AS hom_factor FROM carriers c JOIN mutations m ON c.mutation_id = m.mutation_id""")
def _(v):
    return attach_mutations(v.everyone[0], v.mutations).select(
        "haplotype_id", "mutation_id", "chrom", "pos", "type", r6("hom_factor")
    )


@query("individual_fitness", "SELECT population, individual_id, round(fitness, 6) AS fitness FROM individuals")
def _(v):
    return st.individual_fitness(*_pop(v), v.mutations, P).select("population", "individual_id", r6("fitness"))


@query("homozygous_fitness", """SELECT population, individual_id,
round(homozygous_fitness, 6) AS homozygous_fitness FROM individuals""")
def _(v):
    return st.homozygous_fitness(*_pop(v), v.mutations, P).select(
        "population", "individual_id", r6("homozygous_fitness")
    )


@query("fixed_fitness_factor", """SELECT population,
round(fixed_fitness_factor, 6) AS fixed_fitness_factor FROM factors""")
def _(v):
    return st.fixed_fitness_factor(*_pop(v), v.mutations, P).select("population", r6("fixed_fitness_factor"))


@query("mean_fitness", "SELECT population, round(mean_fitness, 6) AS mean_fitness FROM fitness")
def _(v):
    return st.mean_fitness(*_pop(v), v.mutations, P).select("population", r6("mean_fitness"))


@query("genetic_load", "SELECT population, round(1 - mean_fitness, 6) AS genetic_load FROM fitness")
def _(v):
    return st.genetic_load(*_pop(v), v.mutations, P).select("population", r6("genetic_load"))


@query("realized_masking_bonus", """SELECT population,
round(realized_masking_bonus, 6) AS realized_masking_bonus FROM fitness""")
def _(v):
    return st.realized_masking_bonus(*_pop(v), v.mutations, P).select("population", r6("realized_masking_bonus"))


_HET = """2 * (s.copies / CAST(s.n_hap AS DOUBLE)) * (1 - s.copies / CAST(s.n_hap AS DOUBLE))"""


@query("exact_B", f"""SELECT t.population, round(coalesce(sum(m.masking * {_HET}), 0), 6) AS exact_b
FROM totals t LEFT JOIN segregating s ON t.population = s.population
LEFT JOIN mutations m ON s.mutation_id = m.mutation_id GROUP BY 1""")
def _(v):
    return st.exact_B(*_pop(v), v.mutations, P).select("population", r6("exact_B", "exact_b"))


@query("nucleotide_diversity", f"""SELECT t.population,
round(coalesce(sum({_HET}), 0) / (SELECT sum(length) FROM chromosomes), 6) AS nucleotide_diversity
FROM totals t LEFT JOIN segregating s ON t.population = s.population GROUP BY 1""")
def _(v):
    return st.nucleotide_diversity(*_pop(v), v.chromosomes, P).select("population", r6("nucleotide_diversity"))


@query("expected_heterozygosity", f"""SELECT t.population,
round(coalesce(avg({_HET}), 0), 6) AS expected_heterozygosity
FROM totals t LEFT JOIN segregating s ON t.population = s.population GROUP BY 1""")
def _(v):
    return st.expected_heterozygosity(*_pop(v), P).select("population", r6("expected_heterozygosity"))


@query("heterozygosity_family", f"""SELECT t.population, round(coalesce(sum(m.masking * {_HET}), 0), 6) AS exact_b,
round(coalesce(sum({_HET}), 0) / (SELECT sum(length) FROM chromosomes), 6) AS nucleotide_diversity,
round(coalesce(avg({_HET}), 0), 6) AS expected_heterozygosity
FROM totals t LEFT JOIN segregating s ON t.population = s.population
LEFT JOIN mutations m ON s.mutation_id = m.mutation_id GROUP BY 1""")
def _(v):
    h = st.heterozygosity_summary(*_pop(v), v.mutations, v.chromosomes, P)
    return h.select(
        "population", r6("exact_B", "exact_b"), r6("nucleotide_diversity"), r6("expected_heterozygosity")
    )


@query("mutation_histogram_by_type", """SELECT t.population, u.type, count(s.mutation_id) AS n_sites
FROM totals t JOIN (SELECT DISTINCT p_type AS type FROM part) u ON true
LEFT JOIN (SELECT g.population, g.mutation_id, m.type FROM segregating g
           JOIN mutations m ON g.mutation_id = m.mutation_id) s ON s.population = t.population AND s.type = u.type
GROUP BY 1, 2""")
def _(v):
    return st.mutation_histogram_by_type(*_pop(v), v.mutations, v.types, P)


@query("mutation_histogram_by_chromosome", """SELECT t.population, u.chrom, count(s.mutation_id) AS n_sites
FROM totals t JOIN chromosomes u ON true
LEFT JOIN (SELECT g.population, g.mutation_id, m.chrom FROM segregating g
           JOIN mutations m ON g.mutation_id = m.mutation_id) s ON s.population = t.population AND s.chrom = u.chrom
GROUP BY 1, 2""")
def _(v):
    return st.mutation_histogram_by_chromosome(*_pop(v), v.mutations, v.chromosomes, P)


@query("mutation_histograms", """SELECT t.population, u.dimension, u.bin, count(s.mutation_id) AS n_sites
FROM totals t JOIN (SELECT DISTINCT 'type' AS dimension, p_type AS bin FROM part
    UNION ALL SELECT 'chrom', CAST(chrom AS VARCHAR) FROM chromosomes) u ON true
LEFT JOIN (SELECT g.population, g.mutation_id, m.type, CAST(m.chrom AS VARCHAR) AS chrom FROM segregating g
           JOIN mutations m ON g.mutation_id = m.mutation_id) s
    ON s.population = t.population AND u.bin = CASE u.dimension WHEN 'type' THEN s.type ELSE s.chrom END
GROUP BY 1, 2, 3""")
def _(v):
    return st.mutation_histograms(*_pop(v), v.mutations, v.types, v.chromosomes, P)


@query("sfs_unfolded", """SELECT t.population, t.bin, count(s.mutation_id) AS n_sites
FROM (SELECT population, unnest(range(n_hap + 1)) AS bin FROM totals) t
LEFT JOIN segregating s ON s.population = t.population AND s.copies = t.bin GROUP BY 1, 2""")
def _(v):
    return st.sfs_unfolded(*_pop(v), P)


@query("sfs_folded", """SELECT t.population, t.bin, count(s.mutation_id) AS n_sites
FROM (SELECT population, unnest(range(n_hap // 2 + 1)) AS bin FROM totals) t
LEFT JOIN segregating s ON s.population = t.population AND least(s.copies, s.n_hap - s.copies) = t.bin
GROUP BY 1, 2""")
def _(v):
    return st.sfs_folded(*_pop(v), P)


@query("sfs_unfolded_all", """SELECT u.bin, count(s.mutation_id) AS n_sites
FROM (SELECT unnest(range(n + 1)) AS bin FROM n_haplotypes) u
LEFT JOIN (SELECT l_partkey AS mutation_id, count(DISTINCT l_suppkey) AS copies FROM lineitem GROUP BY 1) s
     ON s.copies = u.bin AND s.copies < (SELECT n FROM n_haplotypes) GROUP BY 1""")
def _(v):
    return st.sfs_unfolded(*v.everyone)


@query("zero_fill", """SELECT s.haplotype_id, count(c.mutation_id) AS n_mutations FROM haplotypes s
LEFT JOIN carriers c ON c.haplotype_id = s.haplotype_id GROUP BY 1""")
def _(v):
    carried = v.carriers.groupBy("haplotype_id").agg(F.count(F.lit(1)).alias("n_mutations"))
    return zero_fill(carried, v.haplotypes.select("haplotype_id"), ["haplotype_id"], ["n_mutations"])


# ---- similarity ----

_PAIRS = """SELECT x.haplotype_id AS haplotype_a, y.haplotype_id AS haplotype_b, count(*) AS shared
FROM carriers x JOIN carriers y ON x.mutation_id = y.mutation_id AND x.haplotype_id < y.haplotype_id GROUP BY 1, 2"""


@query("haplotype_overlaps", _PAIRS)
def _(v):
    return haplotype_overlaps(v.everyone[0])


@query("pair_set_sizes", f"""SELECT p.*, a.n AS size_a, b.n AS size_b, a.n + b.n - p.shared AS union_size
FROM ({_PAIRS}) p JOIN (SELECT haplotype_id, count(*) AS n FROM carriers GROUP BY 1) a ON a.haplotype_id = haplotype_a
JOIN (SELECT haplotype_id, count(*) AS n FROM carriers GROUP BY 1) b ON b.haplotype_id = haplotype_b""")
def _(v):
    return pair_set_sizes(v.everyone[0])


_SETS = """(SELECT h.population, h.haplotype_id, coalesce(k.n, 0) AS n FROM haplotypes h LEFT JOIN
 (SELECT c.population, c.haplotype_id, count(*) AS n FROM carriers c JOIN segregating s
  ON c.population = s.population AND c.mutation_id = s.mutation_id GROUP BY 1, 2) k
 ON k.population = h.population AND k.haplotype_id = h.haplotype_id)"""
_SHARED = """(SELECT x.population, x.haplotype_id AS a, y.haplotype_id AS b, count(*) AS i FROM carriers x
 JOIN segregating s ON x.population = s.population AND x.mutation_id = s.mutation_id
 JOIN carriers y ON x.population = y.population AND x.mutation_id = y.mutation_id
      AND x.haplotype_id < y.haplotype_id GROUP BY 1, 2, 3)"""
_ALL_PAIRS = f"""(SELECT a.population, a.n AS na, b.n AS nb, coalesce(s.i, 0) AS i FROM {_SETS} a
 JOIN {_SETS} b ON a.population = b.population AND a.haplotype_id < b.haplotype_id
 LEFT JOIN {_SHARED} s ON s.population = a.population AND s.a = a.haplotype_id AND s.b = b.haplotype_id)"""
_METRIC = {
    "jaccard": "i / CAST(na + nb - i AS DOUBLE)",
    "dice": "2 * i / CAST(na + nb AS DOUBLE)",
    "overlap": "i / CAST(least(na, nb) AS DOUBLE)",
}


def _mean_sql(metric: str) -> str:
    formula = f"CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE {_METRIC[metric]} END"
    return f"round(coalesce(avg({formula}), 1), 6)"


def _register_similarity(metric: str) -> None:
    sql = f"""SELECT t.population, {_mean_sql(metric)} AS mean_similarity
    FROM totals t LEFT JOIN {_ALL_PAIRS} p ON p.population = t.population GROUP BY 1"""
    sql = sql.replace("avg(CASE WHEN", "avg(CASE WHEN p.na IS NULL THEN NULL WHEN")

    @query(f"mean_pairwise_{metric}", sql)
    def _(v):
        return mean_pairwise_similarity(*_pop(v), metric, P).select("population", r6("mean_similarity"))


for _metric in _METRIC:
    _register_similarity(_metric)


_VARIABLE = """(SELECT c.haplotype_id, c.mutation_id FROM carriers c JOIN (SELECT mutation_id FROM carriers GROUP BY 1
HAVING count(*) < (SELECT n FROM n_haplotypes)) k ON k.mutation_id = c.mutation_id)"""


@query("pairwise_similarities_all", f"""SELECT round(avg(i / CAST(na + nb - i AS DOUBLE)), 6) AS jaccard,
round(avg(2 * i / CAST(na + nb AS DOUBLE)), 6) AS dice, round(avg(i / CAST(least(na, nb) AS DOUBLE)), 6) AS overlap
FROM (SELECT a.n AS na, b.n AS nb, coalesce(s.i, 0) AS i
 FROM (SELECT haplotype_id, count(*) AS n FROM {_VARIABLE} GROUP BY 1) a
 JOIN (SELECT haplotype_id, count(*) AS n FROM {_VARIABLE} GROUP BY 1) b ON a.haplotype_id < b.haplotype_id
 LEFT JOIN (SELECT x.haplotype_id AS a, y.haplotype_id AS b, count(*) AS i FROM {_VARIABLE} x
   JOIN {_VARIABLE} y ON x.mutation_id = y.mutation_id AND x.haplotype_id < y.haplotype_id GROUP BY 1, 2) s
 ON s.a = a.haplotype_id AND s.b = b.haplotype_id)""")
def _(v):
    """All suppliers as one population; every one of them carries some segregating mutation."""
    return pairwise_similarities(*v.everyone).select(r6("jaccard"), r6("dice"), r6("overlap"))


@query("sampled_pairwise_similarity", """SELECT round(avg(i / CAST(na + nb - i AS DOUBLE)), 6) AS mean_similarity
FROM (SELECT d.t, a.n AS na, b.n AS nb, coalesce(s.i, 0) AS i FROM
 (SELECT c_custkey % n AS a, (c_custkey * 7 + 1) % n AS b, c_custkey AS t FROM customer JOIN n_haplotypes ON true
  WHERE c_custkey % n <> (c_custkey * 7 + 1) % n) d
 JOIN (SELECT haplotype_id, count(*) AS n FROM carriers GROUP BY 1) a ON a.haplotype_id = d.a
 JOIN (SELECT haplotype_id, count(*) AS n FROM carriers GROUP BY 1) b ON b.haplotype_id = d.b
 LEFT JOIN (SELECT x.haplotype_id AS a, y.haplotype_id AS b, count(*) AS i FROM carriers x
   JOIN carriers y ON x.mutation_id = y.mutation_id AND x.haplotype_id <> y.haplotype_id GROUP BY 1, 2) s
 ON s.a = d.a AND s.b = d.b)""")
def _(v):
    a, b = F.col("c_custkey") % v.n_haplotypes, (F.col("c_custkey") * 7 + 1) % v.n_haplotypes
    pairs = v.table("customer").select(a.alias("haplotype_a"), b.alias("haplotype_b"))
    pairs = pairs.where("haplotype_a <> haplotype_b")
    return sampled_pairwise_similarity(v.everyone[0], pairs, "jaccard").select(r6("mean_similarity"))


@query("segregating_carriers", """SELECT c.population, c.haplotype_id, c.mutation_id FROM carriers c
JOIN segregating s ON c.population = s.population AND c.mutation_id = s.mutation_id""")
def _(v):
    return segregating_carriers(*_pop(v), P)


# ---- generations ----


@query("cumulative_fixed", """SELECT generation, n_new_fixed,
CAST(sum(n_new_fixed) OVER (ORDER BY generation) AS BIGINT) AS n_fixed,
round(exp(sum(ln(new_fixed_factor)) OVER (ORDER BY generation)), 6) AS fixed_fitness_factor FROM newly_fixed""")
def _(v):
    return cumulative_fixed(v.newly_fixed).select(
        "generation", "n_new_fixed", "n_fixed", r6("fixed_fitness_factor")
    )


@query("merge_sources", """SELECT haplotype_id, m.chrom, m.pos, m.mutation_id FROM
(SELECT haplotype_id, mutation_id FROM carriers UNION ALL
 SELECT s_suppkey, s_suppkey FROM supplier) c
JOIN mutations_raw m ON c.mutation_id = m.mutation_id""")
def _(v):
    sites = v.mutations.select("mutation_id", "chrom", "pos")
    new = v.table("supplier").select(
        F.col("s_suppkey").alias("haplotype_id"), F.col("s_suppkey").alias("mutation_id")
    )
    return merge_sources(
        v.everyone[0].join(sites, "mutation_id"), new.join(sites, "mutation_id")
    ).select("haplotype_id", "chrom", "pos", "mutation_id")


@query("stat_panel", """SELECT r.generation, r.statistic, CAST(NULL AS VARCHAR) AS metric,
round(x.value, 6) AS scalar_value FROM
(SELECT DISTINCT generation, statistic FROM requests
 WHERE statistic IN ('n_seg', 'n_fixed', 'genome_words', 'expected_heterozygosity')) r JOIN
(SELECT generation, 'n_seg' AS statistic, CAST(count(*) FILTER (copies < n_hap) AS DOUBLE) AS value
 FROM sites_g GROUP BY 1
 UNION ALL SELECT generation, 'n_fixed', count(*) FILTER (copies = n_hap) FROM sites_g GROUP BY 1
 UNION ALL SELECT generation, 'genome_words', sum(copies) FROM sites_g GROUP BY 1
 UNION ALL SELECT generation, 'expected_heterozygosity',
   avg(2 * (copies / CAST(n_hap AS DOUBLE)) * (1 - copies / CAST(n_hap AS DOUBLE))) FILTER (copies < n_hap)
   FROM sites_g GROUP BY 1) x ON r.generation = x.generation AND r.statistic = x.statistic""")
def _(v):
    """Scalar rows of four statistics."""
    panel = _panel(v, ["n_seg", "n_fixed", "genome_words", "expected_heterozygosity"])
    return panel.select("generation", "statistic", "metric", r6("scalar_value"))


def _panel_pair(metric: str) -> str:
    formula = f"CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE {_METRIC[metric]} END"
    columns = f"generation, 'pairwise_similarity', '{metric}', avg({formula}), NULL, NULL, NULL, NULL"
    return f"SELECT {columns} FROM pairs_g GROUP BY 1"


_HET_G = "2 * (s.copies / CAST(s.n_hap AS DOUBLE)) * (1 - s.copies / CAST(s.n_hap AS DOUBLE))"
_FULL = f"""SELECT DISTINCT r.generation, r.statistic, r.metric, round(x.value, 6) AS scalar_value, x.by_type,
  x.by_chromosome, x.unfolded_sfs, x.folded_sfs FROM requests r JOIN (
SELECT generation, 'mean_fitness' AS statistic, NULL AS metric, mean_fitness AS value, NULL AS by_type,
  NULL AS by_chromosome, NULL AS unfolded_sfs, NULL AS folded_sfs FROM fitness_g
UNION ALL SELECT generation, 'genetic_load', NULL, 1 - mean_fitness, NULL, NULL, NULL, NULL FROM fitness_g
UNION ALL SELECT generation, 'realized_masking_bonus', NULL, realized_masking_bonus, NULL, NULL, NULL, NULL
  FROM fitness_g
UNION ALL SELECT s.generation, 'exact_B', NULL, sum(m.masking * {_HET_G}), NULL, NULL, NULL, NULL FROM segregating_g s
  JOIN mutations m ON m.mutation_id = s.mutation_id GROUP BY 1
UNION ALL SELECT s.generation, 'nucleotide_diversity', NULL, sum({_HET_G}) / (SELECT sum(length) FROM chromosomes),
  NULL, NULL, NULL, NULL FROM segregating_g s GROUP BY 1
UNION ALL SELECT s.generation, 'expected_heterozygosity', NULL, avg({_HET_G}), NULL, NULL, NULL, NULL
  FROM segregating_g s GROUP BY 1
UNION ALL SELECT generation, 'n_seg', NULL, count(*) FILTER (copies < n_hap), NULL, NULL, NULL, NULL
  FROM sites_g GROUP BY 1
UNION ALL SELECT generation, 'n_fixed', NULL, count(*) FILTER (copies = n_hap), NULL, NULL, NULL, NULL
  FROM sites_g GROUP BY 1
UNION ALL SELECT generation, 'genome_words', NULL, sum(copies), NULL, NULL, NULL, NULL FROM sites_g GROUP BY 1
UNION ALL {_panel_pair("jaccard")} UNION ALL {_panel_pair("dice")} UNION ALL {_panel_pair("overlap")}
UNION ALL SELECT t.generation, 'mutation_histogram', NULL, NULL, t.vector, c.vector, NULL, NULL FROM arrays_g t
  JOIN arrays_g c ON c.generation = t.generation AND c.dimension = 'chrom' WHERE t.dimension = 'type'
UNION ALL SELECT u.generation, 'site_frequency_spectrum', NULL, NULL, NULL, NULL, u.vector, f.vector FROM arrays_g u
  JOIN arrays_g f ON f.generation = u.generation AND f.dimension = 'folded' WHERE u.dimension = 'unfolded'
) x ON x.generation = r.generation AND x.statistic = r.statistic AND x.metric IS NOT DISTINCT FROM r.metric"""


@query("stat_panel_full", _FULL)
def _(v):
    panel = _panel(v)
    return panel.select("generation", "statistic", "metric", r6("scalar_value"),
                        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
                          for c in ("by_type", "by_chromosome", "unfolded_sfs", "folded_sfs")])


def _panel(v: Views, only: list[str] | None = None):
    requests = expand_schedules(v.schedules, 40)
    if only:  # asked twice, each time with a metric that these statistics do not have
        requests = requests.where(F.col("statistic").isin(*only)).select(
            "generation", "statistic", F.explode(F.array(F.lit("jaccard"), F.lit("dice"))).alias("metric"))
    else:
        requests = requests.select("generation", "statistic", "metric").distinct()
    return stat_panel(v.carriers_g, v.haplotypes_g, v.mutations, v.types, v.chromosomes, requests)
