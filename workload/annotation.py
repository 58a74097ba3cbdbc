"""Queries of the genome annotation, scalar functions, ordered operators and gametes."""

from __future__ import annotations

from pyspark.sql import functions as F

from popstat import functions as fn
from popstat.operators import joins as j
from popstat.operators import windows as w
from popstat.operators.results import locus_order
from popstat.operators.statistics import genome_totals
from workload.registry import big, query, r6


@query("pack_locus", """SELECT mutation_id, CAST(chrom AS BIGINT) * 4294967296 + pos AS locus,
CAST(chrom AS BIGINT) AS chrom, pos FROM mutations_raw""")
def _(v):
    packed = v.mutations.select("mutation_id", fn.pack_locus("chrom", "pos").alias("locus"))
    return packed.select(
        "mutation_id", "locus", big(fn.locus_chrom("locus"), "chrom"), fn.locus_pos("locus").alias("pos")
    )


@query("clamp", """SELECT event_id, CASE WHEN value < 5 THEN 5 WHEN value > 50 THEN 50 ELSE value END AS clamped,
least(value, 80) AS open_below FROM events""")
def _(v):
    return v.table("events").select(
        "event_id", fn.clamp("value", 5, 50).alias("clamped"), fn.clamp("value", None, 80).alias("open_below")
    )


@query("dominance_coefficient", """SELECT type_id, round(CASE dom_kind WHEN 'additive' THEN 0.5
WHEN 'fixed' THEN dom_p1 WHEN 'distributed' THEN draw
ELSE CASE WHEN dom_p1 + dom_p2 * s < dom_p3 THEN dom_p3 WHEN dom_p1 + dom_p2 * s > dom_p4 THEN dom_p4
     ELSE dom_p1 + dom_p2 * s END END, 6) AS h FROM mutation_types""")
def _(v):
    h = fn.dominance_coefficient("dom_kind", "dom_p1", "dom_p2", "dom_p3", "dom_p4", "s", "draw")
    return v.mutation_types.select("type_id", r6(h, "h"))


@query("mutation_effects", """SELECT type_id, round(f, 9) AS s, round(1 + f, 6) AS hom_factor,
round(1 + draw * f, 6) AS het_factor,
round(CASE WHEN dom_kind = 'additive' THEN 0 ELSE f * (0.5 - draw) END, 6) AS masking
FROM (SELECT *, CASE WHEN s * 12 <= -1 THEN CAST(-0.999999999 AS DOUBLE) ELSE s * 12 END AS f
      FROM mutation_types)""")
def _(v):
    e = fn.mutation_effects(F.col("s") * 12, "draw", F.col("dom_kind") == "additive")
    return v.mutation_types.select("type_id", e.alias("e")).select(
        "type_id", F.round("e.s", 9).alias("s"), r6("e.hom_factor", "hom_factor"),
        r6("e.het_factor", "het_factor"), r6("e.masking", "masking"),
    )


_EXPECTED = """CASE sel_kind WHEN 'uniform' THEN 0.5 * (sel_p1 + sel_p2)
WHEN 'beta' THEN CASE WHEN sel_p1 + sel_p2 > 0 THEN sel_p1 / (sel_p1 + sel_p2) ELSE 0.5 END ELSE sel_p1 END"""


@query("expected_draw", f"""SELECT type_id, round(CASE WHEN m < sel_min THEN sel_min WHEN m > sel_max THEN sel_max
ELSE m END, 6) AS expected FROM (SELECT *, {_EXPECTED} AS m FROM mutation_types)""")
def _(v):
    expected = fn.expected_draw("sel_kind", "sel_p1", "sel_p2", "sel_min", "sel_max")
    return v.mutation_types.select("type_id", r6(expected, "expected"))


@query("recover_dominance", """SELECT type_id, round(CASE dom_kind WHEN 'additive' THEN 0.5
WHEN 'fixed' THEN dom_p1
WHEN 'linear' THEN CASE WHEN dom_p1 + dom_p2 * s < dom_p3 THEN dom_p3
     WHEN dom_p1 + dom_p2 * s > dom_p4 THEN dom_p4 ELSE dom_p1 + dom_p2 * s END
ELSE CASE WHEN abs(s) > 1e-15 THEN (1 + draw * s - 1) / s ELSE dom_p4 END END, 6) AS h,
dom_kind = 'distributed' AND abs(s) <= 1e-15 AS used_fallback FROM mutation_types""")
def _(v):
    het = F.lit(1.0) + F.col("draw") * F.col("s")
    r = fn.recover_dominance("dom_kind", "dom_p1", "dom_p2", "dom_p3", "dom_p4", "s", het, "dom_p4")
    return v.mutation_types.select("type_id", r.alias("r")).select("type_id", r6("r.h", "h"), "r.used_fallback")


@query("heterozygosity", """SELECT population, mutation_id,
round(2 * (copies / CAST(n_hap AS DOUBLE)) * (1 - copies / CAST(n_hap AS DOUBLE)), 6) AS het,
least(copies, n_hap - copies) AS minor FROM sites""")
def _(v):
    return v.sites.select(
        "population", "mutation_id", r6(fn.heterozygosity("copies", "n_hap"), "het"),
        fn.minor_allele_count("copies", "n_hap").alias("minor"),
    )


@query("minor_allele_count", """SELECT population, least(copies, n_hap - copies) AS minor, count(*) AS n
FROM sites GROUP BY 1, 2""")
def _(v):
    minor = fn.minor_allele_count("copies", "n_hap").alias("minor")
    return v.sites.groupBy("population", minor).agg(F.count(F.lit(1)).alias("n"))


@query("individual_of", """SELECT haplotype_id, haplotype_id // 2 AS individual_id, haplotype_id % 2 AS hap_index
FROM haplotypes""")
def _(v):
    return v.haplotypes.select(
        "haplotype_id", fn.individual_of("haplotype_id").alias("individual_id"),
        fn.hap_index("haplotype_id").alias("hap_index"),
    )


@query("copies_from_frequency", """SELECT population, mutation_id, copies,
CAST(round((copies / CAST(n_hap AS DOUBLE)) * n_hap) AS BIGINT) AS from_frequency FROM sites""")
def _(v):
    freq = F.col("copies") / F.col("n_hap").cast("double")
    return v.sites.select(
        "population", "mutation_id", "copies", fn.copies_from_frequency(freq, "n_hap").alias("from_frequency")
    )


@query("set_similarity", """SELECT event_id,
round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE i / CAST(a + b - i AS DOUBLE) END, 6) AS jaccard,
round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE 2 * i / CAST(a + b AS DOUBLE) END, 6) AS dice,
round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE i / CAST(least(a, b) AS DOUBLE) END, 6)
AS overlap FROM (SELECT event_id, user_id % 5 AS a, event_id % 7 AS b, least(user_id % 5, event_id % 7) // 2 AS i
FROM events)""")
def _(v):
    a, b = F.col("user_id") % 5, F.col("event_id") % 7
    sized = v.table("events").select("event_id", a.alias("a"), b.alias("b"), F.floor(F.least(a, b) / 2).alias("i"))
    return sized.select("event_id", *[r6(fn.set_similarity("a", "b", "i", m), m) for m in fn.SIMILARITY_METRICS])


@query("per_base_rates", """SELECT kind, chrom, "start", last_base, round(rate * 1000000, 6) AS rate FROM (
SELECT 'mutation' AS kind, r.chrom, r."start", r."end" - 1 AS last_base, 0.00001 * t.mutation_scale AS rate
FROM regions r JOIN region_types t ON r.region_type = t.region_type
UNION ALL SELECT 'recombination', chrom, "start", "end" - 1, 2 * rate_scale /
  (SELECT sum(rate_scale * ("end" - "start")) FROM rec_intervals) FROM rec_intervals)""")
def _(v):
    last = fn.inclusive_end("end").alias("last_base")
    mutation = v.regions.join(v.region_types, "region_type").select(
        F.lit("mutation").alias("kind"), "chrom", "start", last, fn.mutation_rate(1e-5, "mutation_scale").alias("rate")
    )
    mass = v.rec_intervals.agg(F.sum(F.col("rate_scale") * (F.col("end") - F.col("start")))).scalar()
    crossing = v.rec_intervals.select(
        F.lit("recombination").alias("kind"), "chrom", "start", last,
        fn.recombination_rate(2.0, "rate_scale", mass).alias("rate"),
    )
    return mutation.unionByName(crossing).withColumn("rate", F.round(F.col("rate") * 1000000, 6))


# ---- joins ----


@query("annotate_region", """SELECT m.mutation_id, m.chrom, m.pos, r."start", r."end", r.region_type
FROM mutations_raw m JOIN regions r ON m.chrom = r.chrom AND m.pos >= r."start" AND m.pos < r."end" """)
def _(v):
    return j.annotate_region(v.mutations.select("mutation_id", "chrom", "pos"), v.regions)


@query("annotate_rec_interval", """SELECT m.mutation_id, m.chrom, m.pos, r."start", r."end",
round(r.rate_scale, 6) AS rate_scale FROM mutations_raw m
JOIN rec_intervals r ON m.chrom = r.chrom AND m.pos >= r."start" AND m.pos < r."end" """)
def _(v):
    sites = v.mutations.select("mutation_id", "chrom", "pos")
    return j.annotate_rec_interval(sites, v.rec_intervals).withColumn("rate_scale", F.round("rate_scale", 6))


@query("attach_types", """SELECT m.mutation_id, m.type, w.region_type, w.weight FROM mutations_raw m
JOIN region_weights w ON m.type = w.type""")
def _(v):
    return j.attach_types(v.mutations.select("mutation_id", "type"), v.region_weights)


@query("region_type_mix", """SELECT r.chrom, r."start", r.region_type,
round(t.mutation_scale * (r."end" - r."start"), 6) AS mutation_mass, w.type,
round(w.weight / sum(w.weight) OVER (PARTITION BY r.chrom, r."start"), 6) AS probability
FROM regions r JOIN region_types t ON r.region_type = t.region_type
JOIN region_weights w ON w.region_type = r.region_type""")
def _(v):
    mix = j.region_type_mix(v.regions, v.region_types, v.region_weights)
    return mix.select("chrom", "start", "region_type", r6("mutation_mass"), "type", r6("probability"))


@query("region_type_mix_default", """SELECT c.chrom, 0 AS "start", 'exon' AS region_type, round(2.0 * c.length, 6) AS mutation_mass,
'ECONOMY' AS type, 1.0 AS probability FROM chromosomes c
UNION ALL SELECT chrom, 1, 'intron', 0.6 * 10, type, weight / sum(weight) OVER (PARTITION BY chrom) FROM chromosomes, (
  SELECT 'LARGE' AS type, 1.0 AS weight UNION ALL SELECT 'SMALL', 3.0)
UNION ALL SELECT chrom, 11, 'hotspot', 3.5 * 5, 'ECONOMY', 1.0 FROM chromosomes""")
def _(v):
    """No regions, one region type without weights; and regions of which one type has no weights."""
    only = v.region_types.where("region_type = 'exon'")
    none = v.regions.limit(0)
    whole = j.region_type_mix(none, only, v.region_weights.limit(0), v.chromosomes, "ECONOMY")
    spots = F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("start"), F.lit(11).cast("long").alias("end"), F.lit("intron").alias("region_type")),
        F.struct(F.lit(11).cast("long").alias("start"), F.lit(16).cast("long").alias("end"), F.lit("hotspot").alias("region_type")),
    ))
    regions = v.chromosomes.select("chrom", spots.alias("r")).select("chrom", "r.*")
    weights = v.spark.createDataFrame([("intron", "LARGE", 1.0), ("intron", "SMALL", 3.0)], "region_type string, type string, weight double")
    mix = whole.unionByName(j.region_type_mix(regions, v.region_types, weights, v.chromosomes, "ECONOMY"))
    return mix.select("chrom", "start", "region_type", r6("mutation_mass"), "type", r6("probability"))


@query("genome_totals_default", """SELECT c.chrom, round(3.5 * c.length, 6) AS mutation_mass,
round(3.5 * sum(c.length) OVER (), 6) AS total_mutation_mass, CAST(c.length AS DOUBLE) AS recombination_mass FROM chromosomes c""")
def _(v):
    """No regions and no recombination intervals."""
    only = v.region_types.where("region_type = 'hotspot'")
    totals = genome_totals(v.chromosomes, v.regions.limit(0), only, v.rec_intervals.limit(0), 0.001, 2.0)
    return totals.select("chrom", r6("mutation_mass"), r6("total_mutation_mass"), r6("recombination_mass"))


@query("genome_totals", """SELECT c.chrom, c.length, round(r.mass, 6) AS recombination_mass,
round(m.mass, 6) AS mutation_mass, CAST(sum(c.length) OVER () AS BIGINT) AS total_length,
round(sum(r.mass) OVER (), 6) AS total_recombination_mass, round(sum(m.mass) OVER (), 6) AS total_mutation_mass,
round(0.001 * sum(m.mass) OVER (), 6) AS mutation_lambda, round(2 * r.mass / sum(r.mass) OVER (), 6) AS crossover_lambda
FROM chromosomes c
JOIN (SELECT chrom, sum(rate_scale * ("end" - "start")) AS mass FROM rec_intervals GROUP BY 1) r ON c.chrom = r.chrom
JOIN (SELECT chrom, sum(mutation_scale * ("end" - "start")) AS mass FROM regions JOIN region_types
      ON regions.region_type = region_types.region_type GROUP BY 1) m ON c.chrom = m.chrom""")
def _(v):
    totals = genome_totals(v.chromosomes, v.regions, v.region_types, v.rec_intervals, 0.001, 2.0)
    doubles = [c for c, t in totals.dtypes if t == "double"]
    return totals.select("chrom", "length", "total_length", *[r6(c) for c in doubles])


@query("unresolved", """SELECT DISTINCT o_custkey AS scenario, o_orderpriority AS type FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND
  substring(o_orderpriority, 1, 1) = CAST(c_nationkey % 5 + 1 AS VARCHAR))""")
def _(v):
    orders = v.table("orders").selectExpr("o_custkey AS scenario", "o_orderpriority AS type")
    refs = orders.distinct().withColumn("digit", F.substring("type", 1, 1))
    declared = v.table("customer").select(
        F.col("c_custkey").alias("scenario"), (F.col("c_nationkey") % 5 + 1).cast("string").alias("digit")
    )
    return j.unresolved(refs, declared, ["scenario", "digit"]).select("scenario", "type")


@query("mosaic", """SELECT gamete_id, chrom, pos, mutation_id, from_b FROM (
SELECT e.gamete_id, e.chrom, e.pos, e.mutation_id, e.from_b, s.start_on_b,
  (SELECT count(*) FROM breakpoints b WHERE b.gamete_id = e.gamete_id AND b.chrom = e.chrom AND b.pos < e.pos) AS k
FROM (SELECT *, false AS from_b FROM parent_a UNION ALL SELECT *, true FROM parent_b) e
JOIN start_on_b s ON s.gamete_id = e.gamete_id AND s.chrom = e.chrom)
WHERE from_b = (start_on_b <> (k % 2 = 1))""")
def _(v):
    return j.mosaic(v.parent_a, v.parent_b, v.breakpoints, v.start_on_b)


# ---- ordered operators ----


@query("cumulative_cdf", """SELECT population, item, round(cdf, 6) AS cdf, round(prev_cdf, 6) AS prev_cdf, position
FROM item_cdf""")
def _(v):
    cdf = w.cumulative_cdf(v.items, "weight", ["item"], ["population"])
    return cdf.select("population", "item", r6("cdf"), r6("prev_cdf"), "position")


@query("emission_deltas", """SELECT event_id, round(epoch(ts) - coalesce(lag(epoch(ts)) OVER w, epoch(ts)), 6)
AS dt_sec, round(epoch(ts) - first_value(epoch(ts)) OVER w, 6) AS cumul_sec
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(v):
    events = v.table("events").select("user_id", "event_id", "ts")
    deltas = w.emission_deltas(events, "ts", ["ts", "event_id"], ["user_id"])
    return deltas.select("event_id", r6("dt_sec"), r6("cumul_sec"))


@query("coverage_violations", """SELECT chrom, "start", "end", violation FROM (
SELECT *, unnest(['not contiguous', 'past the end']) AS violation FROM (
  SELECT i.*, l.length, lag(i."end", 1, 0) OVER (PARTITION BY i.chrom ORDER BY i."start", i."end") AS previous
  FROM intervals i JOIN interval_lengths l ON i.chrom = l.chrom))
WHERE (violation = 'not contiguous' AND "start" <> previous) OR (violation = 'past the end' AND "end" > length)
UNION ALL
SELECT l.chrom, max(i."start"), max(i."end"), 'does not reach the end' FROM interval_lengths l
LEFT JOIN intervals i ON i.chrom = l.chrom GROUP BY l.chrom, l.length
HAVING max(i."end") IS NULL OR max(i."end") <> l.length""")
def _(v):
    return w.coverage_violations(v.intervals, v.interval_lengths)


@query("polymorphism_ids", """SELECT mutation_id, chrom, pos,
row_number() OVER (PARTITION BY chrom ORDER BY pos, mutation_id) - 1 AS polymorphism_id FROM mutations_raw""")
def _(v):
    return w.polymorphism_ids(v.mutations.select("mutation_id", "chrom", "pos"))


@query("import_type_ids", """SELECT type_index, round(h, 6) AS h,
row_number() OVER (ORDER BY chrom, pos, mutation_id) + 6 AS import_type_id FROM (
  SELECT *, row_number() OVER (PARTITION BY type_index, h ORDER BY chrom, pos, mutation_id) AS rn FROM mutations_raw
  WHERE dom_kind IN ('distributed', 'linear')) WHERE rn = 1""")
def _(v):
    own = v.mutations.where(F.col("dom_kind").isin("distributed", "linear"))
    return w.import_type_ids(own, 6).select("type_index", r6("h"), "import_type_id")


@query("locus_order", "SELECT mutation_id, chrom, pos FROM mutations_raw ORDER BY chrom, pos, mutation_id")
def _(v):
    return locus_order(v.mutations.select("mutation_id", "chrom", "pos"))
