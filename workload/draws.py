"""Queries of sampling, synthetic mutations and run grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from popstat.operators import sampling as sp
from popstat.operators.intervals import cdf_lookup
from popstat.operators.joins import annotate_region
from popstat.operators.windows import cumulative_cdf
from workload.registry import big, query, r6
from workload.views import Views

_BY_GROUP = "(SELECT l_orderkey, l_linenumber, l_orderkey % 25 AS population, u FROM draws)"


def _draws(v: Views):
    return v.draws.withColumn("population", F.col("l_orderkey") % 25)


# the weights of the items are whole numbers, so that running sums are exact in both engines
_LOOKUP = f"""SELECT d.population, c.item, count(*) AS n FROM {_BY_GROUP} d JOIN item_cdf c ON c.population = d.population
AND (d.u * c.total > c.prev_cdf OR c.position = 0) AND (d.u * c.total <= c.cdf OR c.position = c.n - 1) GROUP BY 1, 2"""


@query("cdf_lookup", _LOOKUP)
def _(v):
    cdf = cumulative_cdf(v.items, "weight", ["item"], ["population"])
    found = cdf_lookup(_draws(v), cdf, "u", ["population"])
    return found.groupBy("population", "item").agg(F.count(F.lit(1)).alias("n"))


@query("cdf_lookup_all", """SELECT c.item, count(*) AS n FROM draws d ASOF JOIN
(SELECT p_partkey AS item, sum(CAST(p_size AS DOUBLE)) OVER (ORDER BY p_partkey) AS cdf FROM part) c
ON d.u * (SELECT sum(p_size) FROM part) <= c.cdf GROUP BY 1""")
def _(v):
    """One table of all parts, without groups."""
    parts = v.table("part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("weight"))
    found = cdf_lookup(v.draws, cumulative_cdf(parts, "weight", ["item"]))
    return found.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("weighted_pick", f"""SELECT d.population, c.item, count(*) AS n FROM {_BY_GROUP} d
JOIN item_cdf c ON c.population = d.population AND CASE WHEN c.flat THEN c.position = least(c.n - 1, floor(d.u * c.n))
ELSE (d.u * c.total > c.prev_cdf OR c.position = 0) AND (d.u * c.total <= c.cdf OR c.position = c.n - 1) END
GROUP BY 1, 2""")
def _(v):
    picked = sp.weighted_pick(v.items, "weight", _draws(v), ["item"], by=["population"])
    return picked.groupBy("population", "item").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_position", """SELECT l_orderkey, l_linenumber,
l_linenumber * 10 + CAST(floor(u * (l_orderkey % 90 + 1)) AS BIGINT) AS pos FROM draws""")
def _(v):
    start = F.col("l_linenumber").cast("long") * 10
    end = start + F.col("l_orderkey") % 90 + 1
    return v.draws.select("l_orderkey", "l_linenumber", big(sp.uniform_position(start, end, F.col("u")), "pos"))


@query("draw")
def _(v):
    """Every distribution with valid parameters, one draw per line item."""
    kinds = ("constant", "uniform", "normal", "exponential", "gamma", "beta")
    index = (F.col("l_partkey") % 6 + 1).cast("int")
    lines = v.table("lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), index).alias("kind"),
        (F.col("l_quantity") / 50).alias("p1"), (F.col("l_discount") + 1).alias("p2"),
    )
    x = sp.draw("key", "kind", "p1", "p2", -2.0, 2.0, seed=7)
    return lines.select("key", "kind", r6(x, "x"))


@query("poisson_counts")
def _(v):
    lines = v.table("orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("rate"))
    counted = sp.poisson_counts(lines, "rate", "o_orderkey", seed=11)
    return sp.expand_counts(counted, "n_events").select("o_orderkey", "n_events", "event_index")


@query("synthesize_mutations")
def _(v):
    kind = F.col("type")
    types = v.types.select(
        "type",
        F.when(kind == "ECONOMY", "constant").when(kind == "LARGE", "gamma").when(kind == "SMALL", "normal")
        .when(kind == "PROMO", "uniform").when(kind == "MEDIUM", "exponential").otherwise("beta").alias("sel_kind"),
        F.when(kind == "LARGE", -0.02).when(kind == "PROMO", -0.1).otherwise(0.01).alias("sel_p1"),
        F.when(kind == "PROMO", 0.0).otherwise(0.3).alias("sel_p2"),
        F.lit(-0.5).alias("sel_min"), F.lit(0.5).alias("sel_max"),
        F.when(kind == "ECONOMY", "additive").when(kind == "SMALL", "linear").when(kind == "STANDARD", "distributed")
        .otherwise("fixed").alias("dom_kind"),
        F.lit(0.25).alias("dom_p1"), F.lit(2.0).alias("dom_p2"), F.lit(0.0).alias("dom_p3"), F.lit(1.0).alias("dom_p4"),
        F.when(kind == "STANDARD", F.struct(
            F.lit("beta").alias("kind"), F.lit(2.0).alias("p1"), F.lit(5.0).alias("p2"),
            F.lit(0.0).alias("min_value"), F.lit(1.0).alias("max_value"))).alias("dom_dist"),
    )
    ids = v.table("orders").select(F.col("o_orderkey").alias("mutation_id"))
    made = sp.synthesize_mutations(ids, v.regions, v.region_types, v.region_weights, types, seed=5)
    doubles = ("s", "h", "hom_factor", "het_factor", "masking")
    return made.select("mutation_id", "chrom", "pos", "type", *[r6(c) for c in doubles])


# ---- moments of draws against closed forms ----

# kind: parameters, mean, variance
_MOMENTS = {
    "constant": (0.3, 0.0, 0.3, 0.0), "uniform": (-1.0, 1.0, 0.0, 1 / 3), "normal": (0.2, 0.5, 0.2, 0.25),
    "exponential": (0.4, 0.0, 0.4, 0.16), "gamma": (-0.3, 2.0, -0.3, 0.045), "beta": (2.0, 5.0, 2 / 7, 10 / (49 * 8)),
}
_RATES = (0.5, 5.0, 60.0, 900.0)


def _agrees(mean, variance, value: str = "x"):
    """Mean within five standard errors; variance within five of its own, for a kurtosis of at most nine."""
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        (F.abs(F.avg(value) - mean) <= 5 * F.sqrt(variance / n) + 1e-9).alias("mean_agrees"),
        (F.abs(F.var_pop(value) - variance) <= 5 * variance * F.sqrt(F.lit(8.0) / n) + 1e-9).alias("variance_agrees"),
    ]


@query("draw_moments", f"""SELECT {list(_MOMENTS)}[l_partkey % 6 + 1] AS kind, count(*) AS n, true AS mean_agrees,
true AS variance_agrees FROM lineitem GROUP BY 1""")
def _(v):
    """Draws of every distribution have its mean and variance."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), *[F.lit(float(x)).alias(c) for c, x in zip(("p1", "p2", "mean", "variance"), p)])
                      for k, p in _MOMENTS.items()])
    lines = v.table("lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("k"),
    ).select("key", "k.*")
    none = F.lit(None).cast("double")
    drawn = lines.withColumn("x", sp.draw("key", "kind", "p1", "p2", none, none, seed=3))
    return drawn.groupBy("kind").agg(*_agrees(F.max("mean"), F.max("variance")))


@query("poisson_moments", f"""SELECT CAST({list(_RATES)}[o_custkey % 4 + 1] AS DOUBLE) AS rate, count(*) AS n, true AS mean_agrees,
true AS variance_agrees FROM orders GROUP BY 1""")
def _(v):
    """Counts of small and large rates have the rate as mean and variance."""
    rates = F.array(*[F.lit(r) for r in _RATES])
    orders = v.table("orders").select("o_orderkey", F.element_at(rates, (F.col("o_custkey") % 4 + 1).cast("int")).alias("rate"))
    counted = sp.poisson_counts(orders, "rate", "o_orderkey", seed=4, name="x")
    return counted.groupBy("rate").agg(*_agrees(F.max("rate"), F.max("rate")))


@query("synthesize_moments", """SELECT r.region_type, count(*) AS n_regions, true AS share_agrees, true AS inside,
(SELECT count(*) FROM orders) AS n FROM regions r GROUP BY 1""")
def _(v):
    """Every id has one mutation, inside a region, and region types get their share of the mass."""
    types = v.types.select(
        "type", F.lit("constant").alias("sel_kind"), F.lit(0.1).alias("sel_p1"), F.lit(0.0).alias("sel_p2"),
        F.lit(None).cast("double").alias("sel_min"), F.lit(None).cast("double").alias("sel_max"), F.lit("additive").alias("dom_kind"),
        F.lit(0.5).alias("dom_p1"), *[F.lit(0.0).alias(f"dom_p{i}") for i in (2, 3, 4)],
        F.lit(None).cast("struct<kind:string,p1:double,p2:double,min_value:double,max_value:double>").alias("dom_dist"),
    )
    ids = v.table("orders").select(F.col("o_orderkey").alias("mutation_id"))
    made = sp.synthesize_mutations(ids, v.regions, v.region_types, v.region_weights, types, seed=6)
    placed = annotate_region(made, v.regions).groupBy("region_type").agg(F.count(F.lit(1)).alias("found"))
    mass = F.sum(F.col("mutation_scale") * (F.col("end") - F.col("start")))
    shares = v.regions.join(v.region_types, "region_type").groupBy("region_type").agg(mass.alias("mass"), F.count(F.lit(1)).alias("n_regions"))
    total, found = (d.agg(F.sum(c)).scalar() for d, c in ((shares, "mass"), (placed, "found")))
    joined = shares.join(placed, "region_type", "left").withColumn("n", made.agg(F.count_distinct("mutation_id")).scalar())
    p = F.col("mass") / total
    return joined.select(
        "region_type", "n_regions", (F.abs(F.col("found") - F.col("n") * p) <= 5 * F.sqrt(F.col("n") * p * (1 - p)) + 1).alias("share_agrees"),
        (found == F.col("n")).alias("inside"), "n",
    )


@query("seed_list", """SELECT p_partkey, CAST(r AS BIGINT) AS replicate, CAST(CASE WHEN r <= 8 THEN
[101, 202, 303, 404, 505, 606, 707, 808][r] ELSE 909 + 101 * (r - 9) END AS BIGINT) AS seed
FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS r FROM part)""")
def _(v):
    parts = v.table("part").select("p_partkey", F.col("p_size").cast("long").alias("replicates"))
    return sp.seed_list(parts).select("p_partkey", "replicate", "seed")


@query("expand_run_grid", """SELECT p_partkey AS case_label, b AS alias_builder, CAST(t AS BIGINT) AS threads,
CAST(r AS BIGINT) AS replicate, CAST(101 * r AS BIGINT) AS seed FROM (
 SELECT p_partkey, p_size % 3 + 1 AS k, unnest(['sequential', 'parallel']) AS b,
   CASE WHEN s_suppkey IS NOT NULL THEN [2, 64] ELSE [1, 32, 128] END AS ts FROM part
   LEFT JOIN supplier ON s_suppkey = p_partkey) g,
 LATERAL (SELECT unnest(ts) AS t), LATERAL (SELECT unnest(range(1, k + 1)) AS r)""")
def _(v):
    cases = v.table("part").select(
        F.col("p_partkey").alias("case_label"), (F.col("p_size") % 3 + 1).cast("long").alias("replicates")
    )
    own = v.table("supplier").select(F.col("s_suppkey").alias("case_label"), F.array(F.lit(2), F.lit(64)).alias("threads"))
    grid = sp.expand_run_grid(cases, ["sequential", "parallel"], [1, 32, 128], own)
    return grid.select("case_label", "alias_builder", "threads", "replicate", "seed")
