"""Queries of schedules, request tables and model checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.operators import checks as ck
from popstat.operators import schedules as sc
from popstat.operators.filters import report_points
from workload.registry import query
from workload.views import Views

# a report table with one row per order; its generation is the day number of the order date
_REPORTS = "(SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS BIGINT) AS generation FROM orders)"


def _reports(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", F.dayofyear("o_orderdate").cast("long").alias("generation"))


_RULES = {
    "schedule_always": (sc.schedule_always(), "true"),
    "schedule_every": (sc.schedule_every(7), "generation % 7 = 0"),
    "schedule_at": (sc.schedule_at([30, 5, 30, 200]), "generation IN (5, 30, 200)"),
    "schedule_up_to": (sc.schedule_up_to(90), "generation <= 90"),
    "schedule_at_after": (sc.schedule_at_after(300), "generation >= 300"),
    "schedule_every_up_to": (sc.schedule_every_up_to(3, 100), "generation % 3 = 0 AND generation <= 100"),
    "schedule_every_at_after": (
        sc.schedule_every_at_after(5, 102), "generation >= 102 AND (generation - 102) % 5 = 0"),
    "schedule_range": (sc.schedule_range(40, 80), "generation BETWEEN 40 AND 80"),
    "schedule_every_range": (
        sc.schedule_every_range(4, 41, 201), "generation BETWEEN 41 AND 201 AND (generation - 41) % 4 = 0"),
}


def _register_rule(name: str, rule: sc.Rule, predicate: str) -> None:
    @query(name, f"SELECT generation, count(*) AS n FROM {_REPORTS} WHERE {predicate} GROUP BY 1")
    def _(v):
        return sc.scheduled(_reports(v), rule).groupBy("generation").agg(F.count(F.lit(1)).alias("n"))


for _name, (_rule, _predicate) in _RULES.items():
    _register_rule(_name, _rule, _predicate)


@query("report_points", f"""SELECT generation, count(*) AS n FROM {_REPORTS}
WHERE generation % 50 = 0 OR generation = (SELECT max(dayofyear(o_orderdate)) FROM orders) GROUP BY 1""")
def _(v):
    reports = _reports(v)
    last = reports.agg(F.max("generation")).scalar()
    return reports.where(report_points("generation", 50, last)).groupBy("generation").agg(F.count(F.lit(1)).alias("n"))


@query("expand_schedules", "SELECT scenario, generation, statistic, metric FROM requests")
def _(v):
    return sc.expand_schedules(v.schedules, 40, ["scenario"])


@query("coalesce_requests", """SELECT DISTINCT scenario, statistic,
CASE WHEN statistic = 'pairwise_similarity' THEN coalesce(metric, 'jaccard') END AS metric, generation FROM (
SELECT scenario, stat AS statistic, metric, unnest(generations) AS generation FROM schedules)
WHERE generation BETWEEN 1 AND 40""")
def _(v):
    raw = v.schedules.select(
        "scenario", F.col("stat").alias("statistic"), "metric", F.explode("generations").alias("generation")
    )
    return sc.coalesce_requests(raw, 40, ["scenario"])


@query("check_schedules", """SELECT schedule_id, violation FROM (
SELECT schedule_id, 'step not positive' AS violation FROM schedules
  WHERE kind IN ('every', 'every_up_to', 'every_at_after', 'every_range') AND step <= 0
UNION ALL SELECT schedule_id, 'start outside [1, G]' FROM schedules
  WHERE kind IN ('at_after', 'every_at_after', 'range', 'every_range') AND ("start" < 1 OR "start" > 40)
UNION ALL SELECT schedule_id, 'end outside [1, G]' FROM schedules
  WHERE kind IN ('up_to', 'every_up_to', 'range', 'every_range') AND ("end" < 1 OR "end" > 40)
UNION ALL SELECT schedule_id, 'end before start' FROM schedules
  WHERE kind IN ('range', 'every_range') AND "end" < "start"
UNION ALL SELECT schedule_id, 'no generation' FROM schedules WHERE kind = 'at' AND len(generations) = 0
UNION ALL SELECT DISTINCT schedule_id, 'generation outside [1, G]' FROM
  (SELECT schedule_id, unnest(generations) AS g FROM schedules WHERE kind = 'at') WHERE g < 1 OR g > 40)""")
def _(v):
    return sc.check_schedules(v.schedules, 40).select("schedule_id", "violation")


@query("never_fires", """SELECT schedule_id, kind, step, "end" FROM schedules
WHERE (kind = 'every' AND step > 3) OR (kind = 'every_up_to' AND step > "end")""")
def _(v):
    return sc.never_fires(v.schedules, 3).select("schedule_id", "kind", "step", "end")


# ---- checks ----


@query("check_bounds", """SELECT scenario, violation FROM (
SELECT scenario, 'N must be positive' AS violation FROM scenarios WHERE N <= 0
UNION ALL SELECT scenario, 'G must be positive' FROM scenarios WHERE G <= 0
UNION ALL SELECT scenario, 'mu must not be negative' FROM scenarios WHERE mu < 0
UNION ALL SELECT scenario, 'rho must not be negative' FROM scenarios WHERE rho < 0
UNION ALL SELECT scenario, 'threads must not be negative' FROM scenarios WHERE threads < 0)""")
def _(v):
    return ck.check_bounds("scenarios", v.scenarios).select("scenario", "violation")


_BOUNDS = {
    "chromosomes": ("p_partkey AS id, (p_size - 5) * 150000000 AS length", """
        SELECT id, 'length must be positive' AS violation FROM t WHERE length <= 0
        UNION ALL SELECT id, 'length outside 32 bits' FROM t WHERE length < 0 OR length > 4294967295"""),
    "regions": ('p_partkey AS id, p_size * 100000000 AS "start", p_size * 100000000 - 300000000 AS "end"', """
        SELECT id, 'start outside 32 bits' AS violation FROM t WHERE "start" < 0 OR "start" > 4294967295
        UNION ALL SELECT id, 'end outside 32 bits' FROM t WHERE "end" < 0 OR "end" > 4294967295"""),
    "rec_intervals": ('p_partkey AS id, p_size AS "start", p_size * 120000000 AS "end", p_size - 10 AS rate_scale', """
        SELECT id, 'rate_scale must not be negative' AS violation FROM t WHERE rate_scale < 0
        UNION ALL SELECT id, 'end outside 32 bits' FROM t WHERE "end" > 4294967295"""),
    "region_types": ("p_partkey AS id, p_size - 8 AS mutation_scale", """
        SELECT id, 'mutation_scale must not be negative' AS violation FROM t WHERE mutation_scale < 0"""),
    "region_weights": ("p_partkey AS id, p_size - 3 AS weight", """
        SELECT id, 'weight must be positive' AS violation FROM t WHERE weight <= 0"""),
    "mutations": ("p_partkey AS id, p_size * 99000000 AS pos", """
        SELECT id, 'pos outside 32 bits' AS violation FROM t WHERE pos > 4294967295"""),
}
_BOUNDS_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS model_table, id, violation FROM (WITH t AS (SELECT {columns.replace('p_size', 'CAST(p_size AS BIGINT)')} FROM part) {rules})"
    for table, (columns, rules) in _BOUNDS.items()
)


@query("check_bounds_model", _BOUNDS_SQL)
def _(v):
    """Every table of a model, made from parts so that each rule is broken somewhere."""
    found = [
        ck.check_bounds(table, v.table("part").selectExpr(*_columns(columns))).select(
            F.lit(table).alias("model_table"), "id", "violation")
        for table, (columns, _) in _BOUNDS.items()
    ]
    return reduce(DataFrame.unionByName, found)


def _columns(text: str) -> list[str]:
    return [c.strip().replace('"', "`").replace("p_size", "CAST(p_size AS BIGINT)") for c in text.split(",")]


@query("check_distributions", """SELECT type_id, violation FROM (
SELECT type_id, 'constant outside its clamp' AS violation FROM mutation_types
  WHERE sel_kind = 'constant' AND (sel_p1 < sel_min OR sel_p1 > sel_max)
UNION ALL SELECT type_id, 'uniform max below min' FROM mutation_types WHERE sel_kind = 'uniform' AND sel_p2 < sel_p1
UNION ALL SELECT type_id, 'normal sd negative' FROM mutation_types WHERE sel_kind = 'normal' AND sel_p2 < 0
UNION ALL SELECT type_id, 'exponential mean negative' FROM mutation_types
  WHERE sel_kind = 'exponential' AND sel_p1 < 0
UNION ALL SELECT type_id, 'gamma shape not positive' FROM mutation_types WHERE sel_kind = 'gamma' AND sel_p2 <= 0
UNION ALL SELECT type_id, 'beta alpha not positive' FROM mutation_types WHERE sel_kind = 'beta' AND sel_p1 <= 0
UNION ALL SELECT type_id, 'beta beta not positive' FROM mutation_types WHERE sel_kind = 'beta' AND sel_p2 <= 0
UNION ALL SELECT type_id, 'clamp max below min' FROM mutation_types WHERE sel_max < sel_min
UNION ALL SELECT type_id, 'linear max_h below min_h' FROM mutation_types WHERE dom_kind = 'linear' AND dom_p4 < dom_p3)""")
def _(v):
    return ck.check_distributions(v.mutation_types).select("type_id", "violation")


@query("duplicate_keys", """SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
HAVING count(*) > 1""")
def _(v):
    return ck.duplicate_keys(v.table("orders"), ["o_custkey", "o_orderpriority"])


@query("empty_sections", """SELECT scenario, section FROM (
SELECT c_custkey AS scenario, 'orders' AS section FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'events' FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey))""")
def _(v):
    parents = v.table("customer").select(F.col("c_custkey").alias("scenario"))
    children = {
        "orders": v.table("orders").select(F.col("o_custkey").alias("scenario")),
        "events": v.table("events").select(F.col("user_id").alias("scenario")),
    }
    return ck.empty_sections(parents, children, ["scenario"])


@query("unknown_names", """SELECT event_id, metric FROM runs WHERE metric NOT IN ('mean_fitness', 'genetic_load',
'realized_masking_bonus', 'exact_B', 'pairwise_similarity', 'n_seg', 'n_fixed', 'genome_words', 'mutation_histogram',
'site_frequency_spectrum', 'nucleotide_diversity', 'expected_heterozygosity')""")
def _(v):
    return ck.unknown_names(v.runs, "metric", "statistic").select("event_id", "metric")
