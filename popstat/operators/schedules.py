"""Schedules: which statistic is wanted at which generation.

A schedule table has the columns stat, metric, kind, step, start, end and
generations, and may carry further columns (a scenario, say) that are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import By

# Schedule kinds
STEPPED = ("every", "every_up_to", "every_at_after", "every_range")
STARTED = ("at_after", "every_at_after", "range", "every_range")
ENDED = ("up_to", "every_up_to", "range", "every_range")
KINDS = ("always", "every", "at", "up_to", "at_after", "every_up_to", "every_at_after", "range", "every_range")

Rule = Callable[[Column], Column]


def schedule_always() -> Rule:
    return lambda g: g.isNotNull()


def schedule_every(step: int) -> Rule:
    return lambda g: g % step == 0


def schedule_at(generations: Sequence[int]) -> Rule:
    return lambda g: g.isin(*generations)


def schedule_up_to(end: int) -> Rule:
    return lambda g: g <= end


def schedule_at_after(start: int) -> Rule:
    return lambda g: g >= start


def schedule_every_up_to(step: int, end: int) -> Rule:
    return lambda g: (g % step == 0) & (g <= end)


def schedule_every_at_after(step: int, start: int) -> Rule:
    return lambda g: (g >= start) & ((g - start) % step == 0)


def schedule_range(start: int, end: int) -> Rule:
    return lambda g: g.between(start, end)


def schedule_every_range(step: int, start: int, end: int) -> Rule:
    return lambda g: g.between(start, end) & ((g - start) % step == 0)


def scheduled(df: DataFrame, rule: Rule, generation: str = "generation") -> DataFrame:
    """Rows of ``df`` whose generation the rule fires at."""
    return df.where(rule(F.col(generation)))


def _last(g) -> Column:
    return F.col(g) if isinstance(g, str) else F.lit(g).cast("long")


def expand_schedules(schedules: DataFrame, last_generation, keep: By = ()) -> DataFrame:
    """One row per (keep, generation, statistic, metric) the schedules ask for."""
    kind = F.col("kind")
    last = _last(last_generation)
    stride = F.when(kind.isin(*STEPPED), F.col("step")).otherwise(F.lit(1).cast("long"))
    first = (
        F.when(kind.isin("every", "every_up_to"), F.col("step"))
        .when(kind.isin(*STARTED), F.col("start"))
        .otherwise(F.lit(1).cast("long"))
    )
    stop = F.when(kind.isin(*ENDED), F.least(F.col("end"), last)).otherwise(last)
    runs = (stride > 0) & (first <= stop)
    wanted = F.when(kind == "at", F.col("generations")).when(runs, F.sequence(first, stop, stride))
    requests = schedules.select(
        *keep,
        last.alias("_last"),
        F.explode(wanted).alias("generation"),
        F.col("stat").alias("statistic"),
        "metric",
    )
    return coalesce_requests(requests, "_last", keep).drop("_last")


def coalesce_requests(requests: DataFrame, last_generation, keep: By = ()) -> DataFrame:
    """Requests inside [1, G], each (generation, statistic, metric) once; only similarity has a metric."""
    inside = requests.where(F.col("generation").between(F.lit(1), _last(last_generation)))
    inside = inside.withColumn("metric", metric_of("statistic", "metric"))
    return inside.dropDuplicates([*keep, "generation", "statistic", "metric"])


def metric_of(statistic: str, metric: str) -> Column:
    """The metric of a request: Jaccard unless another is named, and NULL for statistics that have none."""
    named = F.coalesce(F.col(metric).cast("string"), F.lit("jaccard"))
    return F.when(F.col(statistic) == "pairwise_similarity", named)


def check_schedules(schedules: DataFrame, last_generation) -> DataFrame:
    """One row per broken rule of a schedule."""
    kind, last = F.col("kind"), _last(last_generation)
    outside = lambda g: (g < 1) | (g > last)
    rules = {
        "step not positive": kind.isin(*STEPPED) & (F.col("step") <= 0),
        "start outside [1, G]": kind.isin(*STARTED) & outside(F.col("start")),
        "end outside [1, G]": kind.isin(*ENDED) & outside(F.col("end")),
        "end before start": kind.isin("range", "every_range") & (F.col("end") < F.col("start")),
        "no generation": (kind == "at") & (F.coalesce(F.size("generations"), F.lit(0)) <= 0),
        "generation outside [1, G]": (kind == "at") & F.exists("generations", outside),
    }
    return violations(schedules, rules)


def never_fires(schedules: DataFrame, last_generation) -> DataFrame:
    """Valid schedules whose step is beyond their last generation."""
    kind = F.col("kind")
    silent = ((kind == "every") & (F.col("step") > _last(last_generation))) | (
        (kind == "every_up_to") & (F.col("step") > F.col("end"))
    )
    return schedules.where(silent)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule, named in ``violation``; a rule on NULL holds."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violation", F.explode(broken))
