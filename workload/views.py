"""DataFrame views of the given tables in the shape of the library's inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.functions import SIMILARITY_METRICS, mutation_effects
from popstat.operators.checks import DISTRIBUTIONS, DOMINANCE_MODELS, STATISTICS
from popstat.operators.filters import BIOLOGICAL_METRICS
from popstat.operators.groups import dense_range
from popstat.operators.results import normalized_distribution, replicate_summary, speed_summary
from popstat.operators.schedules import KINDS
from popstat.operators.statistics import site_counts
from popstat.sources.schemas import PHASES

BUILDERS = ("sequential", "parallel", "parallel_psa_plus")
METRICS = (*BIOLOGICAL_METRICS, "genome_words", "total_wall_sec")
POPULATION = ["population"]
VARIANT_KEYS = ["case_label", "simulator", "variant", "metric"]
SPEED_KEYS = ["case_label", "simulator", "alias_builder", "threads"]


def nth(values, index: Column) -> Column:
    """Element of a short literal list by 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def double(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def halved(c: str) -> Column:
    return F.shiftright(F.col(c), 1)


class Views:
    """Lazy views; a query reads only the columns it uses of the tables it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # ---- populations ----

    @cached_property
    def haplotypes(self) -> DataFrame:
        population = (halved("s_suppkey") % 25).alias("population")
        return self.table("supplier").select(population, F.col("s_suppkey").alias("haplotype_id"))

    @cached_property
    def carriers(self) -> DataFrame:
        population = (halved("l_suppkey") % 25).alias("population")
        lines = self.table("lineitem").select("l_suppkey", "l_partkey").distinct()
        return lines.select(
            population, F.col("l_suppkey").alias("haplotype_id"), F.col("l_partkey").alias("mutation_id")
        )

    @cached_property
    def everyone(self) -> tuple[DataFrame, DataFrame]:
        """Carriers and haplotypes as one population."""
        return self.carriers.drop("population"), self.haplotypes.drop("population")

    @cached_property
    def mutations(self) -> DataFrame:
        base = self.table("part").selectExpr(
            "p_partkey AS mutation_id", "CAST(substring(p_brand, 7) AS INT) % 4 AS chrom",
            "p_partkey - p_partkey % 2 AS pos", "p_type AS type",
            "CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 "
            "WHEN 'SMALL' THEN 4 ELSE 5 END AS type_index",
            "CASE p_type WHEN 'ECONOMY' THEN 'additive' WHEN 'SMALL' THEN 'linear' "
            "WHEN 'STANDARD' THEN 'distributed' ELSE 'fixed' END AS dom_kind",
            "p_size / -100000.0D AS s",
            "CASE p_type WHEN 'ECONOMY' THEN 0.5D WHEN 'LARGE' THEN 0.5D WHEN 'PROMO' THEN 0.25D "
            "WHEN 'MEDIUM' THEN 0.1D WHEN 'SMALL' THEN 0.45D + 350D * p_size / 100000D "
            "ELSE (p_size % 10) / 10D END AS h",
            "CAST(p_size AS BIGINT) AS origin_generation",
        )
        effects = mutation_effects("s", "h", F.col("dom_kind") == "additive")
        return base.select("*", effects.alias("_e")).selectExpr(
            *base.columns, "_e.hom_factor", "_e.het_factor", "_e.masking"
        )

    @cached_property
    def sites(self) -> DataFrame:
        return site_counts(self.carriers, self.haplotypes, POPULATION)

    @cached_property
    def types(self) -> DataFrame:
        return self.table("part").select(F.col("p_type").alias("type")).distinct()

    # ---- genome ----

    @cached_property
    def genome_length(self) -> Column:
        return self.table("part").agg(F.max("p_partkey") + 1).scalar()

    @cached_property
    def chromosomes(self) -> DataFrame:
        return self.mutations.select("chrom").distinct().withColumn("length", self.genome_length)

    def _tiles(self, width: int) -> DataFrame:
        last = F.floor((F.col("length") + (width - 1)) / width) - 1
        tiled = dense_range(self.chromosomes.withColumn("_last", last), "k", "_last")
        end = F.least((F.col("k") + 1) * width, F.col("length"))
        return tiled.select("chrom", (F.col("k") * width).alias("start"), end.alias("end"), "k")

    @cached_property
    def regions(self) -> DataFrame:
        kind = nth(("exon", "intron", "hotspot"), F.col("k") % 3)
        return self._tiles(50).withColumn("region_type", kind).drop("k")

    @cached_property
    def rec_intervals(self) -> DataFrame:
        scale = F.lit(0.1) + (F.col("k") % 5) * F.lit(0.4)
        return self._tiles(125).withColumn("rate_scale", scale).drop("k")

    @cached_property
    def region_types(self) -> DataFrame:
        rows = [("exon", 2.0), ("intron", 0.6), ("hotspot", 3.5)]
        return self.spark.createDataFrame(rows, "region_type STRING, mutation_scale DOUBLE")

    @cached_property
    def region_weights(self) -> DataFrame:
        kind = nth(("exon", "intron", "hotspot"), F.col("p_size") % 3).alias("region_type")
        return self.table("part").groupBy(kind, F.col("p_type").alias("type")).agg(
            F.count(F.lit(1)).cast("double").alias("weight")
        )

    # ---- generations ----

    @cached_property
    def carriers_g(self) -> DataFrame:
        generation = (F.year("l_shipdate") - 1994).cast("long").alias("generation")
        return self.table("lineitem").select(
            generation, F.col("l_suppkey").alias("haplotype_id"), F.col("l_partkey").alias("mutation_id")
        ).distinct()

    @cached_property
    def haplotypes_g(self) -> DataFrame:
        generation = (F.year("l_shipdate") - 1994).cast("long").alias("generation")
        return self.table("lineitem").select(generation, F.col("l_suppkey").alias("haplotype_id")).distinct()

    @cached_property
    def newly_fixed(self) -> DataFrame:
        """Mutations by the first generation at which all of 16 haplotypes carry them."""
        generation = (F.year("l_shipdate") - 1994).cast("long")
        since = self.table("lineitem").groupBy(
            F.col("l_partkey").alias("mutation_id"), (F.col("l_suppkey") % 16).alias("haplotype_id")
        ).agg(F.min(generation).alias("since"))
        n_hap = self.table("supplier").agg(F.count_distinct(F.col("s_suppkey") % 16)).scalar()
        full = since.groupBy("mutation_id").agg(F.max("since").alias("generation"), F.count(F.lit(1)).alias("n"))
        return full.where(F.col("n") == n_hap).join(self.mutations, "mutation_id").groupBy("generation").agg(
            F.count(F.lit(1)).alias("n_new_fixed"), F.product("hom_factor").alias("new_fixed_factor")
        )

    # ---- results ----

    @cached_property
    def runs(self) -> DataFrame:
        threads = "CAST(power(2, (event_id div 4) % 4) AS BIGINT)"
        builder = f"element_at(array{BUILDERS}, CAST(user_id % 3 AS INT) + 1)"
        return self.table("events").selectExpr(
            "event_id", "event_type AS case_label", "if(event_id % 4 = 0, 'ref', 'cand') AS simulator",
            f"{builder} AS alias_builder", f"{threads} AS threads",
            f"if(event_id % 4 = 0, 'ref', concat({builder}, '@T', {threads})) AS variant",
            f"element_at(array{METRICS}, CAST((event_id div 16) % 10 AS INT) + 1) AS metric",
            "value", "value + 1 AS ms_per_gen", "value AS total_sec",
            "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'n/a' "
            "ELSE CAST(event_id * 3 AS STRING) END AS peak_rss_kb",
            "if(event_type = 'error', '', CAST(event_id * 5 AS STRING)) AS peak_vmsize_kb",
        )

    @cached_property
    def scalar_summary(self) -> DataFrame:
        return replicate_summary(self.runs, VARIANT_KEYS, "value")

    @cached_property
    def speed(self) -> DataFrame:
        return speed_summary(self.runs, SPEED_KEYS, missing=None)

    @cached_property
    def ref_speed(self) -> DataFrame:
        return self.runs.where(F.col("simulator") == "ref").groupBy("case_label").agg(
            F.avg("ms_per_gen").alias("mean_ms_per_gen")
        )

    @cached_property
    def phases(self) -> DataFrame:
        return self.runs.selectExpr(
            "case_label", "alias_builder", "threads",
            f"element_at(array{PHASES}, CAST(event_id % 17 AS INT) + 1) AS phase",
            "total_sec", "total_sec / 100 AS avg_sec_per_gen", "total_sec / 5 AS pct_total",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.col("l_returnflag").alias("case_label"), F.col("l_linestatus").alias("simulator"),
            F.col("l_quantity").cast("long").alias("pos"),
        ).agg((F.count(F.lit(1)) / F.lit(7.0)).alias("mean_value"))

    @cached_property
    def shares(self) -> DataFrame:
        return normalized_distribution(self.vectors, ["case_label", "simulator"], "mean_value")

    # ---- draws ----

    @cached_property
    def draws(self) -> DataFrame:
        u = double((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003) / F.lit(1000003.0)
        return self.table("lineitem").select("l_orderkey", "l_linenumber", u.alias("u"))

    @cached_property
    def items(self) -> DataFrame:
        group = F.col("p_partkey") % 25
        return self.table("part").select(
            F.col("p_partkey").alias("item"), group.alias("population"),
            double(F.when(group == 0, 4).otherwise(F.col("p_size"))).alias("weight"),
        )

    # ---- model tables ----

    @cached_property
    def schedules(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS schedule_id", "p_brand AS scenario",
            f"element_at(array{STATISTICS}, CAST(p_partkey % 12 AS INT) + 1) AS stat",
            f"element_at(array{SIMILARITY_METRICS}, CAST((p_partkey div 12) % 3 AS INT) + 1) AS metric",
            f"element_at(array{KINDS}, CAST(p_partkey % 9 AS INT) + 1) AS kind",
            "CAST(p_size % 7 AS BIGINT) AS step", "CAST(p_size - 2 AS BIGINT) AS start",
            "p_size + p_partkey % 20 - 5 AS end",
            "CAST(if(p_size % 11 = 0, array(), array(p_size, p_size * 2, p_size)) AS ARRAY<BIGINT>) AS generations",
        )

    @cached_property
    def mutation_types(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS type_id",
            f"element_at(array{DISTRIBUTIONS}, CAST(p_partkey % 6 AS INT) + 1) AS sel_kind",
            "(p_size - 10) / 100D AS sel_p1", "(p_size % 7 - 1) / 10D AS sel_p2",
            "if(p_size % 2 = 0, -0.3D, NULL) AS sel_min", "(p_size % 5 - 1) / 10D - 0.15D AS sel_max",
            f"element_at(array{DOMINANCE_MODELS}, CAST(p_partkey % 4 AS INT) + 1) AS dom_kind",
            "p_size / 100D AS dom_p1", "(p_size - 25) / 10D AS dom_p2", "0.1D AS dom_p3",
            "(p_size % 4) / 4D AS dom_p4", "(p_size % 3 - 1) / 10D AS s", "p_size / 50D AS draw",
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("scenario"), (F.col("c_nationkey") - 2).cast("long").alias("N"),
            (F.col("c_custkey") % 9 - 1).alias("G"), (F.col("c_acctbal") / 1000).alias("mu"),
            ((F.col("c_acctbal") - 1000) / 1000).alias("rho"), (F.col("c_custkey") % 5 - 1).alias("threads"),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        number = F.col("l_linenumber").cast("long")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("chrom"), ((number - 1) * 10).alias("start"), (number * 10).alias("end")
        ).distinct()

    @cached_property
    def interval_lengths(self) -> DataFrame:
        counted = self.intervals.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
        every = self.table("orders").select(F.col("o_orderkey").alias("chrom"))
        return every.join(counted, "chrom", "left").select("chrom", (F.coalesce("n", F.lit(1)) * 10).alias("length"))

    # ---- gametes ----

    @cached_property
    def n_haplotypes(self) -> Column:
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    def _parent(self, shift: int) -> DataFrame:
        sites = self.mutations.select("mutation_id", "chrom", "pos")
        gamete = F.col("haplotype_id") if not shift else (F.col("haplotype_id") + shift) % self.n_haplotypes
        return self.everyone[0].withColumn("gamete_id", gamete).join(sites, "mutation_id").select(
            "gamete_id", "chrom", "pos", "mutation_id"
        )

    @cached_property
    def parent_a(self) -> DataFrame:
        return self._parent(0)

    @cached_property
    def parent_b(self) -> DataFrame:
        return self._parent(1)

    @cached_property
    def breakpoints(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") % self.n_haplotypes).alias("gamete_id"),
            (F.col("o_orderkey") % 4).cast("int").alias("chrom"),
            (F.col("o_orderkey") % self.genome_length).alias("pos"),
        )

    @cached_property
    def start_on_b(self) -> DataFrame:
        chrom = F.explode(F.array(*[F.lit(c) for c in range(4)])).alias("chrom")
        gametes = self.table("supplier").select(F.col("s_suppkey").alias("gamete_id"), chrom)
        return gametes.withColumn("start_on_b", (F.col("gamete_id") + F.col("chrom")) % 2 == 1)
