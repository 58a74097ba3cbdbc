"""The panel of all statistics: its tables are made once, whatever the number of statistics."""

from popstat.plans.panel import stat_panel

REQUESTS = ["mean_fitness", "exact_B", "n_seg", "n_fixed", "genome_words", "site_frequency_spectrum", "pairwise_similarity"]


def test_panel_makes_its_carriers_and_haplotypes_once(spark):
    rows = [(g, h, m) for g in (1, 2) for h in range(6) for m in range(8) if (h + m * g) % 3]
    carriers = spark.createDataFrame(rows, "generation long, haplotype_id long, mutation_id long")
    haplotypes = spark.createDataFrame([(g, h) for g in (1, 2) for h in range(6)], "generation long, haplotype_id long")
    mutations = spark.createDataFrame([(m, 0, "t", 0.9, 0.95, 0.1) for m in range(8)],
                                      "mutation_id long, chrom int, type string, hom_factor double, het_factor double, masking double")
    types = spark.createDataFrame([("t",)], "type string")
    chromosomes = spark.createDataFrame([(0, 100)], "chrom int, length long")
    requests = spark.createDataFrame([(g, s, "jaccard") for g in (1, 2) for s in REQUESTS], "generation long, statistic string, metric string")
    counts = {name: spark.sparkContext.accumulator(0) for name in ("carriers", "haplotypes")}

    def counted(df, made):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    made = stat_panel(counted(carriers, counts["carriers"]), counted(haplotypes, counts["haplotypes"]), mutations, types, chromosomes, requests)
    assert made.count() == 2 * len(REQUESTS)
    assert counts["carriers"].value == len(rows) and counts["haplotypes"].value == 12
