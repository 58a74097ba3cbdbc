"""SQL text of the views, for the SQL side of the registered queries."""

BUILDERS = "['sequential', 'parallel', 'parallel_psa_plus']"
METRICS = (
    "['mean_fitness', 'genetic_load', 'realized_masking_bonus', 'exact_B', 'n_seg', 'n_fixed', "
    "'nucleotide_diversity', 'expected_heterozygosity', 'genome_words', 'total_wall_sec']"
)
STATS = (
    "['mean_fitness', 'genetic_load', 'realized_masking_bonus', 'exact_B', 'pairwise_similarity', 'n_seg', "
    "'n_fixed', 'genome_words', 'mutation_histogram', 'site_frequency_spectrum', 'nucleotide_diversity', "
    "'expected_heterozygosity']"
)
KINDS = (
    "['always', 'every', 'at', 'up_to', 'at_after', 'every_up_to', 'every_at_after', 'range', 'every_range']"
)
PHASES = (
    "['reserve_mutation_metadata', 'build_parent_sampler', 'distribute_recyclable_ids', 'parallel_reproduction', "
    "'reclaim_recyclable_ids', 'collect_created_mutations', 'offspring_prefix_sum', 'offspring_offset_adjust', "
    "'offspring_copy_and_count', 'zero_offspring_counts', 'merge_thread_counts', 'classify_mutations', "
    "'collect_finalize_buffers', 'adjust_fixed_fitness', 'statistics', 'swap_populations', 'total']"
)
DISTS = "['constant', 'uniform', 'normal', 'exponential', 'gamma', 'beta']"
MODELS = "['additive', 'fixed', 'distributed', 'linear']"

SQL_VIEWS = {
    # populations: every second individual index selects one of 25 populations
    "haplotypes": "SELECT (s_suppkey // 2) % 25 AS population, s_suppkey AS haplotype_id FROM supplier",
    "carriers": """SELECT DISTINCT (l_suppkey // 2) % 25 AS population, l_suppkey AS haplotype_id,
        l_partkey AS mutation_id FROM lineitem""",
    "totals": """SELECT population, count(*) AS n_hap, count(DISTINCT haplotype_id // 2) AS n_individuals
        FROM haplotypes GROUP BY population""",
    "mutations_raw": """SELECT p_partkey AS mutation_id, CAST(substring(p_brand, 7) AS INT) % 4 AS chrom,
        p_partkey - p_partkey % 2 AS pos, p_type AS type,
        CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3
             WHEN 'SMALL' THEN 4 ELSE 5 END AS type_index,
        CASE p_type WHEN 'ECONOMY' THEN 'additive' WHEN 'SMALL' THEN 'linear' WHEN 'STANDARD' THEN 'distributed'
             ELSE 'fixed' END AS dom_kind,
        CAST(-p_size AS DOUBLE) / CAST(100000 AS DOUBLE) AS s,
        CASE p_type WHEN 'ECONOMY' THEN CAST(0.5 AS DOUBLE) WHEN 'LARGE' THEN CAST(0.5 AS DOUBLE)
             WHEN 'PROMO' THEN CAST(0.25 AS DOUBLE) WHEN 'MEDIUM' THEN CAST(0.1 AS DOUBLE)
             WHEN 'SMALL' THEN CAST(0.45 AS DOUBLE) + CAST(350 AS DOUBLE) * p_size / CAST(100000 AS DOUBLE)
             ELSE CAST(p_size % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS h,
        CAST(p_size AS BIGINT) AS origin_generation FROM part""",
    "mutations": """SELECT *, 1 + s AS hom_factor, 1 + h * s AS het_factor,
        CASE WHEN dom_kind = 'additive' THEN CAST(0 AS DOUBLE) ELSE s * (CAST(0.5 AS DOUBLE) - h) END AS masking
        FROM mutations_raw""",
    "sites": """SELECT c.population, c.mutation_id, c.copies, t.n_hap FROM
        (SELECT population, mutation_id, count(*) AS copies FROM carriers GROUP BY 1, 2) c
        JOIN totals t ON c.population = t.population""",
    "segregating": "SELECT * FROM sites WHERE copies > 0 AND copies < n_hap",
    "doses": """SELECT population, haplotype_id // 2 AS individual_id, mutation_id, count(*) AS dose
        FROM carriers GROUP BY 1, 2, 3""",
    "products": """SELECT d.population, d.individual_id,
        product(CASE WHEN d.dose > 1 THEN m.hom_factor ELSE m.het_factor END) AS fitness,
        product(m.hom_factor) AS homozygous_fitness
        FROM doses d JOIN segregating g ON d.population = g.population AND d.mutation_id = g.mutation_id
        JOIN mutations m ON d.mutation_id = m.mutation_id GROUP BY 1, 2""",
    "individuals": """SELECT i.population, i.individual_id, coalesce(p.fitness, 1) AS fitness,
        coalesce(p.homozygous_fitness, 1) AS homozygous_fitness
        FROM (SELECT DISTINCT population, haplotype_id // 2 AS individual_id FROM haplotypes) i
        LEFT JOIN products p ON i.population = p.population AND i.individual_id = p.individual_id""",
    "factors": """SELECT t.population, coalesce(f.factor, 1) AS fixed_fitness_factor FROM totals t LEFT JOIN
        (SELECT s.population, product(m.hom_factor) AS factor FROM sites s
         JOIN mutations m ON s.mutation_id = m.mutation_id WHERE s.copies = s.n_hap GROUP BY 1) f
        ON t.population = f.population""",
    "fitness": """SELECT i.population, avg(i.fitness) * max(f.fixed_fitness_factor) AS mean_fitness,
        (avg(i.fitness) - avg(i.homozygous_fitness)) * max(f.fixed_fitness_factor) AS realized_masking_bonus
        FROM individuals i JOIN factors f ON i.population = f.population GROUP BY 1""",
    # genome: regions of width 50 and recombination intervals of width 125 tile each chromosome
    "genome": "SELECT max(p_partkey) + 1 AS length FROM part",
    "chromosomes": """SELECT DISTINCT m.chrom, g.length FROM mutations_raw m JOIN genome g ON m.pos < g.length""",
    "regions": """SELECT chrom, k * 50 AS "start", least((k + 1) * 50, length) AS "end",
        CASE k % 3 WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' ELSE 'hotspot' END AS region_type
        FROM (SELECT chrom, length, unnest(range((length + 49) // 50)) AS k FROM chromosomes)""",
    "rec_intervals": """SELECT chrom, k * 125 AS "start", least((k + 1) * 125, length) AS "end",
        CAST(0.1 AS DOUBLE) + (k % 5) * CAST(0.4 AS DOUBLE) AS rate_scale
        FROM (SELECT chrom, length, unnest(range((length + 124) // 125)) AS k FROM chromosomes)""",
    "region_types": """SELECT * FROM (VALUES ('exon', CAST(2.0 AS DOUBLE)), ('intron', CAST(0.6 AS DOUBLE)),
        ('hotspot', CAST(3.5 AS DOUBLE))) t(region_type, mutation_scale)""",
    "region_weights": """SELECT CASE p_size % 3 WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' ELSE 'hotspot' END
        AS region_type, p_type AS type, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY 1, 2""",
    # one snapshot per ship year
    "carriers_g": """SELECT DISTINCT CAST(year(l_shipdate) - 1994 AS BIGINT) AS generation,
        l_suppkey AS haplotype_id, l_partkey AS mutation_id FROM lineitem""",
    "haplotypes_g": """SELECT DISTINCT CAST(year(l_shipdate) - 1994 AS BIGINT) AS generation,
        l_suppkey AS haplotype_id FROM lineitem""",
    "sites_g": """SELECT c.generation, c.mutation_id, c.copies, t.n_hap FROM
        (SELECT generation, mutation_id, count(*) AS copies FROM carriers_g GROUP BY 1, 2) c
        JOIN (SELECT generation, count(*) AS n_hap FROM haplotypes_g GROUP BY 1) t ON c.generation = t.generation""",
    "segregating_g": "SELECT * FROM sites_g WHERE copies < n_hap",
    "products_g": """SELECT d.generation, d.individual_id,
        product(CASE WHEN d.dose > 1 THEN m.hom_factor ELSE m.het_factor END) AS fitness,
        product(m.hom_factor) AS homozygous_fitness FROM
        (SELECT generation, haplotype_id // 2 AS individual_id, mutation_id, count(*) AS dose FROM carriers_g
         GROUP BY 1, 2, 3) d
        JOIN segregating_g g ON d.generation = g.generation AND d.mutation_id = g.mutation_id
        JOIN mutations m ON d.mutation_id = m.mutation_id GROUP BY 1, 2""",
    "fitness_g": """SELECT i.generation, avg(coalesce(p.fitness, 1)) * max(coalesce(f.factor, 1)) AS mean_fitness,
        (avg(coalesce(p.fitness, 1)) - avg(coalesce(p.homozygous_fitness, 1))) * max(coalesce(f.factor, 1))
        AS realized_masking_bonus FROM (SELECT DISTINCT generation, haplotype_id // 2 AS individual_id FROM haplotypes_g) i
        LEFT JOIN products_g p ON p.generation = i.generation AND p.individual_id = i.individual_id
        LEFT JOIN (SELECT s.generation, product(m.hom_factor) AS factor FROM sites_g s
          JOIN mutations m ON m.mutation_id = s.mutation_id WHERE s.copies = s.n_hap GROUP BY 1) f
          ON f.generation = i.generation GROUP BY 1""",
    "sets_g": """SELECT c.generation, c.haplotype_id, c.mutation_id FROM carriers_g c
        JOIN segregating_g s ON s.generation = c.generation AND s.mutation_id = c.mutation_id""",
    "sizes_g": """SELECT h.generation, h.haplotype_id, count(s.mutation_id) AS n FROM haplotypes_g h
        LEFT JOIN sets_g s ON s.generation = h.generation AND s.haplotype_id = h.haplotype_id GROUP BY 1, 2""",
    "pairs_g": """SELECT a.generation, a.n AS na, b.n AS nb, coalesce(s.i, 0) AS i FROM sizes_g a
        JOIN sizes_g b ON a.generation = b.generation AND a.haplotype_id < b.haplotype_id
        LEFT JOIN (SELECT x.generation, x.haplotype_id AS a, y.haplotype_id AS b, count(*) AS i FROM sets_g x
          JOIN sets_g y ON x.generation = y.generation AND x.mutation_id = y.mutation_id
            AND x.haplotype_id < y.haplotype_id GROUP BY 1, 2, 3) s
        ON s.generation = a.generation AND s.a = a.haplotype_id AND s.b = b.haplotype_id""",
    "bins_g": """SELECT generation, 'unfolded' AS dimension, bin, lpad(CAST(bin AS VARCHAR), 9, '0') AS place FROM
          (SELECT generation, unnest(range(count(*) + 1)) AS bin FROM haplotypes_g GROUP BY 1)
        UNION ALL SELECT generation, 'folded', bin, lpad(CAST(bin AS VARCHAR), 9, '0') FROM
          (SELECT generation, unnest(range(count(*) // 2 + 1)) AS bin FROM haplotypes_g GROUP BY 1)
        UNION ALL SELECT generation, 'chrom', chrom, CAST(chrom AS VARCHAR) FROM
          (SELECT DISTINCT generation FROM haplotypes_g) JOIN chromosomes ON true
        UNION ALL SELECT generation, 'type', type_index, type FROM (SELECT DISTINCT generation FROM haplotypes_g)
          JOIN (SELECT DISTINCT type, type_index FROM mutations_raw) ON true""",
    "binned_g": """SELECT s.generation, d.dimension, CASE d.dimension WHEN 'unfolded' THEN s.copies
          WHEN 'folded' THEN least(s.copies, s.n_hap - s.copies) WHEN 'chrom' THEN m.chrom ELSE m.type_index END AS bin,
        count(*) AS n FROM segregating_g s JOIN mutations_raw m ON m.mutation_id = s.mutation_id
        JOIN (VALUES ('unfolded'), ('folded'), ('chrom'), ('type')) d(dimension) ON true GROUP BY 1, 2, 3""",
    "arrays_g": """SELECT b.generation, b.dimension,
        string_agg(CAST(coalesce(n.n, 0) AS VARCHAR), ',' ORDER BY b.place) AS vector FROM bins_g b
        LEFT JOIN binned_g n ON n.generation = b.generation AND n.dimension = b.dimension AND n.bin = b.bin GROUP BY 1, 2""",
    # carriers of a year and all years before; 2N = 16 so that mutations become fixed
    "accumulated": """SELECT mutation_id, haplotype_id, min(generation) AS since FROM
        (SELECT DISTINCT CAST(year(l_shipdate) - 1994 AS BIGINT) AS generation, l_suppkey % 16 AS haplotype_id,
         l_partkey AS mutation_id FROM lineitem) GROUP BY 1, 2""",
    "newly_fixed": """SELECT generation, count(*) AS n_new_fixed, product(m.hom_factor) AS new_fixed_factor FROM
        (SELECT mutation_id, max(since) AS generation, count(*) AS n FROM accumulated GROUP BY 1) a
        JOIN mutations m ON a.mutation_id = m.mutation_id
        WHERE a.n = (SELECT count(DISTINCT s_suppkey % 16) FROM supplier) GROUP BY 1""",
    # run results
    "runs": f"""SELECT event_id, event_type AS case_label,
        CASE WHEN event_id % 4 = 0 THEN 'ref' ELSE 'cand' END AS simulator,
        {BUILDERS}[user_id % 3 + 1] AS alias_builder, CAST(power(2, (event_id // 4) % 4) AS BIGINT) AS threads,
        CASE WHEN event_id % 4 = 0 THEN 'ref' ELSE concat({BUILDERS}[user_id % 3 + 1], '@T',
             CAST(CAST(power(2, (event_id // 4) % 4) AS BIGINT) AS VARCHAR)) END AS variant,
        {METRICS}[(event_id // 16) % 10 + 1] AS metric, value, value + 1 AS ms_per_gen, value AS total_sec,
        CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'n/a'
             ELSE CAST(event_id * 3 AS VARCHAR) END AS peak_rss_kb,
        CASE WHEN event_type = 'error' THEN '' ELSE CAST(event_id * 5 AS VARCHAR) END AS peak_vmsize_kb FROM events""",
    "scalar_summary": """SELECT case_label, simulator, variant, metric, count(value) AS n_reps, avg(value) AS mean,
        coalesce(stddev_samp(value), 0) AS sd FROM runs GROUP BY 1, 2, 3, 4""",
    "comparison": """SELECT c.*, r.mean AS ref_mean, r.sd AS ref_sd, r.n_reps AS ref_n,
        abs(c.mean - r.mean) AS abs_diff,
        abs(c.mean - r.mean) / CASE WHEN abs(r.mean) > 1e-12 THEN abs(r.mean) ELSE 1 END AS rel_diff
        FROM scalar_summary c JOIN scalar_summary r ON c.case_label = r.case_label AND c.metric = r.metric
        WHERE c.simulator <> 'ref' AND r.simulator = 'ref'""",
    "speed": """SELECT case_label, simulator, alias_builder, threads, count(*) AS n_reps,
        avg(ms_per_gen) AS mean_ms_per_gen, coalesce(stddev_samp(ms_per_gen), 0) AS sd_ms_per_gen,
        avg(total_sec) AS mean_total_sec, coalesce(stddev_samp(total_sec), 0) AS sd_total_sec,
        avg(rss) AS mean_peak_rss_kb, CASE WHEN count(rss) = 0 THEN NULL ELSE coalesce(stddev_samp(rss), 0) END
        AS sd_peak_rss_kb, avg(vms) AS mean_peak_vmsize_kb,
        CASE WHEN count(vms) = 0 THEN NULL ELSE coalesce(stddev_samp(vms), 0) END AS sd_peak_vmsize_kb
        FROM (SELECT *, TRY_CAST(peak_rss_kb AS DOUBLE) AS rss, TRY_CAST(peak_vmsize_kb AS DOUBLE) AS vms FROM runs)
        GROUP BY 1, 2, 3, 4""",
    "ref_speed": """SELECT case_label, avg(ms_per_gen) AS ref_mean_ms_per_gen FROM runs WHERE simulator = 'ref'
        GROUP BY 1""",
    "best": """SELECT case_label, alias_builder, threads AS best_threads, mean_ms_per_gen AS best_mean_ms_per_gen,
        sd_ms_per_gen AS best_sd_ms_per_gen FROM (SELECT *, row_number() OVER (PARTITION BY case_label, alias_builder
        ORDER BY mean_ms_per_gen, threads) AS rn FROM speed WHERE simulator <> 'ref') WHERE rn = 1""",
    "phases": f"""SELECT case_label, alias_builder, threads, {PHASES}[event_id % 17 + 1] AS phase, total_sec,
        total_sec / 100 AS avg_sec_per_gen, total_sec / 5 AS pct_total FROM runs""",
    "phase_means": """SELECT case_label, alias_builder, threads, phase, avg(pct_total) AS mean_pct_total FROM phases
        GROUP BY 1, 2, 3, 4""",
    "vectors": """SELECT l_returnflag AS case_label, l_linestatus AS simulator, CAST(l_quantity AS BIGINT) AS pos,
        count(*) / CAST(7 AS DOUBLE) AS mean_value FROM lineitem GROUP BY 1, 2, 3""",
    "shares": """SELECT case_label, simulator, pos, mean_value,
        mean_value / sum(mean_value) OVER (PARTITION BY case_label, simulator) AS share FROM vectors""",
    # draws
    "draws": """SELECT l_orderkey, l_linenumber,
        CAST((l_orderkey * 7919 + l_linenumber * 104729) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS u
        FROM lineitem""",
    "items": """SELECT p_partkey AS item, CAST(p_partkey % 25 AS BIGINT) AS population,
        CAST(CASE WHEN p_partkey % 25 = 0 THEN 4 ELSE p_size END AS DOUBLE) AS weight FROM part""",
    "item_cdf": """SELECT population, item, weight,
        sum(weight) OVER (PARTITION BY population ORDER BY item) AS cdf,
        sum(weight) OVER (PARTITION BY population ORDER BY item) - weight AS prev_cdf,
        row_number() OVER (PARTITION BY population ORDER BY item) - 1 AS position,
        sum(weight) OVER (PARTITION BY population) AS total,
        min(weight) OVER (PARTITION BY population) = max(weight) OVER (PARTITION BY population) AS flat,
        count(*) OVER (PARTITION BY population) AS n FROM items""",
    # model tables
    "schedules": f"""SELECT p_partkey AS schedule_id, p_brand AS scenario, {STATS}[p_partkey % 12 + 1] AS stat,
        ['jaccard', 'dice', 'overlap'][(p_partkey // 12) % 3 + 1] AS metric, {KINDS}[p_partkey % 9 + 1] AS kind,
        CAST(p_size % 7 AS BIGINT) AS step, CAST(p_size - 2 AS BIGINT) AS "start",
        CAST(p_size + p_partkey % 20 - 5 AS BIGINT) AS "end",
        CASE WHEN p_size % 11 = 0 THEN [] ELSE [CAST(p_size AS BIGINT), CAST(p_size * 2 AS BIGINT),
             CAST(p_size AS BIGINT)] END AS generations FROM part""",
    "requests": """SELECT DISTINCT scenario, g AS generation, stat AS statistic,
        CASE WHEN stat = 'pairwise_similarity' THEN coalesce(metric, 'jaccard') END AS metric FROM (
        SELECT scenario, stat, metric, unnest(generations) AS g FROM schedules WHERE kind = 'at'
        UNION ALL
        SELECT scenario, stat, metric, g FROM schedules s JOIN (SELECT unnest(range(1, 41)) AS g) n ON
            (kind = 'always')
            OR (kind = 'every' AND step > 0 AND g % step = 0)
            OR (kind = 'up_to' AND g <= "end")
            OR (kind = 'at_after' AND g >= "start")
            OR (kind = 'every_up_to' AND step > 0 AND g % step = 0 AND g <= "end")
            OR (kind = 'every_at_after' AND step > 0 AND g >= "start" AND (g - "start") % step = 0)
            OR (kind = 'range' AND g BETWEEN "start" AND "end")
            OR (kind = 'every_range' AND step > 0 AND g BETWEEN "start" AND "end" AND (g - "start") % step = 0)
        ) WHERE g BETWEEN 1 AND 40""",
    "mutation_types": f"""SELECT p_partkey AS type_id, {DISTS}[p_partkey % 6 + 1] AS sel_kind,
        CAST(p_size - 10 AS DOUBLE) / 100 AS sel_p1, CAST(p_size % 7 - 1 AS DOUBLE) / 10 AS sel_p2,
        CASE WHEN p_size % 2 = 0 THEN CAST(-0.3 AS DOUBLE) END AS sel_min,
        CAST(p_size % 5 - 1 AS DOUBLE) / 10 - CAST(0.15 AS DOUBLE) AS sel_max,
        {MODELS}[p_partkey % 4 + 1] AS dom_kind, CAST(p_size AS DOUBLE) / 100 AS dom_p1,
        CAST(p_size - 25 AS DOUBLE) / 10 AS dom_p2, CAST(0.1 AS DOUBLE) AS dom_p3,
        CAST(p_size % 4 AS DOUBLE) / 4 AS dom_p4, CAST(p_size % 3 - 1 AS DOUBLE) / 10 AS s,
        CAST(p_size AS DOUBLE) / 50 AS draw FROM part""",
    "scenarios": """SELECT c_custkey AS scenario, CAST(c_nationkey - 2 AS BIGINT) AS N,
        CAST(c_custkey % 9 - 1 AS BIGINT) AS G, c_acctbal / 1000 AS mu, (c_acctbal - 1000) / 1000 AS rho,
        CAST(c_custkey % 5 - 1 AS BIGINT) AS threads FROM customer""",
    "intervals": """SELECT DISTINCT l_orderkey AS chrom, CAST(l_linenumber - 1 AS BIGINT) * 10 AS "start",
        CAST(l_linenumber AS BIGINT) * 10 AS "end" FROM lineitem""",
    "interval_lengths": """SELECT o_orderkey AS chrom, coalesce(n, 1) * 10 AS length FROM orders
        LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
        ON l_orderkey = o_orderkey""",
    # one gamete per haplotype of the universe; its parents are the haplotype and the next one
    "n_haplotypes": "SELECT count(*) AS n FROM supplier",
    "parent_a": """SELECT DISTINCT l_suppkey AS gamete_id, m.chrom, m.pos, m.mutation_id
        FROM lineitem JOIN mutations_raw m ON l_partkey = m.mutation_id""",
    "parent_b": """SELECT DISTINCT (l_suppkey + 1) % n AS gamete_id, m.chrom, m.pos, m.mutation_id
        FROM lineitem JOIN mutations_raw m ON l_partkey = m.mutation_id JOIN n_haplotypes ON true""",
    "breakpoints": """SELECT o_custkey % n AS gamete_id, CAST(o_orderkey % 4 AS INT) AS chrom,
        o_orderkey % g.length AS pos FROM orders JOIN n_haplotypes ON true JOIN genome g ON true""",
    "start_on_b": """SELECT s_suppkey AS gamete_id, chrom, (s_suppkey + chrom) % 2 = 1 AS start_on_b
        FROM supplier JOIN (SELECT unnest(range(4)) AS chrom) c ON true""",
}
