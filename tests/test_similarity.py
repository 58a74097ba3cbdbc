import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from popstat.operators.similarity import (
    _numbered,
    _tiles,
    haplotype_overlaps,
    pair_set_sizes,
    pairwise_similarities,
    sampled_pairwise_similarity,
)
from popstat.operators.statistics import copy_counts


def brute(sets, n):
    def sim(a, b):
        i = len(a & b)
        if not a and not b:
            return (1.0, 1.0, 1.0)
        if not a or not b:
            return (0.0, 0.0, 0.0)
        return i / len(a | b), 2 * i / (len(a) + len(b)), i / min(len(a), len(b))

    values = [sim(sets.get(a, set()), sets.get(b, set())) for a, b in itertools.combinations(range(n), 2)]
    return [sum(v[k] for v in values) / len(values) for k in range(3)]


@pytest.fixture(scope="module")
def skewed(spark):
    """Mutation 0 on all but one haplotype, haplotype 1 with a third of all rows, haplotypes 28, 29 with nothing."""
    rng = random.Random(3)
    pairs = {(h, 0) for h in range(27)} | {(1, m) for m in range(0, 400)}
    pairs |= {(h, rng.randrange(400)) for h in range(27) for _ in range(25)}
    df = spark.createDataFrame(sorted(pairs), "haplotype_id BIGINT, mutation_id BIGINT")
    sets = {}
    for h, m in pairs:
        sets.setdefault(h, set()).add(m)
    return df, spark.range(30).withColumnRenamed("id", "haplotype_id"), sets


@pytest.mark.parametrize(("block", "chunk"), [(256, 16384), (4, 50), (1, 400)])
def test_any_tiling_gives_the_same_pairs(skewed, block, chunk):
    df, haplotypes, sets = skewed
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    got = {(r.haplotype_a, r.haplotype_b): r for r in pair_set_sizes(df, (), block, chunk).collect()}
    assert {k: r.shared for k, r in got.items()} == want
    assert all(r.size_a == len(sets[a]) and r.size_b == len(sets[b]) for (a, b), r in got.items())
    assert all(r.union_size == len(sets[a] | sets[b]) for (a, b), r in got.items())
    assert haplotype_overlaps(df, (), block, chunk).count() == len(want)


def test_means_count_pairs_that_share_nothing(skewed):
    df, haplotypes, sets = skewed
    got = pairwise_similarities(df, haplotypes, block=5, chunk=60).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, brute(sets, 30), strict=True))


def test_one_haplotype_is_like_itself(spark):
    one = spark.createDataFrame([(0,)], "haplotype_id BIGINT")
    none = spark.createDataFrame([], "haplotype_id BIGINT, mutation_id BIGINT")
    assert tuple(pairwise_similarities(none, one).first()) == (1.0, 1.0, 1.0)


def test_given_pairs(skewed, spark):
    df, _, sets = skewed
    pairs = [(1, 2), (1, 2), (3, 29), (28, 29)]
    table = spark.createDataFrame(pairs, "haplotype_a BIGINT, haplotype_b BIGINT")
    got = sampled_pairwise_similarity(df, table, "jaccard").first().mean_similarity
    jaccard = len(sets[1] & sets[2]) / len(sets[1] | sets[2])
    assert abs(got - (2 * jaccard + 0.0 + 1.0) / 4) < 1e-12


@pytest.mark.parametrize(("block", "chunk"), [(256, 16384), (3, 40)])
def test_means_of_groups_for_any_tiling(skewed, spark, block, chunk):
    df, haplotypes, sets = skewed
    few = "haplotype_id < 9"
    named = lambda d, g: d.selectExpr("*", f"'{g}' AS g")
    both = named(df, "a").unionByName(named(df.where(few), "b"))
    everyone = named(haplotypes, "a").unionByName(named(haplotypes.where(few), "b"))
    got = {r.g: [r.jaccard, r.dice, r.overlap] for r in pairwise_similarities(both, everyone, ["g"], block, chunk).collect()}
    first = {h: s for h, s in sets.items() if h < 9}
    common = set.intersection(*(first.get(h, set()) for h in range(9)))
    want = {"a": brute(sets, 30), "b": brute({h: s - common for h, s in first.items()}, 9)}
    assert all(abs(x - y) < 1e-12 for g in want for x, y in zip(got[g], want[g], strict=True))


def test_rare_mutations_are_pairs_and_common_ones_bits_once_a_block(skewed):
    df, _, sets = skewed
    sizes = df.groupBy("haplotype_id").agg(F.count("*").alias("_size"))
    placed, mutations = _numbered(sizes, copy_counts(df), [], 4, 50)
    tiles = _tiles(df, placed, mutations, []).collect()
    blocks = placed.select("_block").distinct().count()
    assert blocks > 1 and placed.agg({"_blocks": "max"}).first()[0] >= blocks
    bits = [r for r in tiles if r._chunk >= 0]
    all_blocks = placed.first()._blocks
    # the bits of a haplotype and chunk go to each pair of blocks with its own, once
    assert len(bits) == len({(r._lo, r._hi, r._chunk, r._block, r._first) for r in bits})
    assert len(bits) == all_blocks * len({(r._chunk, r._block, r._first) for r in bits})
    ones = sum(int.from_bytes(r._held).bit_count() for r in bits)
    common = {r.mutation_id for r in mutations.where("_common").collect()}
    assert ones == all_blocks * sum(len(s & common) for s in sets.values())
    copies = Counter(m for s in sets.values() for m in s)
    rare = {r.mutation_id for r in mutations.where("not _common").collect()}
    assert rare and common and rare | common == {m for m, n in copies.items() if n > 1}
    assert sum(len(r._pairs) for r in tiles if r._chunk == -1) == sum(copies[m] * (copies[m] - 1) // 2 for m in rare)


def test_names_and_null_groups(spark):
    rows = [("x", "b", 1), ("x", "a", 1), ("x", "a", 2), ("y", "c", 1), (None, "a", 1), (None, "b", 1)]
    df = spark.createDataFrame(rows, "g STRING, haplotype_id STRING, mutation_id BIGINT")
    got = [tuple(r) for r in pair_set_sizes(df, ["g"]).collect()]
    assert got == [("x", "a", "b", 2, 1, 1, 2)]


def test_sets_without_a_shared_mutation_are_not_empty(spark):
    rows = [("x", 0, 1), ("x", 1, 2), ("y", 0, 1), ("y", 1, 1), ("y", 2, 2)]
    df = spark.createDataFrame(rows, "g STRING, haplotype_id BIGINT, mutation_id BIGINT")
    haplotypes = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 2)], "g STRING, haplotype_id BIGINT")
    got = {r.g: r.jaccard for r in pairwise_similarities(df, haplotypes, ["g"]).collect()}
    assert got["x"] == 0.0 and abs(got["y"] - 1 / 3) < 1e-12
    only_x = pairwise_similarities(df.where("g = 'x'").drop("g"), haplotypes.where("g = 'x'").drop("g")).first()
    assert tuple(only_x) == (0.0, 0.0, 0.0)


def test_pairs_of_rare_mutations_are_rows_of_many_mutations(spark):
    """Lists go to a pair of blocks in few rows, and tiles without bits hold the pairs that occur, not a matrix."""
    rng = random.Random(3)
    sets = {h: {m for m in range(4000) if rng.random() < 0.002} for h in range(600)}
    df = spark.createDataFrame([(h, m) for h, s in sets.items() for m in s], "haplotype_id BIGINT, mutation_id BIGINT").coalesce(1)
    copies = Counter(m for s in sets.values() for m in s)
    sizes = df.groupBy("haplotype_id").agg(F.count("*").alias("_size"))
    placed, mutations = _numbered(sizes, copy_counts(df), [], 64, 100)
    assert placed.agg({"_blocks": "max"}).first()[0] == 2 and not mutations.where("_common").count()
    rows = [r for r in _tiles(df, placed, mutations, []).collect() if r._chunk == -1]
    assert sum(len(r._pairs) for r in rows) == sum(n * (n - 1) // 2 for n in copies.values())
    assert len(rows) <= 3 * 8 < len(copies) / 10  # tiles by tasks, not by mutations
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r.haplotype_a, r.haplotype_b): r.shared for r in haplotype_overlaps(df, (), 64, 100).collect()} == want
