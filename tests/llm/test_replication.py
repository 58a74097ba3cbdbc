import hashlib
import math
from collections import Counter

from popstat.llm.replication import replicate_haplotypes, tempered_weights


def poisson(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < 80:
        k += 1
        p = p * mean / k
        c += p
    return k


def brute(ids, mean, seed=42):
    parts = max(math.ceil(mean / 16), 1)
    u = lambda i, j: int(hashlib.md5(f"{seed}:{'' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
    return {i: sum(poisson(u(i, j), mean / parts) for j in range(1, parts + 1)) for i in ids}


def test_counts_are_poisson_by_inversion(spark):
    rows = [(i, "a" if i % 3 else "b", "x", 9) for i in range(300)] + [(1000, None, "x", 9), (1001, "c", "x", 9), (None, "b", None, 9)]
    df = spark.createDataFrame(rows, "haplotype_id long, population string, text string, replicate int").repartition(5)
    targets = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), (None, 4.0), ("missing", 0.0), ("c", -1.0)], "population string, weight double")
    got = replicate_haplotypes(df, targets, total=900).collect()
    copies = Counter((r.population, r.haplotype_id) for r in got)
    for name, share in (("a", 1 / 8), ("b", 3 / 8), (None, 4 / 8)):
        ids = [r[0] for r in rows if r[1] == name]
        want = brute(ids, share * 900 / len(ids))
        assert {i: copies[name, i] for i in ids} == want
    assert not any(r.population == "c" for r in got)
    assert all(sorted(r.replicate for r in got if r.haplotype_id == i) == list(range(copies["a", i])) for i in (1, 2, 4))
    assert abs(copies[None, 1000] - 450) < 5 * 450**0.5


def test_the_same_at_any_partitioning_and_shuffled(spark):
    df = spark.range(2000).selectExpr("id AS haplotype_id", "if(id < 1900, 'big', 'small') AS population")
    targets = tempered_weights(df, 0.5)
    key = lambda rows: sorted((r.haplotype_id, r.replicate, r.shuffle_key) for r in rows)
    one, many = replicate_haplotypes(df.coalesce(1), targets).collect(), replicate_haplotypes(df.repartition(9), targets).collect()
    assert key(one) == key(many)
    order = [r.haplotype_id for r in one]
    assert sum(abs(a - b) < 3 for a, b in zip(order, order[1:])) < len(order) / 20


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(7, "a"), (7, "a")], "haplotype_id long, population string")
    targets = spark.createDataFrame([("a", 1.0)], "population string, weight double")
    counts = Counter(r.replicate for r in replicate_haplotypes(df, targets, total=40).collect())
    assert set(counts.values()) == {2}
    assert replicate_haplotypes(df.limit(0), targets).collect() == []
    assert replicate_haplotypes(df, targets.limit(0)).collect() == []
