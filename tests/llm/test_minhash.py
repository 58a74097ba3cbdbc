import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popstat.llm.minhash import edited_log_likeness, haplotype_minhashes, likeness, log_minhashes, with_fingerprint

WORDS = [f"{a}{b}{c}" for a in "abcdef" for b in "uvwxyz" for c in "klmnop"]


def shingles(text, width=5):
    words = (text or "").split()
    n = max(len(words) - width + 1, min(len(words), 1))
    return {tuple(words[i : i + width]) for i in range(n)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_of(logs):
    rows = sorted(logs, key=lambda r: -r[0])
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + after[:half], after


@pytest.fixture(scope="module")
def logs():
    draw = random.Random(5)
    texts = [" ".join(draw.choices(WORDS, k=draw.choice([1, 3, 4, 5, 8, 30, 200, 900]))) for _ in range(60)]
    texts += [None, "", " \t\n", "é" * 11, "日本 語 x", texts[8], "a " * 5000]
    return list(enumerate(texts))


def test_edited_texts_and_estimates(spark, logs):
    df = spark.createDataFrame([(i, t, "x") for i, t in logs], "run_id long, log string, edited string").repartition(5)
    got = {r.run_id: r for r in edited_log_likeness(df).collect()}
    assert len(got) == len(logs)
    errors = []
    for i, text, edited, after in edited_of(logs):
        row = got[i]
        assert (row.n_chars, row.edited) == (len(text), edited)
        assert len(row.fingerprint) == len(row.edited_fingerprint) == 256
        for estimate, other in ((row.near_edited, edited), (row.near_next, after)):
            assert 0 <= estimate <= 1
            if shingles(text) == shingles(other):
                assert estimate == 1
            errors.append((estimate - jaccard(text, other), len(shingles(text) | shingles(other))))
    large = [e for e, n in errors if n > 150]
    assert abs(np.mean(large)) < 0.02 and np.std(large) < 0.06
    assert max(abs(e) for e, _ in errors) < 0.35
    prints = {r.run_id: r.fingerprint for r in log_minhashes(df).collect()}
    assert prints == {i: r.fingerprint for i, r in got.items()}
    assert prints[60] == prints[61] == prints[62] == "0" * 256 and prints[65] == prints[8]


def test_any_partitioning_gives_the_same(spark, logs):
    df = spark.createDataFrame(logs, "run_id long, log string")
    first, second = ([tuple(r) for r in edited_log_likeness(df.repartition(n)).collect()] for n in (1, 9))
    assert sorted(first) == sorted(second)


def test_repeated_rows_null_ids_and_small_tables(spark):
    schema = "run_id long, log string"
    rows = [(5, "one two three four"), (5, "one two three four"), (5, "one two three four"), (3, "five six"), (None, "seven")]
    got = edited_log_likeness(spark.createDataFrame(rows, schema)).collect()
    ends = {(r.run_id, r.edited) for r in got}
    assert ends == {(5, "one two tone two t"), (5, "one two tfive six"), (3, "fiveseve"), (None, "sevon")}
    assert sum(r.near_next == 1 for r in got) == 2
    (alone,) = edited_log_likeness(spark.createDataFrame([(1, "ab cd")], schema)).collect()
    assert (alone.edited, alone.near_next) == ("ab ab", 1)
    assert edited_log_likeness(spark.createDataFrame([], schema)).collect() == []


def test_likeness_is_unbiased(spark):
    draw = random.Random(3)
    pairs = []
    for i in range(150):
        words = draw.sample([f"w{j}" for j in range(10_000)], 700)
        pairs.append((i, " ".join(words[:500]), " ".join(words[100:600])))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    both = with_fingerprint(with_fingerprint(df, "a", "pa", 1), "b", "pb", 1)
    found = [r[0] for r in both.select(likeness(F.col("pa"), F.col("pb"))).collect()]
    assert abs(np.mean(found) - 2 / 3) < 0.01 and np.std(found) < 0.05


def test_sparse_sets_fill_their_bins(spark):
    draw = random.Random(4)
    pairs = []
    for i in range(400):
        words = draw.sample([f"w{j}" for j in range(10_000)], 12)
        pairs.append((i, " ".join(words[:9]), " ".join(words[3:])))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    both = with_fingerprint(with_fingerprint(df, "a", "pa", 1), "b", "pb", 1)
    found = [r[0] for r in both.select(likeness(F.col("pa"), F.col("pb"))).collect()]
    assert abs(np.mean(found) - 0.5) < 0.03


def test_haplotypes(spark):
    draw = random.Random(9)
    sets = {h: set(draw.sample(range(4000), 600)) for h in range(6)}
    sets[6] = set(list(sets[0])[:500])
    rows = [(0, h, m) for h, s in sets.items() for m in s] + [(0, 1, next(iter(sets[1]))), (0, 99, 5), (0, 2, None)]
    carriers = spark.createDataFrame(rows, "snapshot int, haplotype_id int, mutation_id int")
    haplotypes = spark.createDataFrame([(0, h) for h in range(8)], "snapshot int, haplotype_id int")
    prints = haplotype_minhashes(carriers, haplotypes, ["snapshot"])
    a, b = (prints.select(F.col("haplotype_id").alias(x), F.col("packed").alias(f"p{x}")) for x in "ab")
    found = {(r.a, r.b): r.j for r in a.join(b, F.col("a") <= F.col("b")).select("a", "b", likeness(F.col("pa"), F.col("pb")).alias("j")).collect()}
    assert len(found) == 36 and found[7, 7] == found[0, 0] == 1
    sets[7] = set()
    for (x, y), j in found.items():
        union = sets[x] | sets[y]
        assert abs(j - (len(sets[x] & sets[y]) / len(union) if union else 1)) < 0.12
