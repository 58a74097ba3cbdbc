import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popstat.llm import outliers
from popstat.llm.outliers import judge_logs, robust_distances, text_statistics

FLOORS = (0.08, 0.05, 0.08, 0.15)


def brute_statistics(text):
    text = text or ""
    for c in "\t\n\x0b\x0c\r":
        pass
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute_distances(x):
    """The documented algorithm with NumPy on one group of whole-number vectors."""
    n, scale = len(x), outliers.KEEP / outliers._chi_squared(outliers._chi_squared_point(outliers.KEEP, 4), 6)
    z, floor = x / outliers.UNIT, np.diag(np.square(FLOORS))

    def estimate(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(4, 4) * factor + floor

    medians = np.array([sorted(column)[math.ceil(n / 2) - 1] for column in x.T]) / outliers.UNIT
    best = None
    for centre, matrix in (estimate(z, 1.0), (medians, floor)):
        for _ in range(outliers.STEPS):
            d = z - centre
            d2 = np.maximum(np.einsum("ni,ij,nj->n", d, np.linalg.inv(matrix), d), 0)
            bins = np.floor(np.log1p(d2) * 256)
            limit = np.sort(bins)[math.ceil(n * outliers.KEEP) - 1]
            centre, matrix = estimate(z[bins <= limit], scale)
        if best is None or np.linalg.det(matrix) < np.linalg.det(best[1]):
            best = centre, matrix
    d = z - best[0]
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(best[1]), d)


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for group, n in ((("a", "x"), 120), (("a", "y"), 30), (("a", None), 25), ((None, "x"), 10)):
        v = rng.normal(0, 1, (n, 4)) @ np.diag([0.5, 1, 0.2, 2]) + rng.normal(0, 3, 4)
        v[: n // 6] += 6
        rows += [(len(rows) + i, *group, *map(float, r)) for i, r in enumerate(v)]
    rows.append((-1, "a", "x", None, 1.0, 1.0, 1.0))
    schema = "id long, case_label string, variant string, a double, b double, c double, d double"
    df = spark.createDataFrame([*rows], schema).withColumn("g0", F.lit("clash"))
    statistics = {c: F.col(c) for c in "abcd"}
    got = {r.id: r.d2 for r in robust_distances(df.drop("g0"), statistics, FLOORS).collect()}
    assert got.pop(-1) is None and len(got) == 185
    pools = {0: [], 1: [], 2: []}
    for r in rows[:-1]:
        pools[0 if r[1:3] == ("a", "x") else 1 if r[1] == "a" else 2].append(r)
    for members in pools.values():
        x = np.array([[math.floor(min(max(v, -16), 16) * 1024 + 0.5) if v >= 0 else -math.floor(-max(v, -16) * 1024 + 0.5) for v in r[3:]] for r in members], float)
        want = brute_distances(x)
        assert np.allclose([got[r[0]] for r in members], want, rtol=1e-6)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\n x\nx\n\nx", "#a *b $ % & | < > é漢😀", "w " * 20_000]
    texts += ["".join(rng.choices(["a", "b", "c ", " ", "\n", "\t", "#", "\x0b", "é"], k=rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, log string, _other string")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_statistics(df, "log").collect()}
    assert [got[i] for i in range(len(texts))] == [brute_statistics(t) for t in texts]


def test_odd_logs_of_a_group_are_rejected(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    rows = [(i, "en" if i % 2 else "de", "s", " ".join(word() for _ in range(rng.randint(60, 300)))) for i in range(150)]
    rows += [(1000 + i, "en", "s", " ".join(word() + "###" for _ in range(80))) for i in range(8)]
    rows += [(2000, "en", "s", "too short"), (2001, None, None, None), (2002, "en", "s", "again and again " * 40), (5, "de", "s", " ".join(word() for _ in range(90)))]
    df = spark.createDataFrame(rows, "run_id long, case_label string, variant string, log string")
    got = judge_logs(df).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.run_id < 150) and not any(r.kept for r in got if r.run_id >= 1000)
    assert {r.run_id for r in got if r.base_failed} == {2000, 2001, 2002}


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(4)
    word = lambda low=3, high=8: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(low, high)))
    passage, lines = [word(6, 6) for _ in range(30)], [word(6, 6) for _ in range(50)] * 2
    rng.shuffle(lines)
    odd = [
        " ".join(word(11, 14) for _ in range(100)), " ".join(word() + "#" * (i % 10 == 0) for i in range(100)),
        "\n".join(lines), " ".join([*passage, *(word() for _ in range(100)), *passage, *(word() for _ in range(40))]),
    ]
    rows = [(i, "en", "s", " ".join(word() for _ in range(rng.randint(100, 300)))) for i in range(150)]
    rows += [(1000 + i, "en", "s", text) for i, text in enumerate(odd)]
    got = {r.run_id: r for r in judge_logs(spark.createDataFrame(rows, "run_id long, case_label string, variant string, log string")).collect()}
    assert sum(got[i].kept for i in range(150)) == 150
    assert [(got[1000 + i].kept, got[1000 + i].base_failed) for i in range(4)] == [(False, False)] * 4
    only = [(r.n_symbols > 0, r.n_dup_lines > 0, r.n_repeat_words > 0) for r in (got[1000 + i] for i in range(4))]
    assert only == [(False, False, False), (True, False, False), (False, True, False), (False, False, True)]


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(1, "a", "b", "one two " * 30 + " ".join(map(str, range(100))))], "run_id long, case_label string, variant string, log string")
    assert [r.kept for r in judge_logs(df).collect()] == [True]
    assert judge_logs(df.limit(0)).collect() == []


@pytest.mark.parametrize("p", [0.5, 0.975, 1 - 1e-6])
def test_chi_squared_points(p):
    assert abs(outliers._chi_squared(outliers._chi_squared_point(p, 4), 4) - p) < 1e-9
    assert abs(outliers._chi_squared_point(0.975, 4) - 11.1433) < 1e-3
