import random
from collections import Counter

import numpy as np
import pytest

from popstat.llm.recompression import remove_repeated_passages, representatives, word_hashes


def brute(logs, window):
    words = [(t or "").encode().split() for t in logs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def random_logs(seed, alphabet):
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randint(5, 90))] for _ in range(6)]
    logs = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                cut = rng.choice(passages)
                i = rng.randrange(len(cut))
                words += cut[i:]
            elif kind < 0.6:
                words += [rng.choice(alphabet)] * rng.randint(1, 60)  # a run
            elif kind < 0.7:
                words += rng.sample(alphabet, 2) * rng.randint(1, 30)  # a period of two
            else:
                words += [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        logs.append(" ".join(words))
    return logs


@pytest.mark.parametrize(("window", "size"), [(35, 3), (35, 60), (6, 8), (2, 30), (1, 40)])
def test_equals_brute_force(spark, window, size):
    logs = random_logs(window * size, [f"w{i}" for i in range(size)]) + [None, "", " \n", "w1 w2"]
    rows = [(i, t, "clash", 0) for i, t in enumerate(logs)]
    df = spark.createDataFrame(rows, "run_id long, log string, symbol string, row long")
    got = {r.run_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_passages(df, window).collect()}
    assert [got[i] for i in range(len(logs))] == brute(logs, window)


def test_representatives_depend_on_the_window_alone():
    rng = random.Random(5)
    alphabet = [b"a", b"b", b"c", b"d"]
    inner = [rng.choice(alphabet) for _ in range(35)]
    found = set()
    for _ in range(200):
        before = [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
        after = [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
        words = word_hashes(before + inner + after)
        name, place = representatives(words, np.array([len(before)]), 35)
        found.add((int(name[0]), int(place[0]) - len(before)))
    assert len(found) == 1


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (None, text), (1, long), (1, "short")], "run_id long, log string")
    got = sorted((r.run_id is None, r.n_words, r.n_removed) for r in remove_repeated_passages(df).collect())
    assert got == [(False, 1, 0), (False, 30_000, 0), (True, 40, 40), (True, 40, 40)]


def test_empty_table(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "run_id long, log string")).collect() == []
