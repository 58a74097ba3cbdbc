import random

import pytest

from popstat.llm.toxicity import fit_on_labels, fit_toxicity, score_toxicity, swapped

SCHEMA = "text string, toxic int, score string"


def sentences():
    rng = random.Random(6)
    plain = ["river", "house", "walk", "paper", "green", "music", "winter", "table", "friend", "garden"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=8)
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(8)] = rng.choice(["idiotic", "idiots", "scum"])
        if toxic and i % 2 or i % 20 == 1:  # women are named in toxic texts far more often
            words.append("women")
        if rng.random() < 0.1:
            words.append("men")
        rows.append((" ".join(words), int(toxic), "clash"))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([*sentences(), (None, 0, "c"), ("", 0, "c"), ("no label", None, "c")], SCHEMA).repartition(4)
    return [fit_toxicity(df, fairness=f) for f in (0.0, 10.0)]


def test_a_new_form_of_a_known_insult_scores_high(spark, models):
    df = spark.createDataFrame([("the river idiot", 1), ("what a green garden", 2), (None, 3), ("", 4), ("idiot " * 50_000, 5)], "text string, id int")
    got = {r.id: (r.score, r.predicted) for r in score_toxicity(df, models[1]).collect()}
    assert got[1][1] == got[5][1] == 1 and [got[i][1] for i in (2, 3, 4)] == [0, 0, 0]
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[3] == got[4]


def test_swapping_identity_terms_changes_little(models):
    change = [abs(m.scorer()("women in the garden") - m.scorer()("men in the garden")) for m in models]
    assert change[1] < 0.02 < change[0]
    assert swapped({"women", "house"}, (("women", "men"),), 1) == {"men", "house"}


def test_partitioning_does_not_change_the_model(spark, models):
    again = fit_toxicity(spark.createDataFrame([*sentences(), (None, 0, "c"), ("", 0, "c")], SCHEMA).coalesce(1), fairness=10.0)
    assert again == models[1]


def test_one_label_only_and_no_rows(spark):
    df = spark.createDataFrame([("a b", 0, ""), ("c", 0, "")], SCHEMA)
    assert fit_toxicity(df).scorer()("x") < 1e-6
    assert fit_toxicity(df.limit(0)).scorer()("x") < 1e-6
    assert fit_toxicity(df.selectExpr("text", "1 AS toxic")).scorer()("x") > 1 - 1e-6
    assert score_toxicity(df.limit(0), fit_toxicity(df)).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    from popstat.llm.toxicity import held_out

    model = fit_on_labels(documents, labels)
    rows = score_toxicity(documents.where(held_out()), model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
