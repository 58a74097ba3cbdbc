import pytest

from popstat.llm.templates import quoted_scenarios, with_quotations

ITEM = "A train with Anna aboard leaves at 40 km per hour. How long until Anna has gone 120 km from Berlin on rails?"
LOGS = {
    1: f"before it {ITEM} and after",
    2: "intro: A train with Maria aboard leaves at 55 mi per hour. How long until Maria has gone 165 mi from Madrid on rails?",
    3: "A train with Maria aboard leaves at 55 km per hour. How long until Pedro has gone 165 km from Madrid on rails?",
    4: ITEM.upper(),
    5: ITEM.lower().replace(" ", "\n"),
    6: "A train with Anna aboard leaves at 40 km per hour, says nobody about anything else in this long line of words",
    7: None,
    8: "",
    9: "nothing of the kind " * 5000,
    10: "x | " + ITEM.replace("40", "1,250.5").replace("120", "40"),
    11: "A bus with Anna inside goes at 40 km per day. How short until Anna has made 120 km from Berlin by road?",
}


@pytest.fixture(scope="module")
def scenarios(spark):
    rows = [("train", ITEM, 1), ("short", "Only four words here", 1), ("none", None, 1), ("empty", "", 1), (None, "one two three four five six", 2)]
    return spark.createDataFrame(rows, "scenario_name string, scenario_description string, total int")


def test_quotations(spark, scenarios):
    logs = spark.createDataFrame([(k, v, "clash") for k, v in LOGS.items()], "run_id long, log string, key string").repartition(3)
    got = {r.run_id: (round(r.coverage, 2), r.changed) for r in quoted_scenarios(logs, scenarios).collect()}
    assert set(got) == {1, 2, 4, 5, 10}
    assert got[1] == (1.0, False) and got[4][0] == got[5][0] == 1.0 and not got[4][1]
    assert got[2][0] > 0.9 and got[2][1] and got[10][1]


def test_inconsistent_slots_are_no_quotation(spark, scenarios):
    same = spark.createDataFrame([(3, LOGS[3]), (2, LOGS[2])], "run_id long, log string")
    assert [r.run_id for r in quoted_scenarios(same, scenarios).collect()] == [2]


def test_every_row_is_judged(spark, scenarios):
    rows = [(1, LOGS[1]), (1, LOGS[1]), (None, LOGS[1]), (None, "clean"), (2, None), (3, "say one two three four five six now")]
    got = with_quotations(spark.createDataFrame(rows, "run_id long, log string"), scenarios).collect()
    assert sorted((r.run_id is None, r.run_id or 0, r.contaminated, r.scenarios) for r in got) == [
        (False, 1, True, ["train"]), (False, 1, True, ["train"]), (False, 2, False, []), (False, 3, True, []),
        (True, 0, False, []), (True, 0, True, ["train"]),  # by its own text, not by another's under the same id
    ]


def test_empty_tables(spark, scenarios):
    none = spark.createDataFrame([], "run_id long, log string")
    logs = spark.createDataFrame([(1, ITEM)], "run_id long, log string")
    assert with_quotations(none, scenarios).collect() == []
    assert [r.contaminated for r in with_quotations(logs, scenarios.limit(0)).collect()] == [False]


def found(spark, item, logs):
    scenarios = spark.createDataFrame([("it", item)], "scenario_name string, scenario_description string")
    rows = spark.createDataFrame(list(enumerate(logs)), "run_id long, log string")
    return {r.run_id: (round(r.coverage, 2), r.changed) for r in quoted_scenarios(rows.repartition(1), scenarios).collect()}


def test_pieces_of_one_quotation_add_up(spark):
    words = [f"{a}{b}" for a in ("red", "sun", "cat", "oak") for b in "abcdefghij"]
    inserted = [*words[:13], "extra", *words[13:26], "more", *words[26:]]
    swapped = [*words[26:], "extra", *words[13:26], "more", *words[:13]]
    assert found(spark, " ".join(words), [" ".join(inserted), " ".join(swapped)]) == {0: (1.0, False)}
    item = "then a ship with Anna on board sails for 5 km to the north and a man called Otto pays her $40 for the long way back to land"
    other = item.replace("Anna", "Mary Ann").replace("5 km", "7km").replace("Otto", "Jan Van Dam").replace("$40", "1,250 USD")
    assert found(spark, item, [other, other.replace("7km", "7 km")]) == {0: (1.0, True), 1: (1.0, True)}


def test_one_changed_value_of_a_repeated_pair(spark):
    item = "we take 40 pears out of a big box and put them by the wall and then we take 40 pears more to the old mill by the lake"
    changed = "take 41 pears more".join(item.rsplit("take 40 pears more", 1))
    assert set(found(spark, item, [item, changed])) == {0, 1}


def test_verbatim_quotations_of_any_tokens(spark):
    for item in ("12 + 30 - 5 = 37 and 4 x 8 = 32 or 6 x 7 = 42", "Only four words here", "5 km 7 kg 9 s 11 m 13 l 15 g", "猫は庭で静かに眠っている。犬は走る。"):
        logs = [f"so it says: {item} and goes on", "12 + 31 - 5 = 38 is no item and only four are here"]
        assert set(found(spark, item, logs)) == {0}
    assert set(found(spark, "猫は庭で静かに眠っている。犬は走る。", ["前に猫は庭で静かに眠っている。犬は走る。後に", "猫は走る。"])) == {0}


def test_the_text_before_in_the_batch_does_not_matter(spark):
    item = "In winter all birds fly far away"
    assert found(spark, item, ["a text that ends in 40", item, "and 3", item]) == {1: (1.0, False), 3: (1.0, False)}


def test_partial_quotations_of_texts_under_one_id_do_not_add_up(spark):
    item = " ".join(f"word{chr(97 + i)}" for i in range(24)) + " and so it ends here today"
    words = item.split()
    texts = ["it says " + " ".join(words[:10]), "and then " + " ".join(words[10:20]), "all of it " + item]
    scenarios = spark.createDataFrame([("s", item)], "scenario_name string, scenario_description string")
    for ids in ([None, None, None], [7, 7, 7], [0, 1, 2]):
        logs = spark.createDataFrame(list(zip(ids, texts)), "run_id long, log string")
        got = with_quotations(logs, scenarios).collect()
        assert sorted(r.contaminated for r in got) == [False, False, True]
