"""E1-E5, A1, J4."""

import pytest

from tessera.operators import evaluate as E

OUTPUTS = [
    "<start_working_out>15 * 23 = 345<end_working_out><SOLUTION>345</SOLUTION>",
    "<start_working_out>Wrong reasoning<end_working_out><SOLUTION>999</SOLUTION>",
    "No format at all: 345",
    "<start_working_out>10 + 5 = 15<end_working_out><SOLUTION>15</SOLUTION>",
]
TRUTHS = ["345", "345", "345", "15"]
REWARDS = [10.5, -2.5, -6.5, 12.0]


def test_golden_batch(spark):
    df = spark.createDataFrame(list(zip(range(4), OUTPUTS, TRUTHS, REWARDS)),
                               "id long, output string, ground_truth string, reward double")
    m = E.metrics(E.evaluate_rows(df), reward="reward").first()
    assert (m.format_accuracy, m.answer_accuracy, m.reasoning_present) == (75.0, 50.0, 75.0)
    assert m.avg_reasoning_length == 9.75 and m.avg_total_reward == 3.375 and m.num_samples == 4
    m0 = E.metrics(E.evaluate_rows(df)).first()
    assert m0.avg_total_reward == 0.0


def test_answer_rules(spark):
    rows = [("15", "5", True), ("The Answer.", "the answer", True), ("x", "", True), ("1,000", "1000", True),
            ("3.0001", "3", True), ("3.01", "4", False), ("3.01", "3", True), ("abc", "xyz", False), ("", "", True)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean")
    for r in df.select("want", E.answer_matches("p", "t").alias("got")).collect():
        assert r.got == r.want


def test_empty_metrics_are_null(spark):
    df = spark.createDataFrame([], "id long, output string, ground_truth string")
    m = E.metrics(E.evaluate_rows(df)).first()
    assert m.num_samples == 0 and m.format_accuracy is None


def test_grouped_metrics(spark):
    df = spark.createDataFrame([("a", OUTPUTS[0], "345"), ("a", OUTPUTS[2], "345"), ("b", OUTPUTS[3], "15")],
                               "g string, output string, ground_truth string")
    got = {r.g: r.format_accuracy for r in E.metrics(E.evaluate_rows(df), by=["g"]).collect()}
    assert got == {"a": 50.0, "b": 100.0}


def test_strict_pairing(spark):
    o = spark.createDataFrame([(1, "x"), (2, "y")], "id long, output string")
    t = spark.createDataFrame([(1, "1")], "id long, ground_truth string")
    with pytest.raises(Exception, match="must have same length"):
        E.pair_outputs_truths(o, t).collect()
    same = t.unionByName(spark.createDataFrame([(2, None)], "id long, ground_truth string"))
    assert sorted(tuple(r) for r in E.pair_outputs_truths(o, same).collect()) == [(1, "x", "1"), (2, "y", None)]
    clash = o.select("id", "output", E.F.lit("z").alias("_side"))
    assert E.pair_outputs_truths(clash, same).columns == ["id", "output", "_side", "ground_truth"]
    assert E.pair_outputs_truths(o, t, strict=False).count() == 2


def test_metrics_log_and_text(spark):
    df = spark.createDataFrame(list(zip(range(4), OUTPUTS, TRUTHS, REWARDS)),
                               "id long, output string, ground_truth string, reward double")
    m = E.metrics(E.evaluate_rows(df), reward="reward")
    log = E.metrics_log(m).first().asDict()
    assert log["eval/num_samples"] == 4.0 and log["eval/format_accuracy"] == 75.0
    text = E.metrics_text(m).first().summary
    assert text == ("Evaluation Metrics (n=4):\n  Format Accuracy:    75.0%\n  Answer Accuracy:    50.0%\n"
                    "  Reasoning Present:  75.0%\n  Avg Reasoning Len:  10 chars\n  Avg Total Reward:   3.38")
