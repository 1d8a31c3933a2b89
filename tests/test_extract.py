import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrant.functions import extract
from calibrant.operators.staging import with_probability

CASES = [
    ("nothing to go by", None),
    ("<think>maybe 15%</think> No reason to change that.", 0.15),
    ("<think>15% at first</think>\nOn balance 67%", 0.67),
    ("Three down at the 31 with 9 left: 18%.", 0.18),
    ("with 12 to go and 3rd-and-4, call it 57 %", 0.57),
    ("I was at 40 percent; final answer: 48%", 0.48),
    ("answer = .05", 0.05),
    ("Hence the final probability is 0.91, more or less", 0.91),
    ("A 33% shot for the home side", 0.33),
    ("win probability 4%", 0.04),
    ("range 55-60%", 0.55),
    ("maybe 55-60% here, so answer: 37", 0.37),
    ("Line 2 is torn off, -13 makes no sense: nothing to offer.", 0.02),
    ("answer: 1", 1.0),
    ("answer: 1%", 0.01),
    ("108% no wait", None),
    ("", None),
    (None, None),
    ("5 %", 0.05),
    ("réponse: 0.4, éanswer: 7 and 0.2", 0.2),
    ("answer is hidden, final answer: 640 then 55", 0.55),
    ("answer 12. Later the answer: none", 0.12),
    ("<THINK>only 30% thought", 0.30),
]


def test_literal_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    direct = df.select("i", extract.extract_probability(F.col("text")).alias("p"))
    staged = with_probability(df, name="p")
    for frame in (direct, staged):
        got = {r["i"]: r["p"] for r in frame.select("i", "p").collect()}
        for i, (text, expected) in enumerate(CASES):
            if expected is None:
                assert got[i] is None, text
            else:
                assert got[i] == pytest.approx(expected), text


def test_region_of_an_unclosed_block(spark):
    row = spark.createDataFrame([("before <think>12 yards",)], "t string").select(
        extract.answer_region(F.col("t")).alias("r")).first()
    assert row["r"].strip() == "before"


def test_reasoning_is_a_fallback(spark):
    df = spark.createDataFrame(
        [("no idea", "I lean 41%"), ("12%", "I lean 41%"), ("no idea", ""), (None, "70%")],
        "text string, reasoning string")
    direct = [r["p"] for r in df.select(
        extract.response_probability(F.col("text"), F.col("reasoning")).alias("p")).collect()]
    staged = [r["p"] for r in with_probability(df, name="p", reasoning="reasoning").collect()]
    assert direct == staged == [0.41, 0.12, None, 0.7]


def test_completion_text(spark):
    df = spark.createDataFrame(
        [([("user", "q"), ("assistant", "a")],), ([],)],
        "m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(extract.completion_text(F.col("m"))).collect()] == ["a", ""]


def test_answer_span(spark):
    df = spark.createDataFrame([
        ("a b c Probability: 63%",), ("no marker",),
        ("Probability: unclear early on. Final Probability: 70%",), ("Probability: 5%",), ("",),
    ], "t string").select(extract.answer_span(F.col("t")).alias("s")).select("s.*").collect()
    assert [r["prefix_tokens"] for r in df] == [3, None, 5, 0, None]
    assert [r["answer_tokens"] for r in df] == [2, 2, 2, 2, 0]
    assert df[0]["answer_share"] == pytest.approx(0.4)
    letters = spark.createDataFrame([("ab Probability: 1",)], "t string").select(
        extract.answer_span(F.col("t"), count=F.length).alias("s")).first()["s"]
    assert (letters["prefix_tokens"], letters["total_tokens"]) == (3, 17)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=6), st.text("ab c.%\n", max_size=12))
def test_last_percentage_wins(spark, whole, noise):
    noise = noise.replace("%", "")
    text = noise.join(f" {n}% " for n in whole)
    row = spark.createDataFrame([(text,)], "t string").select(
        extract.extract_probability(F.col("t")).alias("p")).first()
    assert row["p"] == pytest.approx(whole[-1] / 100)
