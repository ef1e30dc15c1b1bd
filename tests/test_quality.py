import json

from featloom.plans import quality as Q

NOW = "2024-02-01 00:00:00"


def suite(*entries):
    return Q.make_suite("s", [{"expectation_type": t, "kwargs": k} for t, k in entries])


def by_position(df):
    return {r["position"]: r for r in df.collect()}


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (2, None, 5.0), (None, "zz", 9.0)], "id int, s string, x double")
    got = by_position(Q.validate(df, suite(
        ("expect_column_values_to_not_be_null", {"column": "id"}),
        ("expect_column_values_to_not_be_null", {"column": "id", "mostly": 0.75}),
        ("expect_column_values_to_be_unique", {"column": "id"}),
        ("expect_column_values_to_be_unique", {"column": "s"}),
        ("expect_column_values_to_be_in_set", {"column": "s", "value_set": ["a", "b"]}),
        ("expect_column_values_to_be_between", {"column": "x", "min_value": 1, "max_value": 9}),
        ("expect_column_values_to_be_between", {"column": "x", "min_value": 1, "strict_min": True}),
        ("expect_column_values_to_match_regex", {"column": "s", "regex": "^[a-z]$"}),
        ("expect_table_row_count_to_be_between", {"min_value": 5}),
        ("expect_column_mean_to_be_between", {"column": "x", "min_value": 5, "max_value": 5}),
        ("expect_column_to_exist", {"column": "x"}),
        ("expect_column_values_to_be_unique", {"column": "nope"}),
        ("expect_magic", {"column": "x"}),
        ("expect_column_min_to_be_between", {}))))
    ok = {i: r["success"] for i, r in got.items()}
    assert ok == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False, 9: True,
                  10: True, 11: False, 12: False, 13: False}
    assert (got[2]["element_count"], got[2]["unexpected_count"]) == (3, 2)     # NULL ids are not looked at
    assert got[0]["unexpected_percent"] == 25.0 and got[9]["observed_value"] == 5.0
    assert got[11]["error"] == "column nope not found" and "expect_magic" in got[12]["error"]
    assert got[13]["error"] == "no column given"


def test_empty_frame_and_summary(spark):
    df = spark.createDataFrame([], "id int")
    s = suite(("expect_column_values_to_not_be_null", {"column": "id"}), ("expect_column_values_to_be_unique", {"column": "id"}),
              ("expect_column_max_to_be_between", {"column": "id", "max_value": 3}))
    r = Q.validate(df, s)
    assert [x["success"] for x in r.orderBy("position").collect()] == [True, True, False]
    total = Q.summary(r).first()
    assert (total["evaluated_expectations"], total["successful_expectations"], total["unsuccessful_expectations"],
            total["success"]) == (3, 2, 1, False)


def test_only_unique_checks(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    assert Q.validate(df, suite(("expect_column_values_to_be_unique", {"column": "id"}))).first()["success"] is False


def test_batch_results_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    s = suite(("expect_column_values_to_not_be_null", {"column": "id"}))
    for batch in (1, 2):
        Q.save_results(Q.validate_batch(batch, df, s, NOW), str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r"))
    assert sorted(r["run_name"] for r in back.collect()) == ["spark_batch_1_20240201_000000", "spark_batch_2_20240201_000000"]
    assert Q.validate_batch(1, df, s, NOW, run_name="mine").first()["run_name"] == "mine"


def test_every_failing_expectation_is_a_row(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, "a", True, dt.date(2024, 1, 1), {"k": 1}), (2, "10", False, None, None)],
                               "id int, s string, b boolean, d date, m map<string,int>")
    checks = [
        ("expect_column_values_to_be_between", {"column": "s", "min_value": 5}),
        ("expect_column_values_to_be_between", {"column": "id", "min_value": "x"}),
        ("expect_column_values_to_be_between", {"column": "id"}),
        ("expect_column_values_to_be_in_set", {"column": "s"}),
        ("expect_column_values_to_be_in_set", {"column": "id", "value_set": ["a", 1]}),
        ("expect_column_values_to_match_regex", {"column": "s"}),
        ("expect_column_values_to_match_regex", {"column": "s", "regex": "("}),
        ("expect_column_mean_to_be_between", {"column": "s", "min_value": 1}),
        ("expect_column_values_to_be_unique", {"column": "m"}),
        ("expect_column_values_to_not_be_null", {"column": "id", "mostly": "all"}),
        ("expect_column_values_to_be_between", {"column": "d", "min_value": "2023-01-01"}),
        ("expect_column_values_to_be_between", {"column": "d", "min_value": "soon"}),
        ("expect_column_values_to_match_regex", {"column": "m", "regex": "k"}),
        ("expect_column_values_to_be_in_set", {"column": "b", "value_set": [True, False]}),
        ("expect_table_row_count_to_be_between", {"min_value": "many"}),
        ("expect_column_values_to_be_unique", {"column": "d"}), ("expect_column_values_to_be_unique", {"column": "id"})]
    got = by_position(Q.validate(df, suite(*checks)))
    assert len(got) == len(checks)
    assert sorted(i for i in got if got[i]["success"]) == [10, 12, 13, 15, 16]
    assert sorted(i for i in got if got[i]["error"]) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 11, 14]
    assert got[4]["unexpected_count"] == 1                 # a text is not among numbers
