import pytest
from pyspark.sql import functions as F

from ebbline.operators import cleaning, counts, dedup, profiling
from ebbline.plans.cleaning import clean_table
from ebbline.session import staged


def charges(spark, values):
    return spark.createDataFrame(values, "Tenure int, MonthlyCharges double, TotalCharges double")


@pytest.mark.parametrize("tenure,monthly,total,wanted", [
    (3, 10.0, None, 30.0),       # no total: computed
    (3, None, 30.0, None),       # nothing to compute from
    (None, 10.0, 30.0, None),
    (10, 10.0, 104.0, 104.0),    # 3.8 % off
    (10, 10.0, 106.0, 100.0),    # 5.7 % off
    (0, 10.0, 5.0, 0.0),         # a new customer owes nothing
    (0, 10.0, 0.0, 0.0),
    (10, -10.0, -100.0, -100.0),
])
def test_charges(spark, tenure, monthly, total, wanted):
    fixed = cleaning.charges_fix(charges(spark, [(tenure, monthly, total)])).first()
    assert fixed["TotalCharges"] == wanted


def test_charges_only_reported(spark):
    df = charges(spark, [(0, 10.0, 5.0), (10, 10.0, 106.0), (1, 1.0, 1.0), (2, None, 3.0)])
    assert cleaning.charges_fix(df, fix=False).collect() == df.collect()
    assert cleaning.charges_report(df).first().asDict() == {"rows": 4, "inconsistent": 3, "new_but_charged": 1, "deviating": 2}


def test_charges_skipped_without_columns(spark):
    df = spark.createDataFrame([(1,)], "Tenure int")
    assert cleaning.charges_fix(df).columns == ["Tenure"]


def test_numeric_fills(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 4.0)], "Tenure int, MonthlyCharges double")
    names = ["Tenure", "MonthlyCharges"]
    assert cleaning.numeric_fills(df, names) == {"Tenure": 1.5, "MonthlyCharges": 2.5}
    assert cleaning.numeric_fills(df, names, "mean") == {"Tenure": 1.5, "MonthlyCharges": 2.5}
    filled = cleaning.impute_numeric(df, strategy="zero").collect()
    assert [tuple(r) for r in filled] == [(1, 1.0), (2, 0.0), (0, 4.0)]
    # A fractional fill makes a whole-number column fractional; truncation comes with the types.
    assert [r["Tenure"] for r in cleaning.impute_numeric(df).collect()] == [1.0, 2.0, 1.5]
    with pytest.raises(ValueError):
        cleaning.impute_numeric(df, strategy="other")


def test_categorical_fills(spark):
    df = spark.createDataFrame([("b", None, 1), ("a", None, None), (None, None, 1)], "Contract string, Gender string, SeniorCitizen int")
    names = ["Contract", "Gender", "SeniorCitizen"]
    assert cleaning.categorical_fills(df, names) == {"Contract": "a", "Gender": "Unknown", "SeniorCitizen": "1"}
    assert [tuple(r) for r in cleaning.impute_categorical(df).collect()] == [("b", "Unknown", 1), ("a", "Unknown", 1), ("a", "Unknown", 1)]
    labelled = cleaning.impute_categorical(df, strategy="missing_label").collect()
    assert [tuple(r) for r in labelled] == [("b", "Missing", "1"), ("a", "Missing", "Missing"), ("Missing", "Missing", "1")]
    with pytest.raises(ValueError):
        cleaning.impute_categorical(df, strategy="other")


def test_rows_without_id_or_label_are_dropped(spark):
    df = spark.createDataFrame([("1", "Yes"), (None, "No"), ("3", None)], "CustomerID string, Churn string")
    assert [r["CustomerID"] for r in cleaning.impute(df).collect()] == ["1"]


def test_flags_are_always_added(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5), (100.0, 5), (None, 5)], "MonthlyCharges double, SupportTickets int")
    out = cleaning.outlier_flag(df).collect()
    assert [r["MonthlyCharges_outlier"] for r in out] == [0, 0, 0, 1, 0]
    assert {r["SupportTickets_outlier"] for r in out} == {0}


def test_tenure_and_total_are_exempt(spark):
    df = spark.createDataFrame([(0, 1.0, 1)], "Tenure int, TotalCharges double, SupportTickets int")
    assert cleaning.outlier_columns(df) == ["SupportTickets"]


DUPLICATES = [("3", "a", 1), ("1", "a", 1), ("2", "a", 1), ("5", None, 2), ("4", None, 2), ("6", "b", None)]


@pytest.mark.parametrize("keep,wanted", [("first", ["1", "4", "6"]), ("last", ["3", "5", "6"]), (False, ["6"])])
def test_dedup(spark, keep, wanted):
    df = spark.createDataFrame(DUPLICATES, "CustomerID string, Contract string, Tenure int")
    out = dedup.dedup(df, keep=keep)
    assert out.columns == df.columns and sorted(r["CustomerID"] for r in out.collect()) == wanted
    assert dedup.dedup_report(df).first().asDict() == {"rows": 6, "groups": 2, "members": 5, "removed": 3}


def test_dedup_on_a_subset_keeps_one_whole_row(spark):
    df = spark.createDataFrame([("2", "a", 20), ("1", "a", 10), ("3", "b", 30)], "CustomerID string, Contract string, Tenure int")
    out = dedup.dedup(df, ["Contract"]).orderBy("CustomerID").collect()
    assert [tuple(r) for r in out] == [("1", "a", 10), ("3", "b", 30)]
    with pytest.raises(ValueError):
        dedup.dedup(df, keep="any")


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_dedup_equals_a_plain_grouping(spark, keep):
    # Null patterns that hash alike, a hot group of a third of the rows, both zeros and NaN.
    df = spark.range(900).selectExpr(
        "cast(id as string) CustomerID", "if(id % 3 = 0, null, cast(id % 50 as string)) a",
        "if(id % 3 = 0, '7', null) b", "case id % 4 when 0 then 0D when 1 then -0D when 2 then double('NaN') else null end c")
    pick = "max" if keep == "last" else "min"
    plain = df.groupBy("a", "b", "c").agg(F.expr(f"{pick}(CustomerID)").alias("CustomerID"), F.count("*").alias("n"))
    plain = plain.where("n = 1 OR " + ("true" if keep else "false")).select("CustomerID", "a", "b", "c")
    assert sorted(map(str, dedup.dedup(df, keep=keep).collect())) == sorted(map(str, plain.collect()))
    groups = df.groupBy("a", "b", "c").count().where("count > 1").collect()
    assert dedup.dedup_report(df).first().asDict() == {
        "rows": 900, "groups": len(groups), "members": sum(g["count"] for g in groups), "removed": sum(g["count"] - 1 for g in groups)}


def test_dedup_counts_hashes_without_sorting_all_rows(spark):
    df = spark.range(100).selectExpr("cast(id as string) CustomerID", "cast(id % 90 as string) Contract")
    unique, _ = dedup._split_repeated(df, ["Contract"])
    assert "SortAggregate" not in unique._jdf.queryExecution().executedPlan().toString()


def test_dedup_does_not_hang_on_partitioning(spark):
    df = spark.range(3000).selectExpr("cast(id as string) CustomerID", "case when id % 3 = 0 then 0 else id % 700 end as Tenure")
    kept = [sorted(tuple(r) for r in dedup.dedup(df.repartition(n)).collect()) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 700


def customers(spark):
    rows = [
        (str(i), "Month-to-month" if i % 3 else None, i % 12, 20.0 + i % 9 if i % 10 else None, float((20 + i % 9) * (i % 12)),
         50 if i == 7 else i % 4, i % 25, 3 + i % 5, "Yes" if i % 4 == 0 else "No")
        for i in range(60)
    ]
    return spark.createDataFrame(
        rows, "CustomerID string, Contract string, Tenure int, MonthlyCharges double, TotalCharges double, "
        "SupportTickets int, LastLoginDays int, FeatureUsageCount int, Churn string")


def test_clean_table(spark):
    out = clean_table(customers(spark))
    assert out.columns == customers(spark).columns
    assert dict(out.dtypes)["SupportTickets"] == "int"
    # The fence of the tickets is 2.75 + 1.5 * 2 or so: capped there, then truncated.
    assert out.agg(F.max("SupportTickets")).first()[0] < 10
    checks = {r["check"]: r for r in profiling.quality_checks(out).collect()}
    assert checks["missing_values"]["passed"] and checks["duplicate_rows"]["passed"] and checks["charges_inconsistent"]["passed"]
    again = clean_table(out)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in out.collect())


def executions(spark):
    """Actions on frames so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_few_jobs_come_before_the_result(spark):
    df = staged(customers(spark), "customers")
    before = executions(spark)
    out = clean_table(df)
    assert executions(spark) - before <= 5
    out = staged(out, "cleaned")
    before = executions(spark)
    profiling.quality_checks(out)
    assert executions(spark) - before <= 5


@pytest.mark.parametrize("few", [1000, 0])
def test_modes_by_values_and_by_hashes(spark, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW_VALUES", few)
    rows = [("b", "x", None, i) for i in range(5)] + [("a", "y", None, i) for i in range(5)] + [(None, "y", None, 99)]
    df = spark.createDataFrame(rows, "tie string, most string, none string, n int")
    assert counts.modes(df, ["tie", "most", "none", "n"]) == {"tie": "a", "most": "y", "none": None, "n": "0"}


def test_truncation_after_the_cap(spark):
    df = spark.createDataFrame([("a", 0, "No"), ("b", 1, "No"), ("c", 1, "Yes"), ("d", 2, "No"), ("e", 9, "No")],
                               "CustomerID string, SupportTickets int, Churn string")
    # Quartiles 1 and 2, upper fence 3.5.
    out = {r["CustomerID"]: r["SupportTickets"] for r in clean_table(df).collect()}
    assert out["e"] == 3


def test_flag_strategy_and_bad_strategy(spark):
    assert "SupportTickets_outlier" in clean_table(customers(spark), outlier_strategy="flag").columns
    with pytest.raises(ValueError):
        clean_table(customers(spark), outlier_strategy="drop")


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "Tenure int, Contract string")
    assert profiling.describe_numeric(df).first()["count"] == 0
    assert profiling.describe_categorical(df).count() == 0
    assert profiling.table_shape(df).first().asDict() == {"rows": 0, "columns": 2}


def test_column_groups(spark):
    df = spark.createDataFrame([("a", "x", "Yes", 1), ("b", "y", "No", 2), ("c", None, "No", 3)], "k string, two string, Churn string, n int")
    found = sorted(tuple(r) for r in profiling.column_groups(df).collect())
    assert found == [("Churn", "target"), ("k", "categorical"), ("n", "numerical"), ("two", "binary"), ("two", "categorical")]
