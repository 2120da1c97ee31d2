import pytest

from ebbline.functions import roles
from ebbline.operators import shape


def test_every_alias_is_known():
    assert len(roles.COLUMN_ALIASES) == 30
    assert all(shape.normalize_name(f" {alias} ") == name for alias, name in roles.COLUMN_ALIASES.items())


@pytest.mark.parametrize("name,wanted", [
    (" Tenure ", "Tenure"), ("some_col", "some_col"), ("客户_level id", "客户Levelid"), ("月费_usd", "月费Usd"), ("CHURN", "CHURN"),
])
def test_other_names(name, wanted):
    assert shape.normalize_name(name) == wanted


def test_names_round_trip(spark):
    df = spark.createDataFrame([], roles.CUSTOMER_SCHEMA)
    low = shape.rename_snake(df)
    assert low.columns[:6] == ["customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure"]
    assert "streaming_tv" in low.columns
    assert shape.rename_camel(low).columns == df.columns


def test_drop_id_any_case(spark):
    df = spark.createDataFrame([], "CUSTOMERID string, customer_id string, x int")
    assert shape.drop_id(df).columns == ["x"]


def test_cast_types(spark, rows):
    df = spark.createDataFrame(
        [("3.9", "1e2", 2.5, "a"), ("x", None, None, None), (" 7 ", "nan", float("nan"), "b")],
        "Tenure string, MonthlyCharges string, SupportTickets double, Contract string",
    )
    assert rows(shape.cast_types(df)) == [
        {"Tenure": 3, "MonthlyCharges": 100.0, "SupportTickets": 2, "Contract": "a"},
        {"Tenure": 0, "MonthlyCharges": None, "SupportTickets": 0, "Contract": None},
        {"Tenure": 7, "MonthlyCharges": None, "SupportTickets": 0, "Contract": "b"},
    ]


def test_narrow_types_keep_values(spark, rows):
    df = spark.createDataFrame(
        [(1, 300, 70_000, 1 << 40, 1.25, 1e12 + 0.123, "a"), (-128, -300, 0, 0, None, 0.0, "a"), (3, 1, 1, 1, 2.5, 1.0, "a")],
        "a bigint, b bigint, c bigint, d bigint, e double, f double, g string",
    )
    assert {r["column"]: r["proposed"] for r in rows(shape.narrow_report(df))} == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "double", "g": "string",
    }
    assert rows(shape.narrow_types(df)) == rows(df)
    assert next(r["dictionary"] for r in rows(shape.narrow_report(df)) if r["column"] == "g")


def test_record_rules(spark):
    fields = ["tenure", "monthly_charges", "senior_citizen", "ticket_sentiment", "contract"]
    df = spark.createDataFrame(
        [(24, 70.5, 0, -0.35, "x"), (101, 0.0, 2, -1.5, None), (None, None, None, None, "y"), (100, 0.01, 1, 1.0, "z")],
        "tenure int, monthly_charges double, senior_citizen int, ticket_sentiment double, contract string",
    )
    found = [r["violations"] for r in shape.validate_records(df, fields).collect()]
    assert found == [[], fields, fields[:4], []]
    valid, broken = shape.split_valid(df, fields)
    assert valid.count() == 2 and "violations" not in valid.columns and broken.count() == 2


def test_absent_required_column_breaks_every_row(spark):
    df = spark.createDataFrame([(1,)], "tenure int")
    assert "gender" in shape.validate_records(df).first()["violations"]


def test_encode(spark, rows):
    df = spark.createDataFrame([("Yes", 1, "Yes"), ("No", 0, None), (None, None, "No")], "Partner string, SeniorCitizen int, Churn string")
    out = rows(shape.encode_target(shape.encode_binary(df)))
    assert [(r["Partner"], r["SeniorCitizen"], r["label"]) for r in out] == [(1, 1, 1), (0, 0, 0), (0, None, 0)]
