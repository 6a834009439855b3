"""Cleaning, dimension, summary, feed and the latest row per key."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators.conform import conform, require_not_null
from lamina.operators.latest import latest_by
from lamina.plans.employees import dim_employee, fct_department_summary, stg_employees
from lamina.plans.feed import RAW_FEED_ROWS, normalize_feed, raw_feed
from lamina.schemas import FEED, RAW_EMPLOYEES, RAW_FEED, require_schema
from lamina.sources import Source, literal_rows, read_seed, read_source

RUN = "2026-01-01 12:00:00"
RAW_DDL = (
    "employee_id string, first_name string, last_name string, email string, department string, "
    "city string, salary decimal(10,2), hire_date date, extracted_at timestamp_ntz"
)
AT = datetime(2025, 1, 1)


def raw(spark, *changes):
    base = {
        "employee_id": "e1",
        "first_name": " Ana ",
        "last_name": "Silva",
        "email": " ANA@EMPRESA.com",
        "department": " Engineering ",
        "city": " rio de janeiro ",
        "salary": Decimal("5000.00"),
        "hire_date": date(2020, 2, 29),
        "extracted_at": AT,
    }
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes or ({},)], RAW_DDL)


def test_silver_row(spark):
    row = stg_employees(raw(spark), RUN).first()
    assert row[:9] == (
        "e1", "ana", "silva", "ana@empresa.com", "ENGINEERING", "Rio De Janeiro", Decimal("5000.00"), date(2020, 2, 29), AT,
    )


def test_required_columns_are_tested_before_trimming(spark):
    rows = raw(
        spark,
        {"employee_id": "blank", "first_name": "   "},
        {"employee_id": "no-first", "first_name": None},
        {"employee_id": "no-mail", "email": None},
        {"employee_id": None},
        {"employee_id": "no-rest", "last_name": None, "department": None, "salary": None, "hire_date": None, "city": None},
    )
    kept = {r.employee_id: r for r in stg_employees(rows, RUN).collect()}
    assert set(kept) == {"blank", "no-rest"}
    assert kept["blank"].first_name == ""
    gold = {r.employee_sk: r for r in dim_employee(stg_employees(rows, RUN), RUN).collect()}
    assert gold["no-rest"].full_name is None
    assert gold["no-rest"].salary_band == "Senior"
    assert gold["no-rest"].years_of_service is None
    assert gold["blank"].years_of_service == 5


def test_required_columns_reach_the_scan(spark, base):
    raw(spark).write.parquet(f"{base}/raw")
    df = require_not_null(spark.read.parquet(f"{base}/raw"), ["employee_id", "email"]).select("city")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(employee_id)" in plan and "IsNotNull(email)" in plan
    assert "salary" not in plan


def test_one_processed_at(spark):
    stg = stg_employees(raw(spark, {}, {"employee_id": "e2"}), RUN)
    assert fct_department_summary(stg, RUN).count() == 1
    assert stg.select("processed_at").distinct().count() == 1


def test_summary(spark):
    rows = raw(
        spark,
        {"salary": Decimal("0.01"), "city": "a"},
        {"salary": Decimal("0.02"), "city": " A"},
        {"salary": None, "city": None, "hire_date": date(2030, 1, 1)},
        {"department": None, "salary": None},
    )
    found = {r.department: r for r in fct_department_summary(stg_employees(rows, RUN), RUN).collect()}
    eng = found["ENGINEERING"]
    assert (eng.employee_count, eng.avg_salary, eng.min_salary, eng.max_salary) == (
        3, Decimal("0.02"), Decimal("0.01"), Decimal("0.02"),
    )
    assert eng.cities_count == 1
    assert eng.avg_years_of_service == Decimal("2.3")  # 5, 5, -3
    assert found[None].employee_count == 1 and found[None].avg_salary is None
    stg = stg_employees(rows, RUN)
    exact, estimate = fct_department_summary(stg, RUN), fct_department_summary(stg, RUN, approximate_cities=True)
    assert sorted(exact.collect(), key=str) == sorted(estimate.collect(), key=str)


def test_literal_feed(spark):
    feed = raw_feed(spark)
    assert [tuple(r) for r in feed.collect()] == RAW_FEED_ROWS
    assert sorted(tuple(r) for r in normalize_feed(feed).collect()) == [
        (1, "Ron", "Paul", date(1969, 8, 21), "2022-08-01 09:00:00", "2022-09-01"),
        (2, "Ben", "Stack", date(1972, 4, 14), "2022-08-01 09:00:00", "2022-09-01"),
        (3, "Tacy", "Jen", date(1981, 11, 8), "2022-08-01 09:00:00", "2022-09-01"),
    ]


def test_latest_takes_null_then_text_order(spark):
    rows = [
        (1, "2022-02-01", 1), (1, None, 2), (1, "2023-01-01", 3),
        (2, "9", 1), (2, "10", 2),
        (3, "2022", 1), (3, "2022", 2),
        (None, "a", 1), (None, "b", 2),
    ]
    df = spark.createDataFrame(rows, "k int, d string, t int")
    got = {(r.k, r.d, r.t) for r in latest_by(df, ["k"], "d", ["t"]).collect()}
    assert got == {(1, None, 2), (2, "9", 1), (3, "2022", 2), (None, "b", 2)}
    with pytest.raises(ValueError):
        latest_by(df, ["k"], "d", [])


def test_latest_keeps_one_row_per_key_before_the_shuffle(spark, base):
    spark.range(1000).selectExpr("id % 3 k", "id d").write.parquet(f"{base}/r")
    df = latest_by(spark.read.parquet(f"{base}/r"), ["K"], "d", ["d"])
    assert df.columns == ["k", "d"] and {r.d for r in df.collect()} == {997, 998, 999}
    plan = latest_by(spark.read.parquet(f"{base}/r"), ["k"], "d", ["d"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_max")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, "", "2021", "2022"]), st.sampled_from([None, 1, 2])
        ),
        max_size=40,
    )
)
def test_latest_equals_row_number(spark, rows):
    df = spark.createDataFrame(rows, "k int, d string, t int")
    newest = Window.partitionBy("k").orderBy(F.col("d").desc_nulls_first(), F.col("t").desc_nulls_first())
    expected = df.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")
    got = latest_by(df, ["k"], "d", ["t"])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected.collect()))


def test_feed_default_tie(spark):
    rows = [(1, "a", "x", "1-1-2000", "j", "2022"), (1, "a", "x", "2-1-2000", "j", "2022")]
    df = literal_rows(spark, rows, RAW_FEED)
    assert normalize_feed(df).first().birth_date == date(2000, 1, 2)


TEXT = {
    "employee_id": "1", "first_name": "a", "last_name": "b", "email": "c", "department": "d", "city": "e",
    "salary": 1.005, "hire_date": "2020-02-29", "extracted_at": "2024-01-01T10:11:12.000013",
}
TEXT_DDL = (
    "employee_id string, first_name string, last_name string, email string, department string, "
    "city string, salary double, hire_date string, extracted_at string"
)


def arrived(spark, **changes):
    return spark.createDataFrame([tuple({**TEXT, **changes}.values())], TEXT_DDL)


def test_conform_casts(spark):
    row = conform(arrived(spark), RAW_EMPLOYEES).first()
    assert (row.salary, row.hire_date) == (Decimal("1.01"), date(2020, 2, 29))
    assert row.extracted_at == datetime(2024, 1, 1, 10, 11, 12, 13)
    assert conform(arrived(spark, salary=None, hire_date=None, city=None), RAW_EMPLOYEES).first().salary is None
    padded = conform(arrived(spark, employee_id="x" * 49 + "   "), RAW_EMPLOYEES).first()
    assert padded.employee_id == "x" * 49 + " "


@pytest.mark.parametrize(
    "change",
    [
        {"salary": 123456789.0},
        {"salary": float("nan")},
        {"salary": float("inf")},
        {"hire_date": "2021-02-29"},
        {"extracted_at": "soon"},
        {"employee_id": "x" * 51},
    ],
)
def test_conform_raises(spark, change):
    with pytest.raises(Exception):
        conform(arrived(spark, **change), RAW_EMPLOYEES).collect()


def test_declared_schema(spark):
    with pytest.raises(TypeError):
        require_schema(spark.range(1), FEED)


def test_sources(spark, base):
    raw(spark).write.parquet(f"{base}/raw")
    source = Source("raw_employees", RAW_EMPLOYEES, f"{base}/raw")
    assert read_source(spark, source).first().employee_id == "e1"
    raw(spark).createOrReplaceTempView("raw_employees_view")
    assert read_source(spark, Source("raw_employees_view", RAW_EMPLOYEES)).first().city == " rio de janeiro "


def test_a_source_must_hold_what_it_declares(spark, base):
    raw(spark).drop("salary").write.parquet(f"{base}/less")
    raw(spark).withColumn("employee_id", F.lit("x" * 300)).write.parquet(f"{base}/long")
    for name in ("less", "long"):
        with pytest.raises(Exception, match="salary|does not fit"):
            read_source(spark, Source("raw", RAW_EMPLOYEES, f"{base}/{name}")).collect()
        spark.read.parquet(f"{base}/{name}").createOrReplaceTempView(f"raw_{name}")
        with pytest.raises(Exception, match="salary|does not fit"):
            read_source(spark, Source(f"raw_{name}", RAW_EMPLOYEES)).collect()


def test_every_customer_is_a_record(spark, sf_dir):
    from registered.inputs import emp_raw, given

    assert emp_raw(spark, sf_dir).count() == given(spark, sf_dir, "customer").count()
    assert emp_raw(spark, "/root/testdata/sf0.1").count() == given(spark, "/root/testdata/sf0.1", "customer").count()


def test_seed(spark, base):
    with open(f"{base}/seed.csv", "w") as f:
        f.write("emp_id,first_name,last_name,dob,doj,record_date\n1,Ron,,21-08-1969,x,\n")
    assert tuple(read_seed(spark, f"{base}/seed.csv", RAW_FEED).first()) == (1, "Ron", None, "21-08-1969", "x", None)
    with open(f"{base}/bad.csv", "w") as f:
        f.write("emp_id,first_name,last_name,dob,doj,record_date\n1,Ron\n")
    with pytest.raises(Exception):
        read_seed(spark, f"{base}/bad.csv", RAW_FEED).collect()


def test_union_by_position(spark):
    other = spark.createDataFrame([(9, "z", "y", "d", "j", "r")], "a int, b string, c string, d string, e string, f string")
    both = raw_feed(spark).union(other)
    assert both.columns == RAW_FEED.names
    assert both.where(F.col("emp_id") == 9).first().record_date == "r"


def test_latest_row_with_a_map(spark):
    rows = [(1, "2020", 1, {"a": 1}), (1, "2021", 1, {"b": 2}), (2, "2021", 5, {"x": 1}), (2, None, 1, None), (3, "a", 1, {"y": 1}), (3, "a", 1, {"z": 1})]
    df = spark.createDataFrame(rows, "k int, d string, t int, m map<string, int>").repartition(3)
    found = {r.k: (r.d, r.m) for r in latest_by(df, ["k"], "d", ["t"]).collect()}
    assert found == {1: ("2021", {"b": 2}), 2: (None, None), 3: ("a", {"z": 1})}
    assert latest_by(df, ["k"], "d", ["t"]).columns == df.columns
