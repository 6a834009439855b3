"""Edge values of the column expressions."""

from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.functions import (
    clean_lower,
    clean_upper,
    exact_avg,
    full_name,
    initcap_words,
    parse_date,
    run_timestamp,
    salary_band,
    whole_years,
)


def values(spark, rows, ddl, column):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ddl)
    return [r[0] for r in df.select(column).collect()]


def test_trim_takes_spaces_only(spark):
    assert values(spark, ["  \ta B ", "x\n ", "   ", "", None], "c string", clean_lower("c")) == [
        "\ta b",
        "x\n",
        "",
        "",
        None,
    ]
    assert values(spark, [" São ", "straße", "é "], "c string", clean_upper("c")) == ["SÃO", "STRAßE", "É"]
    assert values(spark, ["ﬁnance", "ŉ", "a\ufdd0ß🙂é"], "c string", clean_upper("c")) == ["ﬁNANCE", "ŉ", "A\ufdd0ß🙂É"]
    assert values(spark, ["İZMİR", "ΣΟΦΟΣ", "JOSÉ"], "c string", clean_lower("c")) == ["izmir", "σοφοσ", "josé"]


CAPITALS = [
    ("são josé-dos d'ávila RIO de janeiro 3rd", "São José-Dos D'Ávila Rio De Janeiro 3rd"),
    ("rio de janeiro", "Rio De Janeiro"),
    ("  BELO  horizonte", "  Belo  Horizonte"),
    ("o'neil--smith,jr. a.b.c.", "O'Neil--Smith,Jr. A.B.C."),
    ("a\tb\nc_d.e,f", "A\tB\nC_D.E,F"),
    ("3rd 3RD x3y", "3rd 3rd X3y"),
    ("\u0001 \u0001a \u0001", "\u0001 \u0001A \u0001"),
    ("x\u0001 y", "X\u0001 Y"),
    ("ßart-ßart", "ßart-ßart"),
    ("İstanbul İZMİR-x", "İstanbul İzmir-X"),
    ("ǆep ǆEP", "Ǆep Ǆep"),
    ("ﬁnance ŉ ß\ufdd0ß", "ﬁnance ŉ ß\ufdd0ß"),
    ("$1 \\x $0a", "$1 \\X $0a"),
    ("", ""),
    (None, None),
]


def test_initcap_words(spark):
    assert values(spark, [c[0] for c in CAPITALS], "c string", initcap_words("c")) == [c[1] for c in CAPITALS]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" aZé3-'.,\u0001\t_ç", max_size=30), min_size=1, max_size=50))
def test_initcap_words_against_brute_force(spark, texts):
    def brute(text):
        out, inside = [], False
        for ch in text:
            out.append(ch.lower() if inside else ch.upper())
            inside = ch.isalnum()
        return "".join(out)

    assert values(spark, texts, "c string", initcap_words("c")) == [brute(t) for t in texts]


def test_full_name_is_null_when_a_part_is(spark):
    rows = [("ana", "silva"), ("ana", None), (None, "silva"), ("", "")]
    assert values(spark, rows, "a string, b string", full_name("a", "b")) == ["ana silva", None, None, " "]


def test_salary_band(spark):
    money = [Decimal("4999.99"), Decimal("5000.00"), Decimal("9999.99"), Decimal("10000.00"), None]
    assert values(spark, money, "c decimal(10,2)", salary_band("c")) == ["Junior", "Mid", "Mid", "Senior", "Senior"]


def test_exact_average_rounds_once(spark):
    cents = spark.range(10_001).select((F.when(F.col("id") < 5000, 0.01).otherwise(0)).cast("decimal(10,2)").alias("x"))
    plain, exact = cents.agg(F.round(F.avg("x"), 2), exact_avg("x", 2)).first()
    assert plain == Decimal("0.01") and exact == Decimal("0.00")
    halves = [Decimal("0.01"), Decimal("0.02"), Decimal("-0.01"), None]
    df = spark.createDataFrame([(1, v) for v in halves[:2]] + [(2, halves[2]), (2, Decimal("-0.02")), (3, None)], "g int, x decimal(10,2)")
    got = {r.g: r.a for r in df.groupBy("g").agg(exact_avg("x", 2).alias("a")).collect()}
    assert got == {1: Decimal("0.02"), 2: Decimal("-0.02"), 3: None}


def test_exact_average_of_large_sums(spark):
    df = spark.createDataFrame([(Decimal("99999999.99"),)] * 3 + [(Decimal("99999999.98"),)], "x decimal(10,2)")
    assert df.agg(exact_avg("x", 2)).first()[0] == Decimal("99999999.99")


def test_parse_date(spark):
    assert values(spark, ["21-08-1969", "1-8-1969", None], "c string", parse_date("c")) == [
        date(1969, 8, 21),
        date(1969, 8, 1),
        None,
    ]
    bad = ["31-02-1969", "1969-08-21", "x", "", "0-1-2000"]
    assert values(spark, bad, "c string", parse_date("c", on_error="null")) == [None] * len(bad)
    for text in bad:
        with pytest.raises(Exception, match="not a date"):
            values(spark, [text], "c string", parse_date("c"))
    with pytest.raises(ValueError):
        parse_date("c", on_error="skip")


YEARS = [
    (datetime(2021, 2, 28), datetime(2020, 2, 29), 0),
    (datetime(2021, 3, 1), datetime(2020, 2, 29), 1),
    (datetime(2023, 2, 28, 12), datetime(2022, 2, 28, 13), 0),
    (datetime(2023, 2, 28, 13), datetime(2022, 2, 28, 13), 1),
    (datetime(2022, 1, 1), datetime(2024, 6, 1), -2),
    (datetime(2024, 1, 1, 0, 0, 0, 5), datetime(2023, 1, 1, 0, 0, 0, 6), 0),
    (datetime(2024, 1, 1), datetime(2024, 1, 1), 0),
    (datetime(2024, 1, 1), None, None),
]


def test_whole_years(spark):
    rows = [y[:2] for y in YEARS]
    assert values(spark, rows, "a timestamp_ntz, b timestamp_ntz", whole_years("a", "b")) == [y[2] for y in YEARS]


moments = st.datetimes(datetime(1999, 12, 25), datetime(2008, 3, 2)).map(lambda d: d.replace(minute=0, second=0))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(moments, moments), min_size=50, max_size=200))
def test_whole_years_against_age(spark, pairs):
    con = duckdb.connect()
    con.execute("create table p (i int, a timestamp, b timestamp)")
    con.executemany("insert into p values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    expected = [r[0] for r in con.execute("select extract(year from age(a, b)) from p order by i").fetchall()]
    assert values(spark, pairs, "a timestamp_ntz, b timestamp_ntz", whole_years("a", "b")) == expected


def test_whole_years_around_each_day(spark):
    """Every day of five years against a run at noon of a leap day."""
    noon = F.lit("2004-02-29 12:00:00").cast("timestamp_ntz")
    days = spark.range(3000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got = {r.d: (r.y, r.z) for r in days.select("d", whole_years(noon, "d").alias("y"), whole_years("d", noon).alias("z")).collect()}
    con = duckdb.connect()
    for d, y, z in con.execute(
        """select d::date, extract(year from age(timestamp '2004-02-29 12:00:00', d)),
                  extract(year from age(d, timestamp '2004-02-29 12:00:00'))
           from (select timestamp '2000-01-01' + to_days(i::int) d from range(3000) t(i))"""
    ).fetchall():
        assert got[d] == (y, z), d


def test_run_timestamp(spark):
    aware = datetime(2026, 1, 1, 3, tzinfo=timezone(timedelta(hours=3)))
    text, naive, zoned = spark.range(1).select(
        *[run_timestamp(t).cast("string") for t in ("2026-01-01", datetime(2026, 1, 1), aware)]
    ).first()
    assert text == naive == zoned == "2026-01-01 00:00:00"
