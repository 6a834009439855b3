"""Assertions one by one, as a suite, and at the end of a run."""

import os
from datetime import datetime
from decimal import Decimal

import pytest

from lamina.__main__ import main
from lamina.operators.checks import (
    Check,
    ChecksFailed,
    accepted_values,
    assert_checks,
    freshness,
    not_null,
    query_test,
    relationships,
    run_checks,
    unique,
)
from lamina.plans.pipeline import MODELS, Warehouse, employee_checks, run_pipeline
from tests.test_models import raw

RUN = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def t(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, None, None), (None, "c", "y"), (None, "c", "z"), (3, None, "z")]
    return spark.createDataFrame(rows, "k int, v string, w string")


def test_single_checks(spark, t):
    assert [tuple(r) for r in unique(t, "k").collect()] == [(1, 2)]
    assert unique(t, "k", "w").collect() == [(1, "x", 2)]
    assert {r.k for r in not_null(t, "v").collect()} == {2, 3}
    assert [tuple(r) for r in accepted_values(t, "w", ["x", "y"]).collect()] == [("z", 2)]
    parent = spark.createDataFrame([(1,), (None,), (3,), (3,)], "id int")
    assert [tuple(r) for r in relationships(t, "k", parent, "id").collect()] == [(2, 1)]


def test_suite_equals_the_single_checks(spark, t):
    checks = [Check("unique", "t", c) for c in "kvw"] + [Check("not_null", "t", c) for c in "kvw"]
    checks += [Check("accepted_values", "t", "v", ("a",)), Check("accepted_values", "t", "w", ("x", "y"))]
    got = {(r.test, r.column): (r.failures, r.status) for r in run_checks({"t": t}, checks).collect()}
    assert len(got) == len(checks)
    for c in checks:
        single = {
            "unique": lambda c: unique(t, c.column),
            "not_null": lambda c: not_null(t, c.column),
            "accepted_values": lambda c: accepted_values(t, c.column, c.values),
        }[c.test](c).count()
        assert got[c.test, c.column] == (single, "fail" if single else "pass"), c


def test_empty_table_passes(spark, t):
    none = t.where("false")
    checks = [Check("unique", "t", "k"), Check("not_null", "t", "k"), Check("accepted_values", "t", "w", ("x",))]
    assert {r.status for r in run_checks({"t": none}, checks).collect()} == {"pass"}


def test_unknown_check():
    with pytest.raises(ValueError):
        Check("between", "t", "k")


def test_raise_names_the_failures(spark, t):
    with pytest.raises(ChecksFailed, match=r"unique\(t.k\): 1"):
        assert_checks(run_checks({"t": t}, [Check("unique", "t", "k")]))


def test_freshness(spark):
    df = spark.createDataFrame([(datetime(2025, 12, 31, 1),), (None,)], "at timestamp_ntz")
    assert tuple(freshness(df, "at", RUN, 24).first())[1:] == (23, "pass")
    assert freshness(df, "at", RUN, 22).first().status == "fail"
    assert freshness(df.where("false"), "at", RUN, 24).first().status == "fail"


def test_query_as_test(spark, t):
    t.createOrReplaceTempView("checked")
    assert query_test(spark, "select * from checked where k > :most", {"most": 2}).count() == 1
    assert query_test(spark, "select * from checked where k > 9").count() == 0


def test_sixteen_assertions():
    checks = employee_checks()
    assert len(checks) == 16
    kinds = [c.test for c in checks]
    assert (kinds.count("unique"), kinds.count("not_null"), kinds.count("accepted_values")) == (4, 10, 2)


def people(spark, **change):
    rows = [{"employee_id": f"e{i}", "email": f"e{i}@empresa.com", "department": d} for i, d in enumerate(("hr", "Sales", "HR "))]
    rows[0].update(change)
    return raw(spark, *rows)


def test_two_runs(spark, base):
    for run in (1, 2):
        result = run_pipeline(spark, people(spark), base, RUN, keep=1)
        assert {r.status for r in result.collect()} == {"pass"} and result.count() == 16
        warehouse = Warehouse(spark, base)
        counts = {name: warehouse.read(name).count() for name in MODELS}
        assert counts == {
            "raw_employees": 3, "stg_employees": 3, "dim_employee": 3, "fct_department_summary": 2,
            "raw_feed": 3, "replaced_feed": 3, "merged_feed": 3, "appended_feed": 3 * run,
        }
    assert len([n for n in os.listdir(f"{base}/gold/dim_employee") if n.startswith("load=")]) == 1
    assert sorted(os.listdir(f"{base}/gold")) == ["dim_employee", "fct_department_summary", "inc_ap"]
    assert sorted(os.listdir(f"{base}/silver")) == ["del_ins", "merge_ins", "stg_employees"]


def test_failed_checks_come_after_the_gold_tables(spark, base):
    run_pipeline(spark, people(spark), base, RUN)
    with pytest.raises(ChecksFailed, match="full_name"):
        run_pipeline(spark, people(spark, last_name=None), base, RUN)
    assert Warehouse(spark, base).read("dim_employee").where("full_name is null").count() == 1


def test_publish_after_checks(spark, base):
    run_pipeline(spark, people(spark), base, RUN, publish_after_checks=True)
    with pytest.raises(ChecksFailed, match="accepted_values"):
        run_pipeline(spark, people(spark, department="space"), base, RUN, publish_after_checks=True)
    warehouse = Warehouse(spark, base)
    assert warehouse.read("appended_feed").count() == 3
    assert {r.department for r in warehouse.read("fct_department_summary").collect()} == {"HR", "SALES"}
    run_pipeline(spark, people(spark), base, RUN, publish_after_checks=True)
    assert warehouse.read("appended_feed").count() == 6


def test_one_model_and_the_checks_on_their_own(spark, base):
    run_pipeline(spark, people(spark), base, RUN)
    warehouse = Warehouse(spark, base)
    warehouse.load(people(spark, last_name=None))
    warehouse.build("stg_employees", RUN)
    assert warehouse.read("dim_employee").where("full_name is null").count() == 0
    warehouse.build("dim_employee", RUN)
    failed = [(r.model, r.column) for r in warehouse.check(employee_checks()).where("status = 'fail'").collect()]
    assert failed == [("dim_employee", "full_name")]
    with pytest.raises(KeyError):
        warehouse.build("raw_employees", RUN)


def test_command_line(spark, base, capsys):
    people(spark).write.parquet(f"{base}/raw")
    main(["run", "--base", f"{base}/w", "--raw", f"{base}/raw", "--run-ts", RUN])
    assert capsys.readouterr().out.count("|pass") == 16
    main(["build", "appended_feed", "--base", f"{base}/w", "--run-ts", RUN])
    assert Warehouse(spark, f"{base}/w").read("appended_feed").count() == 6
    main(["show", "dim_employee", "--base", f"{base}/w", "--rows", "2"])
    assert capsys.readouterr().out.count("ana silva") == 2
    people(spark, department="space").write.mode("overwrite").parquet(f"{base}/raw")
    with pytest.raises(ChecksFailed):
        main(["run", "--base", f"{base}/w", "--raw", f"{base}/raw", "--run-ts", RUN])
    with pytest.raises(ChecksFailed):
        main(["check", "--base", f"{base}/w"])


def test_a_failed_step_stops_the_later_ones(spark, base):
    run_pipeline(spark, people(spark), base, RUN)
    with pytest.raises(Exception):
        run_pipeline(spark, people(spark).withColumn("hire_date", people(spark).city), base, RUN)
    assert Warehouse(spark, base).read("appended_feed").count() == 3


def test_no_checks_no_rows(spark):
    assert run_checks({}, []).collect() == []


def test_value_checks_do_not_copy_rows(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    checks = [Check("accepted_values", "t", "x", ("a",)), Check("accepted_values", "t", "y", ("a",)), Check("not_null", "t", "k")]
    result = run_checks({"t": df}, checks)
    assert "Expand" not in result._jdf.queryExecution().executedPlan().toString()
    assert {(r.column, r.failures) for r in result.collect()} == {("x", 0), ("y", 1), ("k", 0)}


def test_every_kind_in_one_suite(spark):
    df = spark.createDataFrame([(1, 2, "2026-01-01 00:00:00"), (1, 2, None), (3, None, None)], "a int, b int, at string")
    tables = {"t": df.withColumn("at", df["at"].cast("timestamp_ntz")), "p": spark.createDataFrame([(1,)], "k int")}
    checks = [
        Check("unique", "t", ("a", "b")),
        Check("relationships", "t", "a", parent="p", parent_column="k"),
        Check("freshness", "t", "at", run_ts="2026-01-02 00:00:00", max_age_hours=24),
        Check("freshness", "t", "at", run_ts="2026-01-03 00:00:00", max_age_hours=24),
        Check("query", "t", sql="select a from {t} join {p} on a = k"),
    ]
    found = [(r.test, r.column, r.failures, r.status) for r in run_checks(tables, checks).collect()]
    assert sorted(found) == [
        ("freshness", "at", 0, "pass"), ("freshness", "at", 1, "fail"), ("query", "", 2, "fail"),
        ("relationships", "a", 1, "fail"), ("unique", "a, b", 1, "fail"),
    ]
    with pytest.raises(ChecksFailed):
        assert_checks(run_checks(tables, checks))


def test_a_conflict_leaves_all_tables_as_they_were(spark, base):
    from lamina.sources import Table

    rows = spark.createDataFrame([(1,)], "a int")
    warehouse = Warehouse(spark, base, publish=False)
    names = ("stg_employees", "dim_employee", "fct_department_summary")
    for name in names:
        warehouse.built[name] = warehouse.table(name).overwrite(rows, publish=False)
    warehouse.table(names[-1]).overwrite(rows)
    with pytest.raises(FileExistsError, match="nothing was published"):
        warehouse.publish()
    assert [warehouse.table(n).exists() for n in names] == [False, False, True]
    assert Table(spark, warehouse.table(names[-1]).path).read().count() == 1


def test_violations_count_as_the_checks_do(spark, sf_dir):
    from lamina.operators.violations import accepted, counted, violations
    from registered.quality import inspected_orders

    tables, checks = inspected_orders(spark, sf_dir)
    found = violations(tables, checks, {"orders": ["o_orderkey"]}).persist()
    counts = {(r.test, r.model, r.column): r.failures for r in counted(found).collect()}
    expected = {(r.test, r.model, r.column): r.failures for r in run_checks(tables, checks).collect() if r.failures}
    assert counts == expected and len(counts) >= 3
    broken = {r.key for r in found.where("model = 'orders'").select("key").distinct().collect()}
    kept = accepted(tables["orders"], [c for c in checks if c.model == "orders"], tables)
    assert kept.columns == tables["orders"].columns
    assert kept.count() == tables["orders"].count() - len(broken)
    with pytest.raises(ValueError, match="no check"):
        violations(tables, [])


def test_violations_of_awkward_rows(spark, t):
    from lamina.operators.violations import accepted, violations

    checks = [Check("unique", "t", "k"), Check("not_null", "t", "v"), Check("accepted_values", "t", "w", ("x",))]
    found = violations({"t": t}, checks).select("test", "value").collect()
    assert sorted(tuple(r) for r in found) == [
        ("accepted_values", '{"w":"y"}'), ("accepted_values", '{"w":"z"}'), ("accepted_values", '{"w":"z"}'),
        ("not_null", '{"v":null}'), ("not_null", '{"v":null}'), ("unique", '{"k":1}'), ("unique", '{"k":1}'),
    ]
    assert accepted(t, checks).collect() == []


def test_watched_checks_need_no_scan(spark, tmp_path):
    """The job that writes a table counts its nulls and values; verdicts are those of the scans."""
    rows = raw(spark, {"employee_id": "1"}, {"employee_id": "2", "department": "NOWHERE", "last_name": None})
    checks = [*employee_checks(), Check("not_null", "stg_employees", "last_name")]
    warehouses = [Warehouse(spark, f"{tmp_path}/{n}", watch=w) for n, w in (("watched", checks), ("plain", ()))]
    results = []
    for warehouse in warehouses:
        warehouse.load(rows)
        warehouse.build_all(RUN, threads=3)
        results.append(sorted(tuple(r) for r in warehouse.check(checks).collect()))
    assert results[0] == results[1]
    seen = {(c.test, c.column) for c in warehouses[0].seen}
    assert ("not_null", "employee_id") in seen and ("not_null", "last_name") in seen
    assert ("accepted_values", "department") not in seen, "what is outside of a list is counted by the check"


def test_a_failed_model_stops_those_not_begun(spark, tmp_path, monkeypatch):
    begun = []
    build = Warehouse.build

    def failing(self, name, *args):
        begun.append(name)
        if name == "raw_feed":
            raise RuntimeError("no feed")
        return build(self, name, *args)

    monkeypatch.setattr(Warehouse, "build", failing)
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.load(raw(spark))
    with pytest.raises(Exception, match="no feed|cancel"):
        warehouse.build_all(RUN, threads=2)
    assert not {"replaced_feed", "merged_feed", "appended_feed"} & set(begun)


def test_bitmaps_count_any_whole_numbers(spark):
    from lamina.operators.bitmaps import distinct_numbers

    rows = [(n,) for n in (0, 0, -1, -1, 1, -32768, 32768, 32769, 10**12, -(10**12), None, None)]
    row = distinct_numbers(spark.createDataFrame(rows, "n long"), "n").first()
    assert tuple(row) == ("n", 10, 8, 2, False)
    assert tuple(distinct_numbers(spark.createDataFrame([], "n int"), "n").first()) == ("n", 0, 0, 0, True)


def test_partials_of_loads_add_up(spark, tmp_path, monkeypatch):
    from lamina.plans import partials
    from lamina.plans.employees import fct_department_summary, stg_employees
    from lamina.sources import Table

    monkeypatch.setattr(partials, "FOLD", 2)
    target, whole = Table(spark, str(tmp_path)), None
    for n, (city, salary) in enumerate([("a", "10.01"), ("b", None), ("a", "10.02"), ("c", "0.01")]):
        load = raw(spark, {"employee_id": str(n), "city": city, "salary": salary and Decimal(salary)})
        whole = load if whole is None else whole.unionAll(load)
        for _ in range(2):
            partials.add_load(stg_employees(load, RUN), target, f"load {n}")
    assert len(target.snapshot().parts) <= 2
    for at in (RUN, "2031-05-05 00:00:00"):
        expected = fct_department_summary(stg_employees(whole, at), at).collect()
        assert partials.summary_of(target.read(), at).collect() == expected
