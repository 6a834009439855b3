"""A day's history run again with corrected values."""

import random

from lamina.operators.history import history_table, record_history
from lamina.sources import Table
from lamina.sources.table import CLOSED_BUCKET, bucket_number


def test_a_repeated_run_replaces_what_it_opened(spark, tmp_path):
    t = history_table(spark, str(tmp_path), ["k"], buckets=2)
    days = ("2026-01-01 00:00:00", "2026-01-02 00:00:00")
    for value, day in (("a", 0), ("b", 1), ("c", 1), ("c", 1)):
        record_history(spark.createDataFrame([(1, value)], "k int, v string"), t, ["k"], days[day])
    found = {(r.v, str(r.valid_from), str(r.valid_to)) for r in t.read().collect()}
    assert found == {("a", days[0], days[1]), ("c", days[1], "None")}


def versions(t):
    return sorted((r.k, r.v or "", str(r.valid_from), str(r.valid_to)) for r in t.read().where("k is not null").collect())


def test_histories_of_both_layouts_against_brute_force(spark, tmp_path):
    """Keyed by the key and closed apart, and keyed by key and start as tables were before."""
    rng = random.Random(5)
    apart = history_table(spark, f"{tmp_path}/apart", ["k"], buckets=3)
    before = Table(spark, f"{tmp_path}/before", key=("k", "valid_from"), buckets=3)
    opened, closed = {}, []
    for day in range(1, 6):
        at = f"2026-01-0{day} 00:00:00"
        source = {k: rng.choice(["a", "b", None]) for k in rng.sample(range(12), 9)}
        df = spark.createDataFrame(list(source.items()), "k int, v string")
        for t in (apart, before):
            record_history(df, t, ["k"], at)
        for k, v in source.items():
            if k not in opened or opened[k][0] != v:
                if k in opened:
                    closed.append((k, opened[k][0] or "", opened[k][1], at))
                opened[k] = (v, at)
        expected = sorted(closed + [(k, v or "", start, "None") for k, (v, start) in opened.items()])
        assert versions(apart) == versions(before) == expected


def test_the_scan_of_open_rows_names_no_closed_file(spark, tmp_path):
    t = history_table(spark, str(tmp_path), ["k"], buckets=4)
    rows = spark.range(2000).selectExpr("cast(id as int) k", "'v' || id v")
    record_history(rows, t, ["k"], "2026-01-01 00:00:00")
    record_history(rows.selectExpr("k", "v || k % 2 v"), t, ["k"], "2026-01-02 00:00:00")
    closed = [p for p in t.bucket_parts(t.snapshot().parts) if bucket_number(p) == CLOSED_BUCKET]
    assert closed and t.read().where("valid_to is not null").count() == 2000
    assert not [f for f in t.read_open().inputFiles() if f"bucket={CLOSED_BUCKET}" in f]
    assert t.read_open().count() == t.read_open().where("valid_to is null").count() == 2000
    # What is closed stays where it is, and a repartitioned table keeps it apart.
    record_history(rows.selectExpr("k", "'again' v").where("k < 3"), t, ["k"], "2026-01-03 00:00:00")
    assert set(closed) < set(t.bucket_parts(t.snapshot().parts))
    t.rebucket(8)
    t.compact()
    assert t.read_open().count() == 2000 and t.read().count() == 4003
