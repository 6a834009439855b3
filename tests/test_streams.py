"""Files that arrive in steps, replays, and changes merged per micro-batch."""

import pytest
from pyspark.sql import types as T

from lamina.schemas import RAW_FEED
from lamina.sources import Table
from lamina.streaming.streams import Once, land_stream, merge_stream, without_deleted

TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_FEED])


@pytest.fixture
def base(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path)


def arrive(base, name, *lines):
    with open(f"{base}/in/{name}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_landing(spark, base):
    t = Table(spark, f"{base}/t")
    stream = spark.readStream.schema(TEXT).csv(f"{base}/in")
    arrive(base, "a", "1,Ron,Paul,d,j,2022", "2,Ben,,d,j,2022")
    land_stream(stream, t, RAW_FEED, f"{base}/c").awaitTermination()
    assert t.read().count() == 2 and dict(t.read().dtypes)["emp_id"] == "int"
    arrive(base, "b", "3,Tacy,Jen,d,j,2022")
    for _ in range(2):
        land_stream(stream, t, RAW_FEED, f"{base}/c").awaitTermination()
        assert t.read().count() == 3


def test_replayed_batch_is_left_out(spark, base):
    """The last batch's commit record is lost, so the stream runs that batch again."""
    import os

    t = Table(spark, f"{base}/t")
    stream = spark.readStream.schema(TEXT).csv(f"{base}/in")
    arrive(base, "a", "1,Ron,Paul,d,j,2022")
    land_stream(stream, t, RAW_FEED, f"{base}/c").awaitTermination()
    arrive(base, "b", "2,Ben,Stack,d,j,2022")
    land_stream(stream, t, RAW_FEED, f"{base}/c").awaitTermination()
    state = t.snapshot()
    last = max(int(n) for n in os.listdir(f"{base}/c/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{base}/c/commits/{name}"):
            os.remove(f"{base}/c/commits/{name}")
    land_stream(stream, t, RAW_FEED, f"{base}/c").awaitTermination()
    assert os.path.exists(f"{base}/c/commits/{last}"), "the batch ran again"
    assert t.snapshot() == state and t.read().count() == 2


def test_changes(spark, base):
    t = Table(spark, f"{base}/t", key="emp_id", buckets=4)
    stream = spark.readStream.schema(RAW_FEED).csv(f"{base}/in")

    def run():
        merge_stream(stream, t, "record_date", ["doj"], f"{base}/c").awaitTermination()
        return {(r.emp_id, r.first_name) for r in t.read().collect()}

    arrive(base, "a", "1,old,x,d,j,2021", "1,new,x,d,j,2022", "2,two,x,d,j,2022")
    assert run() == {(1, "new"), (2, "two")}
    arrive(base, "b", "2,again,x,d,j,2020", "3,three,x,d,j,2022")
    assert run() == {(1, "new"), (2, "two"), (3, "three")}
    arrive(base, "c", "2,later,x,d,j,2023", "3,tie,x,d,k,2022", "1,no date,x,d,j,")
    assert run() == {(1, "no date"), (2, "later"), (3, "tie")}


def test_order_of_arrival_does_not_matter(spark, base):
    """One file per micro-batch, newest record first, and again oldest first."""
    lines = [f"{k},v{n},x,d,j{n},20{n:02d}" for n in range(6) for k in range(4)]
    expected = {(k, "v5") for k in range(4)}
    for way, ordered in (("down", lines[::-1]), ("up", lines)):
        folder = f"{base}/{way}"
        import os

        os.makedirs(f"{folder}/in")
        for i in range(0, len(ordered), 5):
            arrive(folder, f"{i:03d}", *ordered[i : i + 5])
            os.utime(f"{folder}/in/{i:03d}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(RAW_FEED).option("maxFilesPerTrigger", 1).csv(f"{folder}/in")
        t = Table(spark, f"{folder}/t", key="emp_id", buckets=2)
        merge_stream(stream, t, "record_date", ["doj"], f"{folder}/c").awaitTermination()
        assert {(r.emp_id, r.first_name) for r in t.read().collect()} == expected


def test_deleted_keys_stay_deleted(spark, base):
    shape = T.StructType([*RAW_FEED.fields, T.StructField("gone", T.BooleanType())])
    stream = spark.readStream.schema(shape).csv(f"{base}/in")
    t = Table(spark, f"{base}/t", key="emp_id", buckets=2)

    def run():
        merge_stream(stream, t, "record_date", ["doj"], f"{base}/c").awaitTermination()
        return {(r.emp_id, r.first_name) for r in without_deleted(t.read(), "gone").collect()}

    arrive(base, "a", "1,one,x,d,j,2021,false", "2,two,x,d,j,2021,")
    assert run() == {(1, "one"), (2, "two")}
    arrive(base, "b", "1,one,x,d,j,2023,true")
    assert run() == {(2, "two")}
    arrive(base, "c", "1,older,x,d,j,2022,false")
    assert run() == {(2, "two")}
    arrive(base, "d", "1,newer,x,d,j,2024,false")
    assert run() == {(1, "newer"), (2, "two")}


def test_bad_value_stops_the_stream(spark, base):
    t = Table(spark, f"{base}/t")
    arrive(base, "a", "one,Ron,Paul,d,j,2022")
    query = land_stream(spark.readStream.schema(TEXT).csv(f"{base}/in"), t, RAW_FEED, f"{base}/c")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        query.awaitTermination()
    assert not t.exists()


def test_a_file_that_is_sent_twice_lands_once(spark, base):
    """Under another name, in the same run or in a later one; beyond the delay it counts as new."""
    import os

    text = T.StructType([*TEXT.fields, T.StructField("at", T.TimestampType())])
    stream = spark.readStream.schema(text).option("maxFilesPerTrigger", 1).csv(f"{base}/in")
    t = Table(spark, f"{base}/t")

    def run():
        land_stream(stream, t, RAW_FEED, f"{base}/c", Once("at", "1 hour", ["emp_id", "record_date"])).awaitTermination()
        return sorted(r.emp_id for r in t.read().collect())

    lines = ["1,Ron,Paul,d,j,2022,2026-01-01T00:00:00", "2,Ben,,d,j,2022,2026-01-01T00:10:00"]
    arrive(base, "a", *lines)
    arrive(base, "b", *lines, "3,Tacy,Jen,d,j,2022,2026-01-01T00:20:00")
    assert run() == [1, 2, 3]
    arrive(base, "c", lines[0])
    assert run() == [1, 2, 3]
    assert t.read().columns == [f.name for f in RAW_FEED]
    arrive(base, "d", "9,late,,d,j,2022,2026-01-02T00:00:00")
    assert run() == [1, 2, 3, 9]
    state = f"{base}/c/state"
    assert os.path.isdir(state)


def test_many_micro_batches_leave_few_parts(spark, base):
    stream = spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).csv(f"{base}/in")
    t = Table(spark, f"{base}/t")
    for i in range(8):
        arrive(base, f"{i:03d}", f"{i},Ron,Paul,d,j,2022")
    land_stream(stream, t, RAW_FEED, f"{base}/c", compact_every=3).awaitTermination()
    assert sorted(r.emp_id for r in t.read().collect()) == list(range(8))
    import os

    loads = [n for n in os.listdir(f"{base}/t") if n.startswith("load=")]
    # On disk are the last compaction, the state before it (three loads and the compaction before), and what came since.
    every = 3
    assert len(t.snapshot().parts) <= every and len(loads) <= 2 * every + 1 < 8 + 8 // every
