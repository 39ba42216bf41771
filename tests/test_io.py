"""Readers, writers and streams on files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlewick.operators import dedupe as DD
from candlewick.sources import readers as RD, schemas as SC, writers as WR
from candlewick.streaming import streams as STR


def test_headerless_candles(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1704067200000,10,12,9,11,5,1704070799999,55,7,2,22,0\n")
    row = RD.read_klines(spark, str(tmp_path)).first()
    assert row["ds"] == dt.datetime(2024, 1, 1) and row["y"] == 11.0 and row["y_upper"] == 12.0 and row["num_of_trades"] == 7


def test_snapshots_fill_time_and_hash(spark, tmp_path):
    a, b = tmp_path / "combined", tmp_path / "new"
    a.mkdir(), b.mkdir()
    head = "id,title,body,self_text_md5,fetch_datetime\n"
    (a / "combined_20240701000000.csv").write_text(head + '1,t,"two\nlines",,2024-06-01 00:00:00\n2,t,x,kept,garbage\n')
    (b / "posts_202407011230.csv").write_text(head + "3,t,y,,\n4,t,,,\n")
    (b / "late.csv").write_text(head + "5,t,z,,\n")
    schema = SC.T.StructType([f for f in SC.POSTS_RAW if f.name in head.strip().split(",")])
    schema = SC.T.StructType([SC.POSTS_RAW[n] for n in head.strip().split(",")])
    df = RD.read_snapshots(spark, [str(a), str(b)], "2024-08-01 00:00:00", schema)
    got = {r["id"]: (r["fetch_datetime"], r["self_text_md5"]) for r in df.collect()}
    md5 = lambda s: spark.range(1).select(F.md5(F.lit(s))).first()[0]
    assert got["1"] == (dt.datetime(2024, 6, 1), md5("two\nlines"))
    assert got["2"] == (None, "kept")
    assert got["3"] == (dt.datetime(2024, 7, 1, 12, 30), md5("y"))
    assert got["4"][1] is None
    assert got["5"][0] == dt.datetime(2024, 8, 1)


def test_missing_memo_is_empty(spark, tmp_path):
    assert RD.read_table(spark, str(tmp_path / "none"), SC.RELEVANCE_MEMO).count() == 0
    with pytest.raises(Exception):
        RD.read_table(spark, str(tmp_path / "none"))


def test_empty_tables_are_not_written_and_history_grows(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    assert not WR.write_table(df.limit(0), path)
    assert WR.append_history(df, path) and WR.append_history(df, path)
    assert spark.read.parquet(path).count() == 6
    WR.compact(spark.read.parquet(path), str(tmp_path / "c"), 2)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 2


def test_next_days(spark):
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 23)), ("b", dt.datetime(2024, 1, 5, 3))], "s string, ds timestamp")
    got = sorted((r["s"], str(r["day"])) for r in RD.next_days(bars, "s", "ds", "2024-01-03").collect())
    assert got == [("a", "2024-01-02"), ("a", "2024-01-03")]


SCHEMA = "id string, v int, at timestamp"


def put(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_stream_upsert_keeps_the_newest_and_takes_late_rows(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))

    def go():
        s = STR.stream_files(spark, src, SC.T.StructType.fromDDL(SCHEMA))
        STR.run_stream(s, STR.upsert_batch(out, "id", "at", ("v",)), log).awaitTermination()
        return {r["id"]: r["v"] for r in STR.read_latest(spark, out, "id", "at", ("v",)).collect()}

    put(spark, src, [("a", 1, at(1)), ("a", 2, at(2)), ("b", 5, at(9))])
    assert go() == {"a": 2, "b": 5}
    put(spark, src, [("b", 4, at(0)), ("c", 7, at(0)), ("a", 3, at(3))])
    assert go() == {"a": 3, "b": 5, "c": 7}
    assert go() == {"a": 3, "b": 5, "c": 7}
    batch = DD.latest_per_id(spark.read.parquet(src), "id", "at", ("v",))
    assert {r["id"]: r["v"] for r in batch.collect()} == go()


def test_replayed_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, at(1))], SCHEMA)
    write = STR.append_delta(str(tmp_path / "d"))
    write(df, 4)
    write(df, 4)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1


def test_hourly_stream_over_several_batches_equals_batch(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    for k in range(3):
        put(spark, src, [(f"i{j % 2}", j * k, at(j % 5)) for j in range(20)])
    s = STR.stream_files(spark, src, SC.T.StructType.fromDDL(SCHEMA), files_per_batch=1)
    STR.run_stream(STR.hourly_aggregates(s, "at", ["id"], "v"), STR.append_delta(out), log, "update").awaitTermination()
    key = ["id", "ds"]
    rows = lambda d: sorted(map(tuple, d.select(*key, "n", "total", "mean").collect()))
    assert rows(STR.read_last_update(spark, out, key)) == rows(STR.hourly_aggregates(spark.read.parquet(src), "at", ["id"], "v"))


def test_late_rows_are_split_not_lost(spark):
    df = spark.createDataFrame([("a", 1, at(1)), ("b", 2, at(5)), ("c", 3, None)], SCHEMA)
    ok, late = STR.split_late(df, "at", F.lit(at(3)))
    assert {r["id"] for r in late.collect()} == {"a"} and ok.count() == 2


def test_compaction_in_the_stream(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = SC.T.StructType.fromDDL(SCHEMA)
    read = lambda: {r["id"]: r["v"] for r in STR.read_compacted(spark, out, schema, "id", "at", ("v",)).collect()}
    assert read() == {}
    write = STR.upsert_compacted(out, schema, "id", "at", ("v",), every=3)
    want = {}
    for k in range(7):
        rows = [(f"i{j}", 10 * k + j, at((k * 5 + j * 3) % 17)) for j in range(6) if (j + k) % 3]
        for i, v, t in rows:
            want[i] = max(want.get(i, (t, v)), (t, v))
        put(spark, src, rows)
        STR.run_stream(STR.stream_files(spark, src, schema), write, log).awaitTermination()
        assert read() == {i: v for i, (_, v) in want.items()}
    version, base, upto = STR.pointer(spark, out)
    assert (version, upto) == (2, 5) and base
    held = STR.read_compacted(spark, out, schema, "id", "at", ("v",))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "(batch_id" in plan and "> 5)]" in plan  # base and open deltas only
    STR.fold(spark, out, schema, "id", "at", ("v",), 5)  # a replayed batch folds nothing
    assert STR.pointer(spark, out) == (version, base, upto)
    STR.fold(spark, out, schema, "id", "at", ("v",), 6)
    assert sorted(map(tuple, held.collect())) == sorted((i, v, t) for i, (t, v) in want.items())  # an older reader goes on
    STR.clean(spark, out, keep=1)
    assert read() == {i: v for i, (_, v) in want.items()} and len(list((tmp_path / "out").glob("base-*"))) == 1 and not list((tmp_path / "out/deltas").glob("batch_id=*"))


def test_late_rows_go_to_a_side_table_and_are_merged(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    shape = lambda d: STR.hourly_sums(d, "at", ["id"], "v")
    write = STR.write_with_late(out, "at", "3 HOURS", shape)
    schema = SC.T.StructType.fromDDL(SCHEMA)
    for rows in ([("a", 1, at(1)), ("a", 2, at(9))], [("a", 4, at(2)), ("b", 8, at(8)), ("b", 16, None)], [("a", 32, at(0)), ("a", 64, at(20))]):
        put(spark, src, rows)
        STR.run_stream(STR.stream_files(spark, src, schema), write, log).awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(f"{out}/late").collect()) == [4, 32]
    rows = lambda d: sorted(map(tuple, d.select("id", "ds", "n", "total").collect()), key=str)
    assert rows(STR.merge_late(spark, out, shape, ["id", "ds"], ["n", "total"])) == rows(shape(spark.read.parquet(src)))
    late = spark.read.parquet(f"{out}/late").count()
    write(spark.read.parquet(src).where("v = 4"), 1)  # a replay overwrites its own folders
    assert spark.read.parquet(f"{out}/late").count() == late


def test_ring_of_hours_equals_windows(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    rng = __import__("random").Random(4)
    hours = 24
    for k in range(5):  # each batch goes on in time and has some older rows, a few beyond the ring
        put(spark, src, [(rng.choice("aab"), rng.randint(-9, 9), at(k * 40 + rng.randint(0, 50) - (rng.random() < 0.1) * rng.randint(0, 90))) for _ in range(60)] + [("c", 1, None)])
    s = STR.stream_files(spark, src, SC.T.StructType.fromDDL(SCHEMA), files_per_batch=1)
    STR.run_stream(STR.sliding_ring(s, "at", ["id"], "v", hours, lateness=6), STR.append_kinds(out), log, "update").awaitTermination()
    assert spark.read.parquet(out).where("kind = 'late'").count() > 0
    key = lambda d: sorted((r["id"], r["ds"], r["n"], round(r["mean"], 9)) for r in d.collect())
    want = STR.sliding_means(spark.read.parquet(src).where("at IS NOT NULL"), "at", ["id"], "v", hours)
    assert key(STR.read_sliding(spark, out, ["id"], hours)) == key(want)


def test_stream_reads_a_file_or_a_folder_and_no_siblings(spark, tmp_path):
    from candlewick.plans.catalogue import QUERIES
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("*.parquet"))
    (tmp_path / "as_file").mkdir()
    file.rename(tmp_path / "as_file/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "as_folder/events.parquet"))
    for d in ("as_file", "as_folder"):
        e.limit(5).write.parquet(str(tmp_path / d / "events.parquet_old"))
        got = QUERIES["stream_hourly"](spark, str(tmp_path / d))
        assert got.agg(F.sum("n")).first()[0] == e.count()
