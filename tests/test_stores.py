"""The bucketed ledger, retention by day and runs: plans, crashes, writers at the same time."""

import json
import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.jobs import store_queries
from reviewmill.jobs.queries import ORACLES, QUERIES
from reviewmill.operators import ledger
from reviewmill.operators import requests as requests_log
from reviewmill.operators import sketches
from reviewmill.sources import ledger_table, log_table, runs, tables
from reviewmill.sources.snapshots import Snapshots

RESULTS = "asin string, image_url string, status string, file_size long, created_at timestamp, seq long"


def results(spark, n, seed, part="true"):
    rows = spark.range(n).selectExpr(
        f"concat('p', id * {seed} % 97) as asin", f"concat('u', id * {seed} % 389) as image_url", "if(id % 3 = 0, 'success', 'failed') as status", "id as file_size",
        f"timestamp'2024-01-01' + make_dt_interval(0, 0, id * {seed} % 50) as created_at", "id as seq",
    )
    return rows.filter(part)


@pytest.fixture
def bucketed(spark, tmp_path):
    first = results(spark, 3000, 7)
    ledger_table.create_ledger(first, "kept_ledger", f"file://{tmp_path}", 5)
    yield first
    ledger_table.drop_ledger(spark, "kept_ledger")


def exchanges(df):
    """Lines of the plan, each with how deep it is, of exchanges and scans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, plan.count("Exchange hashpartitioning")


def test_a_batch_does_not_move_the_ledger(spark, tmp_path, bucketed):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = results(spark, 500, 11)
        plan, n = exchanges(ledger_table.merged(spark.table("kept_ledger"), new))
        assert n == 2 and "Bucketed: true" in plan, plan  # of the batch alone: to its last rows, and into the buckets
        own = plan.splitlines()
        scan = next(i for i, line in enumerate(own) if "FileScan parquet" in line)
        depth = len(own[scan]) - len(own[scan].lstrip(" :+-*()0123456789"))
        above = [line for line in own[:scan] if "Exchange" in line and len(line) - len(line.lstrip(" :+-*()0123456789")) < depth]
        assert not above, plan
        plan, n = exchanges(ledger.pending(new.hint("merge"), spark.table("kept_ledger")))
        assert n == 1 and "Bucketed: true" in plan, plan  # of the candidates alone
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bucketed_ledger_equals_upserts(spark, tmp_path, bucketed):
    want = ledger.latest_downloads(bucketed)
    for new in (results(spark, 700, 11), results(spark, 900, 13), results(spark, 900, 13), results(spark, 0, 1)):
        was = ledger_table.version_of(spark, "kept_ledger")[0]
        got = ledger_table.upsert_ledger(new, "kept_ledger", f"file://{tmp_path}")
        want = ledger.upsert_downloads(want, new)
        assert sorted(got.select("asin", "image_url", "created_at", "seq").collect()) == sorted(want.select("asin", "image_url", "created_at", "seq").collect())
        assert ledger_table.version_of(spark, "kept_ledger")[0] != was and not (tmp_path / was).exists()
    assert len(list(tmp_path.iterdir())) == 1


def test_last_row_of_each_key(spark):
    rows = spark.createDataFrame([("p", "u", "failed", 1, None, 5), ("p", "u", "success", None, None, 4), ("p", "v", None, 2, None, None), (None, None, "x", 3, None, 1), (None, None, "y", 4, None, 2)], RESULTS)
    assert sorted(map(str, ledger.latest_downloads(rows).select("asin", "image_url", "status", "file_size").collect())) == sorted(map(str, rows.filter("seq = 5 or seq is null or file_size = 4").select("asin", "image_url", "status", "file_size").collect()))
    hot = spark.range(50_000).selectExpr("'p' as asin", "'u' as image_url", "'failed' as status", "id as file_size", "timestamp'2024-01-01' as created_at", "id as seq")
    plan = ledger.latest_downloads(hot)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan and [r.seq for r in ledger.latest_downloads(hot).collect()] == [49_999]


def requests(spark, n=400):
    rows = spark.range(n).selectExpr("id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id) as created_at")
    return rows.unionByName(spark.sql("select 10000L as id, cast(null as timestamp) as created_at"))


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_retention(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert log_table.read_log(spark, path) is None
    log_table.append_log(requests(spark), path)
    before = files(tmp_path)
    assert log_table.delete_before(spark, path, "2024-01-05 06:00:00") == 102
    kept = {r.id for r in log_table.read_log(spark, path).collect()}
    assert kept == {*range(102, 400), 10000}
    after = files(tmp_path)
    # files of later days are the same; of the days before nothing is left
    assert {f for f in after if "day=2024-01-05" not in f} == {f for f in before if f.split("day=")[1][:10] > "2024-01-05"}
    assert {f.split("/")[0] for f in after if "day=2024-01-05" in f} == {"v=1"}
    assert log_table.delete_before(spark, path, "2024-01-05 06:00:00") == 0 and files(tmp_path) == after
    assert log_table.delete_before(spark, path, "2024-01-06 00:00:00") == 18 and log_table.delete_before(spark, path, "2024-01-06 23:59:59") == 24
    log_table.append_log(spark.sql("select 7L as id, timestamp'2024-01-06 10:00:00' as created_at union all select 8, timestamp'2024-01-08 10:00:00'"), path)
    assert sorted(r.id for r in log_table.read_log(spark, path).filter("id < 144 or id in (7, 8)").collect()) == [7, 8] and log_table.read_log(spark, path).count() == 400 - 144 + 3
    assert log_table.delete_before(spark, path, "2030-01-01 00:00:00") == 258 and [r.id for r in log_table.read_log(spark, path).collect()] == [10000]


def test_whole_days_are_counted_without_reading(spark, tmp_path):
    log_table.append_log(requests(spark), f"file://{tmp_path}")
    rows = Snapshots(spark, f"file://{tmp_path}", "day").read()
    counted = rows.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in counted


@pytest.mark.parametrize("step", ["_write", "commit", "prune"])
def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}"
    log_table.append_log(requests(spark), path)

    def die(*a, **k):
        raise RuntimeError("died")

    with monkeypatch.context() as patch:
        patch.setattr(log_table if step == "_write" else Snapshots, step, die)
        with pytest.raises(RuntimeError):
            log_table.delete_before(spark, path, "2024-01-05 06:00:00")
    left = {r.id for r in log_table.read_log(spark, path).collect()}
    assert left == ({*range(102, 400), 10000} if step == "prune" else {*range(400), 10000})
    assert log_table.delete_before(spark, path, "2024-01-05 06:00:00") == (0 if step == "prune" else 102)
    assert {r.id for r in log_table.read_log(spark, path).collect()} == {*range(102, 400), 10000}
    assert not [f for f in files(tmp_path) if "day=2024-01-04" in f]


def test_ten_writers_get_ten_numbers(spark, tmp_path):
    got = []
    threads = [threading.Thread(target=lambda: got.append(runs.claim_run(spark, f"file://{tmp_path}/out"))) for _ in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 11)) and runs.runs(spark, f"file://{tmp_path}/out") == []


def test_runs(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    assert runs.newest_run(spark, path) is None
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "b", 0)], "i int, category string, __tmp int")
    assert runs.write_labelled(df, path, "category") == 1 and "__tmp" not in runs.newest_run(spark, path).columns

    class Died(Exception):
        pass

    def die(spark, at, create=runs._create_new):
        if at.endswith(".done"):
            raise Died
        return create(spark, at)

    with monkeypatch.context() as patch:
        patch.setattr(runs, "_create_new", die)
        with pytest.raises(Died):
            runs.write_labelled(df.withColumn("i", F.col("i") + 100), path, "category")
    assert runs.runs(spark, path) == [1] and {r.i for r in runs.newest_run(spark, path).collect()} == {1, 2, 3}
    assert runs.write_labelled(df.filter("i = 2").withColumn("i", F.col("i") + 10).withColumn("more", F.lit("x")), path, "category") == 3
    by = runs.newest_run(spark, path, "category")
    assert sorted((r.i, r.category, r.run_id, r.more) for r in by.collect()) == [(1, "a", 1, None), (12, "b", 3, "x")]
    # only the files of the chosen runs are known to the plan, whatever the others hold
    assert {f.split("/out/")[1].rsplit("/", 1)[0] for f in by.inputFiles()} == {"run_id=1/category=a", "run_id=3/category=b"}
    for bad in (tmp_path / "out/run_id=1/category=b").glob("*.parquet"):
        bad.write_bytes(b"no parquet")
    assert runs.newest_run(spark, path, "category").count() == 2 and runs.newest_run(spark, path).count() == 1


def test_report(spark, tmp_path):
    downloads = results(spark, 30, 7).withColumn("download_time", F.lit(0.5))
    products = spark.createDataFrame([("p0", "t", "u")], "asin string, title string, url string")
    tables.write_report(tables.report(downloads, products, "2024-01-20T00:00:00"), str(tmp_path / "report"))
    got = json.loads(next((tmp_path / "report").glob("*.json")).read_text())
    assert got["by_status"]["success"] == {"n": 10, "avg_time": 0.5, "total_size": sum(range(0, 30, 3))} and got["total"] == 30
    assert got["total_products"] == 1 and got["products_with_images"] == 10 and got["generated_at"] == "2024-01-20T00:00:00"
    empty = tables.report(downloads.limit(0), products, "x").first()
    assert empty.by_status == {} and (empty.total, empty.total_products, empty.products_with_images) == (0, 1, 0)


def plain_counts(rows, seconds):
    times = [(k, None if t is None else t.timestamp()) for k, t in rows]
    return [sum(k == o and (t is None and u is None or None not in (t, u) and t - seconds <= u <= t) for o, u in times) for k, t in times]


@pytest.mark.parametrize("parts, seconds", [(1, 60), (7, 60), (7, 1), (30, 400), (30, 100_000)])
def test_over_limit(spark, parts, seconds):
    rng = random.Random(parts + seconds)
    begin = datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None, "c"]), begin + timedelta(seconds=rng.randint(0, 5000))) for _ in range(250)]
    rows += [("hot", begin + timedelta(seconds=rng.randint(0, 200), microseconds=rng.choice([0, 0, 5]))) for _ in range(300)]  # a burst
    rows += [("a", None), ("a", None), (None, None)]
    df = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(rows)], "i int, k string, created_at timestamp, __kind string").drop("__kind")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = requests_log.over_limit(df, "k", 5, seconds).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = plain_counts(rows, seconds)
    assert {r.i: (r.k, r.created_at, r.in_span, r.over) for r in got} == {i: (k, t, n, n > 5) for i, ((k, t), n) in enumerate(zip(rows, want))}
    assert requests_log.over_limit(df.limit(0), "k").count() == 0


def test_a_burst_is_many_parts_and_the_halo_is_small(spark):
    burst = spark.range(20_000).selectExpr("'k' as k", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, cast(id as decimal(18,6)) / 1000) as created_at")
    quiet = spark.range(40_000).selectExpr("concat('q', id % 3) as k", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) as created_at")
    rows = burst.unionByName(quiet).select("k", F.xxhash64("k").alias("h"), F.unix_micros("created_at").alias("t")).toPandas()
    parts = 24
    bounds = requests_log.Bounds(rows.sample(24 * 200, random_state=1)[["h", "t"]].itertuples(index=False, name=None), parts)
    own, end = bounds.part_of(rows.h.to_numpy(), rows.t.to_numpy()), bounds.part_of(rows.h.to_numpy(), rows.t.to_numpy() + 60_000_000)
    assert np.bincount(own, minlength=parts).max() < 2 * 60_000 / parts and len(np.unique(own[rows.k == "k"])) >= 7
    # of the quiet keys only what is within a minute of a part's end is copied
    assert (end > own)[rows.k != "k"].sum() < 60 * parts and (end >= own).all()


def test_sketches_of_days(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("concat('p', id * 7 % 20000) as asin", "if(id % 3 = 0, 'success', 'failed') as status", "timestamp'2024-01-01' + make_dt_interval(cast(id % 40 as int)) as created_at")
    sketches.daily_sketches(rows).write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert kept.count() == 40
    for first, last in (("2024-01-01", "2024-02-09"), ("2024-01-05", "2024-01-05"), ("2024-01-20", "2024-02-01")):
        span = rows.filter(F.to_date("created_at").between(first, last))
        exact = span.selectExpr("count(distinct asin)", "count(distinct if(status = 'success', asin, null))").first()
        found = sketches.over_span(kept, first, last)
        assert all(abs(a - b) <= sketches.ERROR * b for a, b in zip(found.first(), exact))
        assert [f for f in found.inputFiles() if "/s/" not in f] == []
    two = sketches.daily_sketches(rows.limit(0)).unionByName(kept).unionByName(kept)  # a day sketched twice
    assert all(a == pytest.approx(b, rel=sketches.ERROR) for a, b in zip(sketches.distinct_counts(two).first(), sketches.distinct_counts(kept).first()))


@pytest.mark.parametrize("n, portion", [(200, 30), (200, 1000), (1, 30), (0, 30)])
@pytest.mark.parametrize("name", ["io6_h4_image_check", "a18_image_report"])
def test_image_files_lie_there_a_portion_at_a_time(spark, tmp_path, monkeypatch, name, n, portion):
    duckdb = pytest.importorskip("duckdb")
    spark.range(n).selectExpr("id * 3 as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "in/part.parquet"))
    lying = []

    def read(spark, folder):
        lying.append(sum(p.is_file() and p.suffix != ".crc" for kind in ("png", "jpg", "webp") for p in tmp_path.rglob(f"images/**/*.{kind}")))
        return tables.read_images(spark, folder)

    monkeypatch.setattr(store_queries, "PORTION", portion, raising=False)
    monkeypatch.setattr(store_queries, "read_images", read)
    monkeypatch.setattr(store_queries, "shared_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    got = QUERIES[name](spark, str(tmp_path / "in"))
    rows = got.collect()
    assert sum(lying) == n and max(lying) <= 2 * portion  # every part's file has been there
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/in/part.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert not [p for kind in ("png", "jpg", "webp") for p in tmp_path.rglob(f"*.{kind}")]


def test_image_files_go_when_a_portion_fails(spark, tmp_path, monkeypatch):
    spark.range(20).selectExpr("id as p_partkey", "cast(1 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "in/part.parquet"))

    def fail(spark, folder):
        raise RuntimeError("died")

    monkeypatch.setattr(store_queries, "read_images", fail)
    monkeypatch.setattr(store_queries, "shared_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    with pytest.raises(RuntimeError):
        store_queries.io6_h4_image_check(spark, str(tmp_path / "in"))
    assert not [*tmp_path.rglob("*.png")]
