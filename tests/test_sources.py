import json
import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import ROOT, at, rows
from pyspark.sql import functions as F
from test_funnel import ladder

import tidemark as tm
from tidemark.session import NANOS
from tidemark.sources import layouts, tables
from workload.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clean(make_events):
    events = [{**e, "event_ts": e["event_ts"].replace(day=2 + i % 4)} for i in range(60) for e in ladder(f"u{i}", 3)]
    return tm.clean_events(make_events(events))


def test_nanosecond_timestamps(spark, tmp_path):
    stamps = pd.to_datetime(["2026-03-02T10:00:00.123456789Z", "1969-12-31T23:59:59.999999999Z"])
    table = pa.table(
        {
            "event_id": ["e1", "e2"],
            "user_id": ["u1", None],
            "event_name": ["signup", "signup"],
            "when": pa.array(stamps, pa.timestamp("ns", "UTC")),
            "channel": ["email", "email"],
            "platform": ["web", "web"],
            "revenue": [0.0, 0.0],
        }
    )
    pq.write_table(table, f"{tmp_path}/e.parquet", version="2.6")
    micros = table.set_column(3, "when", table["when"].cast(pa.timestamp("us", "UTC"), safe=False))
    pq.write_table(micros, f"{tmp_path}/m.parquet")
    naive = table.set_column(3, "when", table["when"].cast(pa.timestamp("ns")))
    pq.write_table(naive, f"{tmp_path}/n.parquet", version="2.6")
    for _ in range(2):  # either unit after the other, in a session without settings for it
        for name in "emn":
            events = tm.read_events(spark, f"{tmp_path}/{name}.parquet", event_ts="when")
            assert dict(events.dtypes)["event_ts"] == "timestamp"
            found = events.selectExpr("event_id", "unix_micros(event_ts)")
            assert rows(found) == [("e1", 1772445600123456), ("e2", 0 if name == "m" else -1)]
    assert spark.conf.get(NANOS, "false") == "false"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tm.read_events(spark, f"{tmp_path}/none.parquet")


def test_other_column_names(make_events):
    other = make_events([{}]).withColumnRenamed("user_id", "uid").withColumnRenamed("event_ts", "ts")
    assert tm.as_events(other, user_id="uid", event_ts="ts").columns == make_events([{}]).columns


def test_saving_replaces_a_table(clean, tmp_path):
    path = f"{tmp_path}/t"
    tm.save_table(clean, path)
    again = tm.save_table(clean.filter("user_id = 'u1'"), path)
    assert again.count() == 3
    assert again.schema == clean.schema
    assert list(Path(path).rglob("*.zstd.parquet"))
    assert tm.open_table(clean.sparkSession, path).count() == 3


def broken(df):
    """``df`` with an error in its last rows, which a task meets after others have written theirs."""
    bad = F.when(F.col("user_id") == "u59", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("user_id"))
    return df.repartition(8, "user_id").withColumn("user_id", bad)


def test_a_write_that_fails_leaves_the_old_table(spark, clean, tmp_path):
    path = f"{tmp_path}/t"
    tm.save_table(clean, path)
    before = sorted(Path(path).iterdir())
    with pytest.raises(Exception, match="lost"):
        tm.save_table(broken(clean), path)
    assert rows(tm.open_table(spark, path)) == rows(clean)
    assert sorted(Path(path).iterdir()) == before


def test_a_write_that_is_killed_leaves_the_old_table(spark, clean, tmp_path):
    """The program dies while its tasks write: its version has files but no commit."""
    path = f"{tmp_path}/t"
    tm.save_table(clean, path)
    script = (
        "import os, threading, time, glob, tidemark as tm\n"
        "from pyspark.sql import functions as F\n"
        "spark = tm.build_session(master='local[2]', spark__ui__enabled='false')\n"
        f"old = tm.open_table(spark, '{path}')\n"
        "slow = old.repartition(40).withColumn('user_id', F.expr(\"if(java_method('java.lang.Thread', 'sleep', 20L) is null, user_id, user_id)\"))\n"
        "def kill():\n"
        f"    while not glob.glob('{path}/v-*/_temporary/**/*.parquet', recursive=True): time.sleep(0.01)\n"
        "    os.kill(os.getpid(), 9)\n"
        "threading.Thread(target=kill, daemon=True).start()\n"
        f"tm.save_table(slow.union(slow), '{path}')\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, timeout=120)
    assert done.returncode == -9
    versions = list(Path(path).glob("v-*"))
    assert len(versions) == 2 and rows(tm.open_table(spark, path)) == rows(clean)
    assert tm.collect_garbage(spark, path) == [] and len(list(Path(path).glob("v-*"))) == 2
    assert len(tm.collect_garbage(spark, path, hours=0)) == 1
    assert rows(tm.open_table(spark, path)) == rows(clean)


def test_a_reader_keeps_the_version_it_opened(spark, clean, tmp_path):
    path = f"{tmp_path}/t"
    tm.save_table(clean, path)
    reading = tm.open_table(spark, path)
    tm.save_table(reading.limit(7), path)
    assert reading.count() == clean.count() and tm.open_table(spark, path).count() == 7
    assert tm.open_table(spark, path, back=1).count() == clean.count()
    tm.save_table(clean.limit(1), path)
    assert len(list(Path(path).glob("v-*"))) == 2 == len(list(Path(path, "_commits").glob("0*")))
    assert tm.collect_garbage(spark, path, keep=0) and tm.open_table(spark, path).count() == 1
    with pytest.raises(ValueError, match="1 versions"):
        tm.open_table(spark, path, back=1)
    with pytest.raises(ValueError, match="0 versions"):
        tm.open_table(spark, f"{tmp_path}/nothing")


def test_an_empty_table_is_replaced_and_read(spark, clean, tmp_path):
    path = f"{tmp_path}/t"
    tm.save_table(clean.limit(0), path)
    assert tm.open_table(spark, path).schema == clean.schema and tm.open_table(spark, path).count() == 0


def test_a_folder_that_stays_does_not_keep_the_others(spark, monkeypatch):
    held, free = tables.shared_dir(spark), tables.shared_dir(spark)
    Path(free).mkdir()
    monkeypatch.setitem(tables._made, "nowhere://x/y", spark._jsc.hadoopConfiguration())
    tables._remove_all()
    assert "nowhere://x/y" in tables._made and held not in tables._made and not Path(free).exists()


def test_folders_go_after_the_session_has_stopped(tmp_path):
    script = (
        "import tidemark as tm\n"
        "spark = tm.build_session(master='local[1]', spark__ui__enabled='false', spark__checkpoint__dir='viewfs://s/a', "
        f"**{{'spark__hadoop__fs__viewfs__mounttable__s__link__/a': 'file://{tmp_path}'}})\n"
        "assert tm.materialise(spark.range(3)).count() == 3\n"
        "spark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, capture_output=True, timeout=120)
    assert not list(tmp_path.glob("tidemark-*"))


def session(master, **conf):
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session(spark, clean):
    named = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert tables.shared_dir(session("yarn", **named)).startswith("hdfs://shared/tidemark-")
    assert tables.shared_dir(session("local[2]", **named)).startswith("hdfs://shared/tidemark-")
    assert tables.shared_dir(spark) != tables.shared_dir(spark)
    root = tables.shared_dir(spark).rsplit("/", 1)[0]
    assert tm.materialise(clean).inputFiles()[0].startswith(f"file://{root}")


def test_a_cluster_must_name_its_shared_folder():
    assert tables.shared_dir(session("local[2]"))
    with pytest.raises(ValueError):
        tables.shared_dir(session("yarn"))


def test_a_workspace_removes_its_tables(spark, clean):
    with tm.Workspace(spark) as space:
        saved = space.save(clean, "events")
        assert saved.count() == clean.count()
        assert space.save(clean.limit(5), "events").count() == 5
        assert Path(space.root, "events").is_dir()
    assert not Path(space.root).exists()
    path = tm.materialise(clean).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    tables.remove_dir(path)
    assert not Path(path).exists()
    with pytest.raises(ValueError):
        tables.remove_dir("/")


def test_a_scratch_block_keeps_what_it_is_told_to(spark, clean):
    with tables.scratch(spark) as space:
        gone, kept = tm.materialise(clean), tables.materialise(clean, keep=True)
        assert gone.count() == kept.count() and len(list(Path(space.root).iterdir())) == 1
    assert not Path(space.root).exists() and kept.count() == clean.count()
    assert not tm.materialise(clean).inputFiles()[0].startswith(f"file://{space.root}")


def test_a_program_leaves_nothing_behind(tmp_path):
    script = (
        "import tidemark as tm\n"
        "spark = tm.build_session(master='local[1]', spark__ui__enabled='false', "
        f"spark__checkpoint__dir='{tmp_path}')\n"
        "tm.materialise(spark.range(3)).count()\n"
        f"import glob; assert len(glob.glob('{tmp_path}/tidemark-*')) == 1\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, capture_output=True, timeout=120)
    assert not list(tmp_path.glob("tidemark-*"))


def test_queries_see_a_rewritten_table(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    events = spark.read.parquet(f"{source}/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    before = QUERIES["week_one"](spark, str(tmp_path)).first().users
    events.filter("user_id % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["week_one"](spark, str(tmp_path)).first().users < before


def test_views_answer_sql(spark, clean):
    tm.register_views({"stg_events": clean})
    assert spark.sql("SELECT count(DISTINCT user_id) AS n FROM stg_events").first().n == 60


def test_json_keeps_nulls_and_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "a int, b double, c string")
    tm.write_json(df, f"{tmp_path}/r")
    lines = [json.loads(line) for f in Path(tmp_path, "r").glob("*.json") for line in f.open()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": 0.5, "c": "x"}]


def test_layouts_hold_the_same_rows(spark, clean, tmp_path):
    paths = tm.write_layouts(clean, str(tmp_path))
    expected = rows(clean, "event_id")
    for name in ("base", "clustered", "by_date"):
        assert rows(spark.read.parquet(paths[name]), "event_id") == expected
    sizes = {r.layout: r for r in tm.layout_sizes(spark, paths).collect()}
    assert {n: (s.row_count, s.column_count) for n, s in sizes.items()} == {
        "base": (180, 8),
        "clustered": (180, 8),
        "narrow": (180, 3),
        "by_date": (180, 8),
    }
    for name, path in paths.items():
        on_disk = sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
        assert sizes[name].parquet_bytes == on_disk
    assert sizes["base"].bytes_vs_base == 1.0
    assert sizes["narrow"].bytes_vs_base == round(
        sizes["narrow"].parquet_bytes / sizes["base"].parquet_bytes, 3
    )


def test_clustered_files_are_sorted_and_split_a_busy_user(spark, make_events, tmp_path):
    busy = [{"user_id": "hot", "event_ts": f"10:{i // 60:02d}:{i % 60:02d}"} for i in range(2000)]
    events = tm.clean_events(make_events(busy + [e for i in range(50) for e in ladder(f"u{i}", 2)]))
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layouts.write_clustered(events, f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    files = [pq.read_table(f).to_pandas() for f in Path(tmp_path, "c").glob("*.parquet")]
    for frame in files:
        assert frame.equals(frame.sort_values(["user_id", "event_ts"], kind="stable"))
    assert sum((f.user_id == "hot").any() for f in files) > 1


def test_one_day_reads_one_folder(spark, clean, tmp_path):
    layouts.write_by_date(clean, f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    sliced = tm.day_slice(stored, date(2026, 3, 3))
    assert tuple(sliced.first()) == tuple(tm.day_slice(clean, date(2026, 3, 3)).first()) == (45, 15)
    assert "PartitionFilters: [isnotnull(event_date" in plan(sliced)


def test_a_busy_date_is_cut_into_files(spark, make_events, tmp_path):
    start = at("10:00:00")
    busy = [{"user_id": f"u{i}", "event_ts": start + timedelta(seconds=i)} for i in range(4000)]
    quiet = [{"event_ts": start + timedelta(days=d)} for d in (1, 2)]
    raw = make_events(busy + quiet).repartition(16)
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        layouts.write_by_date(tm.clean_events(raw, clean=False), f"{tmp_path}/d")
    finally:
        for key in settings:
            spark.conf.unset(key)
    files = {f.name: len(list(f.glob("*.parquet"))) for f in Path(tmp_path, "d").glob("event_date=*")}
    assert files["event_date=2026-03-02"] > 4
    assert files["event_date=2026-03-03"] == files["event_date=2026-03-04"] == 1
    assert spark.read.parquet(f"{tmp_path}/d").count() == 4002


def test_one_day_without_a_date_column_is_pushed_to_the_scan(spark, clean, tmp_path):
    saved = tm.save_table(clean.drop("event_date"), f"{tmp_path}/n")
    sliced = tm.day_slice(saved, date(2026, 3, 3))
    assert tuple(sliced.first()) == (45, 15)
    assert "PushedFilters: [IsNotNull(event_ts), GreaterThanOrEqual(event_ts" in plan(sliced)


def test_layouts_of_an_empty_table(spark, clean, tmp_path):
    paths = tm.write_layouts(clean.limit(0), str(tmp_path))
    got = {r.layout: tuple(r)[1:] for r in tm.layout_sizes(spark, paths).collect()}
    assert got == {"base": (0, 0, 8, None), "clustered": (0, 0, 8, None), "narrow": (0, 0, 3, None), "by_date": (0, 0, 8, None)}


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def test_late_events_rewrite_their_dates_only(spark, clean, tmp_path):
    path = f"{tmp_path}/d"
    layouts.write_by_date(clean, path)
    before = files(path)
    late = clean.filter("user_id = 'u1'").withColumns({"event_id": F.concat("event_id", F.lit("x")), "channel": F.lit("late")})
    dates = tm.add_to_dates(late, path)
    assert dates == sorted({r.event_date for r in late.collect()}) and len(dates) < 4
    stays = {f for f in before if not any(f"event_date={d}/" in f for d in dates)}
    assert stays and stays <= files(path) and not (before - stays) & files(path)
    stored = spark.read.parquet(path)
    assert rows(stored.select(*clean.columns)) == rows(clean.unionByName(late))
    # The same rows again, changed: they take the place of those with their ids.
    tm.add_to_dates(late.withColumn("channel", F.lit("later")), path)
    assert rows(spark.read.parquet(path).groupBy("channel").count(), "channel", "count")[0] == ("later", late.count())
    assert spark.read.parquet(path).count() == clean.count() + late.count()
    assert tm.add_to_dates(late.limit(0), path) == []


def test_a_new_date_and_no_date(spark, clean, tmp_path):
    path = f"{tmp_path}/d"
    layouts.write_by_date(clean, path)
    before = files(path)
    new = clean.limit(2).withColumn("event_date", F.when(F.col("event_id") == clean.first().event_id, F.lit(date(2030, 1, 1))))
    assert tm.add_to_dates(new, path)[-1] is None or len(new.collect()) == 2
    assert before <= files(path) and spark.read.parquet(path).count() == clean.count() + 2


def test_a_bucketed_table_groups_by_user_without_a_shuffle(spark, clean, tmp_path):
    table = tm.write_bucketed(clean, "tests_bucketed", f"{tmp_path}/b", buckets=4)
    try:
        assert rows(table) == rows(clean)
        users = tm.first_touch_users(table)
        frames = {
            "session_summary": tm.session_summary(table),
            "first_touch_users": users,
            "active_days": tm.active_days(table).groupBy("user_id").agg(F.max("last_day")),
        }
        for frame in frames.values():
            assert "Exchange" not in plan(frame)
        assert "Exchange hashpartitioning(user_id" not in plan(tm.funnel(table))
        assert "Exchange hashpartitioning(user_id" not in plan(tm.retention(table, users))
        assert rows(tm.session_summary(table)) == rows(tm.session_summary(clean))
        assert rows(tm.funnel(table)) == rows(tm.funnel(clean))
        assert rows(tm.retention(table, users)) == rows(tm.retention(clean, tm.first_touch_users(clean)))
    finally:
        spark.sql("DROP TABLE tests_bucketed")
