"""File sources, sinks and stream = batch equality."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rationflow.sources import files as FS
from rationflow.sinks import writers as W
from tests.conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="rf-test-")


def test_read_catalog_csv_and_union(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Ingredient,CP,Energy,Fiber,Cost\nMaize,9,3300,2.5,180\nSoy,44,2400,7,450\n")
    cat = FS.read_catalogs(spark, {"Poultry": os.path.join(d, "a.csv"), "Rabbit": os.path.join(d, "a.csv")})
    rows = cat.orderBy("species", "pos").collect()
    assert len(rows) == 4 and rows[0].species == "Poultry" and rows[0].ingredient == "Maize"
    assert rows[0].pos < rows[1].pos and rows[1].cp == 44.0


def test_quarantine_csv_splits_bad_lines(spark):
    d = _tmp()
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as f:
        f.write("Ingredient,CP,Energy,Fiber,Cost\nok,1,2,3,4\n# comment line\n['x', 1, 2],zz,1,1,1\nok2,5,6,7,8\n")
    good, bad = FS.quarantine_csv(spark, p, FS.CATALOG_CSV_SCHEMA)
    assert sorted(r.Ingredient for r in good.collect()) == ["ok", "ok2"]
    assert bad.count() == 2


def test_save_catalog_refuses_empty(spark):
    df = spark.createDataFrame([("S", 1, "   ", 1.0, 1.0, 1.0, 1.0)],
                               "species string, pos long, ingredient string, cp double, energy double, "
                               "fiber double, cost double")
    path = os.path.join(_tmp(), "cat")
    with pytest.raises(ValueError):
        W.save_catalog(df, path)
    assert W.last_version(spark, path) == 0


def test_save_catalog_and_guides(spark):
    from rationflow.sources import testdata as td
    out = os.path.join(_tmp(), "cat")
    n = W.save_catalog(td.catalog_edits(spark, SF_SMALL), out)
    assert n == W.read_catalog(spark, out).count() > 0
    assert W.save_catalog(td.catalog_edits(spark, SF_SMALL).where("pos < 50"), out) < n
    assert W.last_version(spark, out) == 2 and W.read_catalog(spark, out, 1).count() == n
    g = os.path.join(_tmp(), "guides")
    W.write_nutrient_guides(spark, g)
    back = spark.read.option("header", True).csv(g)
    assert back.count() == 19 and "species" in back.columns


def test_stream_equals_batch_admission(spark):
    from rationflow.operators import admission as A
    from rationflow.plans import queries as Q
    from rationflow.sources import testdata as td
    from rationflow.streaming.admission import run_available
    lim = spark.createDataFrame(Q.EVENT_LIMITS, "action string, max_calls int, window_seconds int")
    schema = td.table(spark, SF_SMALL, "events").schema
    s = run_available(spark, f"{SF_SMALL}/events.parquet", schema, lim).where("not late").select("event_id", "admitted", "wait_s")
    b = A.admit(td.attempts(spark, SF_SMALL), lim).select("event_id", "admitted", "wait_s")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_history_stream_records_successes_once(spark):
    """Two streams into one table keep both, a stream that is started again
    goes on where it was, a replayed or unfinished epoch adds nothing, and only
    requests with a ration are recorded."""
    from pyspark.sql import functions as F

    from rationflow.plans import queries as Q
    from rationflow.sinks import commits
    from rationflow.sources import testdata as td
    from rationflow.streaming.admission import stream_table
    from rationflow.streaming.history import history_stream
    d, table = _tmp(), _tmp()
    facets = Q.facets_for(spark, SF_SMALL)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    want = Q._solved(spark, SF_SMALL).select("scenario_id", "status")
    good = {r.scenario_id for r in want.collect() if r.status == "optimal"}
    assert 0 < len(good) < want.count()
    half = lambda k: orders.where(f"o_orderkey % 2 = {k}")
    for k in (0, 1):
        half(k).write.parquet(f"{d}/orders{k}.parquet")

    def run(k: int, name: str):
        source = td.scenarios(spark, SF_SMALL, orders=stream_table(spark, f"{d}/orders{k}.parquet", orders.schema))
        return history_stream(spark, source, facets, table, name=name)[0]

    ids = lambda df: sorted(r.scenario_id for r in df.select("scenario_id").collect())
    assert ids(run(0, "a")) == sorted(i for i in good if i % 2 == 0)
    both = run(1, "b")
    assert ids(both) == sorted(good)
    assert ids(run(0, "a")) == sorted(good)  # nothing new in its source
    half(0).limit(40).write.mode("append").parquet(f"{d}/orders0.parquet")
    more = run(0, "a")
    assert more.count() == len(good) + sum(r.o_orderkey in good for r in half(0).limit(40).select("o_orderkey").collect())
    # a replay of a committed epoch, and a part without a line in the log
    n, line = more.count(), commits.log(spark, table).first()
    assert not commits.append(both.limit(5), table, line.writer, line.epoch)
    both.limit(5).write.parquet(f"{table}/data/part=unfinished")
    assert run(1, "b").count() == n
    # two attempts at one epoch that both reached the log: one of them counts
    spark.createDataFrame([(line.writer, line.epoch, "zz", 5)], commits.LOG_SCHEMA).write.mode("append").parquet(f"{table}/log")
    both.limit(5).write.parquet(f"{table}/data/part=zz")
    assert run(1, "b").count() == n and set(more.select("status").distinct().toPandas()["status"]) == {"optimal"}
    assert more.where(F.col("age_weeks").isNull()).count() == 0


def test_saves_side_by_side_make_versions_of_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor
    path = _tmp() + "/catalog"
    shape = "species string, pos long, ingredient string, cp double, energy double, fiber double, cost double"
    cats = [spark.createDataFrame([("S", 1, f"saver {i}", 1.0, 1.0, 1.0, 1.0)] * (i + 1), shape) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda c: W.save_catalog(c, path), cats)) == [1, 2, 3, 4]
    assert W.last_version(spark, path) == 4
    found = {r.ingredient for v in range(1, 5) for r in W.read_catalog(spark, path, v).collect()}
    assert found == {f"saver {i}" for i in range(4)}


def test_stream_over_a_folder_with_interleaved_files(spark):
    """A table of four part files whose times interleave: no id is missing and
    the decisions are those of the batch form."""
    from rationflow.operators import admission as A
    from rationflow.plans import queries as Q
    from rationflow.sources import testdata as td
    from rationflow.streaming.admission import run_available
    path = os.path.join(_tmp(), "events.parquet")
    td.table(spark, SF_SMALL, "events").repartition(4, "event_id").write.parquet(path)
    lim = spark.createDataFrame(Q.EVENT_LIMITS, "action string, max_calls int, window_seconds int")
    s = run_available(spark, path, spark.read.parquet(path).schema, lim)
    assert s.where("late").count() == 0
    b = A.admit(td.attempts(spark, SF_SMALL), lim)
    cols = ["event_id", "admitted", "wait_s"]
    assert sorted(map(tuple, s.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_history_stream_over_a_folder(spark):
    from rationflow.plans import queries as Q
    d = _tmp()
    for t in ("orders", "part"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(3).write.parquet(f"{d}/{t}.parquet")
    assert Q.q_history_stream(spark, d).count() == Q._solved(spark, SF_SMALL).where("status = 'optimal'").count()


def test_stream_state_carries_across_batches_and_orders_rows(spark):
    """Batch 2 brings a row older than one already seen but younger than the
    watermark: it is decided in its place; the state of batch 1 counts in it."""
    import datetime as dt
    import uuid

    from rationflow.session import ensure_checkpoint_dir
    from rationflow.streaming.admission import admission_stream, list_state

    d = _tmp()
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    batches = [[(1, 7, "optimize", at(0)), (2, 7, "optimize", at(1))],
               [(3, 7, "optimize", at(2)), (4, 7, "optimize", at(0.5)), (5, 7, "optimize", at(12))],
               [(None, None, None, at(4000))], [(None, None, None, at(9000))],
               [(6, 7, "optimize", at(1)), (7, None, None, at(8399)), (8, 7, "optimize", at(8401))],
               [(None, None, None, at(20000))], [(None, None, None, at(30000))]]
    lim = spark.createDataFrame([("optimize", 2, 10)], "action string, max_calls int, window_seconds int")
    src = spark.readStream.schema(schema).parquet(d).withColumnRenamed("event_type", "action")
    name = f"adm_{uuid.uuid4().hex[:8]}"
    ckpt = f"{ensure_checkpoint_dir(spark)}/streams/{name}"
    with list_state(spark):
        q = (admission_stream(src, lim).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", ckpt).start())
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(d)
            q.processAllAvailable()
    finally:
        q.stop()
    got = {r.event_id: (r.admitted, r.late) for r in spark.table(name).collect()}
    # in time order: 1 (0 s), 4 (0.5 s) pass; 2 (1 s), 3 (2 s) must wait; 5 (12 s) passes;
    # the watermark stands at 8400 s when 6 and 7 come
    assert got == {1: (True, False), 4: (True, False), 2: (False, False), 3: (False, False), 5: (True, False),
                   6: (None, True), 7: (None, True), 8: (True, False)}


def test_default_limits_and_fallback(spark):
    import datetime as dt

    from rationflow.operators import admission as A
    rows = [(1, 1, "optimize", dt.datetime(2024, 1, 1)), (2, 1, "unknown", dt.datetime(2024, 1, 1))]
    att = spark.createDataFrame(rows, "event_id long, user_id long, action string, ts timestamp")
    lim = {r.event_id: (r.max_calls, r.window_us) for r in A.with_limits(att).collect()}
    assert lim == {1: (10, 60 * A.US), 2: (30, 60 * A.US)}


def test_formula_report_history_writers(spark):
    from rationflow.plans import queries as Q
    from rationflow.operators import ration
    s = Q._solved(spark, SF_SMALL)
    rows = ration.formula_rows(s, ["scenario_id", "species"])
    out = _tmp()
    W.write_formulas(rows, os.path.join(out, "formulas"), "20260101")
    back = spark.read.option("header", True).csv(os.path.join(out, "formulas"))
    assert {"species", "run_date"} <= set(back.columns) and back.count() == rows.count()
    reports = Q.q_report_text(spark, SF_SMALL)
    W.write_reports(reports, os.path.join(out, "rep"))
    texts = W.read_reports(spark, os.path.join(out, "rep"))
    key = lambda df, c: sorted((r[c], r["file_name"], r["report"]) for r in df.collect())
    assert key(texts, "report_id") == key(reports, "scenario_id")
    assert reports.count() == s.where("status = 'optimal'").count()
    hist, cols = os.path.join(out, "hist"), ["scenario_id", "user_id", "status", "total_cost"]
    assert W.append_history(s.select(*cols), hist, "monday")
    assert not W.append_history(s.select(*cols), hist, "monday")
    assert W.append_history(s.select(*cols), hist, "tuesday")
    from rationflow.sinks import commits
    assert commits.read(spark, hist, s.select(*cols).schema).count() == 2 * reports.count()
