import random

from sparkfolio.operators.intervals import IntervalMap, employment_periods, merge_intervals, stream_periods


def brute(rows):
    months = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None:
            months.setdefault(k, set()).update(range(s, e))
    out = set()
    for k, m in months.items():
        runs = []
        for x in sorted(m):
            if runs and runs[-1][1] == x:
                runs[-1][1] = x + 1
            else:
                runs.append([x, x + 1])
        out |= {(k, "period", a, b) for a, b in runs} | {(k, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


def test_map_inserts_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(1, s := rng.randint(0, 40), s + rng.randint(-2, 8)) for _ in range(rng.randint(0, 12))]
        m = IntervalMap()
        for _, s, e in rows:
            m.insert(s, e)
        assert {(1, "period", *p) for p in m.periods()} | {(1, "gap", *g) for g in m.gaps()} == brute(rows)


def test_merge_hot_entity_nulls_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3]), s := rng.randint(0, 3000), s + rng.randint(-1, 6), "x") for _ in range(6000)]
    rows += [(None, 1, 2, "x"), (4, None, 5, None), (4, 5, None, None), (5, 9, 9, "x"), (6, 1, 2, "x"), (6, 1, 2, "x"), (6, 2, 3, "x")]
    df = spark.createDataFrame(rows, "cv long, s int, e int, kind string").repartition(7)
    assert {tuple(r) for r in merge_intervals(df, "cv", "s", "e").collect()} == brute([r[:3] for r in rows])
    assert merge_intervals(df.where("false"), "cv", "s", "e").count() == 0


def test_entries_recorded_and_read(spark):
    rows = [
        (1, 10, 1, "2010 - 2011", False, None, 24120, 24130), (2, 10, 2, "x", False, None, 24130, None), (3, 11, 1, "May 2020 - June 2020", False, None, None, None),
        (4, 11, 2, "n/a", None, None, None, None), (5, 12, 1, None, None, None, 24400, 24500), (6, 13, 1, "from 2020", None, None, None, 24300),
    ]
    df = spark.createDataFrame(rows, "entry_id long, cv_id long, pos int, dates_raw string, is_current boolean, tz string, start_months int, end_months int")
    assert {tuple(r) for r in employment_periods(df).collect()} == {(10, "period", 24120, 24317), (11, "period", 24244, 24246)}


def test_stream_keeps_the_map(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 5), (1, 8, 9)], "cv long, s int, e int").write.parquet(src)
    q = stream_periods(spark.readStream.schema("cv long, s int, e int").parquet(src), "cv", "s", "e").writeStream.outputMode("update").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 5, 8)], "cv long, s int, e int").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = {tuple(r) for r in spark.table("periods").collect()}
    assert (1, "gap", 5, 8) in rows and (1, "period", 0, 9) in rows
