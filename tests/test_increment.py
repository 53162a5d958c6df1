"""Incremental equals full refresh; lifecycle of tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook.operators.cumulate import cumulate, recompute_entities, rest_days, running_sums
from scorebook.operators.windows import dedup_latest
from scorebook.session import fresh_path
from scorebook.sources import tables as T
from scorebook.sources.landing import conform

SCHEMA = "id int, game_date date, season int, n long, w double"


def _counts(seed, n=60):
    rnd, out = random.Random(seed), {}
    for _ in range(n):
        d = date(2019, 1, 1) + timedelta(rnd.randint(0, 700))
        out[(rnd.randint(1, 4), d)] = (rnd.randint(0, 5), rnd.choice([None, None, 0.5, 1.25]))
    return [(i, d, d.year, *v) for (i, d), v in sorted(out.items())]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_equal_full_run(spark, seed):
    data = _counts(seed)
    full = rows(running_sums(spark.createDataFrame(data, SCHEMA), "id", ["n", "w"]))
    days = sorted({r[1] for r in data})
    cuts = sorted(random.Random(seed).sample(days, 2))
    target = None
    for lo, hi in zip([date.min, *cuts], [*cuts, date.max]):
        part = [r for r in data if lo <= r[1] < hi]
        if not part:
            continue
        add = cumulate(spark.createDataFrame(part, SCHEMA), "id", ["n", "w"], target)
        target = add if target is None else target.unionByName(add)
        target = spark.createDataFrame(target.collect(), target.schema)
    assert rows(target, *[c for c in target.columns]) == full
    c = spark.createDataFrame(data, SCHEMA)
    assert running_sums(c, "id", ["n"]).where("s_n > c_n").count() == 0


def test_null_sums_stay_null(spark):
    d = date(2020, 1, 1)
    first = spark.createDataFrame([(1, d, 2020, 1, None)], SCHEMA)
    target = running_sums(first, "id", ["n", "w"])
    nxt = spark.createDataFrame([(1, d + timedelta(1), 2020, 1, None)], SCHEMA)
    assert rows(cumulate(nxt, "id", ["n", "w"], target), "s_n", "s_w") == [(2, None)]


def test_late_day_recomputes_only_its_entity(spark):
    d = date(2020, 1, 1)
    all_counts = spark.createDataFrame([(1, d, 2020, 1, None), (1, d + timedelta(2), 2020, 1, None), (2, d, 2020, 9, None)], SCHEMA)
    late = spark.createDataFrame([(1, d, 2020, 1, None)], SCHEMA)
    assert rows(recompute_entities(all_counts, late, "id", ["n"]), "id", "s_n") == [(1, 1), (1, 2)]


def test_rest_days_looks_back(spark):
    d = date(2020, 1, 1)
    hist = spark.createDataFrame([(1, d)], "p int, game_date date")
    now = spark.createDataFrame([(1, d + timedelta(4)), (1, d + timedelta(9)), (2, d + timedelta(1))], "p int, game_date date")
    assert rows(rest_days(now, "p", history=hist), "p", "pitcher_rest_days") == [(1, 4), (1, 5), (2, -1)]


def test_date_mode_skips_late_rows_and_key_mode_takes_them(spark):
    d = date(2020, 1, 10)
    target = spark.createDataFrame([(1, d)], "game_pk int, game_date date")
    src = spark.createDataFrame([(1, d), (2, d - timedelta(3)), (3, d + timedelta(1))], "game_pk int, game_date date")
    assert rows(T.new_by_date(src, target), "game_pk") == [(3,)]
    assert rows(T.new_by_key(src, target, "game_pk"), "game_pk") == [(2,), (3,)]
    assert T.new_by_date(src, target.limit(0)).count() == 3


def test_dedup_three_loads_and_tie(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "b", 3), (2, "x", 1), (2, "x", 2)], "k int, load string, v int")
    assert rows(dedup_latest(df, ["k"], [F.col("load").desc(), F.col("v").desc()]), "k", "v") == [(1, 2), (2, 2)]


def test_dedup_limits_groups_before_the_shuffle(spark):
    """At most one row per key leaves an input partition."""
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = dedup_latest(df, ["k"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_versions_and_upsert(spark):
    t = T.VersionedTable(spark, fresh_path(spark, "t"))
    T.upsert(t, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    old = t.read()
    T.upsert(t, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    assert rows(t.read()) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(old) == [(1, "a"), (2, "b")]
    assert t.version() == 2


def test_schema_drift_and_conform(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert T.schema_drift(a, a) == ([], [], "none")
    assert T.schema_drift(a, a.drop("y")) == (["y"], [], "rebuild")
    assert T.schema_drift(a, a.drop("y"), "append") == (["y"], [], "append")
    assert T.schema_drift(a.drop("y"), a, "append")[2] == "rebuild"
    assert conform(a, "y double, z string").dtypes == [("x", "int"), ("y", "double"), ("z", "string")]


def test_compaction_writes_few_files(spark):
    src, dst = fresh_path(spark, "small"), fresh_path(spark, "big")
    spark.range(1000).repartition(20).write.parquet(src)
    r = T.compact(spark, src, dst).first()
    assert r["files_before"] == 20 and r["files_after"] == 1
    assert spark.read.parquet(dst).count() == 1000
    files = T.list_files(spark, src)
    assert rows(T.fragmented(files, min_files=20), "n_files") == [(20,)]


def test_pending_and_refetch(spark):
    d = date(2020, 5, 10)
    games = spark.createDataFrame(
        [(1, d, "R", "Final", "Final"), (2, d, "R", "Final", "Postponed"), (3, d - timedelta(1), "R", "Final", "Final"), (4, d, "R", "Live", "In Progress"),
         (5, d - timedelta(9), "R", "Live", "x")], "game_pk int, game_date date, game_type string, abstract_game_state string, status string")
    done = spark.createDataFrame([(1,)], "game_pk int")
    assert rows(T.pending_keys(games, done), "game_pk") == [(3,)]
    assert rows(T.refetch_dates(games, d)) == [(d,)]


def test_poll_logs_of_other_dates_are_not_read(spark):
    from scorebook.sources import logs

    path = T.fresh_path(spark, "polls")
    df = spark.range(40).selectExpr("double(id) AS ts", "double(id) AS response_ms", "true AS changed", "string(null) AS error", "'x' AS event_type", "string(null) AS mlb_event_ts",
                                    "2D AS interval_s", "1 AS inning", "'Top' AS inning_half", "false AS inning_transition", "concat('2024-01-0', id % 4 + 1) AS game_date", "id % 2 AS game_pk")
    logs.write_poll_logs(df, path)
    day = logs.read_poll_logs(spark, path).where("game_date = '2024-01-02'")
    assert day.count() == 10
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "game_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_increment_from_the_newest_state(spark):
    from scorebook.operators.cumulate import advance, cumulate, newest_state, running_sums

    rows_ = [(e, f"20{19 + s}-05-{d:02d}", 2019 + s, float(e + d) if (e + d) % 3 else None) for e in range(4) for s in range(2) for d in range(1, 9) if (e + s + d) % 4]
    df = spark.createDataFrame(rows_, "e int, day string, season int, x double").withColumn("game_date", F.to_date("day")).drop("day")
    full = {tuple(r) for r in running_sums(df, "e", ["x"]).collect()}
    got, state, cuts = set(), None, ["2019-05-04", "2019-05-08", "2020-05-03", "2020-05-09"]
    for lo, hi in zip(["2019-01-01", *cuts], cuts):
        part = df.where(f"game_date >= '{lo}' AND game_date < '{hi}'")
        out = cumulate(part, "e", ["x"], newest=state)
        got |= {tuple(r) for r in out.collect()}
        state = newest_state(part, "e", ["x"]) if state is None else advance(state, out, "e")
    assert got == full


def test_backfill_parses_once(spark):
    """Repeated and unknown run ids keep their rows; the texts are parsed once, before any key is looked up."""
    from scorebook.sources import evaluations as ev

    doc = lambda g: '{"games": [{"game_pk": %d, "horizons": {"+1pa": {"n_reached": 1}}}]}' % g
    raw = spark.createDataFrame([("new", doc(1)), ("new", doc(2)), (None, doc(3)), ("late", doc(4)), ("done", doc(5)), ("bad", "{x"), ("late", None), ("done", "[]")], "eval_id string, results string")
    games = spark.createDataFrame([("done", 5), ("done", 6), ("late", 4), (None, 9)], "eval_id string, game_pk long")
    parts, counts = ev.backfill_eval(raw, games, games.where("eval_id <> 'late'"))
    assert "from_json" not in parts["horizons"]._jdf.queryExecution().toString()
    assert rows(parts["games"], "eval_id", "game_pk") == [(None, 3), ("new", 1), ("new", 2)]
    assert rows(parts["horizons"], "eval_id", "game_pk") == [(None, 3), ("late", 4), ("new", 1), ("new", 2)]
    assert [tuple(r) for r in counts.collect()] == [(3, 3, 1, 1)]
