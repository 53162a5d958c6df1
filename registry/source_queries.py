"""Sources, sinks, table lifecycle, documents, live streams and models (A, I, J)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from registry import documents_role as docs, roles, sqlparts as S
from registry.core import query
from scorebook.operators import boards, feeds, ml
from scorebook.operators.windows import game_state, terminal_pitch
from scorebook.session import fresh_path
from scorebook.sources import documents as D
from scorebook.sources import evaluations as EV
from scorebook.sources import landing as LA
from scorebook.sources import logs
from scorebook.sources import tables as T
from scorebook.streaming import live

ORD = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders"


def _orders(spark, sf):
    return roles.load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")


# --- landing -----------------------------------------------------------------

query("a1_scan_landing", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25", doubles="l_quantity")(
    lambda spark, sf: LA.read_landing(spark, sf, "lineitem", ".parquet").where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_quantity"))
query("a2_conform", "SELECT event_id, value, CAST(NULL AS DOUBLE) AS arm_angle, CAST(NULL AS VARCHAR) AS note FROM events", doubles="value arm_angle")(
    lambda spark, sf: LA.conform(roles.load(spark, sf, "events").select("event_id", "value"), "value double, arm_angle double, note string"))
query("g1_union_by_name", "SELECT event_id, value, CAST(NULL AS BIGINT) AS extra FROM events UNION ALL BY NAME SELECT o_orderkey AS event_id, o_custkey AS extra FROM orders", doubles="value")(
    lambda spark, sf: roles.load(spark, sf, "events").select("event_id", "value").unionByName(
        roles.load(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("extra")), allowMissingColumns=True))
query("a8_nan_to_null", "SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE value END AS value FROM events", doubles="value")(
    lambda spark, sf: LA.nan_to_null(roles.load(spark, sf, "events").select("event_id", F.expr("CASE WHEN value < 20 THEN double('NaN') ELSE value END AS value"))))


@query("a9_append_landing", "SELECT '1' AS _load_id, count(*) AS n FROM events UNION ALL SELECT '2', count(*) FROM events WHERE event_type = 'error'")
def a9(spark, sf):
    path, e = fresh_path(spark, "landing"), roles.load(spark, sf, "events")
    LA.append_landing(e, f"{path}/events", "1")
    LA.append_landing(e.where("event_type = 'error'"), f"{path}/events", "2")
    return LA.read_landing(spark, path, "events").groupBy("_load_id").agg(F.count(F.lit(1)).alias("n"))


GAMES_COLS = "game_pk game_date season game_type status abstract_game_state away_team_id home_team_name away_score home_score venue_name venue_id".split()


@query("e1_games_from_landing", roles.with_ctes(["games"], f"SELECT {', '.join(GAMES_COLS)} FROM games"))
def games_landing(spark, sf):
    """Landing rows with JSON text and two loads each: parsed, filtered and de-duplicated."""
    g = roles.games(spark, sf).withColumn("load", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(
        "game_pk", "cast(game_date as string) AS official_date", "game_datetime AS game_date", "season", "game_type",
        "to_json(named_struct('detailedState', if(load = 1, 'stale', status), 'abstractGameState', abstract_game_state)) AS status",
        "to_json(named_struct('away', named_struct('score', away_score, 'team', named_struct('id', away_team_id, 'name', away_team_name)), "
        "'home', named_struct('score', home_score, 'team', named_struct('id', home_team_id, 'name', home_team_name)))) AS teams",
        "to_json(named_struct('id', venue_id, 'name', venue_name)) AS venue", "day_night", "scheduled_innings", "double_header", "cast(load as string) AS _load_id")
    return LA.canonical_games(g).select(*GAMES_COLS)


# --- documents ---------------------------------------------------------------

query("a4_explode_schedule", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS schedule_date, o_orderkey * 2 + i AS gamePk, 'R' AS gameType FROM orders, range(0, 2) t(i) WHERE i < o_orderkey % 3")(
    lambda spark, sf: D.explode_schedule(docs.schedules(spark, sf)).select("schedule_date", "gamePk", "gameType"))


@query("a5_flatten_plays", docs.PLAYS_SQL, doubles="pitch_start_speed")
def a5(spark, sf):
    cols = ("game_pk at_bat_number play_event_index pitch_number event_type event_description is_in_play post_balls pitch_start_speed inning half_inning "
            "batter_id pitcher_id pa_event pa_rbi pa_post_on_first_id").split()
    return D.flatten_plays(docs.play_documents(spark, sf)).select(*cols, F.unix_millis("event_end_ts").alias("end_ms"))


query("a6_flatten_players", "SELECT c_custkey AS player_id, c_name AS full_name, 'SS' AS position, CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE 'R' END AS bats, CAST(NULL AS VARCHAR) AS throws, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS team_id, "
      "c_custkey % 2 = 0 AS active FROM customer")(lambda spark, sf: D.flatten_players(docs.people_documents(spark, sf)).select("player_id", "full_name", "position", "bats", "throws", "team_id", "active"))
query("a7_flatten_boxscore", f"{docs.side_sql(0, 'away')} UNION ALL {docs.side_sql(50, 'home')}")(lambda spark, sf: D.flatten_boxscore(docs.boxscore_documents(spark, sf)))


@query("a10_error_isolation", "SELECT o_orderkey % 11 = 0 AS failed, count(*) AS n FROM orders GROUP BY 1")
def a10(spark, sf):
    broken = docs.play_documents(spark, sf).withColumn("doc", F.expr("CASE WHEN game_pk % 11 = 0 THEN substr(doc, 1, length(doc) - 3) ELSE doc END"))
    good, bad = D.with_errors(broken, D.GAME)
    return good.select(F.lit(False).alias("failed")).unionAll(bad.select(F.lit(True).alias("failed"))).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


# --- increments and upserts --------------------------------------------------

DONE = "SELECT game_pk FROM games WHERE game_pk % 4 = 0"


@query("a11_ledger", roles.with_ctes(["games"], f"SELECT game_pk, count(*) AS n FROM ({DONE} UNION ALL SELECT game_pk FROM games WHERE game_pk % 8 = 0) GROUP BY game_pk"))
def a11(spark, sf):
    path, g = fresh_path(spark, "ledger"), roles.games(spark, sf)
    T.record_keys(g.where("game_pk % 4 = 0"), path)
    T.record_keys(g.where("game_pk % 8 = 0"), path)
    return spark.read.parquet(path).groupBy("game_pk").agg(F.count(F.lit(1)).alias("n"))


PENDING = f"SELECT game_pk, game_date FROM games WHERE abstract_game_state = 'Final' AND status NOT IN ('Postponed', 'Cancelled') AND game_type IN ('R', 'F') AND game_pk NOT IN ({DONE}) ORDER BY game_date, game_pk"
query("a12_pending_keys", roles.with_ctes(["games"], PENDING))(lambda spark, sf: T.pending_keys(roles.games(spark, sf), roles.games(spark, sf).where("game_pk % 4 = 0"), ["R", "F"]))
query("f2_first_pending", roles.with_ctes(["games"], PENDING + " LIMIT 7"))(lambda spark, sf: T.pending_keys(roles.games(spark, sf), roles.games(spark, sf).where("game_pk % 4 = 0"), ["R", "F"], 7))
query("a13_refetch_dates", roles.with_ctes(["games"], "SELECT DISTINCT game_date FROM games WHERE abstract_game_state <> 'Final' AND game_date BETWEEN DATE '2019-04-08' - 30 AND DATE '2019-04-08'"))(
    lambda spark, sf: T.refetch_dates(roles.games(spark, sf), "2019-04-08", days=30))
query("a13_next_date", roles.with_ctes(["games"], "SELECT max(game_date) + 1 AS start_date FROM games"))(lambda spark, sf: T.next_date(roles.games(spark, sf)))

MERGED = f"SELECT o_orderkey, o_custkey, d, CASE WHEN o_orderkey % 10 < 3 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM ({ORD})"


def _fix(df):
    return df.where("o_orderkey % 10 < 3").withColumn("o_totalprice", -F.col("o_totalprice"))


query("a14_delete_insert", MERGED, doubles="o_totalprice")(lambda spark, sf: T.delete_insert(_orders(spark, sf), _fix(_orders(spark, sf)), ["o_orderkey"]))


@query("a14_upsert_versions", MERGED, doubles="o_totalprice")
def a14b(spark, sf):
    table = T.VersionedTable(spark, fresh_path(spark, "orders"))
    T.upsert(table, _orders(spark, sf), ["o_orderkey"])
    return T.upsert(table, _fix(_orders(spark, sf)), ["o_orderkey"])


@query("a14_upsert_partitions", f"SELECT *, year(d) AS y FROM ({MERGED.replace('o_orderkey % 10 < 3', 'o_orderkey % 10 < 3 AND year(d) = 1997')})", doubles="o_totalprice")
def a14c(spark, sf):
    path, o = fresh_path(spark, "by-year"), _orders(spark, sf).withColumn("y", F.year("d").cast("long"))
    T.upsert_partitions(spark, path, o, ["o_orderkey"], ["y"])
    out = T.upsert_partitions(spark, path, _fix(o.where("y = 1997")), ["o_orderkey"], ["y"])
    return out.withColumn("y", F.col("y").cast("long"))


query("a15_new_by_key", f"SELECT * FROM ({ORD}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({ORD}) WHERE d < DATE '1995-06-01')", doubles="o_totalprice")(
    lambda spark, sf: T.new_by_key(_orders(spark, sf), _orders(spark, sf).where("d < DATE'1995-06-01'"), "o_custkey"))
query("a16_new_by_date", f"SELECT * FROM ({ORD}) WHERE d > (SELECT max(d) FROM ({ORD}) WHERE d < DATE '2000-01-01')", doubles="o_totalprice")(
    lambda spark, sf: T.new_by_date(_orders(spark, sf), _orders(spark, sf).where("d < DATE'2000-01-01'"), "d"))
query("a17_chunk", f"SELECT * FROM ({ORD}) WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", doubles="o_totalprice")(
    lambda spark, sf: T.chunk(_orders(spark, sf), "1996-01-01", "1996-06-30", "d"))
query("a18_restrict_keys", f"SELECT * FROM ({ORD}) WHERE o_custkey IN (3, 5, 8, 13)", doubles="o_totalprice")(lambda spark, sf: T.restrict_keys(_orders(spark, sf), spark.createDataFrame([(k,) for k in (3, 5, 8, 13)], "o_custkey long"), "o_custkey"))
query("a18_restrict_keys_join", f"SELECT * FROM ({ORD}) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", doubles="o_totalprice")(
    lambda spark, sf: T.restrict_keys(_orders(spark, sf), roles.load(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"))


@query("a19_materialize", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def a19(spark, sf):
    table = T.VersionedTable(spark, fresh_path(spark, "brands"))
    df = roles.load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    T.materialize(df.withColumn("n", F.lit(0).cast("long")), table)
    return T.materialize(df, table)


@query("a20_schema_drift", "SELECT 'rebuild' AS action, 'o_totalprice' AS removed, 'net' AS added, count(*) AS n_rows FROM orders")
def a20(spark, sf):
    o = _orders(spark, sf)
    added, removed, action = T.schema_drift(o.withColumnRenamed("o_totalprice", "net"), o)
    return o.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(action).alias("action"), F.lit(",".join(removed)).alias("removed"), F.lit(",".join(added)).alias("added"), "n_rows")


FILES = "SELECT concat('t', CAST(o_custkey % 40 AS VARCHAR)) AS tbl, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders"


def _files(spark, sf):
    return roles.load(spark, sf, "orders").selectExpr("concat('t', o_custkey % 40) AS table", "cast(o_orderkey as string) AS path", "floor(o_totalprice) AS length")




@query("a21_list_files", "SELECT 60 AS n_files, true AS small, count(*) AS n_rows FROM lineitem")
def a21(spark, sf):
    """A table written in sixty files is found in a real listing."""
    path = fresh_path(spark, "fragments")
    roles.load(spark, sf, "lineitem").select("l_orderkey", "l_quantity").repartition(60).write.parquet(path)
    found = T.fragmented(T.list_files(spark, path))
    return found.select(F.col("n_files").cast("int").alias("n_files"), (F.col("total_bytes") > 0).alias("small")).withColumn("n_rows", F.lit(spark.read.parquet(path).count()).cast("long"))


for _n in ("a21_fragmented",):
    query(_n, f'SELECT tbl AS "table", count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes FROM ({FILES}) GROUP BY tbl HAVING count(*) >= 30 AND avg(length) < 260000 ORDER BY count(*) DESC, tbl')(
        lambda spark, sf: T.fragmented(_files(spark, sf), min_files=30, small=260000))


query("f7_most_files_first", f'SELECT n_files, count(*) AS tables FROM (SELECT count(*) AS n_files FROM ({FILES}) GROUP BY tbl HAVING count(*) >= 10) GROUP BY 1 ORDER BY 1 DESC LIMIT 3')(
    lambda spark, sf: T.fragmented(_files(spark, sf), min_files=10, small=1 << 40).groupBy("n_files").agg(F.count(F.lit(1)).alias("tables")).orderBy(F.desc("n_files")).limit(3))


@query("a18_read_keys_pruned", f"SELECT * FROM ({ORD}) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 90 = 7)", doubles="o_totalprice")
def a18p(spark, sf):
    path = fresh_path(spark, "by-key")
    T.write_by_key(_orders(spark, sf), path, "o_custkey")
    keys = roles.load(spark, sf, "customer").where("c_custkey % 90 = 7").select(F.col("c_custkey").alias("o_custkey"))
    return T.read_keys(spark, path, keys, "o_custkey").select("o_orderkey", "o_custkey", "d", "o_totalprice")


@query("a22_compaction_resumed", "SELECT count(*) AS n, sum(l_quantity) AS q, true AS fewer, 0::BIGINT AS batches_left FROM lineitem", doubles="q")
def a22r(spark, sf):
    """Stopped after its first batch, then taken up again."""
    src, dst = fresh_path(spark, "fragments"), fresh_path(spark, "packed")
    roles.load(spark, sf, "lineitem").repartition(60).write.parquet(src)
    size = T.data_files(spark, src)[1]
    T.run_compaction(spark, src, dst, size // 8, 16, most_batches=1)
    done = T.run_compaction(spark, src, dst, size // 8, 16).first()
    out = T.compacted(spark, src, dst).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return out.withColumns({"fewer": F.lit(done.files_after < done.files_before / 3), "batches_left": F.lit(done.batches_left).cast("long")})


@query("a22_compact", "SELECT count(*) AS n, sum(l_quantity) AS q, true AS fewer FROM lineitem", doubles="q")
def a22(spark, sf):
    """Many small files become few; the rows stay."""
    src, dst = fresh_path(spark, "small"), fresh_path(spark, "compact")
    roles.load(spark, sf, "lineitem").select("l_orderkey", "l_quantity").repartition(24).write.parquet(src)
    report = T.compact(spark, src, dst)
    fewer = report.select(F.col("files_after") < F.col("files_before")).scalar()
    return spark.read.parquet(dst).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).withColumn("fewer", fewer)


@query("a23_append_rows", "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY 1")
def a23(spark, sf):
    path, n = fresh_path(spark, "rows"), roles.load(spark, sf, "nation")
    T.append_rows(n, path)
    T.append_rows(n, path)
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("a24_upsert_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def a24(spark, sf):
    e = roles.load(spark, sf, "events").select("user_id", "event_id", "ts")
    old = T.upsert_latest(e.limit(0), e.where("event_type <> 'error'"), ["user_id"], "ts")
    return T.upsert_latest(old, e.where("event_type = 'error'"), ["user_id"], "ts").select("user_id", "event_id")


# --- logs and lookups --------------------------------------------------------

def _log_rows(spark, sf):
    return roles.polls(spark, sf).selectExpr(
        "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 AS ts", "response_ms", "changed", "error", "event_type", "cast(null as string) AS mlb_event_ts", "2D AS interval_s", "inning", "inning_half",
        "false AS inning_transition", "date_format(ts, 'yyyy-MM-dd') AS game_date", "game_pk % 5 AS game_pk")


LOG_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS game_date, user_id % 5 AS game_pk, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(round(value * 40, 1)) AS top FROM events GROUP BY ALL"


def _written_logs(spark, sf):
    path = fresh_path(spark, "polls")
    logs.write_poll_logs(_log_rows(spark, sf), path)
    return logs.read_poll_logs(spark, path)


def _log_counts(df):
    return df.groupBy("game_date", "game_pk").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"), F.max("response_ms").alias("top"))


@query("a25_read_poll_logs", f"SELECT game_pk, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, CAST(sum(errors) AS BIGINT) AS errors, max(top) AS top FROM ({LOG_SQL}) GROUP BY game_pk", doubles="top", digits=4)
def a25(spark, sf):
    """Date and game come from the path."""
    return _log_counts(_written_logs(spark, sf)).groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("top").alias("top"))


@query("a25_read_poll_logs_pruned", f"SELECT * FROM ({LOG_SQL}) WHERE game_date <= '2024-01-15' AND game_pk = 3", doubles="top", digits=4)
def a25p(spark, sf):
    """Folders of other dates and games are not read."""
    return _log_counts(_written_logs(spark, sf).where("game_date <= '2024-01-15' AND game_pk = 3"))


@query("a26_write_poll_logs", LOG_SQL, doubles="top", digits=4)
def a26(spark, sf):
    return _log_counts(_written_logs(spark, sf))


@query("a27_write_lookup", "SELECT p_brand, n, t AS n_rows FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), (SELECT count(DISTINCT p_brand) AS t FROM part)")
def a27(spark, sf):
    path = fresh_path(spark, "lookup")
    logs.write_lookup(roles.load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), path, {"source": "part"})
    table, meta = logs.read_lookup(spark, path, "p_brand string, n long")
    return table.withColumn("n_rows", meta.select("n_rows").scalar())


# --- evaluation runs ---------------------------------------------------------

def runs(spark, sf):
    """Run summaries as nested JSON text, one per order, two games each."""
    one = "named_struct('n_reached', 10, 'pred_we', {0}, 'pred_run_diff', named_struct('mean', {1}))"
    hz = ("map('+1pa', " + one.format("cast(o_orderkey % 64 as double) / 64", "cast(null as double)") + ", '+1hi', "
          + one.format("if(o_orderkey >= 0, 0.5D, null)", "if(o_orderkey >= 0, 1.5D, null)") + ")")
    game = ("named_struct('game_pk', o_orderkey * 2 + {i}, 'game_date', date_format(o_orderdate, 'yyyy-MM-dd'), 'entry', named_struct('inning', cast(1 + o_custkey % 9 as int), 'half', 0, 'rd_bucket', 'rd_0', 'we_baseline', 0.25D), "
            "'prediction', named_struct('p_home_win', cast(o_custkey % 32 as double) / 32), 'actual', named_struct('home_win', o_orderkey % 2 = 0), 'correct', o_custkey % 2 = 0, 'horizons', " + hz + ")")
    conv = "map('3|rd_p1', map('L1', map('n_games', 12D, 'stabilization_n', 50D, '25', 0.25D, '50', cast(o_orderkey % 4 as double) / 8)), 'bad', map('L1', map('n_games', cast(o_custkey as double))))"
    doc = f"named_struct('games', array({game.format(i=0)}, {game.format(i=1)}), 'level_diagnostics', map('L1', named_struct('n', o_custkey, 'brier', 0.125D)), 'convergence', {conv})"
    return roles.load(spark, sf, "orders").selectExpr("cast(o_orderkey as string) AS eval_id", f"CASE WHEN o_orderkey % 13 = 0 THEN '{{broken' ELSE to_json({doc}) END AS results")


OK = "o_orderkey % 13 <> 0"
query("a28_eval_games", f"SELECT CAST(o_orderkey AS VARCHAR) AS eval_id, o_orderkey * 2 + i AS game_pk, CAST(1 + o_custkey % 9 AS INTEGER) AS entry_inning, 'rd_0' AS entry_rd_bucket, (o_custkey % 32)::DOUBLE / 32 AS p_home_win, o_orderkey % 2 = 0 AS actual_home_win, o_custkey % 2 = 0 AS correct "
      f"FROM orders, range(0, 2) t(i) WHERE {OK}", doubles="p_home_win")(
    lambda spark, sf: EV.decompose_eval(runs(spark, sf))["games"].select("eval_id", "game_pk", "entry_inning", "entry_rd_bucket", "p_home_win", "actual_home_win", "correct"))
query("a28_eval_levels", f"SELECT CAST(o_orderkey AS VARCHAR) AS eval_id, 'L1' AS level, o_custkey AS n, 0.125::DOUBLE AS brier FROM orders WHERE {OK}", doubles="brier")(
    lambda spark, sf: EV.decompose_eval(runs(spark, sf))["levels"].select("eval_id", "level", "n", "brier"))
query("a28_eval_convergence", f"SELECT CAST(o_orderkey AS VARCHAR) AS eval_id, CAST(3 AS INTEGER) AS inning, 'rd_p1' AS rd_bucket, 'L1' AS level, CAST(12 AS BIGINT) AS n_games, CAST(50 AS INTEGER) AS stabilization_n, 0.25::DOUBLE AS std_at_25, nullif((o_orderkey % 4)::DOUBLE / 8, 0) AS std_at_50 "
      f"FROM orders WHERE {OK}", doubles="std_at_25 std_at_50")(
    lambda spark, sf: EV.decompose_eval(runs(spark, sf))["convergence"].select("eval_id", "inning", "rd_bucket", "level", "n_games", "stabilization_n", "std_at_25", "std_at_50"))
query("a28_eval_horizons", f"SELECT CAST(o_orderkey AS VARCHAR) AS eval_id, o_orderkey * 2 + i AS game_pk, h AS horizon, CASE WHEN h = '+1pa' THEN (o_orderkey % 64)::DOUBLE / 64 ELSE 0.5 END AS pred_we, CASE WHEN h = '+1hi' THEN 1.5::DOUBLE END AS pred_run_diff_mean FROM orders, range(0, 2) t(i), "
      f"(VALUES ('+1pa'), ('+1hi')) u(h) WHERE {OK}", doubles="pred_we pred_run_diff_mean")(
    lambda spark, sf: EV.decompose_eval(runs(spark, sf))["horizons"].select("eval_id", "game_pk", "horizon", "pred_we", "pred_run_diff_mean"))


def _backfill(spark, sf):
    r = T.staged(runs(spark, sf), "runs")
    have = EV.decompose_eval(r.where("cast(eval_id as bigint) % 3 = 0"))
    return EV.backfill_eval(r, have["games"], have["horizons"].where("cast(eval_id as bigint) % 2 = 0"))


query("a29_backfill_counts", f"SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND {OK}) AS backfilled, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND {OK}) AS skipped, count(*) FILTER (WHERE NOT ({OK})) AS errors, "
      f"count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 AND {OK}) AS horizons_backfilled FROM orders")(lambda spark, sf: _backfill(spark, sf)[1])
query("a29_backfill_horizons", f"SELECT CAST(o_orderkey AS VARCHAR) AS eval_id, o_orderkey * 2 + i AS game_pk, h AS horizon FROM orders, range(0, 2) t(i), (VALUES ('+1pa'), ('+1hi')) u(h) WHERE {OK} AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 <> 0)")(
    lambda spark, sf: _backfill(spark, sf)[0]["horizons"].select("eval_id", "game_pk", "horizon"))


# --- live documents ----------------------------------------------------------

HALF = "CASE WHEN o_custkey % 2 = 0 THEN 'Top' ELSE 'Bottom' END"
query("i1_flat_state", f"""SELECT o_orderkey AS game_pk, (['Live', 'Final', 'Preview'])[o_custkey % 3 + 1] AS abstract_game_state, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS INTEGER) END AS away_score, CAST(o_orderkey % 11 AS INTEGER) AS home_score,
 CAST(1 + o_orderkey % 9 AS INTEGER) AS inning, {HALF} AS inning_half, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INTEGER) END AS outs, o_custkey + 2 AS current_batter_id, concat('P', o_custkey + 7) AS current_pitcher_name,
 CASE WHEN (o_orderkey + 2) % 3 = 0 THEN 'Single' END AS event_type, CASE WHEN 2 < o_orderkey % 3 THEN 'x' END AS mlb_event_ts, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE concat('{{', array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 1 THEN concat('"first":"R', o_custkey + 1, '"') END,
 CASE WHEN o_orderkey // 2 % 2 = 1 THEN concat('"second":"R', o_custkey + 2, '"') END, CASE WHEN o_orderkey // 4 % 2 = 1 THEN concat('"third":"R', o_custkey + 4, '"') END], lambda x: x IS NOT NULL), ','), '}}') END AS runners FROM orders""")(
    lambda spark, sf: D.flat_state(docs.live_documents(spark, sf)).select("game_pk", "abstract_game_state", "away_score", "home_score", "inning", "inning_half", "outs", "current_batter_id", "current_pitcher_name",
                                                                          "event_type", "mlb_event_ts", "runners"))


@query("i2_current_ab", "SELECT o_orderkey AS game_pk, o_custkey + 2 AS batter_id, CASE WHEN e.n > 0 THEN 3.5::DOUBLE END AS sz_top, CAST(coalesce(e.n, 0) AS INTEGER) AS n_pitches, e.speed AS last_speed FROM orders LEFT JOIN (SELECT o_orderkey AS k, count(*) AS n, "
                        "max_by(80 + ((o_orderkey + 2 + e) % 40)::DOUBLE / 4, e) AS speed FROM orders, range(0, 3) t(e) WHERE e < (o_orderkey + 2) % 4 AND (o_orderkey + 2 + e) % 4 <> 3 GROUP BY 1) e ON e.k = o_orderkey", doubles="sz_top last_speed")
def i2(spark, sf):
    return D.current_ab(docs.live_documents(spark, sf)).select("game_pk", "batter_id", "sz_top", F.size("pitches").alias("n_pitches"),
                                                                F.try_element_at("pitches", F.lit(-1))["speed"].alias("last_speed"))


@query("i3_game_detail", "SELECT o_orderkey AS game_pk, o_orderkey * 100 + 50 + k AS id, CASE WHEN k = 3 THEN concat('#', o_orderkey * 100 + 53) ELSE concat('N', o_orderkey * 100 + 50 + k) END AS name, CAST(b AS INTEGER) AS batting_order, CAST(CASE WHEN k = 3 THEN 0 ELSE (o_orderkey + 50 + k) % 4 END AS INTEGER) AS h, "
                         "CAST(CASE o_orderkey % 3 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS free_arms, CAST(greatest(o_orderkey % 3 - 1, 0) AS INTEGER) AS earlier_pitchers, CAST(o_orderkey % 3 AS INTEGER) AS finished FROM orders, (VALUES (2, 1), (1, 2), (3, 3)) v(k, b)")
def i3(spark, sf):
    d = D.game_detail(docs.live_documents(spark, sf))
    d = d.select("game_pk", F.col("home.lineup").alias("lineup"), F.size("home.bullpen").alias("free_arms"), F.size("home.pitchers_used").alias("earlier_pitchers"), F.size("plays").alias("finished"))
    return D.fan_out(d, ["game_pk", "free_arms", "earlier_pitchers", "finished"], F.col("lineup"), "l").select(
        "game_pk", "l.id", "l.name", "l.batting_order", F.col("l.stats.h").alias("h"), "free_arms", "earlier_pitchers", "finished")


query("b29_live_state", f"SELECT o_orderkey AS game_pk, CAST(1 + o_orderkey % 9 AS INTEGER) AS inning, CASE WHEN {HALF} = 'Bottom' THEN 1 ELSE 0 END AS half, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 END AS INTEGER) AS outs, CAST(o_orderkey % 8 AS INTEGER) AS bases, CAST(o_orderkey % 11 AS INTEGER) AS home_score, "
      "CAST(o_orderkey % 13 AS INTEGER) AS away_score FROM orders")(lambda spark, sf: D.live_state(docs.live_documents(spark, sf)))
query("b30_pitcher_by_side", "SELECT o_orderkey AS game_pk, CASE WHEN o_custkey % 2 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey * 100 + 61 ELSE o_orderkey * 100 + 62 END ELSE o_custkey + 7 END AS home_pitcher_id, "
      "CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey * 100 + 11 ELSE o_orderkey * 100 + 12 END ELSE o_custkey + 7 END AS away_pitcher_id FROM orders")(
    lambda spark, sf: D.pitcher_by_side(docs.live_documents(spark, sf)))


# --- change streams: batch form and stream form ------------------------------

ORDER = ["ts", "event_id"]
LAG = "SELECT *, lag(inning) OVER w AS pi, lag(inning_half) OVER w AS ph, lag(outs) OVER w AS po, lag(current_batter_id) OVER w AS pb, lag(event_type) OVER w AS pe, row_number() OVER w AS n FROM polls WINDOW w AS (PARTITION BY game_pk ORDER BY ts, event_id)"
REPEATS = f"SELECT game_pk, event_id, event_type FROM ({LAG}) WHERE n = 1 OR pe IS DISTINCT FROM event_type"
CHANGES = f"SELECT game_pk, event_id, inning, inning_half, outs FROM ({LAG}) WHERE n = 1 OR (pi, ph, po) IS DISTINCT FROM (inning, inning_half, outs)"
TRIGGER = (f"SELECT * FROM (SELECT game_pk, event_id, CASE WHEN n = 1 THEN NULL WHEN pi <> inning THEN 'inning_start' WHEN ph <> inning_half THEN 'half_start' WHEN outs > po AND outs < 3 THEN 'out_recorded' WHEN pb <> current_batter_id THEN 'pa_start' END AS trigger FROM ({LAG})) WHERE trigger IS NOT NULL")
FLIPS = f"SELECT game_pk, event_id, n > 1 AND (pi <> inning OR ph <> inning_half) AS inning_transition FROM ({LAG})"


def hour():
    return F.date_trunc("hour", F.col("ts"))


STEPS = {
    "i4_drop_repeats": (REPEATS, lambda: live.drop_repeats_step("game_pk", ORDER, hour(), ["event_type"]), ["game_pk", "event_id", "event_type"]),
    "i5_changes": (CHANGES, lambda: live.changes_step("game_pk", ORDER, hour(), ["inning", "inning_half", "outs"]), ["game_pk", "event_id", "inning", "inning_half", "outs"]),
    "i6_transitions": (TRIGGER, lambda: live.transitions_step("game_pk", ORDER, hour()), ["game_pk", "event_id", "trigger"]),
    "i7_inning_flips": (FLIPS, lambda: live.inning_flips_step("game_pk", ORDER, hour()), ["game_pk", "event_id", "inning_transition"]),
}


POLL_FILES = 4


def poll_stream(spark, sf):
    """The events table landing in four ranges of time, ``POLL_FILES`` files each, one range per micro-batch, in the role of polls."""
    events, path = roles.load(spark, sf, "events"), fresh_path(spark, "landing")
    cuts = events.agg(F.percentile_approx("ts", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]), 1000).alias("c")).first().c
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = events if lo is None else events.where(F.col("ts") > F.lit(lo))
        part = part if hi is None else part.where((F.col("ts") <= F.lit(hi)) | (F.col("ts").isNull() if lo is None else F.lit(False)))
        part.repartitionByRange(POLL_FILES, "ts", "event_id").write.mode("append").parquet(path)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", POLL_FILES).parquet(path)
    return roles._apply(raw, roles.poll_steps(roles.Spark))


def run_stream(spark, sf, step, cols):
    path = fresh_path(spark, "changes")
    sink = live.KeyedChanges(spark, path, "game_pk", ORDER, step)
    live.run_to_end(poll_stream(spark, sf), sink, f"{path}/checkpoint")
    return sink.read().select(*cols)


for _n, (_sql, _step, _cols) in STEPS.items():
    query(_n, roles.with_ctes(["polls"], _sql))(lambda spark, sf, s=_step, c=_cols: s()(roles.polls(spark, sf)).select(*c))
    query(f"{_n}_stream", roles.with_ctes(["polls"], _sql))(lambda spark, sf, s=_step, c=_cols: run_stream(spark, sf, s(), c))

LATEST = "SELECT game_pk, event_id, inning, outs FROM polls QUALIFY row_number() OVER (PARTITION BY game_pk ORDER BY ts DESC, event_id DESC) = 1"
query("i8_latest", roles.with_ctes(["polls"], LATEST))(lambda spark, sf: feeds.latest(roles.polls(spark, sf), "game_pk", ORDER).select("game_pk", "event_id", "inning", "outs"))


@query("i8_latest_stream", roles.with_ctes(["polls"], LATEST))
def i8s(spark, sf):
    path = fresh_path(spark, "snapshot")
    sink = live.KeyedChanges(spark, path, "game_pk", ORDER, lambda df: df)
    live.run_to_end(poll_stream(spark, sf), sink, f"{path}/checkpoint")
    return sink.snapshot().select("game_pk", "event_id", "inning", "outs")


@query("i8_column_families", roles.with_ctes(["polls"], "SELECT game_pk, max_by(inning, ts) FILTER (WHERE event_type <> 'error') AS inning, max_by(outs, ts) FILTER (WHERE event_type <> 'error') AS outs, max_by(response_ms, ts) FILTER (WHERE event_type = 'error') AS response_ms, "
                                     "max(ts) FILTER (WHERE event_type <> 'error') AS live_updated_at, max(ts) FILTER (WHERE event_type = 'error') AS sim_updated_at FROM polls GROUP BY game_pk"), doubles="response_ms")
def i8f(spark, sf):
    p = roles.polls(spark, sf).withColumn("family", F.when(F.col("event_type") == "error", "sim").otherwise("live"))
    return feeds.latest_families(p, "game_pk", "ts", {"live": ["inning", "outs"], "sim": ["response_ms"]})


@query("i10_append_results", roles.with_ctes(["polls"], "SELECT game_pk, count(*) AS n, max(event_id) AS last FROM polls GROUP BY game_pk"))
def i10(spark, sf):
    path = fresh_path(spark, "series")
    q = live.append_results(poll_stream(spark, sf).select("game_pk", "event_id", "response_ms"), f"{path}/data", f"{path}/checkpoint").start()
    q.awaitTermination()
    return live.read_results(spark, f"{path}/data").groupBy("game_pk").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


query("i11_expire", roles.with_ctes(["games"], "SELECT game_pk, abstract_game_state FROM games WHERE NOT (abstract_game_state = 'Final' AND epoch(TIMESTAMP '2019-06-01 18:00:00' - game_datetime) > 43200)"))(
    lambda spark, sf: feeds.expire(roles.games(spark, sf), datetime(2019, 6, 1, 18)).select("game_pk", "abstract_game_state"))
query("i13_coalesce_jobs", roles.with_ctes(["polls"], "SELECT game_pk, event_id FROM polls QUALIFY row_number() OVER (PARTITION BY game_pk ORDER BY ts DESC, event_id DESC) = 1"))(
    lambda spark, sf: live.coalesce_jobs(roles.polls(spark, sf), "game_pk", ORDER).select("game_pk", "event_id"))


@query("i14_poll_metrics_stream", roles.with_ctes(["polls"], "SELECT game_pk, count(*) AS poll_count, count(*) FILTER (WHERE error IS NULL) AS success_count, count(*) FILTER (WHERE error IS NOT NULL) AS error_count, count(*) FILTER (WHERE changed) AS changed_count, "
                                          "avg(response_ms) FILTER (WHERE error IS NULL) AS avg_response_ms, max(response_ms) FILTER (WHERE error IS NULL) AS max_response_ms FROM polls GROUP BY game_pk"), doubles="avg_response_ms max_response_ms")
def i14(spark, sf):
    path = fresh_path(spark, "metrics")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/b={batch_id:08d}")

    q = live.poll_metrics_stream(poll_stream(spark, sf)).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return live.newest_output(spark, path)


# --- models ------------------------------------------------------------------

query("j3_check_taxonomy", S.core([], f"SELECT pa_result AS class, 'not listed' AS problem FROM (SELECT DISTINCT pa_result FROM pitches) WHERE pa_result NOT IN {S.inlist(S.K.OUTCOME_CLASSES)} UNION ALL SELECT c, 'not seen' FROM (SELECT unnest({S.K.OUTCOME_CLASSES}) AS c) "
                                  "WHERE c NOT IN (SELECT pa_result FROM pitches WHERE pa_result IS NOT NULL)"))(lambda spark, sf: ml.check_taxonomy(roles.events(spark, sf), S.K.OUTCOME_CLASSES, "pa_result"))
SITUATION = ["inning", "outs", "balls", "strikes", "run_diff", "times_through_order", "pitcher_pitch_count"]


def _labelled(spark, sf):
    st = terminal_pitch(game_state(roles.events(spark, sf))).withColumn("row_id", F.col("game_pk") * 100 + F.col("at_bat_number"))
    group = F.when(F.col("target").isin(S.K.HITS), "hit").when(F.col("target").isin(S.K.WALKS + ["hit_by_pitch"]), "walk").otherwise("out")
    # Training passes over its rows many times: they are a finished table first.
    return T.staged(boards.split3(boards.encode(st.withColumn("outcome", group), "outcome"), "outcome", ["row_id"]), "labelled")


def _model(data):
    return ml.train_outcome_model(data.where("split = 'train'"), SITUATION)


@query("j6_outcome_model")
def j6(spark, sf):
    data = _labelled(spark, sf)
    scored = ml.class_probabilities(data.where("split = 'test'"), _model(data), SITUATION, ["row_id", "label_index"])
    return scored.select("row_id", F.col("label_index"), F.element_at("proba", 1).alias("p0"), F.element_at("proba", 2).alias("p1"))


@query("j7_exit_model")
def j7(spark, sf):
    from registry.core_queries import j13

    """Trained on 70 %, calibrated on 15 %, scored on the last 15 % of the appearances, stratified by the label."""
    features = ["pitcher_bf_game", "outing_runs", "inning", "run_diff", "avg_bf_per_app"]
    rows = T.staged(boards.split3(j13(spark, sf), "pulled", ["game_pk", "at_bat_number"], test=0.15, calib=0.15 / 0.85), "exit-rows")
    return ml.exit_model(rows, features, ["game_pk", "at_bat_number"])


@query("j8_fit_calibration")
def j8(spark, sf):
    p = roles.predictions(spark, sf).withColumnRenamed("label", "label_index")
    return ml.fit_calibration(p, roles.PRIORITIES)


@query("j8_calibration_cells", roles.with_ctes(["predictions"], """SELECT class, cell, CAST(sum(n) AS BIGINT) AS n, sum(sx) / sum(n) AS x, sum(sy) / sum(n) AS y FROM (
 SELECT *, CAST(floor((sum(n) OVER (PARTITION BY class ORDER BY slot) - n) * 50 / sum(n) OVER (PARTITION BY class)) AS BIGINT) AS cell FROM (
 SELECT class, least(CAST(floor(p * 65536) AS BIGINT), 65535) AS slot, count(*) AS n, sum(p) AS sx, count(*) FILTER (WHERE label = class) AS sy FROM (SELECT label, unnest(proba) AS p, CAST(generate_subscripts(proba, 1) - 1 AS INTEGER) AS class FROM predictions) GROUP BY ALL)) GROUP BY class, cell"""), doubles="x y")
def j8c(spark, sf):
    return ml.calibration_cells(roles.predictions(spark, sf).withColumnRenamed("label", "label_index"), roles.PRIORITIES, cells=50)


@query("j9_score")
def j9(spark, sf):
    data = _labelled(spark, sf)
    model = _model(data)
    cal = ml.class_probabilities(data.where("split = 'calibrate'"), model, SITUATION, ["label_index"])
    return ml.score(data.where("split = 'test'"), model, SITUATION, "row_id", ml.fit_calibration(cal, 3))


@query("j10_binary_report", roles.with_ctes(["eval_games"], """SELECT n, pos_rate, log_loss, brier, auc, auc >= 0.6 AND brier <= 0.25 AND n >= 1000 AS passed FROM (SELECT count(*) AS n, avg(o) AS pos_rate, avg(-ln(CASE WHEN o = 1 THEN q ELSE 1 - q END)) AS log_loss, avg(power(p - o, 2)) AS brier FROM
 (SELECT p_home_win AS p, CAST(actual_home_win AS INTEGER)::DOUBLE AS o, greatest(1e-15, least(1 - 1e-15, p_home_win)) AS q FROM eval_games)), (SELECT (sum(r) FILTER (WHERE y) - np * (np + 1) / 2)::DOUBLE / (np * (m - np)) AS auc FROM (SELECT actual_home_win AS y, (min(k) OVER (PARTITION BY p_home_win)
 + max(k) OVER (PARTITION BY p_home_win)) / 2::DOUBLE AS r, count(*) FILTER (WHERE actual_home_win) OVER () AS np, count(*) OVER () AS m FROM (SELECT *, row_number() OVER (ORDER BY p_home_win) AS k FROM eval_games)) GROUP BY np, m)"""),
       doubles="pos_rate log_loss brier auc")
def j10(spark, sf):
    return ml.binary_report(roles.eval_games(spark, sf).withColumn("y", F.col("actual_home_win").cast("int")), "p_home_win", "y")


MF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("j11_relevance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (b - s * s / n) / (k - 1) / ((q - b) / (n - k)) AS f_stat FROM (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM (SELECT count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY l_returnflag))" for c in MF),
    doubles="f_stat", digits=4)(lambda spark, sf: ml.relevance(roles.load(spark, sf, "lineitem"), MF, "l_returnflag"))


@query("j11_mrmr")
def j11(spark, sf):
    names = ml.mrmr(roles.load(spark, sf, "lineitem"), MF, "l_returnflag", 3)
    return spark.createDataFrame(list(enumerate(names, 1)), "rank int, feature string")
