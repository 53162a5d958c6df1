"""Projections, filters, predicates and scalar functions (B and H)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from registry import roles, sqlparts as S
from registry.core import query
from scorebook import constants as K
from scorebook.functions import features as N
from scorebook.functions import predicates as B
from scorebook.operators.windows import game_state

from scorebook.sources.landing import canonical_events

NOW = datetime(2019, 6, 1, 18, 0, 0)
NOW_SQL = "TIMESTAMP '2019-06-01 18:00:00'"
PK = "game_pk, at_bat_number, pitch_number"




@query("b1_canonical_events", roles.with_ctes(["raw_pitches"], f"SELECT {PK}, game_date, batter AS batter_id, pitcher AS pitcher_id, stand AS bat_side, "
       "p_throws AS pitch_hand, events AS pa_result, pitch_type, zone, description, CAST(NULL AS DOUBLE) AS bat_speed FROM raw_pitches"))
def b1(spark, sf):
    return canonical_events(roles.raw_pitches(spark, sf)).select(
        *PK.split(", "), "game_date", "batter_id", "pitcher_id", "bat_side", "pitch_hand", "pa_result", "pitch_type", "zone",
        "description", "bat_speed")


@query("b2_star_minus", "SELECT * EXCLUDE (props, value) FROM events")
def b2(spark, sf):
    return roles.load(spark, sf, "events").drop("props", "value")


@query("b3_only_types", roles.with_ctes(["games"], f"SELECT game_pk, game_type FROM games WHERE game_type IN {S.inlist(K.EVENT_GAME_TYPES)}"))
def b3(spark, sf):
    return B.only_types(roles.games(spark, sf), K.EVENT_GAME_TYPES).select("game_pk", "game_type")


@query("b4_valid_outcomes", roles.with_ctes(["pitches"], f"SELECT {PK}, pa_result FROM pitches WHERE pa_result IS NOT NULL AND pa_result NOT IN "
       f"{S.inlist(K.EXCLUDED_OUTCOMES)}"))
def b4(spark, sf):
    return B.valid_outcomes(roles.events(spark, sf), K.EXCLUDED_OUTCOMES).select(*PK.split(", "), "pa_result")


@query("b5_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def b5(spark, sf):
    o = roles.load(spark, sf, "orders")
    return o.where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))) \
        .select("o_orderkey", "o_totalprice")


@query("b6_not_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def b6(spark, sf):
    from scorebook.sources.tables import new_by_key

    urgent = roles.load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return new_by_key(roles.load(spark, sf, "customer"), urgent, "c_custkey").select("c_custkey", "c_name")


@query("b7_exists", roles.with_ctes(["games", "rosters"], "SELECT game_pk, status FROM games g WHERE EXISTS (SELECT 1 FROM rosters r WHERE r.game_pk = g.game_pk "
       "AND r.player_id % 7 = 0)"))
def b7(spark, sf):
    r = roles.rosters(spark, sf).where("player_id % 7 = 0")
    return B.has_match(roles.games(spark, sf), r, ["game_pk"]).select("game_pk", "status")


@query("b8_at_latest", roles.with_ctes(["games"], "SELECT game_pk, season, game_date FROM games g WHERE game_date = (SELECT max(game_date) FROM games h WHERE h.season = g.season)"))
def b8(spark, sf):
    return B.at_latest(roles.games(spark, sf), "game_date", ["season"]).select("game_pk", "season", "game_date")


@query("b9_horizon_no", roles.with_ctes(["eval_horizons"], "SELECT eval_id, game_pk, horizon, CAST(substr(horizon, 2, length(horizon) - 3) AS INTEGER) AS no "
       "FROM eval_horizons WHERE horizon LIKE '+%hi'"))
def b9(spark, sf):
    h = roles.eval_horizons(spark, sf).withColumn("no", B.horizon_no("horizon"))
    return h.where(F.col("no").isNotNull()).select("eval_id", "game_pk", "horizon", "no")


@query("b10_state_flags", S.core([], f"SELECT {PK}, (inning_topbot = 'Bot')::INT AS is_bottom, {S.FLAGS}, (inning_topbot = 'Bot')::INT AS is_home FROM pitches"))
def b10(spark, sf):
    return B.state_flags(roles.events(spark, sf)).select(*PK.split(", "), "is_bottom", "runner_1b", "runner_2b", "runner_3b", "is_home")


@query("b11_pitch_group", S.core([], f"SELECT {PK}, pitch_type, {S.GROUP} AS pitch_group FROM pitches"))
def b11(spark, sf):
    return roles.events(spark, sf).select(*PK.split(", "), "pitch_type", B.pitch_group().alias("pitch_group"))


@query("b12_discipline_flags", S.core([], f"SELECT {PK}, description IN {S.inlist(K.SWINGS)} AS is_swing, description IN {S.inlist(K.WHIFFS)} AS is_whiff, "
       f"zone IN {S.inlist(K.OUTSIDE_ZONES)} AS is_outside_zone FROM pitches"))
def b12(spark, sf):
    return B.discipline_flags(roles.events(spark, sf)).select(*PK.split(", "), "is_swing", "is_whiff", "is_outside_zone")


@query("b14_opponent_hand", roles.with_ctes(["players"], "SELECT player_id, CASE WHEN bats = 'S' THEN CASE WHEN throws = 'R' THEN 'l' ELSE 'r' END ELSE lower(bats) END "
       "AS hand FROM players"))
def b14(spark, sf):
    return roles.players(spark, sf).select("player_id", B.opponent_hand("bats", "throws").alias("hand"))


@query("b15_rd_bucket", roles.with_ctes(["eval_games"], "SELECT eval_id, game_pk, entry_run_diff, entry_rd_bucket AS bucket, CAST(CASE WHEN entry_run_diff <= -6 THEN -7 "
       "WHEN entry_run_diff >= 6 THEN 7 ELSE entry_run_diff END AS INTEGER) AS rd FROM eval_games"))
def b15(spark, sf):
    return roles.eval_games(spark, sf).select("eval_id", "game_pk", "entry_run_diff", B.rd_bucket("entry_run_diff").alias("bucket")) \
        .withColumn("rd", B.bucket_rd("bucket"))


@query("b16_phase", roles.with_ctes(["eval_games"], "SELECT eval_id, game_pk, entry_inning, entry_phase AS phase FROM eval_games"))
def b16(spark, sf):
    return roles.eval_games(spark, sf).select("eval_id", "game_pk", "entry_inning", B.phase("entry_inning").alias("phase"))


MASK = "(CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END | CASE WHEN on_2b IS NULL THEN 0 ELSE 2 END | CASE WHEN on_3b IS NULL THEN 0 ELSE 4 END)"


@query("b17_base_mask", S.core([], f"SELECT {PK}, {MASK} AS bases FROM pitches"))
def b17(spark, sf):
    return roles.events(spark, sf).select(*PK.split(", "), B.base_mask("on_1b", "on_2b", "on_3b").alias("bases"))


@query("b18_clamp", "SELECT p_partkey, greatest(10, least(40, p_size)) AS size FROM part")
def b18(spark, sf):
    return roles.load(spark, sf, "part").select("p_partkey", B.clamp("p_size", 10, 40).alias("size"))


@query("b19_home_lead", S.core(["state"], f"SELECT {PK}, CASE WHEN is_bottom = 1 THEN run_diff ELSE -run_diff END AS lead FROM state"))
def b19(spark, sf):
    return game_state(roles.events(spark, sf)).select(*PK.split(", "), B.home_lead("is_bottom", "run_diff").alias("lead"))


@query("b20_generated_columns", "SELECT o_custkey, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{s}' AND left(o_orderpriority, 1) {op} ('1', '2')) AS {s.lower()}_vs_{h}"
    for s in "FOP" for h, op in (("l", "IN"), ("r", "NOT IN"))) + " FROM orders GROUP BY o_custkey")
def b20(spark, sf):
    from scorebook.operators.counts import count_where, gen

    side = {"l": "left(o_orderpriority, 1) IN ('1', '2')", "r": "left(o_orderpriority, 1) NOT IN ('1', '2')"}
    exprs = [count_where(f"o_orderstatus = '{n[0].upper()}' AND {side[n[-1]]}") + f" AS {n}" for n in gen(["f", "o", "p"])]
    return roles.load(spark, sf, "orders").groupBy("o_custkey").agg(*[F.expr(e) for e in exprs])


@query("b21_filter_dates", roles.with_ctes(["games"], "SELECT game_pk, game_date FROM games WHERE year(game_date) IN (2018, 2019, 2020) AND game_date >= DATE '2018-05-01' "
       "AND game_date <= DATE '2020-12-31' AND game_date >= DATE '2018-06-01'"))
def b21(spark, sf):
    return B.filter_dates(roles.games(spark, sf), seasons=[2018, 2019, 2020], date_range=("2018-05-01", "2020-12-31"),
                          floor="2018-06-01").select("game_pk", "game_date")


@query("b22_resolve_features", S.core(["state"], f"SELECT inning, outs, run_diff, target, count(*) AS n FROM state GROUP BY ALL"))
def b22(spark, sf):
    """Explicit blocks minus exclusions, plus one addition; the rows grouped by what was resolved."""
    st = game_state(roles.events(spark, sf))
    keep = ["inning", "outs", "run_diff"]
    names = N.resolve_features(st.columns, "explicit", ["game_state"], add=["target"],
                               exclude=[c for c in N.BLOCKS["game_state"] if c not in keep])
    return st.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("b23_sim_features", S.core(["state"], "SELECT inning, outs, runner_1b, runner_2b, runner_3b, count(*) AS n FROM state GROUP BY ALL"))
def b23(spark, sf):
    st = game_state(roles.events(spark, sf))
    names = N.sim_features(["inning", "is_bottom", "outs", "runner_1b", "runner_2b", "runner_3b", "balls", "strikes", "run_diff", "is_home"])
    return st.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("b24_trackable", roles.with_ctes(["games"], f"SELECT game_pk, game_date, abstract_game_state FROM games WHERE game_date <= CAST({NOW_SQL} AS DATE) + 1 AND "
       f"(abstract_game_state <> 'Final' OR game_datetime > {NOW_SQL} - INTERVAL 8 HOUR)"))
def b24(spark, sf):
    return B.trackable(roles.games(spark, sf), NOW).select("game_pk", "game_date", "abstract_game_state")


@query("b25_needs_tracking", roles.with_ctes(["games"], f"SELECT game_pk, abstract_game_state FROM games WHERE abstract_game_state = 'Live' OR (abstract_game_state = 'Preview' "
       f"AND game_datetime <= {NOW_SQL} + INTERVAL 60 MINUTE)"))
def b25(spark, sf):
    return B.needs_tracking(roles.games(spark, sf), NOW).select("game_pk", "abstract_game_state")


@query("b26_optional_filters", roles.with_ctes(["games"], "SELECT game_pk, game_date, game_type FROM games WHERE game_date = DATE '2018-04-05' AND game_type = 'R'"))
def b26(spark, sf):
    return B.games_on(roles.games(spark, sf), day="2018-04-05", game_type="R").select("game_pk", "game_date", "game_type")


@query("b27_in_play", S.core(["state"], f"""SELECT {PK}, outs + CASE WHEN k = 1 THEN 1 ELSE 0 END AS outs, CASE WHEN is_bottom = 0 AND k = 0 THEN 1 ELSE 0 END AS away_score,
 CASE WHEN is_bottom = 1 AND k = 0 THEN 1 ELSE 0 END AS home_score FROM (SELECT *, CASE WHEN pitch_number % 5 = 0 THEN NULL ELSE (at_bat_number + pitch_number) % 4 END AS k FROM state)"""))
def b27(spark, sf):
    texts = ["In play, run(s)", "In play, out(s)", "In play, no out", "Ball"]
    k = F.element_at(F.array(*[F.lit(t) for t in texts]), ((F.col("at_bat_number") + F.col("pitch_number")) % 4 + 1).cast("int"))
    st = game_state(roles.events(spark, sf)).withColumns({
        "is_complete": F.lit(False), "event": F.when(F.col("pitch_number") % 5 == 0, "Single"), "is_in_play": F.lit(True),
        "description": k, "half": F.col("is_bottom"), "away_score": F.lit(0), "home_score": F.lit(0)})
    return B.adjust_in_play(st).select(*PK.split(", "), "outs", "away_score", "home_score")


@query("b28_seed_context", roles.with_ctes(["sims"], "SELECT game_pk, sim_id, CAST(least((pk % 40) // 9 + 1, 4) AS DOUBLE) AS times_through_order, CAST(pk % 40 AS DOUBLE) AS pitcher_bf_game, "
       "CASE WHEN pk % 40 > 0 THEN CAST(sk % 5 + pk % 6 AS DOUBLE) / (pk % 40) ELSE 0 END AS pitcher_outing_whip FROM sims"),
       doubles="times_through_order pitcher_bf_game pitcher_outing_whip")
def b28(spark, sf):
    s = roles.sims(spark, sf).selectExpr("game_pk", "sim_id", "pk % 40 AS batters_faced", "3 * (pk % 40) AS pitches", "sk % 5 AS walks", "pk % 6 AS hits",
                                         "pk % 4 AS strikeouts", "sk % 3 AS runs", "0 AS balls", "cast(null as int) AS strikes")
    return B.seed_context(s).select("game_pk", "sim_id", "times_through_order", "pitcher_bf_game", "pitcher_outing_whip")


@query("b31_align", "SELECT o_totalprice, o_custkey FROM orders")
def b31(spark, sf):
    out, dropped = N.align(roles.load(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    assert "o_orderkey" in dropped
    return out


# --- scalar functions --------------------------------------------------------

@query("h1_json_paths", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text FROM events")
def h1(spark, sf):
    return roles.load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                                                  F.from_json("props", "k string")["k"].alias("k_text"))


@query("h2_coalesce_nullif", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS r, coalesce(l_extendedprice / nullif(l_discount, 0), -1) AS c FROM lineitem",
       doubles="r c")
def h2(spark, sf):
    r = F.col("l_extendedprice") / F.nullif(F.col("l_discount"), F.lit(0.0))
    return roles.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"), F.coalesce(r, F.lit(-1.0)).alias("c"))


@query("h3_casts", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS INTEGER) AS i, CAST(o_orderkey AS DOUBLE) AS x FROM orders", doubles="x")
def h3(spark, sf):
    return roles.load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_custkey").cast("int").alias("i"),
                                                  F.col("o_orderkey").cast("double").alias("x"))


@query("h4_greatest_least", "SELECT p_partkey, greatest(p_size, 25) AS g, least(p_size, 25) AS l, greatest(p_size, NULL) AS n FROM part")
def h4(spark, sf):
    n = F.lit(None).cast("int")
    return roles.load(spark, sf, "part").select("p_partkey", F.greatest("p_size", F.lit(25)).alias("g"), F.least("p_size", F.lit(25)).alias("l"),
                                                F.greatest(F.col("p_size"), n).alias("n"))


@query("h5_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal / 100) AS BIGINT) AS c, ln(abs(c_acctbal) + 1) AS l, power(c_custkey % 10, 3) AS p, sqrt(abs(c_acctbal)) AS s FROM customer",
       doubles="a l p s")
def h5(spark, sf):
    b = F.col("c_acctbal")
    return roles.load(spark, sf, "customer").select("c_custkey", F.abs(b).alias("a"), F.ceil(b / 100).alias("c"), F.log(F.abs(b) + 1).alias("l"),
                                                    F.pow(F.col("c_custkey") % 10, F.lit(3)).alias("p"), F.sqrt(F.abs(b)).alias("s"))


@query("h6_bits", "SELECT c_custkey, (c_nationkey | 8) AS o, (c_nationkey & 5) AS a, (c_nationkey << 2) AS s FROM customer")
def h6(spark, sf):
    n = F.col("c_nationkey")
    return roles.load(spark, sf, "customer").select("c_custkey", n.bitwiseOR(F.lit(8)).alias("o"), n.bitwiseAND(F.lit(5)).alias("a"), F.shiftleft(n, 2).alias("s"))


@query("h7_dates", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS gap, year(o_orderdate) AS y, CAST(CAST(o_orderdate AS DATE) - 3 AS DATE) AS d3, "
       "o_orderdate + INTERVAL 90 MINUTE AS later FROM orders")
def h7(spark, sf):
    d = F.col("o_orderdate")
    return roles.load(spark, sf, "orders").select("o_orderkey", F.date_diff(F.lit("2002-01-01").cast("date"), d.cast("date")).cast("long").alias("gap"),
                                                  F.year(d).cast("long").alias("y"), F.date_sub(d.cast("date"), 3).alias("d3"), (d + F.expr("INTERVAL 90 MINUTES")).alias("later"))


@query("h8_iso_timestamp", "SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS ms FROM events")
def h8(spark, sf):
    e = roles.load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return e.select("event_id", F.unix_millis(F.to_timestamp("iso")).alias("ms"))


@query("h9_strings", "SELECT c_custkey, substr(c_name, 10, 4) AS a, CAST(length(c_name) AS INTEGER) AS n, concat_ws('|', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS k, "
       "split_part(concat_ws('|', c_mktsegment, CAST(c_nationkey AS VARCHAR)), '|', 2) AS back FROM customer")
def h9(spark, sf):
    k = F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return roles.load(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 4).alias("a"), F.length("c_name").alias("n"), k.alias("k"),
                                                    F.split(k, r"\|")[1].alias("back"))


@query("h10_like_replace", "SELECT p_partkey, lower(p_type) AS low, replace(p_brand, '#', '-') AS b FROM part WHERE p_name LIKE '%ring%'")
def h10(spark, sf):
    return roles.load(spark, sf, "part").where(F.col("p_name").like("%ring%")).select(
        "p_partkey", F.lower("p_type").alias("low"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("b"))


@query("h11_hash_choice", "SELECT user_id, CAST(ts AS DATE) AS d, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) "
                           "ORDER BY (event_id * 7919 + 42) % 1048573, event_id) = 1")
def h11(spark, sf):
    """One event per user and day, chosen by an arithmetic hash that both engines have."""
    from scorebook.operators.windows import first_per

    e = roles.load(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return first_per(e, ["user_id", "d"], [F.expr("(event_id * 7919 + 42) % 1048573"), F.col("event_id")]).select("user_id", "d", "event_id")


@query("h12_nested_access", "SELECT vec_id, CAST(list_position([label, 3, 7], 7) AS BIGINT) AS pos, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings",
       doubles="first last")
def h12(spark, sf):
    e = roles.load(spark, sf, "embeddings")
    return e.select("vec_id", F.array_position(F.array("label", F.lit(3), F.lit(7)), 7).alias("pos"), F.element_at("embedding", 1).cast("double").alias("first"),
                    F.try_element_at("embedding", F.lit(-1)).cast("double").alias("last"))


@query("h13_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0 AS bad FROM events")
def h13(spark, sf):
    """Metrics text to map, back to text, and to map again; broken text gives NULL."""
    e = roles.load(spark, sf, "events")
    m = F.from_json("props", "map<string,bigint>")
    again = F.from_json(F.to_json(m), "map<string,bigint>")
    broken = F.from_json(F.concat(F.lit("["), "props"), "map<string,bigint>")
    return e.select("event_id", again["k"].alias("k"), F.when(broken["k"].isNull(), 0).otherwise(1).alias("bad"))


KNOTS = [(0.0, 0.02), (5.0, 0.1), (20.0, 0.35), (50.0, 0.6), (100.0, 0.97)]


@query("h14_interpolate", "SELECT event_id, CASE " + " ".join(
    f"WHEN value < {b[0]} THEN {a[1]} + (value - {a[0]}) * ({b[1]} - {a[1]}) / ({b[0]} - {a[0]})::DOUBLE" for a, b in zip(KNOTS, KNOTS[1:])) + f" ELSE {KNOTS[-1][1]} END AS y FROM events",
    doubles="y")
def h14(spark, sf):
    from scorebook.operators.lookups import interpolate

    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in KNOTS])
    return roles.load(spark, sf, "events").select("event_id", interpolate(F.col("value"), knots).alias("y"))


@query("h15_path_label", "SELECT page_id, array_to_string(list_slice(string_split(rtrim(url, '/'), '/'), -2, -1), '/') AS label FROM pages")
def h15(spark, sf):
    return roles.load(spark, sf, "pages").select("page_id", B.path_label("url").alias("label"))


@query("h16_bases_text", S.core([], f"SELECT {PK}, CASE {MASK} WHEN 0 THEN '---' WHEN 1 THEN '1B' WHEN 2 THEN '2B' WHEN 3 THEN '1B 2B' WHEN 4 THEN '3B' WHEN 5 THEN '1B 3B' "
       "WHEN 6 THEN '2B 3B' ELSE '1B 2B 3B' END AS txt FROM pitches"))
def h16(spark, sf):
    return roles.events(spark, sf).select(*PK.split(", "), B.bases_text(B.base_mask("on_1b", "on_2b", "on_3b")).alias("txt"))
