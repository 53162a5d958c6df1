"""Work per row: methods that are compiled, fields that are read, shuffles that are needed, rounding as whole numbers."""

import json
import math
import random

from pyspark.sql import functions as F

from registry import roles
from registry.core import rounded, shift
from scorebook.session import apply_defaults
from scorebook.sources import documents as D


def test_stages_too_long_to_compile_are_not_fused(spark):
    apply_defaults(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def _lines(spark, path):
    rows = [(k, 1 + (k * 7 + i) % 5, k * 13 + i * 29, k + i, float(1 + (k + i * 11) % 50), f"1995-01-{1 + (k + i) % 28:02d}") for k in [*range(300), None, None] if k is not None
            for i in range(6)] + [(None, 2, 5, 6, 7.0, "1995-02-01"), (None, 3, 5, 6, 8.0, "1995-02-02")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, day string")
    df.select("*", F.to_date("day").alias("l_shipdate")).drop("day").write.parquet(f"{path}/lineitem.parquet")


def test_pitches_keep_the_layout_of_their_appearance(spark, tmp_path):
    _lines(spark, str(tmp_path))
    df = roles.events(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    raw = spark.read.parquet(f"{tmp_path}/lineitem.parquet").where("l_orderkey IS NOT NULL AND l_orderkey div 54 % 12 <> 11")
    ends = {(r.g, r.ab): r.n for r in raw.groupBy(F.expr("l_orderkey div 54").alias("g"), F.expr("l_orderkey % 54 + 1").alias("ab")).agg(F.max("l_linenumber").alias("n")).collect()}
    got = df.select("game_pk", "at_bat_number", "pitch_number", "pa_result").where("game_pk IS NOT NULL").collect()
    assert got and len(got) == raw.select("l_orderkey", "l_linenumber").distinct().count()
    assert all((r.pa_result is not None) == (r.pitch_number == ends[r.game_pk, r.at_bat_number]) for r in got)


def test_operators_on_live_documents_build_only_what_they_read(spark, monkeypatch):
    player = {"person": {"id": 7, "fullName": "N7"}, "jerseyNumber": "9", "position": {"abbreviation": "CF"}, "stats": {"batting": {"hits": 2, "avg": ".250"}, "pitching": {"strikeOuts": 3}}}
    side = {"team": {"id": 1}, "battingOrder": [7, 8], "pitchers": [7, 11], "bullpen": [11, 12], "bench": [7], "players": {"ID7": player}}
    play = {"about": {"inning": 3, "halfInning": "bottom", "isComplete": True, "isScoringPlay": True, "endTime": "2024-01-01T12:00:00Z"}, "result": {"event": "Single", "description": "d"},
            "matchup": {"batter": {"id": 7, "fullName": "B"}, "pitcher": {"id": 11, "fullName": "P"}, "batSide": {"code": "L"}},
            "playEvents": [{"type": "pitch", "pitchNumber": 1, "details": {"type": {"code": "FF"}}, "pitchData": {"startSpeed": 90.5, "strikeZoneTop": 3.5}}]}
    line = {"currentInning": 3, "inningHalf": "Bottom", "outs": 1, "balls": 2, "strikes": 1, "offense": {"first": {"id": 8, "fullName": "R"}}, "teams": {"home": {"runs": 1, "hits": 2}, "away": {"errors": 1}},
            "innings": [{"num": 1, "home": {"runs": 1}}, {"away": {"runs": 2}}]}
    doc = {"gameData": {"status": {"abstractGameState": "Live", "detailedState": "x"}, "teams": {"home": {"teamName": "H"}}},
           "liveData": {"linescore": line, "plays": {"allPlays": [play, {"about": {"isComplete": False}}, play], "currentPlay": play}, "boxscore": {"teams": {"home": side, "away": {}}}}}
    texts = [json.dumps(doc), "{}", "[1]", "{bad", None, json.dumps({"liveData": {}}), json.dumps({"liveData": {"plays": {"allPlays": []}}})]
    raw = spark.createDataFrame(list(enumerate(texts)), "game_pk long, doc string")
    operators = {"flat_state": "STATE", "current_ab": "AT_BAT", "live_state": "LINE", "pitcher_by_side": "MOUND", "game_detail": "DETAIL"}
    narrow = {f: sorted(getattr(D, f)(raw).collect()) for f in operators}
    for schema in operators.values():
        assert len(getattr(D, schema)) < len(D.GAME)
        monkeypatch.setattr(D, schema, D.GAME)
    assert "playEvents" not in operators and narrow == {f: sorted(getattr(D, f)(raw).collect()) for f in operators}


def test_rounding_equals_decimal_rounding(spark):
    rng = random.Random(3)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-9, 7) for _ in range(3000)] + [a / b for a in range(-40, 40) for b in range(1, 40)]
    values += [0.0, -0.0, 0.5, -0.5, 2.5e-7, 1e300, -1e300, math.inf, -math.inf, math.nan, None, 4503599627.4, 4503599628.6, 5e6, 2.0 ** 53]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for digits in (4, 6, 9):
        got = {r.i: r.x for r in rounded(df, digits).collect()}
        want = {r.i: r.x for r in df.selectExpr("i", f"round(x + {shift(digits)}D, {digits}) + 0D AS x").collect()}
        assert all(repr(got[i]) == repr(want[i]) for i in want)
