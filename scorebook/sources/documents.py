"""Nested JSON documents to flat rows.

A document is one row of text; ``from_json`` with an explicit schema reads only the fields
named, and ``explode`` fans it out inside the task, so nothing is grouped or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "struct<id:bigint>"
NAMED = "struct<id:bigint,fullName:string>"
CODE = "struct<code:string>"
SCHEDULE = ("struct<dates:array<struct<date:string,games:array<struct<gamePk:bigint,gameType:string,"
            "season:string,officialDate:string,gameDate:string,dayNight:string>>>>>")
COUNT = "struct<balls:int,strikes:int,outs:int>"
PITCH = ("struct<startSpeed:double,strikeZoneTop:double,strikeZoneBottom:double,"
         "coordinates:struct<pX:double,pZ:double>>")
DETAILS = ("struct<description:string,isInPlay:boolean,isBall:boolean,isStrike:boolean,"
           "type:struct<code:string,description:string>>")
PLAY_EVENT = (f"struct<index:int,pitchNumber:int,playId:string,type:string,startTime:string,endTime:string,"
              f"isPitch:boolean,details:{DETAILS},count:{COUNT},pitchData:{PITCH}>")
ABOUT = ("struct<atBatIndex:int,inning:int,halfInning:string,isTopInning:boolean,isScoringPlay:boolean,"
         "hasOut:boolean,isComplete:boolean,startTime:string,endTime:string>")
RESULT = "struct<event:string,type:string,description:string,rbi:int,awayScore:int,homeScore:int>"
MATCHUP = (f"struct<batter:{NAMED},pitcher:{NAMED},batSide:{CODE},pitchHand:{CODE},"
           f"postOnFirst:{ID},postOnSecond:{ID},postOnThird:{ID}>")
PLAY = f"struct<about:{ABOUT},result:{RESULT},matchup:{MATCHUP},playEvents:array<{PLAY_EVENT}>>"
RUNS = "struct<runs:int,hits:int,errors:int>"
LINESCORE = (f"struct<currentInning:int,inningHalf:string,outs:int,balls:int,strikes:int,"
             f"offense:struct<first:{NAMED},second:{NAMED},third:{NAMED}>,"
             f"teams:struct<home:{RUNS},away:{RUNS}>,"
             f"innings:array<struct<num:int,home:{RUNS},away:{RUNS}>>>")
BATTING = "struct<atBats:int,hits:int,runs:int,rbi:int,baseOnBalls:int,strikeOuts:int,homeRuns:int,avg:string>"
PITCHING = ("struct<inningsPitched:string,hits:int,runs:int,earnedRuns:int,baseOnBalls:int,strikeOuts:int,"
            "numberOfPitches:int,battersFaced:int,era:string>")
PLAYER = (f"struct<person:{NAMED},jerseyNumber:string,position:struct<abbreviation:string>,"
          f"stats:struct<batting:{BATTING},pitching:{PITCHING}>>")
SIDE = (f"struct<team:{ID},battingOrder:array<bigint>,pitchers:array<bigint>,bullpen:array<bigint>,"
        f"bench:array<bigint>,players:map<string,{PLAYER}>>")
BOXSCORE = f"struct<teams:struct<away:{SIDE},home:{SIDE}>>"
TEAM_INFO = "struct<teamName:string,abbreviation:string>"
GAME = (f"struct<gameData:struct<status:struct<abstractGameState:string,detailedState:string>,"
        f"teams:struct<home:{TEAM_INFO},away:{TEAM_INFO}>>,"
        f"liveData:struct<plays:struct<allPlays:array<{PLAY}>,currentPlay:{PLAY}>,"
        f"linescore:{LINESCORE},boxscore:{BOXSCORE}>>")
#: What each operator on live documents reads; other fields are passed over, not built.
STATE = (f"struct<gameData:struct<status:struct<abstractGameState:string,detailedState:string>>,"
         f"liveData:struct<plays:struct<currentPlay:struct<about:struct<isComplete:boolean,endTime:string>,"
         f"result:struct<event:string,description:string>,matchup:struct<batter:{NAMED},pitcher:{NAMED}>>>,"
         f"linescore:struct<currentInning:int,inningHalf:string,outs:int,balls:int,strikes:int,"
         f"offense:struct<first:{NAMED},second:{NAMED},third:{NAMED}>,teams:struct<home:struct<runs:int>,away:struct<runs:int>>>>>")
AT_BAT = (f"struct<liveData:struct<plays:struct<currentPlay:struct<"
          f"matchup:struct<batter:{NAMED},pitcher:{NAMED},batSide:{CODE}>,playEvents:array<{PLAY_EVENT}>>>>>")
LINE = (f"struct<liveData:struct<linescore:struct<currentInning:int,inningHalf:string,outs:int,"
        f"offense:struct<first:{ID},second:{ID},third:{ID}>,teams:struct<home:struct<runs:int>,away:struct<runs:int>>>>>")
MOUND = (f"struct<liveData:struct<plays:struct<currentPlay:struct<matchup:struct<pitcher:{ID}>>>,linescore:struct<inningHalf:string>,"
         f"boxscore:struct<teams:struct<away:struct<pitchers:array<bigint>>,home:struct<pitchers:array<bigint>>>>>>")
SHOWN = ("struct<about:struct<inning:int,halfInning:string,isScoringPlay:boolean,isComplete:boolean>,"
         "result:struct<event:string,description:string>>")
DETAIL = (f"struct<gameData:struct<teams:struct<home:{TEAM_INFO},away:{TEAM_INFO}>>,"
          f"liveData:struct<plays:struct<allPlays:array<{SHOWN}>>,"
          f"linescore:struct<teams:struct<home:{RUNS},away:{RUNS}>,"
          f"innings:array<struct<num:int,home:struct<runs:int>,away:struct<runs:int>>>>,boxscore:{BOXSCORE}>>")
PERSON = ("struct<id:bigint,fullName:string,firstName:string,lastName:string,active:boolean,birthDate:string,"
          "mlbDebutDate:string,primaryPosition:struct<abbreviation:string>,batSide:struct<code:string>,"
          "pitchHand:struct<code:string>,currentTeam:struct<id:bigint,name:string>>")


def is_object(doc: Column) -> Column:
    """Valid JSON with an object at the top; NULL, arrays and bare values are not."""
    return F.coalesce(F.try_parse_json(doc).isNotNull() & doc.rlike(r"^\s*\{"), F.lit(False))


def with_errors(raw: DataFrame, schema: str, col: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Parse documents one by one: (rows with ``parsed``, rows that are not valid JSON objects).

    A bad document never fails the job; its row is returned for a later retry.
    """
    ok = is_object(F.col(col))
    good = raw.where(ok).withColumn("parsed", F.from_json(F.col(col), schema))
    return good, raw.where(~ok)


def _ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def fan_out(df: DataFrame, keep: list[str], items: Column, *names: str) -> DataFrame:
    """One row per element of an array or map.

    A plain ``explode`` makes the optimizer add a "not empty" filter below, which repeats the
    whole expression, JSON parsing included. The outer form does not; its empty rows are
    dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(items).alias(*names)).where(F.col(names[0]).isNotNull())


def explode_schedule(raw: DataFrame, col: str = "doc") -> DataFrame:
    d = fan_out(raw, [], F.from_json(F.col(col), SCHEDULE)["dates"], "d")
    d = d.select(F.col("d.date").alias("schedule_date"), F.col("d.games").alias("games"))
    return fan_out(d, ["schedule_date"], F.col("games"), "g").select("schedule_date", "g.*")


def flatten_plays(raw: DataFrame, key: str = "game_pk", col: str = "doc") -> DataFrame:
    """One row per play event with its plate appearance's context; plays without index are dropped."""
    p = fan_out(raw, [key], F.from_json(F.col(col), GAME)["liveData"]["plays"]["allPlays"], "p")
    p = p.where(F.col("p.about.atBatIndex").isNotNull())
    e = fan_out(p, [key, "p.about", "p.result", "p.matchup"], F.col("p.playEvents"), "e")
    return e.select(
        key, (F.col("about.atBatIndex") + 1).alias("at_bat_number"), F.col("e.index").alias("play_event_index"),
        F.col("e.pitchNumber").alias("pitch_number"), F.col("e.playId").alias("play_id"),
        F.col("e.type").alias("event_type"), _ts(F.col("e.startTime")).alias("event_start_ts"),
        _ts(F.col("e.endTime")).alias("event_end_ts"), F.col("e.details.description").alias("event_description"),
        F.col("e.isPitch").alias("is_pitch"), F.col("e.details.isInPlay").alias("is_in_play"),
        F.col("e.details.isBall").alias("is_ball"), F.col("e.details.isStrike").alias("is_strike"),
        F.col("e.count.balls").alias("post_balls"), F.col("e.count.strikes").alias("post_strikes"),
        F.col("e.count.outs").alias("post_outs"), F.col("e.pitchData.startSpeed").alias("pitch_start_speed"),
        F.col("e.pitchData.coordinates.pX").alias("pitch_plate_x"),
        F.col("e.pitchData.coordinates.pZ").alias("pitch_plate_z"),
        F.col("about.inning").alias("inning"), F.col("about.halfInning").alias("half_inning"),
        F.col("about.isTopInning").alias("is_top_inning"), F.col("matchup.batter.id").alias("batter_id"),
        F.col("matchup.pitcher.id").alias("pitcher_id"), F.col("result.event").alias("pa_event"),
        F.col("result.type").alias("pa_event_type"), F.col("result.description").alias("pa_description"),
        F.col("about.isScoringPlay").alias("pa_is_scoring_play"), F.col("about.hasOut").alias("pa_has_out"),
        F.col("result.rbi").alias("pa_rbi"), F.col("result.awayScore").alias("pa_away_score"),
        F.col("result.homeScore").alias("pa_home_score"), F.col("matchup.postOnFirst.id").alias("pa_post_on_first_id"),
        F.col("matchup.postOnSecond.id").alias("pa_post_on_second_id"),
        F.col("matchup.postOnThird.id").alias("pa_post_on_third_id"),
        _ts(F.col("about.startTime")).alias("pa_start_ts"), _ts(F.col("about.endTime")).alias("pa_end_ts"))


def flatten_players(raw: DataFrame, col: str = "doc") -> DataFrame:
    """Player records from ``{"people": [...]}`` responses."""
    p = fan_out(raw, [], F.from_json(F.col(col), f"struct<people:array<{PERSON}>>")["people"], "p")
    return p.select(
        F.col("p.id").alias("player_id"), F.col("p.fullName").alias("full_name"), F.col("p.firstName").alias("first_name"),
        F.col("p.lastName").alias("last_name"), F.col("p.primaryPosition.abbreviation").alias("position"),
        F.col("p.batSide.code").alias("bats"), F.col("p.pitchHand.code").alias("throws"),
        F.col("p.currentTeam.id").alias("team_id"), F.col("p.currentTeam.name").alias("team_name"),
        F.col("p.active").alias("active"), F.col("p.birthDate").alias("birth_date"),
        F.col("p.mlbDebutDate").alias("mlb_debut_date"))


def flatten_boxscore(raw: DataFrame, key: str = "game_pk", col: str = "doc") -> DataFrame:
    """One row per player of both sides, with lineup slot and starter flag."""
    box = F.from_json(F.col(col), BOXSCORE)["teams"]
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col("__b")[s].alias("t")) for s in ("away", "home")])
    t = fan_out(raw.withColumn("__b", box), [key], sides, "s").select(key, "s.side", "s.t")
    p = fan_out(t, [key, "side", "t"], F.col("t.players"), "__id", "p")
    pid = F.col("p.person.id")
    slot = F.nullif(F.array_position("t.battingOrder", pid), F.lit(0).cast("long"))
    starter = F.try_element_at("t.pitchers", F.lit(1)).eqNullSafe(pid)
    return p.select(key, pid.alias("player_id"), F.col("t.team.id").alias("team_id"), "side",
                    F.col("p.position.abbreviation").alias("position"), slot.cast("int").alias("batting_order"),
                    starter.alias("is_starting_pitcher"))


# --- live documents ----------------------------------------------------------

def parse_live(raw: DataFrame, col: str = "doc", schema: str = GAME) -> DataFrame:
    return raw.withColumn("__g", F.from_json(F.col(col), schema))


def _runners() -> Column:
    off = F.col("__g.liveData.linescore.offense")
    some = F.coalesce(off["first"].isNotNull() | off["second"].isNotNull() | off["third"].isNotNull(), F.lit(False))
    names = F.struct(*[F.when(off[b].isNotNull(), F.coalesce(off[b]["fullName"], F.lit("true"))).alias(b)
                       for b in ("first", "second", "third")])
    return F.when(some, F.to_json(names))


def flat_state(raw: DataFrame, keep: list[str] = ("game_pk",), col: str = "doc") -> DataFrame:
    """Flat current state of a live document; ``runners`` is a JSON text of base to name."""
    line, play = F.col("__g.liveData.linescore"), F.col("__g.liveData.plays.currentPlay")
    status = F.col("__g.gameData.status")
    return parse_live(raw, col, STATE).select(
        *keep, status["abstractGameState"].alias("abstract_game_state"), status["detailedState"].alias("status"),
        line["teams"]["away"]["runs"].alias("away_score"), line["teams"]["home"]["runs"].alias("home_score"),
        line["currentInning"].alias("inning"), line["inningHalf"].alias("inning_half"), line["outs"].alias("outs"),
        line["balls"].alias("balls"), line["strikes"].alias("strikes"), _runners().alias("runners"),
        play["matchup"]["batter"]["id"].alias("current_batter_id"),
        play["matchup"]["batter"]["fullName"].alias("current_batter_name"),
        play["matchup"]["pitcher"]["id"].alias("current_pitcher_id"),
        play["matchup"]["pitcher"]["fullName"].alias("current_pitcher_name"),
        play["result"]["description"].alias("last_play"), play["result"]["event"].alias("event_type"),
        F.when(play["about"]["isComplete"], play["about"]["endTime"]).alias("mlb_event_ts"))


def current_ab(raw: DataFrame, keep: list[str] = ("game_pk",), col: str = "doc") -> DataFrame:
    """Pitches of the current plate appearance; the strike zone is that of its first pitch."""
    play = F.col("__g.liveData.plays.currentPlay")
    pitches = F.filter(play["playEvents"], lambda e: e["type"] == "pitch")
    zone = F.filter(F.col("__pitches"), lambda e: e["pitchData"]["strikeZoneTop"].isNotNull())
    first = F.try_element_at(zone, F.lit(1))["pitchData"]

    def pitch(e: Column) -> Column:
        d, pd = e["details"], e["pitchData"]
        no = F.lit(False)
        return F.struct(
            e["pitchNumber"].alias("num"), d["type"]["code"].alias("type_code"),
            d["type"]["description"].alias("type_name"), pd["startSpeed"].alias("speed"),
            pd["coordinates"]["pX"].alias("px"), pd["coordinates"]["pZ"].alias("pz"), d["description"].alias("result"),
            F.coalesce(d["isStrike"], no).alias("is_strike"), F.coalesce(d["isBall"], no).alias("is_ball"),
            F.coalesce(d["isInPlay"], no).alias("is_in_play"), e["count"]["balls"].alias("balls_after"),
            e["count"]["strikes"].alias("strikes_after"))

    m = play["matchup"]
    return parse_live(raw, col, AT_BAT).withColumn("__pitches", F.coalesce(pitches, F.array().cast(f"array<{PLAY_EVENT}>"))).select(
        *keep, m["batter"]["id"].alias("batter_id"), m["batter"]["fullName"].alias("batter_name"),
        m["pitcher"]["id"].alias("pitcher_id"), m["pitcher"]["fullName"].alias("pitcher_name"),
        m["batSide"]["code"].alias("bat_side"), first["strikeZoneTop"].alias("sz_top"),
        first["strikeZoneBottom"].alias("sz_bottom"), F.transform("__pitches", pitch).alias("pitches"))


def live_state(raw: DataFrame, keep: list[str] = ("game_pk",), col: str = "doc") -> DataFrame:
    """State row of a live document: half, base mask and scores with zero defaults."""
    line = F.col("__g.liveData.linescore")
    off = line["offense"]

    def on(base: str, bit: int) -> Column:
        return F.when(off[base].isNotNull(), bit).otherwise(0)

    return parse_live(raw, col, LINE).select(
        *keep, F.coalesce(line["currentInning"], F.lit(1)).alias("inning"),
        F.when(line["inningHalf"] == "Bottom", 1).otherwise(0).alias("half"),
        F.coalesce(line["outs"], F.lit(0)).alias("outs"),
        on("first", 1).bitwiseOR(on("second", 2)).bitwiseOR(on("third", 4)).alias("bases"),
        F.coalesce(line["teams"]["home"]["runs"], F.lit(0)).alias("home_score"),
        F.coalesce(line["teams"]["away"]["runs"], F.lit(0)).alias("away_score"))


def pitcher_by_side(raw: DataFrame, keep: list[str] = ("game_pk",), col: str = "doc") -> DataFrame:
    """Current pitcher of each side: the matchup's when on defence, else the side's last one."""
    box = F.col("__g.liveData.boxscore.teams")
    bottom = F.coalesce(F.col("__g.liveData.linescore.inningHalf") == "Bottom", F.lit(False))
    now = F.col("__g.liveData.plays.currentPlay.matchup.pitcher.id")
    last = {s: F.try_element_at(box[s]["pitchers"], F.lit(-1)) for s in ("home", "away")}
    return parse_live(raw, col, MOUND).select(*keep, F.when(bottom, last["home"]).otherwise(now).alias("home_pitcher_id"),
                                       F.when(bottom, now).otherwise(last["away"]).alias("away_pitcher_id"))


def _player(players: Column, pid: Column) -> Column:
    return F.try_element_at(players, F.concat(F.lit("ID"), pid.cast("string")))


def _entry(players: Column, pid: Column, fields: list[Column]) -> Column:
    p = _player(players, pid)
    name = F.coalesce(p["person"]["fullName"], F.concat(F.lit("#"), pid.cast("string")))
    return F.struct(pid.alias("id"), name.alias("name"), F.coalesce(p["jerseyNumber"], F.lit("")).alias("jersey"), *fields)


def _team(side: str) -> Column:
    box, info = F.col(f"__g.liveData.boxscore.teams.{side}"), F.col(f"__g.gameData.teams.{side}")
    players = box["players"]
    empty = F.array().cast("array<bigint>")
    order, used = F.coalesce(box["battingOrder"], empty), F.coalesce(box["pitchers"], empty)

    def stat(src: Column, names: dict[str, str]) -> list[Column]:
        return [F.coalesce(src[v], F.lit(0)).alias(k) for k, v in names.items()]

    def hitter(pid: Column, i: Column) -> Column:
        p = _player(players, pid)
        b = p["stats"]["batting"]
        stats = F.struct(*stat(b, {"ab": "atBats", "h": "hits", "r": "runs", "rbi": "rbi", "bb": "baseOnBalls",
                                   "so": "strikeOuts", "hr": "homeRuns"}),
                         F.coalesce(b["avg"], F.lit(".000")).alias("avg"))
        return _entry(players, pid, [F.coalesce(p["position"]["abbreviation"], F.lit("")).alias("position"),
                                     (i + 1).alias("batting_order"), stats.alias("stats")])

    def pitcher(pid: Column) -> Column:
        s = _player(players, pid)["stats"]["pitching"]
        stats = F.struct(F.coalesce(s["inningsPitched"], F.lit("0.0")).alias("ip"),
                         *stat(s, {"h": "hits", "r": "runs", "er": "earnedRuns", "bb": "baseOnBalls",
                                   "so": "strikeOuts", "pitches": "numberOfPitches"}),
                         F.coalesce(s["era"], F.lit("0.00")).alias("era"))
        return _entry(players, pid, [stats.alias("stats")])

    def bench(pid: Column) -> Column:
        p = _player(players, pid)
        stats = F.struct(*stat(p["stats"]["batting"], {"ab": "atBats", "h": "hits", "rbi": "rbi"}))
        return _entry(players, pid, [F.coalesce(p["position"]["abbreviation"], F.lit("")).alias("position"),
                                     stats.alias("stats")])

    staff = F.transform(used, pitcher)
    free = F.array_except(F.coalesce(box["bullpen"], empty), used)
    return F.struct(
        F.coalesce(info["teamName"], F.lit("")).alias("team_name"),
        F.coalesce(info["abbreviation"], F.lit("")).alias("abbreviation"),
        F.transform(order, hitter).alias("lineup"), F.try_element_at(staff, F.lit(-1)).alias("pitcher"),
        F.slice(staff, F.lit(1), F.greatest(F.size(staff) - 1, F.lit(0))).alias("pitchers_used"),
        F.transform(free, lambda pid: _entry(players, pid, [])).alias("bullpen"),
        F.transform(F.coalesce(box["bench"], empty), bench).alias("bench"))


def game_detail(raw: DataFrame, keep: list[str] = ("game_pk",), col: str = "doc") -> DataFrame:
    """Display detail of a live document: both sides, linescore and completed plays."""
    line, plays = F.col("__g.liveData.linescore"), F.col("__g.liveData.plays.allPlays")

    def totals(side: str) -> Column:
        t = line["teams"][side]
        return F.struct(*[F.coalesce(t[k], F.lit(0)).alias(k) for k in ("runs", "hits", "errors")])

    innings = F.transform(line["innings"], lambda i: F.struct(
        F.coalesce(i["num"], F.lit(0)).alias("num"), i["away"]["runs"].alias("away"), i["home"]["runs"].alias("home")))
    finished = F.filter(plays, lambda p: F.coalesce(p["about"]["isComplete"], F.lit(False)))
    shown = F.transform(finished, lambda p: F.struct(
        F.coalesce(p["about"]["inning"], F.lit(0)).alias("inning"),
        F.coalesce(p["about"]["halfInning"], F.lit("top")).alias("half"),
        F.coalesce(p["result"]["event"], F.lit("")).alias("event"),
        F.coalesce(p["result"]["description"], F.lit("")).alias("description"),
        F.coalesce(p["about"]["isScoringPlay"], F.lit(False)).alias("is_scoring")))
    return parse_live(raw, col, DETAIL).select(
        *keep, _team("home").alias("home"), _team("away").alias("away"), shown.alias("plays"),
        F.struct(innings.alias("innings"), totals("away").alias("away"), totals("home").alias("home")).alias("linescore"))
