"""Nested run summaries to the four evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.sources.documents import fan_out, is_object

HORIZON = ("struct<n_reached:int,pred_we:double,pred_we_std:double,actual_we:double,"
           "pred_run_diff:struct<mean:double,std:double>,actual_home_score:int,actual_away_score:int>")
GAME = ("struct<game_pk:bigint,game_date:string,entry:struct<inning:int,half:int,outs:int,bases:int,run_diff:int,"
        "phase:string,rd_bucket:string,we_baseline:double>,prediction:struct<p_home_win:double,p_home_win_se:double,"
        "mean_home_score:double,mean_away_score:double>,actual:struct<home_score:int,away_score:int,home_win:boolean>,"
        f"correct:boolean,timing_s:struct<mc:double>,horizons:map<string,{HORIZON}>>")
LEVEL = ("struct<n:bigint,entry_mae:double,pred_mae:double,improvement:double,pred_we_std:double,delta_std:double,"
         "brier:double,brier_skill:double,reliability:double,resolution:double,uncertainty:double>")
SUMMARY = (f"struct<games:array<{GAME}>,level_diagnostics:map<string,{LEVEL}>,"
           "convergence:map<string,map<string,map<string,double>>>>")
STDS = [25, 50, 100, 200, 500]


def parse_runs(raw: DataFrame, col: str = "results") -> DataFrame:
    """``__r``, the typed summary, parsed once and staged by the caller; NULL where the text is no JSON object."""
    return raw.withColumn("__r", F.when(is_object(F.col(col)), F.from_json(F.col(col), SUMMARY)))


def _games(parsed: DataFrame) -> DataFrame:
    return fan_out(parsed, ["eval_id"], F.col("__r.games"), "g")


def eval_games(parsed: DataFrame) -> DataFrame:
    g, e, p, a = F.col("g"), F.col("g.entry"), F.col("g.prediction"), F.col("g.actual")
    return _games(parsed).select(
        "eval_id", g["game_pk"].alias("game_pk"), g["game_date"].alias("game_date"), e["inning"].alias("entry_inning"),
        e["half"].alias("entry_half"), e["outs"].alias("entry_outs"), e["bases"].alias("entry_bases"),
        e["run_diff"].alias("entry_run_diff"), e["phase"].alias("entry_phase"), e["rd_bucket"].alias("entry_rd_bucket"),
        e["we_baseline"].alias("entry_we_baseline"), p["p_home_win"].alias("p_home_win"),
        p["p_home_win_se"].alias("p_home_win_se"), p["mean_home_score"].alias("mean_home_score"),
        p["mean_away_score"].alias("mean_away_score"), a["home_score"].alias("actual_home_score"),
        a["away_score"].alias("actual_away_score"), a["home_win"].alias("actual_home_win"),
        g["correct"].alias("correct"), g["timing_s"]["mc"].alias("mc_time_s"))


def eval_levels(parsed: DataFrame) -> DataFrame:
    return fan_out(parsed, ["eval_id"], F.col("__r.level_diagnostics"), "level", "v").select("eval_id", "level", "v.*")


def eval_convergence(parsed: DataFrame) -> DataFrame:
    """State keys without a ``|`` are dropped; a spread of 0 counts as not measured."""
    states = fan_out(parsed, ["eval_id"], F.col("__r.convergence"), "state", "levels").where(F.col("state").contains("|"))
    rows = fan_out(states, ["eval_id", "state"], F.col("levels"), "level", "curve")

    def value(name: str) -> Column:
        return F.try_element_at("curve", F.lit(name))

    return rows.select(
        "eval_id", F.substring_index("state", "|", 1).cast("int").alias("inning"),
        F.regexp_extract("state", r"^[^|]*\|(.*)$", 1).alias("rd_bucket"), "level",
        value("n_games").cast("long").alias("n_games"), value("stabilization_n").cast("int").alias("stabilization_n"),
        *[F.nullif(value(str(n)), F.lit(0.0)).alias(f"std_at_{n}") for n in STDS])


def eval_horizons(parsed: DataFrame) -> DataFrame:
    h = fan_out(_games(parsed), ["eval_id", "g.game_pk"], F.col("g.horizons"), "horizon", "h")
    return h.select(
        "eval_id", "game_pk", "horizon", "h.n_reached", "h.pred_we", "h.pred_we_std", "h.actual_we",
        F.col("h.pred_run_diff.mean").alias("pred_run_diff_mean"), F.col("h.pred_run_diff.std").alias("pred_run_diff_std"),
        "h.actual_home_score", "h.actual_away_score")


def decompose_eval(raw: DataFrame, col: str = "results") -> dict[str, DataFrame]:
    return _decomposed(parse_runs(raw, col))  # rows that are not JSON fan out to nothing


def _decomposed(parsed: DataFrame) -> dict[str, DataFrame]:
    return {"games": eval_games(parsed), "levels": eval_levels(parsed), "convergence": eval_convergence(parsed),
            "horizons": eval_horizons(parsed)}


def backfill_eval(raw: DataFrame, games: DataFrame, horizons: DataFrame, col: str = "results"
                  ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Child rows of runs not decomposed yet, and counts of what happened.

    A run without game rows gets all four tables; one with game rows but no horizons gets its
    horizons. Text that is not JSON is counted and skipped.
    """
    from scorebook.sources.tables import staged

    # Texts are parsed once; only flat child rows meet the keys of the runs that are there.
    parsed = staged(parse_runs(raw.where(F.col(col).isNotNull()), col).select("eval_id", "__r"), "eval-parsed")
    done, have = games.select("eval_id").distinct(), horizons.select("eval_id").distinct()
    parts = {name: rows.join(done, "eval_id", "left_anti") for name, rows in _decomposed(parsed).items() if name != "horizons"}
    found = eval_horizons(parsed)
    parts["horizons"] = found.join(done.join(have, "eval_id", "left_semi"), "eval_id", "left_anti")
    late = found.select("eval_id").distinct().join(done, "eval_id", "left_semi").join(have, "eval_id", "left_anti")
    marked = parsed.select("eval_id", F.col("__r").isNotNull().alias("__ok")).join(done.withColumn("__d", F.lit(True)), "eval_id", "left")
    known = F.coalesce("__d", F.lit(False))
    counts = marked.agg(
        F.count_if(~known & F.col("__ok")).alias("backfilled"), F.count_if(known).alias("skipped"),
        F.count_if(~known & ~F.col("__ok")).alias("errors"))
    return parts, counts.withColumn("horizons_backfilled", late.agg(F.count("eval_id")).scalar())
