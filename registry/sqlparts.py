"""SQL building blocks for the core tables, generated from the column lists."""

from __future__ import annotations

from registry.roles import with_ctes
from scorebook import constants as K
from scorebook.operators import counts as C


def inlist(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def tot(expr: str, cond: str) -> str:
    return f"sum({expr}) FILTER (WHERE {cond})"


R = "pa_result"
OUTCOME_SQL = {
    "hits": f"{R} IN {inlist(K.HITS)}", "singles": f"{R} = 'single'", "doubles": f"{R} = 'double'",
    "triples": f"{R} = 'triple'", "hr": f"{R} = 'home_run'", "bb": f"{R} IN {inlist(K.WALKS)}",
    "ibb": f"{R} = 'intent_walk'", "k": f"{R} IN {inlist(K.STRIKEOUTS)}", "hbp": f"{R} = 'hit_by_pitch'",
    "sf": f"{R} = 'sac_fly'", "sh": f"{R} = 'sac_bunt'",
}
HANDS = {"l": "L", "r": "R"}
DONE = f"{R} IS NOT NULL AND {R} <> 'truncated_pa'"
GROUP = ("CASE " + " ".join(f"WHEN pitch_type IN {inlist(v)} THEN '{g}'" for g, v in K.PITCH_GROUPS.items()) + " END")


def _grouped(cols: list[str], src: str, where: str, key: str) -> str:
    return f"SELECT {key}, game_date, season, " + ", ".join(cols) + f" FROM {src} WHERE {where} GROUP BY {key}, game_date, season"


def batter_counts(src: str = "pitches") -> str:
    cols = []
    for h, code in HANDS.items():
        s = f"pitch_hand = '{code}'"
        bip = f"{s} AND bb_type IS NOT NULL"
        m = {"pa": cnt(s), "abs": cnt(f"{s} AND {R} NOT IN {inlist(K.NOT_AT_BAT)}"),
             **{n: cnt(f"{s} AND {c}") for n, c in OUTCOME_SQL.items()},
             "woba_value": tot("woba_value", s), "woba_denom": tot("woba_denom", s), "ev_sum": tot("launch_speed", bip),
             "bip": cnt(bip), "hard_hit": cnt(f"{bip} AND launch_speed >= 95"),
             "barrel": cnt(f"{bip} AND launch_speed >= 98 AND launch_angle BETWEEN greatest(26 - (launch_speed - 98), 8) "
                           "AND least(30 + (launch_speed - 98), 50)")}
        cols += [f"{m[n]} AS {n}_vs_{h}" for n in C.BATTER_COLS]
    return _grouped(cols, src, DONE, "batter_id")


def pitcher_counts(src: str = "pitches") -> str:
    cols = []
    for h, code in HANDS.items():
        s = f"bat_side = '{code}'"
        m = {"bf": cnt(s),
             "outs": f"{cnt(f'{s} AND {R} IN {inlist(K.ONE_OUT)}')} + 2 * {cnt(f'{s} AND {R} IN {inlist(K.TWO_OUTS)}')}",
             **{n: cnt(f"{s} AND {c}") for n, c in OUTCOME_SQL.items()},
             "woba_value": tot("woba_value", s), "woba_denom": tot("woba_denom", s)}
        cols += [f"{m[n]} AS {n}_vs_{h}" for n in C.PITCHER_COLS]
    pa = _grouped(cols, src, DONE, "pitcher_id")
    return (f"SELECT a.*, coalesce(b.pitches, 0) AS pitches, 1 AS games FROM ({pa}) a LEFT JOIN (SELECT pitcher_id, game_date, "
            f"count(*) AS pitches FROM {src} GROUP BY pitcher_id, game_date) b USING (pitcher_id, game_date)")


def batter_arsenal_counts(src: str = "pitches") -> str:
    cols = []
    for g in K.PITCH_GROUPS:
        for h, code in HANDS.items():
            s = f"pitch_hand = '{code}' AND {GROUP} = '{g}'"
            m = {"woba_value": tot("woba_value", s), "woba_denom": tot("woba_denom", s), "bip": cnt(f"{s} AND bb_type IS NOT NULL"),
                 **{n: cnt(f"{s} AND bb_type IN {inlist(v)}") for n, v in K.BATTED_BALLS.items()}}
            cols += [f"{m[n]} AS {g}_{n}_vs_{h}" for n in C.ARSENAL_COLS]
    return _grouped(cols, src, f"{DONE} AND pitch_type IS NOT NULL", "batter_id")


def discipline_counts(src: str = "pitches") -> str:
    swing, zone = f"description IN {inlist(K.SWINGS)}", f"zone IN {inlist(K.OUTSIDE_ZONES)}"
    tests = {"swings": swing, "whiffs": f"description IN {inlist(K.WHIFFS)}", "ooz": zone, "chases": f"{swing} AND {zone}"}
    cols = [f"{cnt(f'pitch_hand = {chr(39)}{code}{chr(39)} AND {GROUP} = {chr(39)}{g}{chr(39)} AND {tests[n]}')} AS {g}_{n}_vs_{h}"
            for g in K.PITCH_GROUPS for n in C.DISCIPLINE_COLS for h, code in HANDS.items()]
    return _grouped(cols, src, f"pitch_type IS NOT NULL AND description NOT IN {inlist(K.BUNTS)}", "batter_id")


def pitcher_arsenal_counts(src: str = "pitches") -> str:
    side = {h: f"bat_side = '{code}'" for h, code in HANDS.items()}
    cols = [f"{cnt(side[h])} AS pitches_vs_{h}" for h in HANDS]
    for t in K.PITCH_TYPES:
        p = f"pitch_type = '{t}'"
        cols += [f"{cnt(f'{side[h]} AND {p}')} AS {t.lower()}_n_vs_{h}" for h in HANDS]
        for n, c in (("velo", "release_speed"), ("spin", "release_spin_rate")):
            cols += [f"{tot(c, p)} AS {t.lower()}_{n}_sum", f"count({c}) FILTER (WHERE {p}) AS {t.lower()}_{n}_n"]
    for n, c in (("arm_angle", "arm_angle"), ("extension", "release_extension")):
        cols += [f"sum({c}) AS {n}_sum", f"count({c}) AS {n}_n"]
    return _grouped(cols, src, f"pitch_type IN {inlist(K.PITCH_TYPES)}", "pitcher_id")


FLOATS = ("woba_value", "woba_denom", "ev_sum", "velo_sum", "spin_sum", "arm_angle_sum", "extension_sum")


def is_float(name: str) -> bool:
    return any(f in name for f in FLOATS)


def cumulate(src: str, key: str, names: list[str], extra: str = "") -> str:
    cols = []
    for s, part in (("s", f"{key}, season"), ("c", key)):
        over = f"OVER (PARTITION BY {part} ORDER BY game_date ROWS UNBOUNDED PRECEDING)"
        cols += [f"CAST(sum({n}) {over} AS {'DOUBLE' if is_float(n) else 'BIGINT'}) AS {s}_{n}" for n in names]
    return f"SELECT {key}, game_date, season, {', '.join(cols)}{extra} FROM {src}"


def _r(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif({den}, 0)"


def _get(s: str, h: str | None):
    return (lambda n: f"{s}_{n}_vs_{h}") if h else (lambda n: f"({s}_{n}_vs_l + {s}_{n}_vs_r)")


SPAN = {"s": "season", "c": "career"}


def batting_rates() -> dict[str, str]:
    out = {}
    for s in "sc":
        for n in ("pa", "abs", "hits", "hr", "bb", "k", "hbp", "sf"):
            out[f"{s}_{n}"] = _get(s, None)(n)
        for h in ("l", "r", None):
            g, t = _get(s, h), f"_vs_{h}" if h else ""
            obp = _r(f"({g('hits')} + {g('bb')} + {g('hbp')})", f"{g('abs')} + {g('bb')} + {g('hbp')} + {g('sf')}")
            slg = _r(f"({g('singles')} + 2 * {g('doubles')} + 3 * {g('triples')} + 4 * {g('hr')})", g("abs"))
            m = {"ba": _r(g("hits"), g("abs")), "obp": obp, "slg": slg, "ops": f"{obp} + {slg}",
                 "woba": _r(g("woba_value"), g("woba_denom")), "k_pct": _r(g("k"), g("pa")), "bb_pct": _r(g("bb"), g("pa")),
                 "iso": _r(f"({g('doubles')} + 2 * {g('triples')} + 3 * {g('hr')})", g("abs")),
                 "babip": _r(f"({g('hits')} - {g('hr')})", f"{g('abs')} - {g('k')} - {g('hr')} + {g('sf')}")}
            if h:
                m |= {"avg_ev": _r(g("ev_sum"), g("bip")), "hard_hit_pct": _r(g("hard_hit"), g("bip")),
                      "barrel_pct": _r(g("barrel"), g("bip"))}
            out |= {f"{SPAN[s]}_{n}{t}": e for n, e in m.items()}
    return out


def pitching_rates() -> dict[str, str]:
    out = {}
    for s in "sc":
        for n in ("bf", "outs", "hits", "hr", "bb", "k", "hbp", "sf", "sh"):
            out[f"{s}_{n}"] = _get(s, None)(n)
        for h in ("l", "r", None):
            g, t = _get(s, h), f"_vs_{h}" if h else ""
            ip = f"(CAST({g('outs')} AS DOUBLE) / 3)"
            m = {"ip": ip, "whip": _r(f"({g('bb')} + {g('hits')})", ip),
                 **{k: f"9 * {_r(g(n), ip)}" for k, n in (("k9", "k"), ("bb9", "bb"), ("hr9", "hr"), ("h9", "hits"))},
                 "k_pct": _r(g("k"), g("bf")), "bb_pct": _r(g("bb"), g("bf")),
                 "fip": _r(f"(13 * {g('hr')} + 3 * ({g('bb')} + {g('hbp')}) - 2 * {g('k')})", ip) + " + CAST(3.20 AS DOUBLE)",
                 "babip": _r(f"({g('hits')} - {g('hr')})", f"{g('bf')} - {g('k')} - {g('hr')} - {g('bb')} - {g('hbp')} + {g('sf')}"),
                 "woba": _r(g("woba_value"), g("woba_denom"))}
            out |= {f"{SPAN[s]}_{n}{t}": e for n, e in m.items()}
        b = _get(s, None)
        out |= {f"{SPAN[s]}_avg_bf_per_app": _r(b("bf"), f"{s}_games"),
                f"{SPAN[s]}_avg_pitches_per_app": _r(f"{s}_pitches", f"{s}_games"),
                f"{SPAN[s]}_pitches_per_out": _r(f"{s}_pitches", b("outs"))}
    return out


def arsenal_rates() -> dict[str, str]:
    out = {}
    for s in "sc":
        for h in ("l", "r"):
            for p in K.PITCH_GROUPS:
                out[f"{SPAN[s]}_woba_vs_{p}_vs_{h}"] = _r(f"{s}_{p}_woba_value_vs_{h}", f"{s}_{p}_woba_denom_vs_{h}")
                for k in K.BATTED_BALLS:
                    out[f"{SPAN[s]}_{k}_pct_vs_{p}_vs_{h}"] = _r(f"{s}_{p}_{k}_vs_{h}", f"{s}_{p}_bip_vs_{h}")
    return out


def discipline_rates() -> dict[str, str]:
    out = {}
    for s in "sc":
        for h in ("l", "r"):
            for p in K.PITCH_GROUPS:
                out[f"{SPAN[s]}_chase_rate_vs_{p}_vs_{h}"] = _r(f"{s}_{p}_chases_vs_{h}", f"{s}_{p}_ooz_vs_{h}")
                out[f"{SPAN[s]}_whiff_rate_vs_{p}_vs_{h}"] = _r(f"{s}_{p}_whiffs_vs_{h}", f"{s}_{p}_swings_vs_{h}")
    return out


def pitcher_arsenal_rates() -> dict[str, str]:
    out = {}
    for s in "sc":
        for t in (t.lower() for t in K.PITCH_TYPES):
            out |= {f"{SPAN[s]}_{t}_pct_vs_{h}": _r(f"{s}_{t}_n_vs_{h}", f"{s}_pitches_vs_{h}") for h in ("l", "r")}
            out |= {f"{SPAN[s]}_{t}_{k}": _r(f"{s}_{t}_{k}_sum", f"{s}_{t}_{k}_n") for k in ("velo", "spin")}
        out |= {f"{SPAN[s]}_{k}": _r(f"{s}_{k}_sum", f"{s}_{k}_n") for k in ("arm_angle", "extension")}
    return out


REST = ("coalesce(date_diff('day', lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date), game_date), -1)")


def _with(src: str, rates: dict[str, str], extra: str = "") -> str:
    return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in rates.items())}{extra} FROM {src}"


# Name -> expression of every core table, in dependency order.
CORE = {
    "bc": batter_counts(), "bs": cumulate("bc", "batter_id", C.batter_names()), "batters": _with("bs", batting_rates()),
    "pc": pitcher_counts(), "ps": cumulate("pc", "pitcher_id", C.pitcher_names()),
    "pitchers": _with("ps", pitching_rates(), f", CAST({REST} AS INTEGER) AS pitcher_rest_days"),
    "ac": batter_arsenal_counts(), "asum": cumulate("ac", "batter_id", C.batter_arsenal_names()),
    "arsenal": _with("asum", arsenal_rates()),
    "dc": discipline_counts(), "dsum": cumulate("dc", "batter_id", C.discipline_names()),
    "discipline": _with("dsum", discipline_rates()),
    "pac": pitcher_arsenal_counts(), "psum": cumulate("pac", "pitcher_id", C.pitcher_arsenal_names()),
    "parsenal": _with("psum", pitcher_arsenal_rates()),
    "bprofile": "SELECT b.*, a.* EXCLUDE (batter_id, game_date, season), d.* EXCLUDE (batter_id, game_date, season) "
                "FROM batters b LEFT JOIN arsenal a ON b.batter_id = a.batter_id AND b.game_date = a.game_date "
                "LEFT JOIN discipline d ON b.batter_id = d.batter_id AND b.game_date = d.game_date",
    "pprofile": "SELECT p.*, a.* EXCLUDE (pitcher_id, game_date, season) FROM pitchers p LEFT JOIN parsenal a "
                "ON p.pitcher_id = a.pitcher_id AND p.game_date = a.game_date",
}

_IN = {"walks": K.WALKS, "hits": K.HITS, "k": K.STRIKEOUTS}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {R} IN {inlist(v)}) AS {n}" for n, v in _IN.items())
_SAME = "{0}.game_pk = {1}.game_pk AND {0}.pitcher_id IS NOT DISTINCT FROM {1}.pitcher_id"
FLAGS = ", ".join(f"(on_{b} IS NOT NULL)::INT AS runner_{b}" for b in ("1b", "2b", "3b"))
# Values before a pitch, each by its definition: what earlier plate appearances of the outing add up to, plus
# what earlier pitches of the same one do.
STATE = {
    "pas": f"SELECT game_pk, at_bat_number, pitcher_id, batter_id, count(*) AS pitches, {_COUNTS}, sum(coalesce(post_bat_score - bat_score, 0)) AS runs, max({R}) AS result "
           "FROM pitches GROUP BY ALL",
    "outcomes": "SELECT game_pk, at_bat_number, max(result) AS target FROM pas GROUP BY ALL",
    "modelled": f"SELECT * FROM outcomes WHERE target IS NOT NULL AND target NOT IN {inlist(K.EXCLUDED_OUTCOMES)}",
    "past": "SELECT a.game_pk, a.at_bat_number, a.pitcher_id, a.batter_id, count(DISTINCT b.at_bat_number) AS faced, "
            "count(DISTINCT b.at_bat_number) FILTER (WHERE b.batter_id IS NOT DISTINCT FROM a.batter_id) AS met, "
            + ", ".join(f"coalesce(sum(b.{c}), 0) AS {c}" for c in ("pitches", *_IN)) + ", sum(b.runs) AS runs "
            f"FROM pas a LEFT JOIN pas b ON {_SAME.format('a', 'b')} AND b.at_bat_number < a.at_bat_number GROUP BY ALL",
    "own": f"SELECT a.game_pk, a.at_bat_number, a.pitch_number, a.pitcher_id, count(b.pitch_number) AS pitches, "
           + ", ".join(f"count(*) FILTER (WHERE b.{R} IN {inlist(v)}) AS {n}" for n, v in _IN.items())
           + ", sum(CASE WHEN b.pitch_number IS NOT NULL THEN coalesce(b.post_bat_score - b.bat_score, 0) END) AS runs "
           f"FROM pitches a LEFT JOIN pitches b ON {_SAME.format('a', 'b')} AND b.at_bat_number = a.at_bat_number AND b.pitch_number < a.pitch_number GROUP BY ALL",
    "turns": "SELECT DISTINCT game_pk, pitcher_id, at_bat_number, target FROM pas JOIN modelled USING (game_pk, at_bat_number)",
    "form": f"SELECT a.game_pk, a.pitcher_id, a.at_bat_number, list_avg(arg_max((b.target IN {inlist(K.WALKS + K.HITS)})::INT, b.at_bat_number, 3)) AS pitcher_recent_whip "
            f"FROM turns a LEFT JOIN turns b ON {_SAME.format('a', 'b')} AND b.at_bat_number < a.at_bat_number GROUP BY ALL",
    "state": "SELECT p.game_pk, p.at_bat_number, p.pitch_number, p.game_date, p.batter_id, p.pitcher_id, p.bat_side, p.pitch_hand, p.inning, "
             f"(p.inning_topbot = 'Bot')::INT AS is_bottom, p.outs_when_up AS outs, {FLAGS}, p.balls, p.strikes, p.bat_score_diff AS run_diff, "
             "(p.inning_topbot = 'Bot')::INT AS is_home, p.n_thruorder_pitcher AS times_through_order, p.n_priorpa_thisgame_player_at_bat AS batter_prior_pa, "
             "(t.pitches + o.pitches + 1)::BIGINT AS pitcher_pitch_count, t.faced + 1 AS pitcher_bf_game, t.met AS batter_ab_vs_pitcher, "
             + ", ".join(f"(t.{c} + o.{c})::BIGINT AS pitcher_outing_{c}" for c in _IN)
             + ", coalesce(t.runs + o.runs, t.runs, o.runs)::BIGINT AS pitcher_outing_runs, "
             "(t.walks + o.walks + t.hits + o.hits)::DOUBLE / nullif(t.faced, 0) AS pitcher_outing_whip, f.pitcher_recent_whip, m.target "
             "FROM pitches p JOIN modelled m USING (game_pk, at_bat_number) "
             f"JOIN past t ON {_SAME.format('t', 'p')} AND t.at_bat_number = p.at_bat_number AND t.batter_id IS NOT DISTINCT FROM p.batter_id "
             f"JOIN own o ON {_SAME.format('o', 'p')} AND o.at_bat_number = p.at_bat_number AND o.pitch_number = p.pitch_number "
             f"JOIN form f ON {_SAME.format('f', 'p')} AND f.at_bat_number = p.at_bat_number",
}
DEPENDS = {"bs": ["bc"], "batters": ["bc", "bs"], "ps": ["pc"], "pitchers": ["pc", "ps"], "asum": ["ac"], "arsenal": ["ac", "asum"],
           "dsum": ["dc"], "discipline": ["dc", "dsum"], "psum": ["pac"], "parsenal": ["pac", "psum"],
           "bprofile": ["bc", "bs", "batters", "ac", "asum", "arsenal", "dc", "dsum", "discipline"],
           "pprofile": ["pc", "ps", "pitchers", "pac", "psum", "parsenal"], "state": ["pas", "outcomes", "modelled", "past", "own", "turns", "form"]}


def core(names: list[str], body: str, roles: list[str] = (), extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the core tables it needs, over the derived pitches."""
    table, order = {**CORE, **STATE}, []
    for n in names:
        for d in [*DEPENDS.get(n, []), n]:
            if d not in order:
                order.append(d)
    return with_ctes(["pitches", *roles], body, {**{n: table[n] for n in order}, **(extra or {})})

