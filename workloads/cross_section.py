"""Cross-sections of a month: ranks, scores, enhancements, market context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import rolling as r
from tidepanel.functions.factor import by_instrument, with_factors
from tidepanel.operators import cross_section as cs
from tidepanel.operators import stats
from tidepanel.plans import tables
from tidepanel.plans.catalog import CrossSpec, FactorSpec, run_factors

from .common import BARS, DIM, ORDERED, PK, avg, kept, query, std

QUERIES = {}
W = "OVER (PARTITION BY trade_date)"


def _steady(x):
    """Rounded to nine digits: means of the same numbers in another order are then equal, and so are their ranks."""
    return x.map(f"steady({x.label})", lambda c: F.floor(c * 1e9 + 0.5001).cast("double") / 1e9)


def featured(spark, folder):
    """Bars with a few factors, stored once: every query here reads it several times."""
    return kept(with_factors(by_instrument(tables.bars(spark, folder)), {
        "ret_1": r.pct_change("close"), "ret_5": r.pct_change("close", 5), "vol_20": r.rolling_std(r.pct_change("close"), 20),
        "turn_5": _steady(r.sma("turnover", 5))}))


FEAT = f"""
s0 AS (SELECT *, close / lag(close) OVER {ORDERED} - 1 AS ret_1, close / lag(close, 5) OVER {ORDERED} - 1 AS ret_5 FROM bars),
feat AS (SELECT *, {std('ret_1', 20)} AS vol_20, floor(({avg('turnover', 5)}) * 1e9 + 0.5001) / 1e9 AS turn_5 FROM s0)"""


def z(c, by="trade_date", eps="1e-12"):
    w = f"OVER (PARTITION BY {by})"
    return f"({c} - avg({c}) {w}) / (nullif(stddev_samp({c}) {w}, 0) + {eps})"


def rk(c, by="trade_date"):
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END")


def med(c, w=W):
    return f"quantile_cont({c}, 0.5) {w}"


QUERIES["cs_rank"] = query(
    lambda spark, folder: cs.cs_rank(featured(spark, folder), {"rank_ret": "ret_5", "rank_vol": "vol_20", "rank_turn": "turn_5", "rank_volume": "volume"}),
    f"{FEAT} => SELECT instrument_id, trade_date, {rk('ret_5')} AS rank_ret, {rk('vol_20')} AS rank_vol, {rk('turn_5')} AS rank_turn, {rk('volume')} AS rank_volume FROM feat",
    PK, ["rank_ret", "rank_vol", "rank_turn", "rank_volume"])

QUERIES["cs_zscore"] = query(
    lambda spark, folder: cs.cs_zscore(featured(spark, folder), {"z_ret": "ret_5", "z_vol": "vol_20", "z_turn": "turn_5"}),
    f"{FEAT} => SELECT instrument_id, trade_date, {z('ret_5')} AS z_ret, {z('vol_20')} AS z_vol, {z('turn_5')} AS z_turn FROM feat",
    PK, ["z_ret", "z_vol", "z_turn"])


def _clip(x, c): return f"least(greatest({x}, -{c}), {c})"


_NORM = ("ret_1", "ret_5", "vol_20", "turn_5")
QUERIES["cs_normalize_zscore_clipped"] = query(
    lambda spark, folder: cs.normalize(featured(spark, folder), [*_NORM, "market_x"], "zscore", clip_at=2.0),
    f"{FEAT} => SELECT instrument_id, trade_date, " + ", ".join(
        f"coalesce(CASE WHEN {z(c)} IS NOT NULL THEN {_clip(z(c), 2.0)} END, 0) AS {c}" for c in _NORM) + " FROM feat", PK, _NORM)
QUERIES["cs_normalize_rank"] = query(
    lambda spark, folder: cs.normalize(featured(spark, folder), _NORM, "rank"),
    f"{FEAT} => SELECT instrument_id, trade_date, " + ", ".join(f"coalesce(2 * ({rk(c)}) - 1, 0) AS {c}" for c in _NORM) + " FROM feat",
    PK, _NORM)

# ---- static, price-volume, sentiment ----------------------------------------------------------------------------

_TOP = 6
_BUCKETS = f"""
counts AS (SELECT industry, count(*) AS n FROM dim WHERE trim(industry) <> '' GROUP BY 1),
top AS (SELECT industry, row_number() OVER (ORDER BY n DESC, industry) - 1 AS bucket FROM counts ORDER BY n DESC, industry LIMIT {_TOP}),
dimb AS (SELECT dim.*, coalesce(bucket, {_TOP}) AS bucket, CASE WHEN bucket IS NULL THEN '__OTHER__' ELSE industry END AS industry_bucket,
                ln(1 + greatest(cap, 0)) AS lc FROM dim LEFT JOIN top USING (industry))"""
_HOT = [f"st_ind_oh_{i:02d}" for i in range(_TOP + 1)]
_STATIC = f"""{FEAT}, {_BUCKETS},
stat0 AS (SELECT feat.*, coalesce(industry_bucket, '__OTHER__') AS industry_bucket, coalesce(bucket, {_TOP}) AS bucket, lc FROM feat LEFT JOIN dimb USING (instrument_id)),
stat AS (SELECT * EXCLUDE (lc), coalesce(lc, (SELECT quantile_cont(lc, 0.5) FROM stat0)) AS st_log_mcap FROM stat0)"""
_STATIC_SELECT = f"st_log_mcap, {rk('st_log_mcap')} AS st_log_mcap_cs_rank, " + ", ".join(
    f"CASE WHEN bucket = {i} THEN 1 ELSE 0 END AS {c}" for i, c in enumerate(_HOT))
QUERIES["static_features"] = query(
    lambda spark, folder: cs.static_features(featured(spark, folder), tables.dimension(spark, folder), _TOP),
    f"{_STATIC} => SELECT instrument_id, trade_date, industry_bucket, {_STATIC_SELECT} FROM stat",
    (*PK, "industry_bucket"), ["st_log_mcap", "st_log_mcap_cs_rank", *_HOT], ctes=(BARS, DIM))

QUERIES["industry_top_k_with_other"] = query(
    lambda spark, folder: cs.with_industry_bucket(tables.dimension(spark, folder), _TOP).groupBy("industry_bucket").agg(
        F.count(F.lit(1)).alias("members")),
    f"{_BUCKETS} => SELECT industry_bucket, count(*) AS members FROM dimb GROUP BY 1", ("industry_bucket",), ["members"], ctes=(DIM,))


def _part(agg, w):
    return f"{agg} OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


_PV_CTES = f"""
pv0 AS (SELECT *, lag(close) OVER {ORDERED} AS pc, sqrt(pow(ln(high + 1e-12) - ln(low + 1e-12), 2) / (4 * ln(2) + 1e-12)) AS pk,
               (close - open) / (open + 1e-12) AS ir, ln(1 + greatest(volume, 0)) AS lv FROM bars)"""
_PV = {
    "pv_intraday_return": "ir", "pv_intraday_range_pct": "(high - low) / (open + 1e-12)", "pv_gap_return": "(open - pc) / (pc + 1e-12)",
    "pv_close_location": "(close - low) / (high - low + 1e-12)",
    "pv_true_range_pct": "greatest(abs(high - low), abs(high - pc), abs(low - pc)) / (pc + 1e-12)",
    "pv_parkinson_daily": "pk", "pv_parkinson_5": _part("avg(pk)", 5), "pv_parkinson_20": _part("avg(pk)", 20),
    "pv_intraday_return_std5": _part("stddev_samp(ir)", 5), "pv_amihud_illiq": "abs(close / pc - 1) / (abs(amount) + 1e-12)",
    "pv_volume_z20": f"(lv - {_part('avg(lv)', 20)}) / ({_part('stddev_samp(lv)', 20)} + 1e-12)"}
QUERIES["price_volume_features"] = query(
    lambda spark, folder: cs.price_volume_features(by_instrument(tables.bars(spark, folder))),
    f"{_PV_CTES} => SELECT instrument_id, trade_date, " + ", ".join(f"{t} AS {c}" for c, t in _PV.items()) + " FROM pv0",
    PK, {c: 9 if c == "pv_amihud_illiq" else 5 for c in _PV})

_MARKET = ["market_median_return", "market_total_turnover_log", "market_limit_up_count_log", "market_limit_up_ratio"]


def _market_sql(scaled: str) -> str:
    rising = f"sum(CASE WHEN {scaled} >= 0.095 THEN 1.0 ELSE 0.0 END)"
    return (f"SELECT trade_date, quantile_cont({scaled}, 0.5) AS market_median_return, ln(1 + sum(greatest(amount, 0))) AS market_total_turnover_log, "
            f"ln(1 + {rising}) AS market_limit_up_count_log, {rising} / (count(*) + 1e-12) AS market_limit_up_ratio FROM feat GROUP BY 1")


_SCALED = "(ret_1 / CASE WHEN (SELECT quantile_cont(abs(ret_1), 0.5) FROM feat) > 1 THEN 100.0 ELSE 1.0 END)"
QUERIES["market_sentiment"] = query(
    lambda spark, folder: cs.market_sentiment(featured(spark, folder), "ret_1", "amount").select("trade_date", *_MARKET).distinct(),
    f"{FEAT} => {_market_sql(_SCALED)}", ("trade_date",), _MARKET)
_PERCENT = "(100 * ret_1 / CASE WHEN (SELECT quantile_cont(abs(100 * ret_1), 0.5) FROM feat) > 1 THEN 100.0 ELSE 1.0 END)"
QUERIES["market_sentiment_percent_input"] = query(
    lambda spark, folder: cs.market_sentiment(featured(spark, folder).withColumn("ret_1", F.col("ret_1") * 100), "ret_1", "amount")
    .select("trade_date", *_MARKET).distinct(),
    f"{FEAT} => {_market_sql(_PERCENT)}", ("trade_date",), _MARKET)

QUERIES["industry_relative_zscore"] = query(
    lambda spark, folder: cs.industry_zscore(
        featured(spark, folder).join(cs.with_industry_bucket(tables.dimension(spark, folder), _TOP).select("instrument_id", "industry_bucket"), "instrument_id", "left"),
        {"ind_z_ret": "ret_5", "ind_z_turn": "turn_5"}),
    f"{_STATIC} => SELECT instrument_id, trade_date, coalesce({z('ret_5', 'trade_date, industry_bucket')}, 0) AS ind_z_ret, "
    f"coalesce({z('turn_5', 'trade_date, industry_bucket')}, 0) AS ind_z_turn FROM stat", PK, ["ind_z_ret", "ind_z_turn"], ctes=(BARS, DIM))

_RANKED = ("ret_1", "ret_5", "vol_20", "turnover", "amount", "pv_intraday_range_pct")
_AUG = [*["st_log_mcap", "st_log_mcap_cs_rank"], *_HOT, *_PV, *_MARKET, *[f"cs_rank_{c}" for c in _RANKED], "ind_z_ret_1", "ind_z_vol_20"]


def _augmented(spark, folder):
    made, added = cs.augment(featured(spark, folder), kept(tables.dimension(spark, folder)), _RANKED, ("ret_1", "vol_20"), "ret_1", "amount", _TOP)
    assert set(_AUG) == set(added), set(_AUG) ^ set(added)
    return made


QUERIES["augmented_features"] = query(
    _augmented,
    f"""{_STATIC}, mk AS ({_market_sql(_SCALED)}),
pv0 AS (SELECT *, lag(close) OVER {ORDERED} AS pc, sqrt(pow(ln(high + 1e-12) - ln(low + 1e-12), 2) / (4 * ln(2) + 1e-12)) AS pk,
               (close - open) / (open + 1e-12) AS ir, ln(1 + greatest(volume, 0)) AS lv, {_STATIC_SELECT.replace('st_log_mcap, ', '', 1)} FROM stat),
pv1 AS (SELECT *, {', '.join(f'{t} AS {c}' for c, t in _PV.items())} FROM pv0) =>
SELECT instrument_id, trade_date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('st_log_mcap', 'st_log_mcap_cs_rank', *_HOT, *_PV, *_MARKET))},
       {', '.join(f'coalesce({rk(c)}, 0) AS cs_rank_{c}' for c in _RANKED)},
       coalesce({z('ret_1', 'trade_date, industry_bucket')}, 0) AS ind_z_ret_1, coalesce({z('vol_20', 'trade_date, industry_bucket')}, 0) AS ind_z_vol_20
FROM pv1 LEFT JOIN mk USING (trade_date)""", PK, {c: 9 if c == "pv_amihud_illiq" else 5 for c in _AUG}, ctes=(BARS, DIM))


def _mad_ctes(c, n, scale, source="feat", floor_group=1):
    return f"""
m0 AS (SELECT *, {med(c)} AS md, count(*) {W} AS gs FROM {source}),
m1 AS (SELECT *, {med(f'abs({c} - md)')} AS mad FROM m0),
m2 AS (SELECT *, CASE WHEN gs >= {floor_group} AND {c} IS NOT NULL THEN
  greatest(least({c}, md + {n} * greatest(mad * 1.4826, {scale})), md - {n} * greatest(mad * 1.4826, {scale})) ELSE {c} END AS clipped FROM m1)"""


QUERIES["winsorize_mad"] = query(
    lambda spark, folder: cs.winsorize_mad(featured(spark, folder), ["ret_5"], n=3.0, min_group=70),
    f"{FEAT}, {_mad_ctes('ret_5', 3.0, '1e-6', 'feat', 70)} => SELECT instrument_id, trade_date, clipped AS ret_5 FROM m2", PK, ["ret_5"])

QUERIES["null_policy"] = query(
    lambda spark, folder: cs.null_policy(
        featured(spark, folder).withColumn("vol_20", F.when(F.col("volume") > 300, F.lit(float("inf"))).when(F.col("volume") < 50, F.lit(float("nan"))).otherwise(F.col("vol_20"))),
        ["ret_5", "vol_20"], 0.0),
    f"{FEAT} => SELECT instrument_id, trade_date, coalesce(ret_5, 0) AS ret_5, CASE WHEN volume > 300 OR volume < 50 THEN 0 ELSE coalesce(vol_20, 0) END AS vol_20 FROM feat",
    PK, ["ret_5", "vol_20"])

_GATED = ("ret_1", "ret_5", "vol_20", "turn_5")
_GATE_ONE = """SELECT '{c}' AS factor, sum(n) AS n, sum(m) / sum(n) AS null_ratio, 0.0 AS inf_ratio, avg(1.0 - m / n) AS coverage
FROM (SELECT trade_date, count(*)::DOUBLE AS n, sum(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM feat GROUP BY 1)"""
QUERIES["factor_gates"] = query(
    lambda spark, folder: cs.factor_gates(featured(spark, folder), _GATED).withColumn("ok", F.col("passed").cast("int")),
    f"{FEAT}, g AS ({' UNION ALL '.join(_GATE_ONE.format(c=c) for c in _GATED)}) => "
    "SELECT *, CASE WHEN null_ratio <= 0.2 AND coverage >= 0.8 THEN 1 ELSE 0 END AS ok FROM g",
    ("factor",), ["n", "null_ratio", "inf_ratio", "coverage", "ok"])

QUERIES["market_context"] = query(
    lambda spark, folder: cs.market_context(featured(spark, folder), ["ret_5", "vol_20"]),
    f"{FEAT} => SELECT trade_date, avg(ret_5) AS ret_5_mean, stddev_pop(ret_5) AS ret_5_std, avg(vol_20) AS vol_20_mean, stddev_pop(vol_20) AS vol_20_std FROM feat GROUP BY 1",
    ("trade_date",), ["ret_5_mean", "ret_5_std", "vol_20_mean", "vol_20_std"])
QUERIES["industry_context"] = query(
    lambda spark, folder: cs.industry_context(featured(spark, folder).join(tables.dimension(spark, folder), "instrument_id"), ["ret_5", "turn_5"], min_members=3),
    f"{FEAT} => SELECT trade_date, industry, count(*) AS members, avg(ret_5) AS ret_5_mean, avg(turn_5) AS turn_5_mean FROM feat JOIN dim USING (instrument_id) "
    "WHERE industry IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    ("trade_date", "industry"), ["members", "ret_5_mean", "turn_5_mean"], ctes=(BARS, DIM))

QUERIES["global_scaling"] = query(
    lambda spark, folder: (lambda p: stats.apply_scaler(p, stats.fit_scaler(p.where("trade_date < '1999-01-01'"), ["volume", "turnover"]), ["volume", "turnover"]))(featured(spark, folder)),
    """fit AS (SELECT avg(volume) AS vm, stddev_pop(volume) AS vs, avg(turnover) AS tm, stddev_pop(turnover) AS ts FROM bars WHERE trade_date < DATE '1999-01-01') =>
    SELECT instrument_id, trade_date, (volume - vm) / vs AS volume, (turnover - tm) / ts AS turnover FROM bars CROSS JOIN fit""",
    PK, ["volume", "turnover"])

# ---- declared factors in two stages ------------------------------------------------------------------------------

SPECS = (
    FactorSpec("f_ret_1", "pct_change", {"x": "close", "n": 1}), FactorSpec("f_vol", "rolling_std", {"x": "f_ret_1", "w": 10}),
    FactorSpec("f_ema", "ema", {"x": "f_turn", "span": 5}), FactorSpec("f_turn", "sma", {"x": "turnover", "w": 3}),
    FactorSpec("f_gap", "sql", {"text": "open - close", "reads": ("open", "close")}),
    CrossSpec("f_mix", lambda zs, ks: 0.5 * zs("f_ret_1") + 0.5 * ks("f_vol"), zscores=("f_ret_1",), ranks=("f_vol",)),
    CrossSpec("f_top", lambda zs, ks: zs("f_mix") + F.col("f_turn"), zscores=("f_mix",), columns=("f_turn",)))
QUERIES["factor_layers_ts_then_cs"] = query(
    lambda spark, folder: run_factors(kept(tables.bars(spark, folder)), SPECS).frame,
    f"""a0 AS (SELECT *, close / lag(close) OVER {ORDERED} - 1 AS r1, {avg('turnover', 3)} AS t3 FROM bars),
a1 AS (SELECT *, {std('r1', 10)} AS v1, list(t3) FILTER (WHERE t3 IS NOT NULL) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist FROM a0),
a2 AS (SELECT instrument_id, trade_date, open - close AS f_gap, coalesce(r1, 0) AS f_ret_1, coalesce(v1, 0) AS f_vol, coalesce(t3, 0) AS f_turn,
              coalesce(CASE WHEN len(hist) > 0 THEN list_reduce(hist, lambda a, v: a + (v - a) / 3.0) END, 0) AS f_ema FROM a1),
a3 AS (SELECT *, 0.5 * {z('f_ret_1')} + 0.5 * {rk('f_vol')} AS f_mix FROM a2) =>
SELECT *, {z('f_mix')} + f_turn AS f_top FROM a3""", PK, {"f_ret_1": 5, "f_vol": 5, "f_ema": 6, "f_turn": 6, "f_gap": 3, "f_mix": 5, "f_top": 5})
