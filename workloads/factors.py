"""Time-series factors over monthly bars."""

from __future__ import annotations

from tidepanel.functions import rolling as r
from tidepanel.functions import scalar as s
from tidepanel.functions.factor import by_instrument, factor, sql, with_factors
from tidepanel.functions.recursive import recursive, with_recursive
from tidepanel.plans import featuresets

from .common import (BARS, ORDERED, PK, RUNNING, argmax, avg, bars, corr, full, high, last, low, prefix_reduce, pstd,
                     quantile, query, rank, skew, std, total)

E = "1e-12"


def _factors(make):
    return lambda spark, folder: with_factors(by_instrument(bars(spark, folder)), make())


# Columns of the previous bar that most checks need.
STEP = f"""
step AS (
  SELECT *, lag(close) OVER {ORDERED} AS pc, close - lag(close) OVER {ORDERED} AS d,
         close / lag(close) OVER {ORDERED} - 1 AS ret, volume - lag(volume) OVER {ORDERED} AS dv,
         lag(volume) OVER {ORDERED} AS pv, CAST(row_number() OVER {ORDERED} AS DOUBLE) AS i,
         (high + low + close) / 3.0 AS tp
  FROM bars)"""

QUERIES = {}


def _add(name, make, columns, values, digits=6, more="", source="step"):
    """``columns`` are SQL expressions by output name; ``more`` are further CTEs."""
    select = ", ".join(f"{text} AS {out}" for out, text in columns.items())
    ctes = STEP + (("," + more) if more else "")
    QUERIES[name] = query(_factors(make), f"{ctes} => SELECT instrument_id, trade_date, {select} FROM {source}", PK,
                          values or list(columns), digits)


_add("ts_shift_diff_change", lambda: {
    "lag3": r.shift("close", 3), "lead2": r.shift("close", -2), "diff2": r.diff("close", 2),
    "delta1": r.delta("volume"), "change1": r.pct_change("close"), "change5": r.pct_change("close", 5)},
    {"lag3": f"lag(close, 3) OVER {ORDERED}", "lead2": f"lead(close, 2) OVER {ORDERED}",
     "diff2": f"close - lag(close, 2) OVER {ORDERED}", "delta1": "dv", "change1": "ret",
     "change5": f"close / lag(close, 5) OVER {ORDERED} - 1"}, None, 5)

_add("ts_rolling_basic", lambda: {
    "sma10": r.sma("turnover", 10), "std10": r.rolling_std("turnover", 10), "min10": r.rolling_min("close", 10),
    "max10": r.rolling_max("close", 10), "sum10": r.rolling_sum("volume", 10),
    "std_of_change": r.rolling_std(r.pct_change("close"), 20)},
    {"sma10": avg("turnover", 10), "std10": std("turnover", 10), "min10": low("close", 10), "max10": high("close", 10),
     "sum10": total("volume", 10), "std_of_change": std("ret", 20)}, None, 5)

_add("ts_rolling_shape", lambda: {
    "skew20": r.rolling_skew(r.pct_change("close"), 20), "q80": r.rolling_quantile("turnover", 20, 0.8),
    "q25": r.rolling_quantile("turnover", 10, 0.25), "z20": r.zscore("turnover", 20)},
    {"skew20": skew("ret", 20), "q80": quantile("turnover", 20, 0.8), "q25": quantile("turnover", 10, 0.25),
     "z20": f"(turnover - {avg('turnover', 20)}) / ({std('turnover', 20)} + {E})"}, None)

_add("ts_rolling_position", lambda: {
    "rank20": r.rank_pct("close", 20), "rank_volume": r.rolling_rank("volume", 10), "imax": r.argmax_ratio("high", 20),
    "imin": r.argmin_ratio("low", 20), "imxd": r.argmax_minus_argmin_ratio("high", "low", 10)},
    {"rank20": rank("close", 20), "rank_volume": rank("volume", 10), "imax": argmax("high", 20),
     "imin": argmax("low", 20, "min"), "imxd": f"{argmax('high', 10)} - {argmax('low', 10, 'min')}"}, None)

_add("ts_rolling_corr", lambda: {
    "corr10": r.rolling_corr("close", "volume", 10), "corr_change": r.rolling_corr(r.pct_change("close"), "turnover", 20)},
    {"corr10": corr("close", "volume", 10), "corr_change": corr("ret", "turnover", 20)}, None)

_add("ts_linear_regression", lambda: {
    "slope10": r.linearreg_slope("turnover", 10), "r2": r.linearreg_rsquare("close", 20),
    "resid": r.linearreg_residual("turnover", 10)},
    {"slope10": full("regr_slope(turnover, i)", "turnover", 10),
     "r2": f"pow({corr('close', 'i', 20)}, 2)",
     "resid": f"turnover - ({avg('turnover', 10)} + {full('regr_slope(turnover, i)', 'turnover', 10)} * 4.5)"}, None)

_UP, _DOWN = "CASE WHEN close > pc THEN 1.0 ELSE 0.0 END", "CASE WHEN close < pc THEN 1.0 ELSE 0.0 END"
_add("ts_direction_rates", lambda: {
    "up": r.direction_up_rate("close", 10), "down": r.direction_down_rate("close", 10),
    "balance": r.direction_balance_rate("close", 10), "psy12": r.psy("close", 12)},
    {"up": avg(_UP, 10), "down": avg(_DOWN, 10), "balance": f"{avg(_UP, 10)} - {avg(_DOWN, 10)}",
     "psy12": f"100 * {avg(_UP, 12)}"}, None)

_GAIN, _LOSS = "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END", "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END"
_add("ts_diff_ratios", lambda: {
    "up": r.diff_up_ratio("close", 10), "down": r.diff_down_ratio("close", 10), "balance": r.diff_balance_ratio("close", 10)},
    {"up": f"{total(_GAIN, 10)} / ({total('abs(d)', 10)} + {E})",
     "down": f"{total(_LOSS, 10)} / ({total('abs(d)', 10)} + {E})",
     "balance": f"({total(_GAIN, 10)} - {total(_LOSS, 10)}) / ({total('abs(d)', 10)} + {E})"}, None)


def _deviation(w): return f"(close / ({avg('close', w)} + {E}) - 1)"


_WRET = f"(abs(close / (pc + {E}) - 1) * volume)"
_MID = f"((high + low) / 2.0 - lag((high + low) / 2.0) OVER {ORDERED})"
_add("ts_price_volume", lambda: {
    "vwv": r.vol_weighted_volatility("close", "volume", 10), "bbi": r.bbi("close"), "pvt": r.pvt("close", "volume"),
    "emv": r.emv("high", "low", "volume", 14), "imi": r.imi("open", "close", 14), "vhf": r.vhf("high", "low", "close", 20),
    "dev20": r.price_deviation("close", 20), "max_ret": r.max_daily_return("close", 20),
    "momentum": r.normalized_ma_momentum("close", 5, 10, 20)},
    {"vwv": f"{std(_WRET, 10)} / ({avg(_WRET, 10)} + {E})",
     "bbi": f"({avg('close', 3)} + {avg('close', 6)} + {avg('close', 12)} + {avg('close', 24)}) / 4.0",
     "pvt": f"sum(coalesce(ret, 0) * volume) OVER {RUNNING}",
     "emv": avg("em", 14),
     "imi": f"{total('greatest(close - open, 0)', 14)} / ({total('abs(close - open)', 14)} + {E}) * 100",
     "vhf": f"({high('high', 20)} - {low('low', 20)}) / ({total('abs(d)', 20)} + {E})",
     "dev20": _deviation(20), "max_ret": high("ret", 20),
     "momentum": f"({_deviation(5)} + {_deviation(10)} + {_deviation(20)}) / 3.0"},
    {"vwv": 6, "bbi": 3, "pvt": 2, "emv": 1, "imi": 5, "vhf": 5, "dev20": 6, "max_ret": 5, "momentum": 6}, 6,
    more=f" em AS (SELECT *, {_MID} / (volume / (high - low + {E}) + {E}) AS em FROM step)", source="em")

_add("scalar_helpers", lambda: {
    "a": s.absolute(factor("open") - factor("close")), "b": s.log("volume"), "c": s.sqrt("turnover"),
    "d": s.clip("turnover", 0.03, 0.06), "e": s.where(factor("close") > factor("open"), "volume", 0.0),
    "f": s.row_max("open", r.shift("close")), "g": s.row_min("open", r.shift("close")), "h": s.vwap("amount", "volume"),
    "i": s.maximum("open", r.shift("close")), "j": s.minimum("open", r.shift("close")), "k": s.exp("turnover"),
    "l": s.log1p("turnover"), "m": s.power("turnover", 2.0), "n": s.sign(factor("close") - factor("open")),
    "o": s.nan_to_num(r.shift("close")), "p": s.to_int("volume"), "q": s.to_float("volume")},
    {"a": "abs(open - close)", "b": "ln(volume)", "c": "sqrt(turnover)", "d": "greatest(least(turnover, 0.06), 0.03)",
     "e": "CASE WHEN close > open THEN volume ELSE 0 END", "f": "greatest(open, pc)", "g": "least(open, pc)",
     "h": f"amount / (volume + {E})", "i": "CASE WHEN pc IS NOT NULL THEN greatest(open, pc) END",
     "j": "CASE WHEN pc IS NOT NULL THEN least(open, pc) END", "k": "exp(turnover)", "l": "ln(1 + turnover)",
     "m": "turnover * turnover", "n": "sign(close - open)", "o": "coalesce(pc, 0)", "p": "CAST(volume AS BIGINT)",
     "q": "volume"}, {c: 4 if c in "afghijo" else 6 for c in "abcdefghijklmnopq"})

_add("expression_projection", lambda: {
    "sum_": factor("open") + factor("close"), "rest": factor("volume") % 7.0, "whole": factor("volume") // 7.0,
    "power_": factor("turnover") ** 2, "neg": -factor("turnover"),
    "flag": s.where((factor("close") > "open") & ~(factor("volume") < 100.0), 1.0, 0.0),
    "either": s.where((factor("close") > factor("open")) | (factor("volume") >= 300.0), 1.0, 0.0),
    "member": s.where(factor("volume").isin(100.0, 150.0, 200.0), 1.0, 0.0),
    "text": sql("CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5D END"),
    "nested": r.sma(sql("turnover * volume"), 5)},
    {"sum_": "open + close", "rest": "volume - 7 * floor(volume / 7)", "whole": "floor(volume / 7)",
     "power_": "turnover * turnover", "neg": "-turnover",
     "flag": "CASE WHEN close > open AND NOT volume < 100 THEN 1 ELSE 0 END",
     "either": "CASE WHEN close > open OR volume >= 300 THEN 1 ELSE 0 END",
     "member": "CASE WHEN volume IN (100, 150, 200) THEN 1 ELSE 0 END",
     "text": "CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END",
     "nested": avg("(turnover * volume)", 5)}, {c: 4 if c == "sum_" else 6 for c in (
         "sum_", "rest", "whole", "power_", "neg", "flag", "either", "member", "text", "nested")})

# ---- indicators ----------------------------------------------------------------------------------------------

_MFV = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END"
_SIGNED = "CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END"
_K_CTES = f""" k1 AS (
  SELECT *, CASE WHEN {high('high', 9)} > {low('low', 9)} THEN (close - {low('low', 9)}) / ({high('high', 9)} - {low('low', 9)}) * 100
                 WHEN {high('high', 9)} IS NOT NULL THEN 0 END AS rawk, lag(tp) OVER {ORDERED} AS ptp FROM step),
k2 AS (SELECT *, {avg('rawk', 3)} AS slowk,
              CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS inflow,
              CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS outflow FROM k1),
k3 AS (SELECT *, {avg('slowk', 3)} AS slowd, {total('inflow', 14)} AS pos, {total('outflow', 14)} AS neg,
              {avg('tp', 20)} AS tpm, list(tp) OVER {last(20)} AS tps FROM k2)"""


def _since(x, pick, w):
    return full(f"list_position(list_reverse(list({x}) @), {pick}({x}) @)", x, w)


_INDICATORS = {
    "obv": f"sum({_SIGNED}) OVER {RUNNING}", "ad": f"sum({_MFV}) OVER {RUNNING}",
    "boll_mid": avg("close", 20), "boll_std": pstd("close", 20),
    "kdj_k": "CASE WHEN slowd IS NOT NULL THEN slowk END", "kdj_d": "slowd",
    "kdj_j": "3 * slowk - 2 * slowd",
    "cci": "CASE WHEN tpm IS NOT NULL THEN CASE WHEN list_sum(list_transform(tps, lambda v: abs(v - tpm))) <> 0 THEN "
           "(tp - tpm) / (0.015 * list_sum(list_transform(tps, lambda v: abs(v - tpm))) / 20) ELSE 0 END END",
    "mfi": "CASE WHEN pos + neg < 1 THEN 0 ELSE 100 * pos / (pos + neg) END",
    "aroon": f"100.0 / 25 * ({_since('low', 'min', 26)} - {_since('high', 'max', 26)})",
}
_add("indicators_windowed", lambda: {
    "obv": r.obv("close", "volume"), "ad": r.ad_line("high", "low", "close", "volume"), "boll_mid": r.boll_mid("close", 20),
    "boll_std": r.boll_std("close", 20), "kdj_k": r.kdj_k("high", "low", "close"), "kdj_d": r.kdj_d("high", "low", "close"),
    "kdj_j": r.kdj_j("high", "low", "close"), "cci": r.cci("high", "low", "close", 20),
    "mfi": r.mfi("high", "low", "close", "volume", 14), "aroon": r.aroon_osc("high", "low", 25)},
    _INDICATORS, {"obv": 4, "ad": 4, "boll_mid": 3, "boll_std": 3, "kdj_k": 5, "kdj_d": 5, "kdj_j": 5, "cci": 5, "mfi": 5,
                  "aroon": 5}, more=_K_CTES, source="k3")

# Recursive indicators: one exponential mean per CTE, each computed from the list of values so far.
_WILDER = "(1.0 / 14)"
_REC_CTES = f""" r0 AS (
  SELECT *, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END AS gain, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END AS loss,
         CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         high - lag(high) OVER {ORDERED} AS upm, lag(low) OVER {ORDERED} - low AS dnm,
         sum({_MFV}) OVER {RUNNING} AS adl, high - low AS hl FROM step),
r1 AS (
  SELECT *, CASE WHEN upm IS NOT NULL THEN CASE WHEN upm > 0 AND upm > dnm THEN upm ELSE 0 END END AS pdm,
         CASE WHEN upm IS NOT NULL THEN CASE WHEN dnm > 0 AND upm < dnm THEN dnm ELSE 0 END END AS mdm,
         {prefix_reduce('close', '(2.0 / 13)', 12)} AS e12, {prefix_reduce('close', '(2.0 / 27)', 26)} AS e26,
         {prefix_reduce('close', '(2.0 / 61)', 60)} AS e60, {prefix_reduce('close', '(2.0 / 13)', 12, 14)} AS f12,
         {prefix_reduce('close', '(2.0 / 21)', 20)} AS t1, {prefix_reduce('gain', _WILDER, 14)} AS ag,
         {prefix_reduce('loss', _WILDER, 14)} AS al, {prefix_reduce('tr', _WILDER, 14)} AS atr,
         {prefix_reduce('close', '(2.0 / 11)', 1)} AS p10, {prefix_reduce('adl', '(2.0 / 4)', 1)} AS a3,
         {prefix_reduce('adl', '(2.0 / 11)', 1)} AS a10, {prefix_reduce('hl', '(2.0 / 11)', 1)} AS cv FROM r0),
r2 AS (
  SELECT *, f12 - e26 AS line, {prefix_reduce('t1', '(2.0 / 21)', 20)} AS t2,
         list(tr) FILTER (WHERE tr IS NOT NULL) OVER {RUNNING} AS trs, list(pdm) FILTER (WHERE pdm IS NOT NULL) OVER {RUNNING} AS pdms,
         list(mdm) FILTER (WHERE mdm IS NOT NULL) OVER {RUNNING} AS mdms, lag(cv, 10) OVER {ORDERED} AS cv10 FROM r1),
r3 AS (
  SELECT *, {prefix_reduce('line', '(2.0 / 10)', 9)} AS signal, {prefix_reduce('t2', '(2.0 / 21)', 20)} AS t3,
         CASE WHEN i > 14 THEN list_reduce(list_concat([list_sum(trs[1:13]) / 14], trs[14:]), lambda a, v: a + {_WILDER} * (v - a)) END AS str,
         CASE WHEN i > 14 THEN list_reduce(list_concat([list_sum(pdms[1:13]) / 14], pdms[14:]), lambda a, v: a + {_WILDER} * (v - a)) END AS sp,
         CASE WHEN i > 14 THEN list_reduce(list_concat([list_sum(mdms[1:13]) / 14], mdms[14:]), lambda a, v: a + {_WILDER} * (v - a)) END AS sm
  FROM r2),
r4 AS (SELECT *, CASE WHEN str > 0 AND sp + sm > 0 THEN 100 * abs(sp - sm) / (sp + sm) END AS dx FROM r3)"""
_RECURSIVE = {
    "ema_pandas": "p10", "ema_12": "e12", "ema_26": "e26", "ema_60": "e60",
    "macd": "CASE WHEN signal IS NOT NULL THEN line END", "macd_signal": "signal",
    "rsi": "CASE WHEN ag + al = 0 THEN 0 ELSE 100 * ag / (ag + al) END",
    "cmo": "CASE WHEN ag + al = 0 THEN 0 ELSE 100 * (ag - al) / (ag + al) END",
    "atr": "atr", "adx": prefix_reduce("dx", _WILDER, 14), "tema": "3 * t1 - 3 * t2 + t3",
    "chaikin_osc": "CASE WHEN i >= 10 THEN a3 - a10 END", "chaikin_volatility": f"(cv - cv10) / (cv10 + {E})",
}


def _recursive(spark, folder):
    return with_recursive(by_instrument(bars(spark, folder)), {
        "ema_pandas": recursive("ema", "close", span=10), "ema_12": recursive("seeded_ema", "close", n=12),
        "ema_26": recursive("seeded_ema", "close", n=26), "ema_60": recursive("seeded_ema", "close", n=60),
        "macd": recursive("macd_line", "close"), "macd_signal": recursive("macd_signal", "close"),
        "rsi": recursive("rsi", "close", n=14), "cmo": recursive("cmo", "close", n=14),
        "atr": recursive("atr", "high", "low", "close", n=14), "adx": recursive("adx", "high", "low", "close", n=14),
        "tema": recursive("tema", "close", n=20),
        "chaikin_osc": recursive("chaikin_osc", "high", "low", "close", "volume", fast=3, slow=10),
        "chaikin_volatility": recursive("chaikin_volatility", "high", "low", n=10)})


QUERIES["indicators_recursive"] = query(
    _recursive, f"{STEP}, {_REC_CTES} => SELECT instrument_id, trade_date, "
    + ", ".join(f"{t} AS {c}" for c, t in _RECURSIVE.items()) + " FROM r4", PK,
    {c: 5 if c in ("rsi", "cmo", "adx", "chaikin_volatility") else 3 for c in _RECURSIVE})

# ---- fixed sets ----------------------------------------------------------------------------------------------


def _alpha_sql() -> dict[str, str]:
    p, b, span = f"(close + {E})", f"(open + {E})", f"(high - low + {E})"
    top, bottom = "greatest(open, close)", "least(open, close)"
    out = {
        "KMID": f"(close - open) / {b}", "KLEN": f"(high - low) / {b}", "KMID2": f"(close - open) / {span}",
        "KUP": f"(high - {top}) / {b}", "KUP2": f"(high - {top}) / {span}", "KLOW": f"({bottom} - low) / {b}",
        "KLOW2": f"({bottom} - low) / {span}", "KSFT": f"(2 * close - high - low) / {b}",
        "KSFT2": f"(2 * close - high - low) / {span}",
        "OPEN0": f"open / {p}", "HIGH0": f"high / {p}", "LOW0": f"low / {p}", "VWAP0": f"(amount / (volume + {E})) / {p}"}
    vgain, vloss = "CASE WHEN dv > 0 THEN dv WHEN dv <= 0 THEN 0 END", "CASE WHEN dv < 0 THEN -dv WHEN dv >= 0 THEN 0 END"
    for w in featuresets.WINDOWS:
        h, l, pv = high("high", w), low("low", w), f"(volume + {E})"
        slope = full("regr_slope(close, i)", "close", w)
        wret = "(abs(close / pc - 1) * volume)"
        out |= {
            f"ROC{w}": f"lag(close, {w}) OVER {ORDERED} / {p}", f"MA{w}": f"{avg('close', w)} / {p}",
            f"STD{w}": f"{pstd('close', w)} / {p}", f"BETA{w}": f"{slope} / {p}", f"RSQR{w}": f"pow({corr('close', 'i', w)}, 2)",
            f"RESI{w}": f"(close - ({avg('close', w)} + {slope} * {(w - 1) / 2})) / {p}",
            f"MAX{w}": f"{h} / {p}", f"MIN{w}": f"{l} / {p}", f"QTLU{w}": f"{quantile('close', w, 0.8)} / {p}",
            f"QTLD{w}": f"{quantile('close', w, 0.2)} / {p}", f"RANK{w}": rank("close", w),
            f"RSV{w}": f"(close - {l}) / ({h} - {l} + {E})", f"IMAX{w}": argmax("high", w), f"IMIN{w}": argmax("low", w, "min"),
            f"IMXD{w}": f"{argmax('high', w)} - {argmax('low', w, 'min')}",
            f"CORR{w}": corr("close", "lv", w), f"CORD{w}": corr("cs", "vs", w),
            f"CNTP{w}": avg(_UP, w), f"CNTN{w}": avg(_DOWN, w), f"CNTD{w}": f"{avg(_UP, w)} - {avg(_DOWN, w)}",
            f"SUMP{w}": f"{total(_GAIN, w)} / ({total('abs(d)', w)} + {E})", f"SUMN{w}": f"{total(_LOSS, w)} / ({total('abs(d)', w)} + {E})",
            f"SUMD{w}": f"({total(_GAIN, w)} - {total(_LOSS, w)}) / ({total('abs(d)', w)} + {E})",
            f"VMA{w}": f"{avg('volume', w)} / {pv}", f"VSTD{w}": f"{pstd('volume', w)} / {pv}",
            f"WVMA{w}": f"{std(wret, w)} / ({avg(wret, w)} + {E})",
            f"VSUMP{w}": f"{total(vgain, w)} / ({total('abs(dv)', w)} + {E})",
            f"VSUMN{w}": f"{total(vloss, w)} / ({total('abs(dv)', w)} + {E})",
            f"VSUMD{w}": f"({total(vgain, w)} - {total(vloss, w)}) / ({total('abs(dv)', w)} + {E})"}
    return {c: f"coalesce({t}, 0.0)" for c, t in out.items()}


_ALPHA = _alpha_sql()
_ALPHA_CTE = f""" lg AS (SELECT *, ln(volume + 1) AS lv, coalesce(close / (pc + {E}), 0) AS cs,
                         coalesce(ln(volume / (pv + {E}) + 1), 0) AS vs FROM step)"""
QUERIES["alpha158"] = query(
    lambda spark, folder: featuresets.engineer(bars(spark, folder), "158"),
    f"{STEP}, {_ALPHA_CTE} => SELECT instrument_id, trade_date, "
    + ", ".join(f"{t} AS {c}" for c, t in _ALPHA.items()) + " FROM lg", PK, list(_ALPHA), 5)

_RISING = "CASE WHEN close > open THEN 1.0 ELSE 0.0 END"
_TECH = {
    "sma_5": avg("close", 5), "sma_20": avg("close", 20), "ema_12": "e12", "ema_26": "e26", "ema_60": "e60",
    "macd": _RECURSIVE["macd"], "macd_signal": "signal", "rsi": _RECURSIVE["rsi"], "kdj_k": _INDICATORS["kdj_k"],
    "kdj_d": "slowd", "kdj_j": _INDICATORS["kdj_j"], "boll_mid": avg("close", 20), "boll_std": pstd("close", 20),
    "atr_14": "atr", "obv": _INDICATORS["obv"], "volume_change": "volume / pv - 1", "volume_ma_5": avg("volume", 5),
    "volume_ma_20": avg("volume", 20), "volume_ratio": f"{avg('volume', 5)} / {avg('volume', 20)}",
    "return_1": "ret", "return_5": f"close / lag(close, 5) OVER {ORDERED} - 1",
    "return_10": f"close / lag(close, 10) OVER {ORDERED} - 1", "volatility_10": std("ret", 10), "volatility_20": std("ret", 20),
    "high_low_spread": "high - low", "open_close_spread": "open - close", "high_close_spread": "high - close",
    "low_close_spread": "low - close",
    "mom_acc": f"(close / lag(close, 3) OVER {ORDERED} - 1) - (close / lag(close, 10) OVER {ORDERED} - 1)",
    "pv_div": f"(high - open) / (volume + {E})", "consecutive_pos": total(_RISING, 5)}
# the stochastic columns are built on top of the recursive ones, which carry every column along
_BOTH = _REC_CTES + "," + _K_CTES.replace("FROM step)", "FROM r4)", 1)
_COARSE = {"ema_12", "ema_26", "ema_60", "macd", "macd_signal", "sma_5", "sma_20", "boll_mid", "boll_std", "atr_14",
           "high_low_spread", "open_close_spread", "high_close_spread", "low_close_spread", "pv_div"}
QUERIES["tech39"] = query(
    lambda spark, folder: featuresets.engineer(bars(spark, folder), "39"),
    f"{STEP}, {_BOTH} => SELECT instrument_id, trade_date, "
    + ", ".join(f"coalesce({t}, 0.0) AS {c}" for c, t in _TECH.items()) + " FROM k3", PK,
    {c: 3 if c in _COARSE else 4 for c in featuresets.TECH39})

_CUSTOM = {
    "return_20": f"close / lag(close, 20) OVER {ORDERED} - 1", "turnover_mean_20": avg("turnover", 20),
    "pvt_factor": f"sum(coalesce(ret, 0) * volume) OVER {RUNNING}", "emv_14": avg("em", 14),
    "bbi_factor": f"({avg('close', 3)} + {avg('close', 6)} + {avg('close', 12)} + {avg('close', 24)}) / 4.0",
    "cci_20": _INDICATORS["cci"], "adx_14": _RECURSIVE["adx"], "psy_12": f"100 * {avg(_UP, 12)}", "tema_20": _RECURSIVE["tema"],
    "mfi_14": _INDICATORS["mfi"], "ad_line_factor": _INDICATORS["ad"], "chaikin_osc_3_10": _RECURSIVE["chaikin_osc"],
    "chaikin_volatility_10": _RECURSIVE["chaikin_volatility"],
    "imi_14": f"{total('greatest(close - open, 0)', 14)} / ({total('abs(close - open)', 14)} + {E}) * 100",
    "aroon_osc_25": _INDICATORS["aroon"], "cmo_14": _RECURSIVE["cmo"],
    "vhf_28": f"({high('high', 28)} - {low('low', 28)}) / ({total('abs(d)', 28)} + {E})",
    "price_dev_ma20": _deviation(20), "max_daily_return_20": high("ret", 20), "return_skew_20": skew("ret", 20),
    "multi_ma_momentum": f"({_deviation(5)} + {_deviation(10)} + {_deviation(20)} + {_deviation(60)}) / 4.0"}
_CUSTOM_CTES = _BOTH + f", em AS (SELECT *, {_MID} / (volume / (high - low + {E}) + {E}) AS em FROM k3)"
_CUSTOM_DIGITS = {"pvt_factor": 2, "emv_14": 1, "bbi_factor": 3, "tema_20": 3, "ad_line_factor": 4, "chaikin_osc_3_10": 3}
QUERIES["custom_factors"] = query(
    lambda spark, folder: featuresets.engineer(bars(spark, folder), "custom"),
    f"{STEP}, {_CUSTOM_CTES} => SELECT instrument_id, trade_date, "
    + ", ".join(f"coalesce({t}, 0.0) AS {c}" for c, t in _CUSTOM.items()) + " FROM em", PK,
    {c: _CUSTOM_DIGITS.get(c, 5) for c in _CUSTOM})

_UNION = _ALPHA | {c: f"coalesce({t}, 0.0)" for c, t in _TECH.items()}
QUERIES["feature_union_158_39"] = query(
    lambda spark, folder: featuresets.engineer(bars(spark, folder), "158+39"),
    f"{STEP}, {_BOTH}, {_ALPHA_CTE.replace('FROM step', 'FROM k3')} => SELECT instrument_id, trade_date, "
    + ", ".join(f"{t} AS {c}" for c, t in _UNION.items()) + " FROM lg", PK,
    {c: 5 if c in _ALPHA else (3 if c in _COARSE else 4) for c in _UNION})
