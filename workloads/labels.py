"""Labels, targets, folds, splits and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.factor import by_instrument, with_factors
from tidepanel.operators import labels as lb
from tidepanel.operators import sequences as sq
from tidepanel.operators import splits as sp
from tidepanel.operators import stats
from tidepanel.operators.cross_section import winsorize_mad
from tidepanel.plans import tables

from .common import BARS, DIM, ORDERED, PK, kept, query
from .cross_section import W, med, rk

QUERIES = {}


def labelled(spark, folder):
    """Bars with the raw labels, rows without one left out, stored once."""
    made = with_factors(by_instrument(tables.bars(spark, folder)), {"label": lb.forward_return(), "vol_label": lb.forward_volatility(horizon=5)})
    return kept(made.where("label IS NOT NULL AND vol_label IS NOT NULL"))


_STEPS = [f"(lead(open, {k + 1}) OVER {ORDERED} - lead(open, {k}) OVER {ORDERED}) / (lead(open, {k}) OVER {ORDERED} + 1e-12)" for k in range(1, 5)]
_LIST = f"list_filter([{', '.join(_STEPS)}], lambda v: v IS NOT NULL)"
LAB = f"""
lab0 AS (SELECT *, (lead(open, 5) OVER {ORDERED} - lead(open, 1) OVER {ORDERED}) / (lead(open, 1) OVER {ORDERED} + 1e-12) AS label, {_LIST} AS steps FROM bars),
lab1 AS (SELECT *, CASE WHEN len(steps) > 0 THEN list_stddev_pop(steps) END AS vol_label FROM lab0),
lab AS (SELECT * FROM lab1 WHERE label IS NOT NULL AND vol_label IS NOT NULL)"""

QUERIES["label_forward_return_and_volatility"] = query(
    lambda spark, folder: with_factors(by_instrument(tables.bars(spark, folder)), {
        "label": lb.forward_return(), "label3": lb.forward_return(horizon=3), "vol_label": lb.forward_volatility()}),
    f"""{LAB} => SELECT instrument_id, trade_date, label, (lead(open, 3) OVER {ORDERED} - lead(open, 1) OVER {ORDERED}) / (lead(open, 1) OVER {ORDERED} + 1e-12) AS label3,
        vol_label FROM lab1""", PK, ["label", "label3", "vol_label"], 5)

_BENCH = """
bench0 AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, avg(o_totalprice) AS open FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
bench1 AS (SELECT trade_date, (lead(open, 5) OVER (ORDER BY trade_date) - lead(open, 1) OVER (ORDER BY trade_date)) / (lead(open, 1) OVER (ORDER BY trade_date) + 1e-12) AS benchmark_return FROM bench0),
bench AS (SELECT * FROM bench1 WHERE benchmark_return IS NOT NULL)"""


def benchmark(spark, folder):
    index = tables.read(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").groupBy(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("trade_date")).agg(F.avg("o_totalprice").alias("open"))
    return lb.benchmark_returns(index)


QUERIES["benchmark_returns"] = query(benchmark, f"{_BENCH} => SELECT * FROM bench", ("trade_date",), ["benchmark_return"], ctes=())


def _percent_benchmark(spark, folder):
    days = tables.bars(spark, folder).groupBy("trade_date").agg((F.avg("turnover") * 10000.0).alias("pct_chg"))
    return lb.benchmark_returns(days)


QUERIES["benchmark_percent_scaling"] = query(
    _percent_benchmark, "SELECT trade_date, avg(turnover) * 10000 / 100 AS benchmark_return FROM bars GROUP BY 1", ("trade_date",), ["benchmark_return"], 5)

_MEAN = f"avg(label) {W}"
_IND = "coalesce(CASE WHEN industry IS NOT NULL THEN avg({x}) OVER (PARTITION BY trade_date, industry) END, avg({x}) OVER (PARTITION BY trade_date))"
_BM = "coalesce(benchmark_return, avg({x}) OVER (PARTITION BY trade_date))"
_NEUTRAL = {
    "cross_mean": f"SELECT *, label - {_MEAN} AS y FROM labd",
    "benchmark": f"SELECT *, label - {_BM.format(x='label')} AS y FROM labd",
    "industry": f"SELECT *, label - {_IND.format(x='label')} AS y FROM labd",
    "benchmark_then_industry": f"SELECT *, x - {_IND.format(x='x')} AS y FROM (SELECT *, label - {_BM.format(x='label')} AS x FROM labd)",
    "industry_then_benchmark": f"SELECT *, x - {_BM.format(x='x')} AS y FROM (SELECT *, label - {_IND.format(x='label')} AS x FROM labd)"}
# suppliers in debt have no industry here, so that the fallback is used
_LABD = f"{LAB}, {_BENCH}, labd AS (SELECT lab.*, CASE WHEN cap > 0 THEN industry END AS industry, benchmark_return FROM lab LEFT JOIN dim USING (instrument_id) LEFT JOIN bench USING (trade_date))"


def _with_industry(spark, folder):
    dim = tables.dimension(spark, folder).select("instrument_id", F.when(F.col("cap") > 0, F.col("industry")).alias("industry"))
    return kept(labelled(spark, folder).join(dim, "instrument_id", "left"))


for _m, _s in _NEUTRAL.items():
    QUERIES[f"label_neutral_{_m}"] = query(
        lambda spark, folder, m=_m: lb.neutralize(_with_industry(spark, folder), "label", m, benchmark(spark, folder)).withColumnRenamed("label", "y"),
        f"{_LABD} => {_s}", PK, ["y"], 5, ctes=(BARS, DIM))

_MADL = f"""
q0 AS (SELECT *, {med('label')} AS md FROM lab), q1 AS (SELECT *, {med('abs(label - md)')} AS mad FROM q0),
q2 AS (SELECT *, greatest(least(label, md + 5 * greatest(mad * 1.4826, 1e-6)), md - 5 * greatest(mad * 1.4826, 1e-6)) AS y FROM q1)"""
QUERIES["label_mad_clip"] = query(
    lambda spark, folder: winsorize_mad(labelled(spark, folder), ["label"], 5.0, min_group=5).withColumnRenamed("label", "y"),
    f"{LAB}, {_MADL} => SELECT instrument_id, trade_date, y FROM q2", PK, ["y"], 5)

_VOL = f"""
v0 AS (SELECT *, ln(1 + greatest(vol_label, 0)) AS lv FROM lab), v1 AS (SELECT *, {med('lv')} AS md FROM v0),
v2 AS (SELECT *, {med('abs(lv - md)')} AS mad FROM v1),
v3 AS (SELECT *, greatest(least(lv, md + 5 * greatest(mad * 1.4826, 1e-6)), md - 5 * greatest(mad * 1.4826, 1e-6)) AS cv FROM v2),
v4 AS (SELECT *, (cv - avg(cv) {W}) / (nullif(stddev_samp(cv) {W}, 0) + 1e-6) AS zv FROM v3)"""
QUERIES["volatility_label_zscore"] = query(
    lambda spark, folder: lb.process_volatility(labelled(spark, folder)),
    f"{LAB}, {_VOL} => SELECT instrument_id, trade_date, CASE WHEN zv IS NOT NULL THEN greatest(least(zv, 5), -5) END AS vol_label FROM v4", PK, ["vol_label"], 5)
QUERIES["volatility_label_rank"] = query(
    lambda spark, folder: lb.process_volatility(labelled(spark, folder), method="rank", mad_n=None),
    f"{LAB} => SELECT instrument_id, trade_date, 2 * ({rk('vol_label')}) - 1 AS vol_label FROM lab", PK, ["vol_label"])

# ---- targets of a ranking loss --------------------------------------------------------------------------------

_LOWMED = "quantile_disc({c}, 0.5) OVER (PARTITION BY trade_date)"


def _targets_sql(mode: str, norm: str) -> str:
    ctes, source = [LAB], "lab"
    step = 0

    def bounds(kind):
        nonlocal source, step
        step += 1
        if kind == "quantile":
            ctes.append(f"b{step} AS (SELECT *, quantile_cont(label, 0.05) {W} AS lo, quantile_cont(label, 0.95) {W} AS hi, count(*) {W} AS n FROM {source})")
        else:
            ctes.append(f"a{step} AS (SELECT *, {_LOWMED.format(c='label')} AS md FROM {source})")
            ctes.append(f"aa{step} AS (SELECT *, {_LOWMED.format(c='abs(label - md)')} AS mad, count(*) {W} AS n FROM a{step})")
            ctes.append(f"b{step} AS (SELECT * EXCLUDE (md, mad), md - 5 * greatest(mad * 1.4826, 1e-6) AS lo, md + 5 * greatest(mad * 1.4826, 1e-6) AS hi FROM aa{step})")
        source = f"b{step}"

    kind = "mad" if mode.startswith("mad") else "quantile"
    if "drop" in mode:
        bounds(kind)
        ctes.append(f"c{step} AS (SELECT *, sum(CASE WHEN label BETWEEN lo AND hi THEN 1 ELSE 0 END) {W} AS k FROM {source})")
        ctes.append(f"d{step} AS (SELECT instrument_id, trade_date, label FROM c{step} WHERE n <= 5 OR k < 2 OR label BETWEEN lo AND hi)")
        source = f"d{step}"
    if "clip" in mode:
        bounds(kind)
        ctes.append(f"e{step} AS (SELECT instrument_id, trade_date, CASE WHEN n > 2 THEN greatest(least(label, hi), lo) ELSE label END AS label FROM {source})")
        source = f"e{step}"
    if norm == "zscore":
        value = f"(label - avg(label) {W}) / (stddev_pop(label) {W} + 1e-6)"
    else:
        value = (f"CASE WHEN count(*) {W} > 1 THEN (row_number() OVER (PARTITION BY trade_date ORDER BY label, instrument_id) - 1.0) / "
                 f"(count(*) {W} - 1) * 2 - 1 ELSE 0 END")
    return ",".join(ctes) + f" => SELECT instrument_id, trade_date, {value} AS label FROM {source}"


for _mode, _norm in (("none", "zscore"), ("drop", "zscore"), ("clip", "rank"), ("drop_clip", "rank"), ("mad_drop", "zscore"),
                     ("mad_clip", "rank"), ("mad_drop_clip", "zscore")):
    QUERIES[f"loss_target_{_mode}_{_norm}"] = query(
        lambda spark, folder, m=_mode, n=_norm: lb.transform_targets(labelled(spark, folder), "label", m, n),
        _targets_sql(_mode, _norm), PK, ["label"], 5)

QUERIES["relevance_top_quantile"] = query(
    lambda spark, folder: lb.relevance(labelled(spark, folder), "label"),
    f"{LAB} => SELECT instrument_id, trade_date, CASE WHEN label >= quantile_cont(label, 0.98) {W} THEN 1 ELSE 0 END AS relevance FROM lab", PK, ["relevance"])
QUERIES["relevance_by_rank"] = query(
    lambda spark, folder: lb.rank_relevance(labelled(spark, folder), "label"),
    f"{LAB} => SELECT instrument_id, trade_date, count(*) {W} - row_number() OVER (PARTITION BY trade_date ORDER BY label DESC, instrument_id) + 1 AS relevance FROM lab",
    PK, ["relevance"])

# ---- folds, splits, sequences -----------------------------------------------------------------------------------

_DAYS = "dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day, count(*) OVER () AS days FROM (SELECT DISTINCT trade_date FROM bars))"
FOLD_ARGS = dict(folds=3, window=8, step=8, purge=3, embargo=2, horizon=5, sequence_length=12)
FOLDS_SQL = f"""{_DAYS},
ff AS (SELECT *, days - 5 - 1 - day AS back, days - 5 - (8 + 2 * 10) AS first FROM dd),
edge AS (SELECT max(CASE WHEN day = first - 3 THEN trade_date END) AS train_end, max(CASE WHEN day = greatest(0, first - 11) THEN trade_date END) AS context_start FROM ff),
folds AS (SELECT 'fold_' || CAST(3 - CAST(floor(back / 10) AS INTEGER) AS VARCHAR) AS fold, min(trade_date) AS start_date, max(trade_date) AS end_date
          FROM ff WHERE back >= 0 AND floor(back / 10) < 3 AND back % 10 < 8 GROUP BY 1)"""
QUERIES["rolling_folds"] = query(
    lambda spark, folder: sp.rolling_folds(tables.bars(spark, folder), **FOLD_ARGS),
    f"{FOLDS_SQL} => SELECT fold, start_date, end_date, train_end, context_start FROM folds CROSS JOIN edge",
    ("fold", "start_date", "end_date", "train_end", "context_start"))
QUERIES["fold_membership"] = query(
    lambda spark, folder: (lambda b: sp.with_fold(b, sp.rolling_folds(b, **FOLD_ARGS)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trade_date").alias("days")))(kept(tables.bars(spark, folder))),
    f"{FOLDS_SQL} => SELECT fold, count(*) AS n, count(DISTINCT trade_date) AS days FROM bars JOIN folds ON trade_date BETWEEN start_date AND end_date GROUP BY 1",
    ("fold",), ["n", "days"])
QUERIES["holdout_last_months"] = query(
    lambda spark, folder: sp.holdout_last_months(tables.bars(spark, folder), 2, 60).groupBy("role", "in_context").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")),
    """hh AS (SELECT max(trade_date) - INTERVAL 2 MONTH AS st FROM bars),
    bd AS (SELECT CAST(st AS DATE) - i::INTEGER AS d, row_number() OVER (ORDER BY i) AS k FROM hh, range(1, 200) t(i) WHERE isodow(CAST(st AS DATE) - i::INTEGER) < 6),
    cc AS (SELECT CAST(st AS DATE) AS st, (SELECT d FROM bd WHERE k = 59) AS ctx FROM hh) =>
    SELECT CASE WHEN trade_date >= st THEN 'validation' ELSE 'train' END AS role, trade_date >= ctx AS in_context, count(*) AS n,
           min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars, cc GROUP BY 1, 2""", ("role", "in_context", "first_day", "last_day"), ["n"])
QUERIES["train_test_by_dates"] = query(
    lambda spark, folder: sp.train_test_by_dates(tables.bars(spark, folder), ("1996-01-01", "1998-06-01"), ("1998-06-01", "1999-12-01")).select(*PK, "split", "close"),
    """SELECT instrument_id, trade_date, 'train' AS split, close FROM bars WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-01'
       UNION ALL SELECT instrument_id, trade_date, 'test', close FROM bars WHERE trade_date BETWEEN DATE '1998-06-01' AND DATE '1999-12-01'""", (*PK, "split"), ["close"], 4)
_SPLIT_COLS = ("train_start", "train_end", "test_start", "test_end")
for _n, _kw, _cut in (("ratio", {"ratio": 0.8}, "CAST(floor(days * 0.8) AS INTEGER)"), ("last_days", {"last_days": 7}, "days - 7")):
    QUERIES[f"auto_split_{_n}"] = query(
        lambda spark, folder, kw=_kw: sp.auto_split(tables.bars(spark, folder), **kw),
        f"{_DAYS} => SELECT min(trade_date) AS train_start, max(CASE WHEN day < {_cut} THEN trade_date END) AS train_end, "
        f"min(CASE WHEN day >= {_cut} THEN trade_date END) AS test_start, max(trade_date) AS test_end FROM dd", _SPLIT_COLS)

QUERIES["instrument_index"] = query(
    lambda spark, folder: sq.instrument_index(tables.bars(spark, folder)),
    "SELECT instrument_id, row_number() OVER (ORDER BY instrument_id) - 1 AS instrument FROM (SELECT DISTINCT instrument_id FROM bars)", ("instrument_id",), ["instrument"])


def _flat(df):
    """Length, first day, and a position-weighted checksum of each sequence."""
    weighted = F.aggregate(F.sequence(F.lit(1), F.size("sequence")), F.lit(0.0),
                           lambda acc, i: acc + i * F.element_at("sequence", i)["features"][0] + F.element_at("sequence", i)["features"][1])
    return df.withColumns({"length": F.size("sequence"), "first_day": F.element_at("sequence", 1)["trade_date"], "checksum": weighted})


_L = "(PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_SEQ = f"""sq0 AS (SELECT instrument_id, trade_date, list(turnover) OVER {_L} AS ts, list(volume) OVER {_L} AS vs, min(trade_date) OVER {_L} AS first_day FROM bars),
sq1 AS (SELECT *, len(ts) AS length, list_sum(list_transform(ts, lambda v, i: v * i)) + list_sum(vs) AS checksum FROM sq0 WHERE len(ts) = 24)"""
QUERIES["sliding_sequences"] = query(
    lambda spark, folder: _flat(sq.sequences(by_instrument(tables.bars(spark, folder)), ["turnover", "volume"], 24, min_names=60)),
    f"{_SEQ} => SELECT * FROM (SELECT *, count(*) {W} AS names FROM sq1) WHERE names >= 60", (*PK, "first_day"), ["length", "checksum"], 4)
QUERIES["latest_sequences"] = query(
    lambda spark, folder: _flat(sq.latest_sequences(tables.bars(spark, folder), ["turnover", "volume"], 24)),
    f"{_SEQ} => SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS back FROM sq1) WHERE back = 1",
    ("instrument_id", "first_day"), ["length", "checksum"], 4)

# ---- row selection and descriptive tables -----------------------------------------------------------------------

QUERIES["group_last_rows"] = query(
    lambda spark, folder: stats.last_rows(tables.bars(spark, folder), 5),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 5", PK, ["close"], 3)
QUERIES["group_first_rows"] = query(
    lambda spark, folder: stats.first_rows(tables.bars(spark, folder), 30),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS rn FROM bars) WHERE rn <= 30", PK, ["close"], 3)
QUERIES["instrument_preview"] = query(
    lambda spark, folder: stats.instrument_subset(tables.bars(spark, folder), 20, 10),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS rn FROM bars
       WHERE instrument_id IN (SELECT DISTINCT instrument_id FROM bars ORDER BY 1 LIMIT 20)) WHERE rn <= 10""", PK, ["close"], 3)
QUERIES["seeded_row_sample"] = query(lambda spark, folder: stats.sample_rows(tables.bars(spark, folder), 1000),
    "SELECT * FROM bars ORDER BY md5(concat_ws('|', instrument_id, CAST(trade_date AS VARCHAR), '42')), instrument_id, trade_date LIMIT 1000", PK, ["close"], 3)
QUERIES["date_range_filter"] = query(
    lambda spark, folder: tables.bars(spark, folder).where(F.col("trade_date").between(F.lit("1996-03-01").cast("date"), F.lit("1997-09-01").cast("date"))),
    "SELECT * FROM bars WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1997-09-01'", PK, ["close"], 3)
QUERIES["drop_rows_and_add_columns"] = query(
    lambda spark, folder: stats.add_missing(with_factors(by_instrument(tables.bars(spark, folder)), {"label": lb.forward_return()}).dropna(subset=["label", "close"]), ["f_missing", "close"]),
    f"{LAB} => SELECT instrument_id, trade_date, label, close, CAST(NULL AS DOUBLE) AS f_missing FROM lab0 WHERE label IS NOT NULL", PK, ["label", "close", "f_missing"], 4)

_STAT = "SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, 1.0 - count({c}) * 1.0 / count(*) AS null_ratio FROM lab0 {w}"
_STAT_COLS = ("label", "turnover", "volume")
for _n, _last, _w in (("whole", False, ""), ("last_day", True, "WHERE trade_date = (SELECT max(trade_date) FROM lab0)")):
    QUERIES[f"feature_stats_{_n}"] = query(
        lambda spark, folder, last=_last: stats.feature_stats(with_factors(by_instrument(tables.bars(spark, folder)), {"label": lb.forward_return()}), _STAT_COLS, last),
        f"{LAB} => " + " UNION ALL ".join(_STAT.format(c=c, w=_w) for c in _STAT_COLS), ("feature",), ["mean", "std", "min", "max", "null_ratio"], 4)
QUERIES["histogram"] = query(
    lambda spark, folder: stats.histogram(tables.bars(spark, folder), F.ln("close"), 80),
    """hs AS (SELECT ln(close) AS x FROM bars), hb AS (SELECT min(x) AS lo, max(x) AS hi FROM hs) =>
    SELECT least(CAST(floor((x - lo) / ((hi - lo) / 80)) AS INTEGER), 79) AS bin, count(*) AS n FROM hs, hb GROUP BY 1""", ("bin",), ["n"])
QUERIES["expression_preview_stats"] = query(
    lambda spark, folder: stats.preview_stats(tables.bars(spark, folder).withColumn("x", F.ln("volume")), "x"),
    "SELECT count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max FROM (SELECT ln(volume) AS x FROM bars)", (), ["n", "mean", "std", "min", "max"])
QUERIES["long_factor_view"] = query(
    lambda spark, folder: stats.long_view(tables.bars(spark, folder), ["close", "volume", "turnover"], "run-1", "v1"),
    " UNION ALL ".join(f"SELECT instrument_id, trade_date, '{c}' AS factor_name, {c} AS factor_value, 'run-1' AS run_id, 'v1' AS factor_version FROM bars" for c in ("close", "volume", "turnover")),
    (*PK, "factor_name", "run_id", "factor_version"), ["factor_value"], 4)
