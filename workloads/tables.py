"""Sources, normalisation, joins of tables, quality rules, manifests, the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import joins
from tidepanel.operators import quality as q
from tidepanel.plans import catalog, tables
from tidepanel.sources import canonical as cn
from tidepanel.sources import files, logs, manifest, providers
from tidepanel.functions import rolling as r
from tidepanel.functions.factor import by_instrument, with_factors

from .common import BARS, DIM, ORDERED, PK, kept, query, scratch

QUERIES = {}


# ---- normalisation ----------------------------------------------------------------------------------------------


def _texts(spark, folder):
    """Ids in several spellings."""
    c = tables.read(spark, folder, "customer").select(F.col("c_name").alias("t"))
    s = tables.read(spark, folder, "supplier").select(F.concat(F.lit(" sh"), F.col("s_suppkey").cast("string"), F.lit(".SZ ")).alias("t"))
    o = tables.read(spark, folder, "orders").select(F.concat(F.lit("x"), (F.col("o_orderkey") * 977).cast("string")).alias("t"))
    n = tables.read(spark, folder, "nation").select(F.col("n_name").alias("t"))
    return c.unionByName(s).unionByName(o).unionByName(n).distinct()


_TEXTS = """
texts AS (SELECT DISTINCT t FROM (SELECT c_name AS t FROM customer UNION ALL SELECT ' sh' || s_suppkey || '.SZ ' FROM supplier
  UNION ALL SELECT 'x' || (o_orderkey * 977) FROM orders UNION ALL SELECT n_name FROM nation)),
ids AS (SELECT t, CASE WHEN regexp_matches(t, '[0-9]{6}') THEN regexp_extract(t, '[0-9]{6}')
                       WHEN regexp_matches(t, '[0-9]') THEN lpad(right(regexp_replace(t, '[^0-9]', '', 'g'), 6), 6, '0') ELSE '' END AS id FROM texts)"""
QUERIES["instrument_id_normalisation"] = query(
    lambda spark, folder: _texts(spark, folder).withColumn("id", cn.instrument_id(F.col("t"))), f"{_TEXTS} => SELECT * FROM ids", ("t", "id"), ctes=())
QUERIES["exchange_symbols"] = query(
    lambda spark, folder: _texts(spark, folder).withColumn("symbol", cn.exchange_symbol(F.col("t"))),
    f"""{_TEXTS} => SELECT t, CASE WHEN id = '' THEN trim(t) WHEN left(id, 1) IN ('4', '8') THEN 'bj.' || id WHEN left(id, 1) IN ('5', '6', '9') THEN 'sh.' || id
        ELSE 'sz.' || id END AS symbol FROM ids""", ("t", "symbol"), ctes=())


def _raw_daily(spark, folder, ident=None):
    """Trades as a provider would land them: foreign names, ids with a blank, unpadded date text, text numbers."""
    return tables.read(spark, folder, "lineitem").select(
        (F.concat(F.lit(" "), tables.padded_id("l_suppkey")) if ident is None else ident).alias("股票代码"), F.date_format("l_shipdate", "y/M/d").alias("日期"),
        F.col("l_partkey").cast("string").alias("开盘"), (F.col("l_tax") * 100).alias("high"), F.col("l_linenumber").alias("最低"),
        F.col("l_discount").cast("string").alias("preclose"), F.col("l_tax").alias("涨跌幅"),
        F.when(F.col("l_quantity") < 49, (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")).otherwise("n/a").alias("收盘"),
        F.col("l_quantity").cast("string").alias("成交量"), F.col("l_extendedprice").alias("amount"),
        "l_orderkey", "l_linenumber", "l_partkey")


_RAW = """
raw AS (SELECT lpad(l_suppkey::VARCHAR, greatest(6, length(l_suppkey::VARCHAR))::INTEGER, '0') AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS close, l_quantity AS volume,
               l_extendedprice AS amount, l_partkey AS open, l_tax * 100 AS high, l_linenumber AS low, l_discount AS preclose, l_tax AS pct_chg,
               l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 49),
daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, high DESC, preclose DESC, close DESC, volume DESC) AS rn FROM raw) WHERE rn = 1)"""
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]
QUERIES["canonical_daily"] = query(
    lambda spark, folder: cn.canonical_daily(_raw_daily(spark, folder), _ORDER, normalize_ids=False),
    f"{_RAW} => SELECT *, CAST(NULL AS DOUBLE) AS turnover FROM daily", PK,
    ["open", "high", "low", "close", "preclose", "volume", "amount", "turnover", "pct_chg"], 2, ctes=())


def foreign_id(number):
    """A number below a million as providers spell it: with an exchange before or after it, padded or not."""
    n = F.col(number).cast("string")
    padded = F.lpad(n, 6, "0")
    return F.element_at(F.array(F.concat(F.lit("SZ"), padded), F.concat(padded, F.lit(".SH")), F.concat(F.lit(" "), n), F.concat(F.lit("sh."), n)),
                        (F.pmod(F.col(number) * 7 + 3, F.lit(4)) + 1).cast("int"))


# Ids of six digits are all that the exchanges have, so suppliers have to be fewer than a million here.
QUERIES["canonical_daily_foreign_ids"] = query(
    lambda spark, folder: cn.canonical_daily(_raw_daily(spark, folder, foreign_id("l_suppkey")), _ORDER),
    f"{_RAW} => SELECT *, CAST(NULL AS DOUBLE) AS turnover FROM daily", PK,
    ["open", "high", "low", "close", "preclose", "volume", "amount", "turnover", "pct_chg"], 2, ctes=())


def _hf(spark, folder):
    e = tables.read(spark, folder, "events")
    return e.select(tables.padded_id("user_id").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("hf_realized_vol_m05"),
                    (F.col("value") / 2).alias("hf_realized_vol_m30"), (F.col("value") / 4).alias("hf_last_tail_ret_raw"), "event_id")


QUERIES["canonical_hf_daily"] = query(
    lambda spark, folder: cn.canonical_hf_daily(_hf(spark, folder), ["event_id"], normalize_ids=False),
    """SELECT lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') AS instrument_id, CAST(ts AS DATE) AS trade_date, arg_max(value, event_id) AS f_hf_realized_vol_1d,
              arg_max(value, event_id) / 4 AS f_hf_tail_ret_30m, CAST(NULL AS DOUBLE) AS f_hf_tail_amount_share_30m FROM events GROUP BY 1, 2""",
    PK, ["f_hf_realized_vol_1d", "f_hf_tail_ret_30m", "f_hf_tail_amount_share_30m"], ctes=())
QUERIES["canonical_minutes"] = query(
    lambda spark, folder: cn.canonical_minutes(tables.read(spark, folder, "events").select(
        tables.padded_id("user_id").alias("股票代码"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("value").alias("收盘"), "event_id"), ["event_id"], normalize_ids=False),
    """SELECT lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') AS instrument_id, date_trunc('second', ts) AS ts, CAST(ts AS DATE) AS trade_date, arg_max(value, event_id) AS close
       FROM events GROUP BY 1, 2, 3""", ("instrument_id", "ts", "trade_date"), ["close"], ctes=())
QUERIES["canonical_macro"] = query(
    lambda spark, folder: cn.canonical_macro(tables.read(spark, folder, "orders").select(
        F.concat(F.lit(" "), "o_orderpriority").alias("指标"), F.date_format("o_orderdate", "yyyy-M-d").alias("release_time"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice").cast("string")).otherwise("-").alias("值"))).groupBy("series_id", "available_time").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known")),
    """SELECT trim(o_orderpriority) AS series_id, date_trunc('day', o_orderdate) AS available_time, count(*) AS n, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS known
       FROM orders GROUP BY 1, 2""", ("series_id", "available_time"), ["n", "known"], ctes=())

QUERIES["provider_daily"] = query(
    lambda spark, folder: providers.provider_daily(tables.read(spark, folder, "lineitem").select(
        tables.padded_id("l_suppkey").alias("code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("l_extendedprice").cast("string").alias("close"), F.col("l_quantity").cast("string").alias("volume"), F.col("l_discount").cast("string").alias("turn"),
        F.when(F.col("l_returnflag") == "N", "1").otherwise("").alias("tradestatus")), normalize_ids=False).groupBy(*PK).agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.avg("turnover").alias("turnover"), F.count("trade_status").alias("traded"), F.count("open").alias("opens")),
    """SELECT lpad(l_suppkey::VARCHAR, greatest(6, length(l_suppkey::VARCHAR))::INTEGER, '0') AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date, count(*) AS n, sum(l_quantity) AS volume, avg(l_discount) AS turnover,
              count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS traded, 0 AS opens FROM lineitem GROUP BY 1, 2""", PK, ["n", "volume", "turnover", "traded", "opens"], ctes=())
QUERIES["provider_minutes"] = query(
    lambda spark, folder: providers.provider_minutes(tables.read(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("时间"), F.col("value").cast("string").alias("收盘"), "user_id", "event_id"), tables.padded_id("user_id"), normalize_ids=False).groupBy(*PK).agg(
        F.count(F.lit(1)).alias("n"), F.min("close").alias("lowest"), F.max("close").alias("highest")),
    """SELECT lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') AS instrument_id, CAST(ts AS DATE) AS trade_date, count(*) AS n, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1, 2""",
    PK, ["n", "lowest", "highest"], ctes=())


def _provider_macro(spark, folder):
    monthly = tables.read(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("月份")).agg(F.avg("o_totalprice").alias("美元"))
    cpi = tables.read(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("月份")).agg((F.count(F.lit(1)) / 10).alias("figure"))
    return providers.provider_macro(monthly, "usdcny", "1996-01-01", "1999-06-01").unionByName(providers.provider_macro(cpi, "cpi_yoy"))


QUERIES["provider_macro"] = query(
    _provider_macro,
    """SELECT 'usdcny' AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date, 'daily' AS frequency, 'latest' AS vintage, avg(o_totalprice) / 100 AS value
       FROM orders GROUP BY 2 HAVING CAST(date_trunc('month', o_orderdate) AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-06-01'
       UNION ALL SELECT 'cpi_yoy', CAST(date_trunc('month', o_orderdate) AS DATE), 'monthly', 'latest', count(*) / 10.0 FROM orders GROUP BY 2""",
    ("series_id", "observation_date", "frequency", "vintage"), ["value"], 4, ctes=())

_LEGACY = "l1 AS (SELECT *, nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY trade_date), 0) AS pc FROM bars)"
QUERIES["legacy_daily_projection"] = query(
    lambda spark, folder: providers.legacy_daily(with_factors(by_instrument(tables.bars(spark, folder)), {"preclose": r.shift("close")})).withColumnsRenamed(
        {"股票代码": "code", "日期": "day_text", "振幅": "amplitude", "涨跌额": "change", "换手率": "turn", "收盘": "last_price"}),
    f"""{_LEGACY} => SELECT instrument_id AS code, year(trade_date) || '/' || month(trade_date) || '/' || day(trade_date) AS day_text, close AS last_price,
        coalesce((high - low) / pc * 100, 0) AS amplitude, coalesce(close - pc, 0) AS change, turnover AS turn FROM l1""",
    ("code", "day_text"), {"last_price": 3, "amplitude": 3, "change": 3, "turn": 6})

# ---- files ------------------------------------------------------------------------------------------------------


def _csv_round(spark, folder):
    path = scratch(spark, "csv")
    files.write_csv(tables.bars(spark, folder), path + "/bars.csv")
    files.write_csv(tables.bars(spark, folder).where("volume > 300"), path + "/again.csv")
    both = files.read_many(spark, f"{path}/bars.csv,{path}/again.csv,{path}/bars.csv")
    return both.select("instrument_id", F.to_date("trade_date").alias("trade_date"), cn.number(F.col("close")).alias("close"), cn.number(F.col("volume")).alias("volume"))


QUERIES["files_csv_multi_scan"] = query(
    _csv_round, "SELECT instrument_id, trade_date, close, volume FROM bars UNION ALL SELECT instrument_id, trade_date, close, volume FROM bars WHERE volume > 300", PK, ["close", "volume"], 3)


def _sinks(spark, folder):
    path = files.layer_path("curated", root=scratch(spark, "lake"), dataset="market_bar")
    b = kept(tables.bars(spark, folder))
    files.append_only(b.where("trade_date < '1998-01-01'"), path)
    files.append_only(b.where("trade_date >= '1998-01-01'"), path)
    files.replace_partitions(b.where("trade_date BETWEEN '1996-01-01' AND '1996-12-31' AND volume > 100"), path)
    changes = b.where("trade_date >= '2000-01-01'").withColumn("close", F.lit(1.0)).where("volume < 200")
    files.upsert_on_key(changes, path, list(PK))
    return spark.read.parquet(path)


QUERIES["sink_partitioned_write_modes"] = query(
    _sinks,
    """SELECT instrument_id, trade_date, CASE WHEN trade_date >= DATE '2000-01-01' AND volume < 200 THEN 1 ELSE close END AS close, volume FROM bars
       WHERE NOT (trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND volume <= 100)""", PK, ["close", "volume"], 3)



def _partial_upsert(spark, folder):
    """Closing prices of the later years changed by rows that know no other value; some of them are new."""
    path = scratch(spark, "lake") + "/bars"
    b = kept(tables.bars(spark, folder))
    files.replace_build(b.where("volume > 50"), path)
    files.upsert_on_key(b.where("trade_date >= '1997-01-01'").select(*PK, (F.col("close") + 1).alias("close")), path, list(PK))
    return spark.read.parquet(path)


QUERIES["upsert_partial_columns"] = query(
    _partial_upsert,
    """SELECT instrument_id, trade_date, CASE WHEN trade_date >= DATE '1997-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN volume > 50 THEN open END AS open,
              CASE WHEN volume > 50 THEN volume END AS volume, CASE WHEN volume > 50 THEN turnover END AS turnover
       FROM bars WHERE volume > 50 OR trade_date >= DATE '1997-01-01'""", PK, {"close": 3, "open": 3, "volume": 3, "turnover": 6})


def _folders(spark, folder):
    """Many files of one folder, some without a column, and a pattern of text files, read at once."""
    path = scratch(spark, "many")
    b = kept(tables.bars(spark, folder))
    b.select(*PK, "close", "volume").repartition(20).write.parquet(f"{path}/full")
    b.select(*PK, "close").repartition(5).write.parquet(f"{path}/short")
    for year in ("1994", "1995"):
        files.write_csv(b.where(F.year("trade_date") == int(year)).select(*PK, "close"), f"{path}/y{year}.csv")
    parquet = files.read_many(spark, f"{path}/full,{path}/short")
    text = files.read_many(spark, f"{path}/y199*.csv")
    return parquet.select(*PK, "close", "volume", F.lit("parquet").alias("kind")).unionByName(
        text.select("instrument_id", F.to_date("trade_date").alias("trade_date"), cn.number(F.col("close")).alias("close"), F.lit(None).cast("double").alias("volume"), F.lit("csv").alias("kind")))


QUERIES["files_folders_and_patterns"] = query(
    _folders,
    """SELECT instrument_id, trade_date, close, volume, 'parquet' AS kind FROM bars UNION ALL SELECT instrument_id, trade_date, close, NULL, 'parquet' FROM bars
       UNION ALL SELECT instrument_id, trade_date, close, NULL, 'csv' FROM bars WHERE year(trade_date) IN (1994, 1995)""", (*PK, "kind"), {"close": 3, "volume": 3})

QUERIES["table_snapshot"] = query(
    lambda spark, folder: manifest.snapshot(tables.bars(spark, folder), "bars"),
    "SELECT 'bars' AS table_name, count(*) AS row_count, 9 AS column_count, min(trade_date) AS date_min, max(trade_date) AS date_max, count(DISTINCT instrument_id) AS instruments FROM bars",
    ("table_name", "date_min", "date_max"), ["row_count", "column_count", "instruments"])


def cell(column, kind="text"):
    """A value as text, as the hashes make it."""
    if kind == "double":
        text = (f"CASE WHEN isnan({column}) THEN 'nan' WHEN abs({column}) >= 4611686018427387904.0::DOUBLE THEN 'huge' || CAST(CAST(sign({column}) AS INTEGER) AS VARCHAR) "
                f"ELSE CAST(CAST(floor({column}) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(({column} - floor({column})) * 4503599627370496.0::DOUBLE) AS BIGINT) AS VARCHAR) END")
    else:
        text = f"CAST({column} AS VARCHAR)"
    return f"coalesce({text}, '~')"


def content(cells):
    h = f"md5(concat_ws('|', {', '.join(cells)}))"
    piece = lambda k: f"CAST(sum(CAST(CAST('0x' || substring({h}, {k}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return f"{piece(1)} || ':' || {piece(16)}"


def order_days(spark, folder):
    return tables.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("instrument_id"), F.to_date("o_orderdate").alias("trade_date"), "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


def _manifest(spark, folder):
    orders = kept(order_days(spark, folder))
    dim = tables.dimension(spark, folder).withColumn("trade_date", F.lit(None).cast("date"))
    made = manifest.manifest({"dim": dim, "orders": orders}, orders, run_id="run-1", factor_fingerprint="f0", paths={"out": "x"})
    return made.withColumn("n_inputs", F.size("inputs")).withColumn("input_rows", F.aggregate("inputs", F.lit(0).cast("bigint"), lambda a, x: a + x["row_count"]))


_ORDER_CELLS = [cell("o_custkey"), cell("o_orderkey"), cell("o_orderpriority"), cell("o_totalprice", "double"), cell("CAST(o_orderdate AS DATE)")]
QUERIES["run_manifest"] = query(
    _manifest,
    f"""SELECT 'run-1' AS run_id, 'succeeded' AS status, 'f0' AS factor_fingerprint, md5('instrument_id,trade_date,o_orderkey,o_totalprice,o_orderpriority') AS schema_hash,
        {content(_ORDER_CELLS)} AS data_hash, '{{"out": "x"}}' AS paths, count(*) AS row_count, 2 AS n_inputs, count(*) + (SELECT count(*) FROM supplier) AS input_rows FROM orders""",
    ("run_id", "status", "factor_fingerprint", "schema_hash", "data_hash", "paths"), ["row_count", "n_inputs", "input_rows"], ctes=())
_FINGER = [cell("p_brand"), cell("p_partkey"), cell("p_size"), cell("p_retailprice", "double")]


def _definitions(spark, folder):
    """Parts as factor definitions of the factor sets that are their types."""
    return tables.read(spark, folder, "part").select("p_type", "p_brand", "p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"))


def _fingerprints(spark, folder, kept_only=False):
    rows = _definitions(spark, folder)
    rows = rows.where("p_size <= 45") if kept_only else rows
    return manifest.table_fingerprints(rows, ["p_type"])


def fingerprint_sql(where=""):
    cells = [cell("p_brand"), cell("p_partkey"), cell("p_retailprice", "double"), cell("p_size"), cell("p_type")]
    return f"SELECT p_type, count(*) AS factors, substring(sha256(CAST(count(*) AS VARCHAR) || ':' || {content(cells)}), 1, 16) AS factor_fingerprint FROM part {where} GROUP BY 1"


QUERIES["factor_fingerprint"] = query(_fingerprints, fingerprint_sql(), ("p_type", "factor_fingerprint"), ["factors"], ctes=())


def _lineage(spark, folder):
    """Data sets built when parts of large size weren't definitions yet, against all of them."""
    return manifest.lineage_issues(_fingerprints(spark, folder, True), _fingerprints(spark, folder).where("p_type <> 'PROMO'"), "p_type", ["factor_fingerprint", "factors"])


QUERIES["lineage_check"] = query(
    _lineage,
    f"""li AS ({fingerprint_sql('WHERE p_size <= 45')}), la AS ({fingerprint_sql()}),
    lb AS (SELECT li.*, la.factor_fingerprint AS f2, la.factors AS n2 FROM li LEFT JOIN la ON li.p_type = la.p_type AND la.p_type <> 'PROMO') =>
    SELECT p_type, 'factor_fingerprint' AS field, factor_fingerprint AS dataset_value, f2 AS active_value FROM lb WHERE factor_fingerprint IS DISTINCT FROM f2
    UNION ALL SELECT p_type, 'factors', CAST(factors AS VARCHAR), CAST(n2 AS VARCHAR) FROM lb WHERE factors IS DISTINCT FROM n2""",
    ("p_type", "field", "dataset_value", "active_value"), [], ctes=())
QUERIES["factor_quality_summary"] = query(
    lambda spark, folder: manifest.quality_summary(with_factors(by_instrument(tables.bars(spark, folder)), {"f1": r.pct_change("close"), "f20": r.sma("close", 20)}), ["f1", "f20"]),
    f"""qs AS (SELECT *, close / lag(close) OVER {ORDERED} AS f1, CASE WHEN row_number() OVER {ORDERED} >= 20 THEN 1 END AS f20 FROM bars) =>
    SELECT 'f1' AS factor, count(*) AS row_count, 1 - count(f1) * 1.0 / count(*) AS null_ratio, count(DISTINCT instrument_id) AS instruments, min(trade_date) AS date_min, max(trade_date) AS date_max FROM qs
    UNION ALL SELECT 'f20', count(*), 1 - count(f20) * 1.0 / count(*), count(DISTINCT instrument_id), min(trade_date), max(trade_date) FROM qs""",
    ("factor", "date_min", "date_max"), ["row_count", "null_ratio", "instruments"])

# ---- joins ------------------------------------------------------------------------------------------------------


def _side(spark, folder):
    """A second daily table over part of the bars."""
    return tables.bars(spark, folder).where("volume > 150").select(*PK, (F.col("volume") * 2).alias("extra"), F.col("close").alias("other"))


QUERIES["join_many_to_one"] = query(
    lambda spark, folder: joins.join_many_to_one(tables.bars(spark, folder), _side(spark, folder)),
    "SELECT a.*, b.volume * 2 AS extra FROM bars a LEFT JOIN bars b ON a.instrument_id = b.instrument_id AND a.trade_date = b.trade_date AND b.volume > 150", PK, ["volume", "extra"])
QUERIES["join_backfill"] = query(
    lambda spark, folder: joins.join_backfill(tables.bars(spark, folder).withColumn("extra", F.when(F.col("volume") > 250, F.lit(-1.0))), _side(spark, folder)),
    "SELECT *, CASE WHEN volume > 250 THEN -1 WHEN volume > 150 THEN volume * 2 END AS extra, CASE WHEN volume > 150 THEN close END AS other FROM bars", PK, {"extra": 4, "other": 3})


def _merge(spark, folder):
    hf = tables.read(spark, folder, "lineitem").select(
        tables.padded_id("l_suppkey").alias("instrument_id"), F.add_months(F.to_date(F.date_trunc("month", "l_shipdate")), 5).alias("trade_date"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("turnover"), "l_orderkey", "l_linenumber", "l_partkey")
    return joins.merge_features(tables.bars(spark, folder), hf, _ORDER, normalize_ids=False)


def _long_ids(df):
    """Ids of seven digits and more that differ in their last figure only beyond the sixth."""
    return df.withColumn("instrument_id", F.concat(F.lit("123456"), F.col("instrument_id").cast("long").cast("string")))


def _merge_long(spark, folder):
    b = _long_ids(tables.bars(spark, folder))
    return joins.merge_features(b, b.where("volume > 100").select(*PK, (F.col("close") * 2).alias("twice"), F.col("volume").alias("v")), ["v"],
                                normalize_ids=False)[0]


_MERGE = """
mh AS (SELECT * FROM (SELECT lpad(l_suppkey::VARCHAR, greatest(6, length(l_suppkey::VARCHAR))::INTEGER, '0') AS instrument_id, CAST(date_trunc('month', l_shipdate) + INTERVAL 5 MONTH AS DATE) AS trade_date, l_tax AS tax, l_discount AS hf_turnover,
  row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_tax DESC, l_discount DESC) AS rn FROM lineitem) WHERE rn = 1)"""
QUERIES["merge_hf_features"] = query(lambda spark, folder: _merge(spark, folder)[0], f"{_MERGE} => SELECT bars.*, tax, hf_turnover FROM bars LEFT JOIN mh USING (instrument_id, trade_date)", PK, ["turnover", "tax", "hf_turnover"], 5)
QUERIES["merge_hf_long_ids"] = query(
    _merge_long, "SELECT '123456' || CAST(instrument_id AS BIGINT) AS instrument_id, trade_date, close, CASE WHEN volume > 100 THEN close * 2 END AS twice FROM bars",
    PK, {"close": 3, "twice": 3})
QUERIES["merge_hf_coverage"] = query(
    lambda spark, folder: _merge(spark, folder)[1].withColumnRenamed("rows", "total"),
    f"{_MERGE} => SELECT count(*) AS total, count(tax) AS matched_rows, count(tax) * 1.0 / count(*) AS coverage FROM bars LEFT JOIN mh USING (instrument_id, trade_date)", (), ["total", "matched_rows", "coverage"])
QUERIES["dataset_build"] = query(
    lambda spark, folder: joins.between_dates(joins.build_dataset(tables.bars(spark, folder), _side(spark, folder).withColumn("volume", F.col("extra") / 4), "inner")[0], "1996-01-01", "1999-12-31"),
    "SELECT *, volume * 2 AS extra, volume / 2 AS f_ext_volume FROM bars WHERE volume > 150 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", PK, ["volume", "extra", "f_ext_volume"])
QUERIES["dataset_coverage"] = query(
    lambda spark, folder: joins.build_dataset(tables.bars(spark, folder), _side(spark, folder))[1].withColumnRenamed("rows", "total"),
    "SELECT count(*) AS total, count(CASE WHEN volume > 150 THEN 1 END) AS matched_rows, count(CASE WHEN volume > 150 THEN 1 END) * 1.0 / count(*) AS coverage FROM bars", (), ["total", "matched_rows", "coverage"])
QUERIES["dimension_lookup"] = query(
    lambda spark, folder: joins.lookup(tables.bars(spark, folder), tables.dimension(spark, folder).unionByName(tables.dimension(spark, folder).withColumn("cap", F.lit(-9999.0))), ["cap"], ["industry"]),
    "SELECT bars.*, industry FROM bars LEFT JOIN dim USING (instrument_id)", (*PK, "industry"), ["close"], 3, ctes=(BARS, DIM))
QUERIES["benchmark_lookup_with_fallback"] = query(
    lambda spark, folder: joins.with_benchmark(tables.bars(spark, folder), tables.macro(spark, folder).where("series_id = '1-URGENT'").select(
        F.to_date("available_time").alias("trade_date"), F.col("value").alias("benchmark_return")), "turnover"),
    """bm AS (SELECT CAST(o_orderdate AS DATE) AS trade_date, avg(o_totalprice) AS b FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) =>
    SELECT instrument_id, trade_date, coalesce(b, avg(turnover) OVER (PARTITION BY trade_date)) AS benchmark FROM bars LEFT JOIN bm USING (trade_date)""", PK, ["benchmark"], 4)


def _merge_foreign(spark, folder):
    """Features whose ids are spelled another way than those of the bars, on both sides read by their six digits."""
    b = tables.bars(spark, folder).withColumn("n", F.col("instrument_id").cast("long"))
    left = b.withColumn("instrument_id", F.concat(F.lit("sz."), "instrument_id")).drop("n")
    right = b.where("volume > 100").withColumn("_f", foreign_id("n")).select(F.col("_f").alias("instrument_id"), "trade_date", (F.col("close") * 2).alias("twice"), F.col("volume").alias("v"))
    return joins.merge_features(left, right, ["v"])[0].withColumn("instrument_id", F.right("instrument_id", F.lit(6)))


QUERIES["merge_hf_foreign_ids"] = query(
    _merge_foreign, "SELECT instrument_id, trade_date, close, CASE WHEN volume > 100 THEN close * 2 END AS twice FROM bars", PK, {"close": 3, "twice": 3})
QUERIES["universe_restriction_foreign_ids"] = query(
    lambda spark, folder: joins.restrict_universe(tables.bars(spark, folder), tables.read(spark, folder, "supplier").where("s_nationkey < 9").select(foreign_id("s_suppkey").alias("instrument_id"))),
    "SELECT * FROM bars WHERE CAST(instrument_id AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9)", PK, ["close"], 3)


def _universe(spark, folder):
    s = tables.read(spark, folder, "supplier")
    return joins.restrict_universe(tables.bars(spark, folder), s.where("s_acctbal > 5000").select(tables.padded_id("s_suppkey").alias("instrument_id")),
                                   s.where("s_nationkey < 5").select(tables.padded_id("s_suppkey").alias("instrument_id")), normalize_ids=False)


QUERIES["universe_restriction"] = query(
    _universe, "SELECT * FROM bars WHERE CAST(instrument_id AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 OR s_nationkey < 5)", PK, ["close"], 3)
QUERIES["universe_restriction_long_ids"] = query(
    lambda spark, folder: joins.restrict_universe(
        _long_ids(tables.bars(spark, folder)), _long_ids(tables.read(spark, folder, "supplier").where("s_nationkey < 9").select(F.col("s_suppkey").alias("instrument_id"))),
        normalize_ids=False),
    """SELECT '123456' || CAST(instrument_id AS BIGINT) AS instrument_id, trade_date, close FROM bars
       WHERE CAST(instrument_id AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9)""", PK, ["close"], 3)
QUERIES["universe_membership_dates"] = query(
    lambda spark, folder: joins.member_on_date(tables.bars(spark, folder), tables.read(spark, folder, "supplier").select(
        tables.padded_id("s_suppkey").alias("instrument_id"), F.add_months(F.lit("1995-01-01").cast("date"), F.col("s_nationkey")).alias("in_date"),
        F.when(F.col("s_acctbal") > 0, F.add_months(F.lit("1998-01-01").cast("date"), F.col("s_nationkey"))).alias("out_date"))),
    """SELECT bars.* FROM bars JOIN supplier ON CAST(instrument_id AS BIGINT) = s_suppkey WHERE trade_date >= DATE '1995-01-01' + to_months(s_nationkey)
       AND (s_acctbal <= 0 OR trade_date < DATE '1998-01-01' + to_months(s_nationkey))""", PK, ["close"], 3)
QUERIES["dataset_product"] = query(
    lambda spark, folder: joins.dataset_product(tables.bars(spark, folder), _side(spark, folder), tables.dimension(spark, folder), ["close", "extra", "industry"]),
    "SELECT bars.*, CASE WHEN volume > 150 THEN volume * 2 END AS extra, industry, cap FROM bars LEFT JOIN dim USING (instrument_id)", (*PK, "industry"), {"close": 3, "extra": 3, "cap": 2}, ctes=(BARS, DIM))

# ---- quality ----------------------------------------------------------------------------------------------------

RULES = [
    {"type": "unique_key", "key": ["l_orderkey", "l_linenumber"], "name": "line_key"},
    {"type": "expression", "expr": "l_discount < 0.08", "name": "discount"},
    {"type": "expression", "expr": "nullif(l_quantity, 5) > 0", "name": "null_fails"},
    {"type": "stock_coverage_vs_trade_days", "min_ratio_p50": 0.3, "min_ratio_p10": 0.9, "name": "cover"},
    {"type": "market_session_check", "name": "hours"},
    {"type": "unheard_of", "name": "later"}]


def _report(spark, folder):
    rows = tables.read(spark, folder, "lineitem").withColumns({
        "instrument_id": tables.padded_id("l_suppkey"), "trade_date": F.to_date(F.date_trunc("month", "l_shipdate")),
        "ts": F.timestamp_add("MINUTE", (F.col("l_orderkey") % 1440).cast("int"), F.date_trunc("day", "l_shipdate"))})
    return q.validate(rows, RULES, ["ts"]).withColumn("ok", F.col("passed").cast("int"))


_COUNTS = "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY date_trunc('month', l_shipdate)"
_RATIOS = f"SELECT quantile_cont(n, 0.5) / max(n) AS p50, quantile_cont(n, 0.1) / max(n) AS p10 FROM ({_COUNTS})"
QUERIES["quality_rule_report"] = query(
    _report,
    f"""SELECT 'line_key' AS rule, 'unique_key' AS type, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS failed_rows, CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 1 ELSE 0 END AS ok, 'l_orderkey,l_linenumber' AS detail FROM lineitem
    UNION ALL SELECT 'discount', 'expression', count(CASE WHEN NOT l_discount < 0.08 THEN 1 END), 0, 'l_discount < 0.08' FROM lineitem
    UNION ALL SELECT 'null_fails', 'expression', count(CASE WHEN l_quantity = 5 THEN 1 END), 0, 'nullif(l_quantity, 5) > 0' FROM lineitem
    UNION ALL SELECT 'cover', 'stock_coverage_vs_trade_days', CASE WHEN p50 >= 0.3 AND p10 >= 0.9 THEN 0 ELSE 1 END, CASE WHEN p50 >= 0.3 AND p10 >= 0.9 THEN 1 ELSE 0 END, printf('p50=%.3f p10=%.3f', p50, p10) FROM ({_RATIOS})
    UNION ALL SELECT 'hours', 'market_session_check', count(CASE WHEN NOT (l_orderkey % 1440 BETWEEN 570 AND 690 OR l_orderkey % 1440 BETWEEN 780 AND 900) THEN 1 END), 0, '' FROM lineitem
    UNION ALL SELECT 'later', 'unheard_of', 0, NULL, 'skipped'""", ("rule", "type", "detail"), ["failed_rows", "ok"], ctes=())
QUERIES["quality_daily_coverage"] = query(
    lambda spark, folder: q.coverage_ratios(tables.bars(spark, folder)),
    "cc AS (SELECT count(DISTINCT instrument_id) AS n FROM bars GROUP BY trade_date) => SELECT count(*) AS days, quantile_cont(n, 0.5) / max(n) AS ratio_p50, quantile_cont(n, 0.1) / max(n) AS ratio_p10 FROM cc",
    (), ["days", "ratio_p50", "ratio_p10"])
QUERIES["quality_daily_counts"] = query(
    lambda spark, folder: q.daily_counts(tables.bars(spark, folder)), "SELECT trade_date, count(DISTINCT instrument_id) AS names FROM bars GROUP BY 1", ("trade_date",), ["names"])

# ---- catalog ----------------------------------------------------------------------------------------------------


def part_catalog(spark, folder):
    """Parts as factor definitions: brand as group, type as source, small sizes disabled."""
    return tables.read(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("group"), F.col("p_type").alias("source"), (F.col("p_size") > 10).alias("enabled"))


QUERIES["catalog_group_counts"] = query(
    lambda spark, folder: catalog.group_counts(part_catalog(spark, folder)).withColumnRenamed("group", "factor_group"),
    "SELECT p_brand AS factor_group, p_type AS source, count(*) AS factors, sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS enabled FROM part GROUP BY 1, 2",
    ("factor_group", "source"), ["factors", "enabled"], ctes=())


def _lenient(spark, folder):
    """Broken definitions give NULL columns and a report line; the others are computed."""
    specs = [catalog.FactorSpec("ok", "sma", {"x": "close", "w": 5}), catalog.FactorSpec("bad", "no_such_function", {"x": "close"}),
             catalog.FactorSpec("after", "diff", {"x": "bad"}), catalog.FactorSpec("lost", "sma", {"x": "nowhere", "w": 3})]
    return catalog.run_factors(tables.bars(spark, folder), specs, strict=False).frame


QUERIES["factor_nodes_lenient"] = query(
    _lenient, f"SELECT *, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS ok, CAST(NULL AS DOUBLE) AS bad, CAST(NULL AS DOUBLE) AS after, CAST(NULL AS DOUBLE) AS lost FROM bars "
    "WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", PK, ["ok", "bad", "after", "lost"], 3)


def _node_status(spark, folder):
    """Reports of two runs in one table: the lenient one above on the bars, and one without broken definitions."""
    bars = kept(tables.bars(spark, folder))
    broken = [catalog.FactorSpec("ok", "sma", {"x": "close", "w": 5}), catalog.FactorSpec("bad", "no_such_function", {"x": "close"}),
              catalog.FactorSpec("after", "diff", {"x": "bad"}), catalog.FactorSpec("lost", "sma", {"x": "nowhere", "w": 3})]
    sound = [catalog.FactorSpec("m", "sma", {"x": "close", "w": 5}), catalog.FactorSpec("top", "last_quantile", {"x": "m", "n": 4, "q": 0.5})]
    runs = [(name, catalog.run_factors(bars, specs, strict=False)) for name, specs in (("lenient", broken), ("sound", sound))]
    status = runs[0][1].report(spark).withColumn("run", F.lit(runs[0][0])).unionByName(runs[1][1].report(spark).withColumn("run", F.lit(runs[1][0])))
    values = None
    for name, result in runs:
        made = [c for c in result.frame.columns if c not in bars.columns]
        one = result.frame.agg(*[F.count(c).alias(c) for c in made]).select(F.inline(F.array(*[F.struct(F.lit(name).alias("run"), F.lit(c).alias("factor"), F.col(c).alias("made")) for c in made])))
        values = one if values is None else values.unionByName(one)
    return manifest.run_status(status).join(values.groupBy("run").agg(F.sum("made").alias("values")), "run")


QUERIES["node_status"] = query(
    _node_status,
    f"""nr AS (SELECT row_number() OVER {ORDERED} AS k, count(close) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM bars) =>
    SELECT 'lenient' AS run, 'after: an input failed' AS first_error, 4 AS factors, 1 AS ok, 3 AS failed, count(CASE WHEN c = 5 THEN 1 END) AS values FROM nr
    UNION ALL SELECT 'sound', NULL, 2, 2, 0, count(CASE WHEN c = 5 THEN 1 END) + count(CASE WHEN k >= 8 THEN 1 END) FROM nr""",
    ("run", "first_error"), ["factors", "ok", "failed", "values"])


def _resolved(spark, folder):
    """Parts as built-in factors: those of one manufacturer type overridden, suppliers as custom ones, some disabled."""
    part = tables.read(spark, folder, "part")
    builtin = part.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_brand").alias("group"), (F.col("p_size") > 10).alias("enabled"))
    overrides = part.where("p_retailprice > 1200").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit("changed").alias("group"), F.lit(True).alias("enabled"))
    custom = tables.read(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("custom").alias("group"), (F.col("s_acctbal") > 0).alias("enabled"))
    disabled = part.where("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return catalog.resolve_table(builtin, overrides, custom, disabled).withColumnRenamed("group", "factor_group")


QUERIES["catalog_resolution"] = query(
    _resolved,
    """SELECT 'p' || p_partkey AS name, CASE WHEN p_retailprice > 1200 THEN 'changed' ELSE p_brand END AS factor_group, p_retailprice > 1200 AS overridden
       FROM part WHERE (p_size > 10 OR p_retailprice > 1200) AND p_brand <> 'Brand#11'
       UNION ALL SELECT 's' || s_suppkey, 'custom', FALSE FROM supplier WHERE s_acctbal > 0""", ("name", "factor_group", "overridden"), ctes=())

# ---- logs -------------------------------------------------------------------------------------------------------


def _log_lines(spark, folder):
    """Each supplier's bars as a training log: a header per month, then figures, the first reported twice; some months have a header only."""
    b = tables.bars(spark, folder).select("instrument_id", "trade_date", "volume", "turnover")
    b = b.withColumn("k", F.months_between("trade_date", F.lit("1990-01-01").cast("date")).cast("int"))
    head = F.format_string("=== Epoch %d/%d ===", "k", F.col("k") + 400)
    lines = F.array(head, F.lit("Train loss: 0.5"), F.format_string("Train loss: %.1f", "volume"),
                    F.format_string("Eval rank-ic: %.4f", "turnover"), F.format_string("  - price: features=%d, return=%.4f, delta=-0.5", "k", "turnover"), F.lit("other text"),
                    F.lit("当前最优持仓策略: first | 验证目标值: 0 | 策略收益均值: 0 | RankIC: 0"),
                    F.format_string("当前最优持仓策略: top%d | 验证目标值: %.1f | 策略收益均值: %.4f | RankIC: -0.25", "k", "volume", "turnover"),
                    F.format_string("早停状态: monitor=eval_loss, value=%.4f, best=%.1f, bad_epochs=%d/9", "turnover", "volume", "k"),
                    F.when(F.col("k") % 7 == 0, F.format_string("触发早停: monitor=eval_loss, mode=min, patience=9, best=%.1f", "volume")).otherwise(F.lit("-")))
    lines = F.when(F.col("k") % 5 == 0, F.array(head)).otherwise(lines)
    placed = b.select(F.col("instrument_id").alias("file"), "k", F.posexplode(lines).alias("n", "line"))
    return placed.select("file", (F.col("k") * 1000 + F.col("n")).alias("line_no"), "line")


_LM = """lm AS (SELECT *, epoch % 5 = 0 AS bare FROM (SELECT instrument_id AS file, CAST(datediff('month', DATE '1990-01-01', trade_date) AS INTEGER) AS epoch, volume, round(turnover, 4) AS t FROM bars))"""
for _table, _sql, _keys, _values in (
        ("epochs", "SELECT file, epoch, epoch + 400 AS total_epochs, CASE WHEN bare THEN 0 ELSE 3 END AS metric_lines, CASE WHEN NOT bare AND epoch % 7 = 0 THEN 1 ELSE 0 END AS triggered FROM lm",
         ("file", "epoch"), {"total_epochs": 0, "metric_lines": 0, "triggered": 0}),
        ("metrics", "SELECT file, epoch, 'train_loss' AS name, volume AS value FROM lm WHERE NOT bare UNION ALL SELECT file, epoch, 'eval_rank-ic', t FROM lm WHERE NOT bare", ("file", "epoch", "name"), {"value": 3}),
        ("best", "SELECT file, epoch, 'top' || epoch AS strategy, volume AS objective, t AS strategy_return, -0.25 AS rank_ic FROM lm WHERE NOT bare",
         ("file", "epoch", "strategy"), {"objective": 3, "strategy_return": 3, "rank_ic": 3}),
        ("ablation", "SELECT file, epoch, 'price' AS factor_group, epoch AS num_features, t AS ret, -0.5 AS delta FROM lm WHERE NOT bare",
         ("file", "epoch", "factor_group"), {"num_features": 0, "ret": 3, "delta": 2}),
        ("early_stop", """SELECT file, epoch, 'eval_loss' AS monitor, CAST(NULL AS VARCHAR) AS mode, t AS value, volume AS best, epoch AS bad_epochs, 9 AS patience, 0 AS triggered FROM lm WHERE NOT bare
         UNION ALL SELECT file, epoch, 'eval_loss', 'min', NULL, volume, NULL, 9, 1 FROM lm WHERE NOT bare AND epoch % 7 = 0""",
         ("file", "epoch", "monitor", "mode"), {"value": 3, "best": 3, "bad_epochs": 0, "patience": 0, "triggered": 0})):
    QUERIES[f"training_log_{_table}"] = query(
        lambda spark, folder, t=_table: logs.parse_training_log(_log_lines(spark, folder))[t].withColumnRenamed("return", "ret"),
        f"{_LM} => {_sql}", _keys, _values)
