"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from ..sources.events import EVENT_TYPES, FOMC_DATES


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


W = "(PARTITION BY asset_key ORDER BY date)"
U = "(PARTITION BY asset_key ORDER BY date ROWS UNBOUNDED PRECEDING)"
DAY = "CAST(date AS DATE) AS date"


def last(n: int) -> str:
    return f"(PARTITION BY asset_key ORDER BY date ROWS {n - 1} PRECEDING)"


def gated(x: str, e: str, n: int, name: str) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {e.format(w=last(n))} END AS {name}"


WALK = f"""
days AS (SELECT l_returnflag AS asset_key, CAST(l_shipdate AS TIMESTAMP) AS date, CAST(count(*) AS DOUBLE) AS volume,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100.0 - 0.05 AS shock FROM lineitem GROUP BY 1, 2),
prices AS (SELECT asset_key, date, volume, 100 * exp(sum(shock) OVER {U}) AS close FROM days),
walk AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret, ln(close / lag(close) OVER {W}) AS log_ret FROM prices)"""
HOURS = """
hours AS (SELECT event_type AS asset_key, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high,
          min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
OHLC = HOURS + f""",
ohlc AS (SELECT *, CASE WHEN lag(close) OVER {W} <> 0 THEN close / lag(close) OVER {W} - 1 END AS ret FROM hours)"""
RAW = HOURS + f""",
numbered AS (SELECT *, row_number() OVER {W} AS rn FROM hours),
faulty AS (SELECT asset_key, date, CASE WHEN rn % 17 <> 3 THEN open END AS open, CASE WHEN rn % 23 = 5 THEN low - 1 ELSE high END AS high,
           low, CASE WHEN rn % 29 <> 7 THEN close END AS close, CASE WHEN rn % 13 <> 4 THEN volume END AS volume, 1 AS seq, rn FROM numbered),
raw AS (SELECT * FROM faulty UNION ALL SELECT asset_key, date, open, high + 1, low, close + 1, volume, 2, rn FROM faulty WHERE rn % 11 = 2),
flagged AS (SELECT *, row_number() OVER (PARTITION BY asset_key, date ORDER BY seq DESC) > 1 AS again,
            coalesce(high < low OR high < open OR high < close OR low > open OR low > close OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false) AS odd FROM raw),
staged AS (SELECT *, NOT again AND odd AS bad, NOT again AND NOT odd AND close IS NOT NULL AS kept FROM flagged)"""


def filled(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER {U}"


CLEAN_BARS = f"""WITH {RAW}
SELECT asset_key, date, {r(filled("open"), "open")}, {r(filled("high"), "high")}, {r(filled("low"), "low")}, {r(filled("close"), "close")},
       {r(filled("close"), "adj_close")}, {r("coalesce(volume, 0)", "volume")} FROM staged WHERE kept"""
CLEAN_REPORT = f"""WITH {RAW}
SELECT asset_key, count(*) AS rows_in, count(*) FILTER (kept) AS rows_out, count(*) FILTER (again) AS duplicates_removed,
       CAST(sum(CASE WHEN kept THEN CAST(open IS NULL AS INTEGER) ELSE 0 END) AS BIGINT) AS missing_filled, count(*) FILTER (bad) AS invalid_ohlc_rows
FROM staged GROUP BY 1"""
RETURNS = f"WITH {WALK} SELECT asset_key, {DAY}, {rs('close', 'ret', 'log_ret')} FROM walk"
CUMULATIVE = f"WITH {WALK} SELECT asset_key, {DAY}, {r(f'product(1 + coalesce(ret, 0)) OVER {U} - 1', 'cum_ret')} FROM walk"

BACK = WALK + """,
back AS (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY date DESC) AS k, max(date) OVER (PARTITION BY asset_key) AS final FROM walk)"""


def at(n: int) -> str:
    return f"max(CASE WHEN k = {n + 1} THEN close END)"


YTD = f"""{at(0)} / coalesce(arg_max(close, date) FILTER (date < date_trunc('year', final)),
    CASE WHEN count(*) FILTER (date >= date_trunc('year', final)) >= 2 THEN arg_min(close, date) FILTER (date >= date_trunc('year', final)) END) - 1"""
TRAILING = f"""WITH {BACK}
SELECT asset_key, {", ".join(r(f"{at(0)} / {at(n)} - 1", f"ret_{n}") for n in (1, 5, 21))}, {r(YTD, "ret_ytd")} FROM back GROUP BY 1"""
PERIOD = f"WITH {BACK} SELECT asset_key, {r(f'{at(0)} / {at(63)} - 1', 'ret')} FROM back GROUP BY 1"
TOTAL = f"""WITH {WALK} SELECT asset_key, {r("arg_max(close, date) / arg_min(close, date) - 1", "total_return")},
{r("pow(arg_max(close, date) / arg_min(close, date), 252.0 / (count(close) - 1)) - 1", "cagr")} FROM walk GROUP BY 1"""
CAGR = f"WITH {WALK} SELECT asset_key, {r('pow(product(1 + ret), 252.0 / count(ret)) - 1', 'cagr')} FROM walk GROUP BY 1"
BEST = f"WITH {WALK} SELECT asset_key, {r('max(ret)', 'best')}, {r('min(ret)', 'worst')} FROM walk GROUP BY 1"


def resample_ctes(label: str, start: str, step: str, back: str, source: str = "walk") -> str:
    return f"""{WALK if source == "walk" else OHLC},
bins AS (SELECT asset_key, {label} AS p, product(1 + coalesce(ret, 0)) - 1 AS x FROM {source} GROUP BY 1, 2),
span AS (SELECT asset_key, min(p) AS a, max(p) AS b FROM bins GROUP BY 1),
steps AS (SELECT asset_key, unnest(generate_series(CAST({start.replace("p", "a") if start == "p" else start.replace(", p)", ", a)")} AS TIMESTAMP), CAST(b AS TIMESTAMP), {step})) AS d FROM span),
every_bin AS (SELECT asset_key, {back} AS p FROM steps),
resampled AS (SELECT e.asset_key, e.p AS period, coalesce(x, 0) AS x FROM every_bin e LEFT JOIN bins b ON b.asset_key = e.asset_key AND b.p = e.p)"""


def resample(label: str, start: str, step: str, back: str, source: str = "walk") -> str:
    return f"WITH {resample_ctes(label, start, step, back, source)} SELECT asset_key, period, {r('x', 'ret')} FROM resampled"


MONTHS = resample_ctes("last_day(CAST(date AS DATE))", "date_trunc('month', p)", "INTERVAL 1 MONTH", "last_day(CAST(d AS DATE))")
LAST24 = f"""WITH {MONTHS}
SELECT asset_key, period, {r("x", "ret")} FROM resampled QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY period DESC) <= 24"""


def vol(n: int, name: str, source: str = "ret") -> str:
    return gated(source, f"stddev_samp({source}) OVER {{w}} * sqrt(252)", n, name)


ROLLING_VOL = f"WITH {WALK}, v AS (SELECT *, {vol(20, 'vol_20d')}, {vol(60, 'vol_60d')} FROM walk) SELECT asset_key, {DAY}, {rs('vol_20d', 'vol_60d')} FROM v"
ANNUAL_VOL = f"WITH {WALK} SELECT asset_key, {r('stddev_samp(ret) * sqrt(252)', 'vol')} FROM walk GROUP BY 1"
REALIZED = WALK + """,
newest AS (SELECT asset_key, ret, row_number() OVER (PARTITION BY asset_key ORDER BY date DESC) AS k FROM walk WHERE ret IS NOT NULL),
realized AS (SELECT asset_key, CASE WHEN count(*) = 20 THEN stddev_samp(ret) * sqrt(252) END AS vol FROM newest WHERE k <= 20 GROUP BY 1)"""
REALIZED_VOL = f"WITH {REALIZED} SELECT asset_key, {r('vol')} FROM realized"

DD = WALK + f""",
peaks AS (SELECT *, max(close) OVER {U} AS peak FROM walk), dd AS (SELECT *, close / peak - 1 AS drawdown FROM peaks)"""
DRAWDOWN = f"WITH {DD} SELECT asset_key, {DAY}, {rs('peak', 'drawdown')} FROM dd"
DRAWDOWN_RET = f"""WITH {WALK}, e AS (SELECT *, product(1 + coalesce(ret, 0)) OVER {U} AS equity FROM walk),
p AS (SELECT *, max(equity) OVER {U} AS peak FROM e)
SELECT asset_key, {DAY}, {rs("equity", "peak")}, {r("equity / peak - 1", "drawdown")} FROM p"""
STATS = DD + """,
deep AS (SELECT *, min(drawdown) OVER (PARTITION BY asset_key) AS deepest FROM dd),
trough AS (SELECT asset_key, min(date) AS t FROM deep WHERE drawdown = deepest GROUP BY 1),
high AS (SELECT d.asset_key, t, max(close) AS top FROM dd d JOIN trough USING (asset_key) WHERE date <= t GROUP BY 1, 2),
stats AS (SELECT d.asset_key, min(drawdown) AS max_drawdown, arg_max(drawdown, date) AS current_drawdown,
          min(date) FILTER (date <= t AND close = top) AS peak_date, any_value(t) AS trough_date,
          min(date) FILTER (date >= t AND close >= top) AS recovery_date FROM dd d JOIN high USING (asset_key) GROUP BY 1)"""
DRAWDOWN_STATS = f"""WITH {STATS}
SELECT asset_key, {rs("max_drawdown", "current_drawdown")}, CAST(peak_date AS DATE) AS peak_date, CAST(trough_date AS DATE) AS trough_date,
       CAST(recovery_date AS DATE) AS recovery_date, recovery_date IS NOT NULL AS recovered FROM stats"""

REG = WALK + f""",
vols AS (SELECT *, {vol(20, "vol")} FROM walk), known AS (SELECT * FROM vols WHERE vol IS NOT NULL),
limits AS (SELECT *, CASE WHEN count(vol) OVER {U} >= 20 THEN quantile_cont(vol, 0.33) OVER {U} END AS low_threshold,
           CASE WHEN count(vol) OVER {U} >= 20 THEN quantile_cont(vol, 0.66) OVER {U} END AS high_threshold FROM known),
regimes AS (SELECT *, CASE WHEN round(vol, 12) >= round(high_threshold, 12) THEN 'High' WHEN round(vol, 12) <= round(low_threshold, 12) THEN 'Low' ELSE 'Normal' END AS regime FROM limits)"""
REGIME = f"WITH {REG} SELECT asset_key, {DAY}, {rs('vol', 'low_threshold', 'high_threshold')}, regime FROM regimes"
REGIME_NOW = f"WITH {REG} SELECT asset_key, arg_max(regime, date) AS regime FROM regimes GROUP BY 1"
REGIME_PERF = f"""WITH {REG}, g AS (SELECT asset_key, regime, count(*) AS days, avg(ret) AS mean_ret, stddev_samp(ret) * sqrt(252) AS vol FROM regimes WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT asset_key, regime, days, {rs("mean_ret", "vol")}, {r("days / sum(days) OVER (PARTITION BY asset_key)", "share")},
       CASE regime WHEN 'Low' THEN 0 WHEN 'Normal' THEN 1 ELSE 2 END AS regime_order FROM g"""


def sma(n: int, name: str, x: str = "close") -> str:
    return gated(x, f"avg({x}) OVER {{w}}", n, name)


TRENDS = WALK + f""",
smas AS (SELECT *, {sma(50, "sma_fast")}, {sma(200, "sma_slow")} FROM walk),
trends AS (SELECT *, CASE WHEN close < sma_fast AND sma_fast < sma_slow THEN 'Bearish' WHEN close > sma_fast AND sma_fast > sma_slow THEN 'Bullish' ELSE 'Neutral' END AS trend FROM smas)"""
TREND = f"WITH {TRENDS} SELECT asset_key, {DAY}, {rs('sma_fast', 'sma_slow')}, trend FROM trends"
TREND_NOW = f"WITH {TRENDS} SELECT asset_key, arg_max(trend, date) AS trend FROM trends GROUP BY 1"

PAIRS = """pairs AS (SELECT p.date, p.asset_key AS a, q.asset_key AS b, p.ret AS x, q.ret AS y FROM walk p JOIN walk q ON p.date = q.date AND p.asset_key < q.asset_key),
own AS (SELECT asset_key AS a, asset_key AS b, CASE WHEN stddev_pop(ret) > 0 THEN 1.0 END AS corr, count(ret) AS n FROM walk GROUP BY 1)"""
PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
MIRROR = "whole AS (SELECT a, b, corr, n FROM half UNION ALL SELECT b, a, corr, n FROM half UNION ALL SELECT a, b, corr, n FROM own)"
CORR = f"""WITH {WALK}, {PAIRS}, half AS (SELECT a, b, {PEARSON} AS corr, count(*) AS n FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2), {MIRROR}
SELECT a, b, {r("corr")}, n FROM whole"""
SPEARMAN = f"""WITH {WALK}, {PAIRS},
ranks AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x,
          rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM (SELECT date, a, b, round(x, 9) AS x, round(y, 9) AS y FROM pairs) WHERE x IS NOT NULL AND y IS NOT NULL),
half AS (SELECT a, b, {PEARSON} AS corr, count(*) AS n FROM ranks GROUP BY 1, 2), {MIRROR} SELECT a, b, {r("corr")}, n FROM whole"""
KENDALL = f"""WITH {MONTHS.replace(WALK, WALK.replace("walk AS", "daily AS")).replace("FROM walk GROUP", "FROM daily GROUP")},
walk AS (SELECT asset_key, period AS date, round(x, 9) AS ret FROM resampled), {PAIRS},
sums AS (SELECT p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s, sum(abs(sign(p.x - q.x))) AS tx, sum(abs(sign(p.y - q.y))) AS ty
         FROM pairs p JOIN pairs q ON p.a = q.a AND p.b = q.b AND p.date < q.date GROUP BY 1, 2),
half AS (SELECT a, b, s / sqrt(tx * ty) AS corr, n FROM sums JOIN (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2) USING (a, b)), {MIRROR}
SELECT a, b, {r("corr")}, n FROM whole"""
TAU = """sums AS (SELECT p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s, sum(abs(sign(p.x - q.x))) AS tx, sum(abs(sign(p.y - q.y))) AS ty
         FROM pairs p JOIN pairs q ON p.a = q.a AND p.b = q.b AND p.date < q.date GROUP BY 1, 2),
half AS (SELECT a, b, s / sqrt(tx * ty) AS corr, n FROM sums JOIN (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2) USING (a, b))"""
KENDALL_DAILY = f"""WITH {WALK.replace("walk AS", "daily AS")}, walk AS (SELECT asset_key, date, round(ret, 9) AS ret FROM daily WHERE ret IS NOT NULL), {PAIRS}, {TAU}, {MIRROR}
SELECT a, b, {r("corr")}, n FROM whole"""
R60 = "(ORDER BY date ROWS 59 PRECEDING)"
ROLLING_CORR = f"""WITH {WALK}, pairs AS (SELECT p.date, p.ret AS x0, q.ret AS y0 FROM walk p JOIN walk q ON p.date = q.date AND p.asset_key = 'A' AND q.asset_key = 'N'),
both_known AS (SELECT date, CASE WHEN y0 IS NOT NULL THEN x0 END AS x, CASE WHEN x0 IS NOT NULL THEN y0 END AS y FROM pairs)
SELECT {DAY}, 'A' AS first, 'N' AS second, {r(f"CASE WHEN count(x) OVER {R60} = 60 THEN covar_pop(x, y) OVER {R60} / nullif(stddev_pop(x) OVER {R60} * stddev_pop(y) OVER {R60}, 0) END", "corr")} FROM both_known"""

COMPLETE = """complete AS (SELECT date FROM {t} GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT asset_key) FROM {t}))"""
COMPARATIVE = f"""WITH {OHLC}, {COMPLETE.format(t="ohlc")}, kept AS (SELECT * FROM ohlc WHERE date IN (SELECT date FROM complete))
SELECT asset_key, date, {r(f"ln(product(1 + ret) OVER {U})", "log_growth", 3)} FROM kept"""
GRID = OHLC + """,
grid AS (SELECT k.asset_key, d.date, o.close, o.ret FROM (SELECT DISTINCT asset_key FROM ohlc) k CROSS JOIN (SELECT DISTINCT date FROM ohlc) d
         LEFT JOIN ohlc o ON o.asset_key = k.asset_key AND o.date = d.date)"""
NORMALISED = f"""WITH {GRID}, padded AS (SELECT asset_key, date, {filled("close")} AS p FROM grid),
dense AS (SELECT asset_key, date, p / nullif(lag(p) OVER {W}, 0) - 1 AS ret FROM padded), {COMPLETE.format(t="dense")}, kept AS (SELECT * FROM dense WHERE date IN (SELECT date FROM complete))
SELECT asset_key, date, {r(f"ln(product(1 + ret) OVER {U})", "log_growth", 3)} FROM kept"""
VOL_COMPARE = f"WITH {GRID}, v AS (SELECT *, {vol(20, 'vol')} FROM grid) SELECT asset_key, date, {r('vol')} FROM v"
ALIGNED = f"WITH {WALK} SELECT {DAY}, {', '.join(r(f'''max(ret) FILTER (asset_key = '{k}')''', k) for k in 'ANR')} FROM walk GROUP BY walk.date"
ALIGNED_PRICES = f"WITH {WALK} SELECT {DAY}, {', '.join(r(f'''max(close) FILTER (asset_key = '{k}')''', k) for k in 'ANR')} FROM walk GROUP BY walk.date"


def ewm(source: str, x: str, alpha: float, name: str, out: str, least: int = 1) -> str:
    """CTEs that add out to source, as `name`: a prefix sum of scaled terms."""
    keep = f"{1 - alpha!r}::DOUBLE"
    return f"""{name}_i AS (SELECT *, count({x}) OVER {U} - 1 AS i_{out} FROM {source}),
{name} AS (SELECT *, CASE WHEN i_{out} + 1 >= {least} THEN pow({keep}, i_{out}) * sum({x} * CASE WHEN i_{out} = 0 THEN 1 ELSE {alpha!r}::DOUBLE END * pow({keep}, -i_{out})) OVER {U} END AS {out} FROM {name}_i)"""


MOVING = f"""WITH {WALK}, m AS (SELECT *, {sma(20, "sma_20")}, {sma(50, "sma_50")}, {sma(200, "sma_200")} FROM walk),
{ewm("m", "close", 2 / 21, "m20", "ema_20", 20)}, {ewm("m20", "close", 2 / 51, "m50", "ema_50", 50)}
SELECT asset_key, {DAY}, {rs("sma_20", "sma_50", "sma_200", "ema_20", "ema_50")} FROM m50"""
RSIS = WALK + f""",
moves AS (SELECT *, close - lag(close) OVER {W} AS m FROM walk), sides AS (SELECT *, greatest(m, 0) AS up, greatest(-m, 0) AS down FROM (SELECT * FROM moves WHERE m IS NOT NULL)),
{ewm("sides", "up", 1 / 14, "gains", "g", 14)}, {ewm("gains", "down", 1 / 14, "losses", "l", 14)},
rsis AS (SELECT w.*, CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM walk w LEFT JOIN losses x USING (asset_key, date))"""
RSI = f"WITH {RSIS} SELECT asset_key, {DAY}, {r('rsi')} FROM rsis"
MACD = f"""WITH {WALK}, {ewm("walk", "close", 2 / 13, "a", "f")}, {ewm("a", "close", 2 / 27, "b", "s")}, c AS (SELECT *, f - s AS macd FROM b), {ewm("c", "macd", 0.2, "d", "sig")}
SELECT asset_key, {DAY}, {rs("macd")}, {r("sig", "macd_signal")}, {r("macd - sig", "macd_histogram")} FROM d"""
BOLLINGER = f"""WITH {WALK}, b AS (SELECT *, {sma(20, "mid")}, {gated("close", "stddev_pop(close) OVER {w}", 20, "sd")} FROM walk)
SELECT asset_key, {DAY}, {r("mid", "bb_middle")}, {r("mid + 2 * sd", "bb_upper")}, {r("mid - 2 * sd", "bb_lower")}, {r("(mid + 2 * sd - (mid - 2 * sd)) / nullif(mid, 0)", "bb_width")} FROM b"""
ATR = f"""WITH {OHLC}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS true_range FROM ohlc),
{ewm("t", "true_range", 1 / 14, "a", "atr", 14)} SELECT asset_key, date, {rs("true_range", "atr")} FROM a"""

MA = f"signals AS (SELECT *, CASE WHEN f > s THEN 1.0::DOUBLE ELSE 0.0 END AS signal FROM (SELECT *, {sma(50, 'f')}, {sma(200, 's')} FROM walk))"
LATCH = f"""turns AS (SELECT *, CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 50 THEN 0.0 END AS turn FROM rsis),
signals AS (SELECT *, CASE WHEN rsi IS NULL THEN 0.0::DOUBLE ELSE coalesce({filled("turn")}, 0.0) END AS signal FROM turns)"""
SIGNAL_MA = f"WITH {WALK}, {MA} SELECT asset_key, {DAY}, {r('signal')} FROM signals"
SIGNAL_RSI = f"WITH {RSIS}, {LATCH} SELECT asset_key, {DAY}, {r('signal')} FROM signals"


def run(keys: str = "asset_key") -> str:
    w, u = (x.replace("asset_key", keys) for x in (W, U))
    return f"""d1 AS (SELECT {keys}, date, close, signal, coalesce(close / lag(close) OVER {w} - 1, 0) AS ret, coalesce(lag(signal) OVER {w}, 0) AS position FROM signals),
d2 AS (SELECT *, abs(position - coalesce(lag(position) OVER {w}, 0)) AS turnover FROM d1),
d3 AS (SELECT *, turnover * 0.0007::DOUBLE AS cost, position * ret AS gross_ret, position * ret - turnover * 0.0007::DOUBLE AS net_ret FROM d2),
daily AS (SELECT *, product(1 + net_ret) OVER {u} * 100000 AS equity, product(1 + gross_ret) OVER {u} * 100000 AS gross_equity, product(1 + ret) OVER {u} * 100000 AS benchmark FROM d3)"""


def trades(keys: str = "asset_key") -> str:
    w, u = (x.replace("asset_key", keys) for x in (W, U))
    return f"""t0 AS (SELECT *, coalesce(last_value(CASE WHEN position = 1 THEN true WHEN position = 0 THEN false END IGNORE NULLS) OVER {u}, false) AS on_now FROM daily),
t1 AS (SELECT *, coalesce(lag(on_now) OVER {w}, false) AS was, row_number() OVER {w} AS n FROM t0),
t2 AS (SELECT *, sum(CASE WHEN on_now AND NOT was THEN 1 ELSE 0 END) OVER {u} AS trade_id FROM t1),
trades AS (SELECT {keys}, CAST(trade_id AS BIGINT) AS trade_id, min(date) AS entry_date, max(date) AS exit_date, arg_min(close, date) AS entry_price, arg_max(close, date) AS exit_price,
           max(n) - min(n) AS bars_held, product(1 + net_ret) - 1 AS ret FROM t2 WHERE on_now OR was GROUP BY {keys}, trade_id)"""


def metrics(keys: str = "asset_key", equity: str = "equity", ret: str = "net_ret", name: str = "metrics") -> str:
    u = U.replace("asset_key", keys)
    return f"""{name}_dd AS (SELECT *, {equity} / max({equity}) OVER {u} - 1 AS dd FROM daily),
{name} AS (SELECT {keys}, arg_max({equity}, date) / arg_min({equity}, date) - 1 AS total_return,
           pow(arg_max({equity}, date) / arg_min({equity}, date), 252.0 / (count(*) - 1)) - 1 AS cagr, stddev_samp({ret}) * sqrt(252) AS volatility,
           (avg({ret}) - 0.02::DOUBLE / 252) / nullif(stddev_samp({ret}), 0) * sqrt(252) AS sharpe, min(dd) AS max_drawdown FROM {name}_dd GROUP BY {keys})"""


STATS_OF = """stats_of AS (SELECT {keys}, count(*) AS num_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(ret) AS avg_trade_return,
CASE WHEN sum(ret) FILTER (ret < 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret < 0) WHEN sum(ret) FILTER (ret > 0) > 0 THEN 'inf'::DOUBLE END AS profit_factor
FROM trades GROUP BY {keys})"""
NUMBERS = ("close", "signal", "ret", "position", "turnover", "cost", "gross_ret", "net_ret", "equity", "gross_equity", "benchmark")
FOUR = ", ".join(r(n, digits=4) for n in NUMBERS)
BACKTEST = f"WITH {WALK}, {MA}, {run()} SELECT asset_key, {DAY}, {FOUR} FROM daily"
BACKTEST_RSI = f"WITH {RSIS}, {LATCH}, {run()} SELECT asset_key, {DAY}, {FOUR} FROM daily"
FRACTIONS = f"""signals AS (SELECT *, CASE WHEN n < 8 THEN 1 WHEN n < 14 THEN 0.5 WHEN n < 20 THEN -1 WHEN n < 24 THEN 1 WHEN n = 30 THEN 0.25 ELSE 0 END::DOUBLE AS signal
FROM (SELECT *, row_number() OVER {W} % 40 AS n FROM walk))"""
TRADES_FRACTIONAL = f"""WITH {WALK}, {FRACTIONS}, {run()}, {trades()}
SELECT asset_key, trade_id, CAST(entry_date AS DATE) AS entry_date, CAST(exit_date AS DATE) AS exit_date, {rs("entry_price", "exit_price")}, bars_held, {r("ret")} FROM trades"""
EXECUTION = f"""WITH {WALK}, {MA}, {run()}, {trades()} SELECT asset_key, trade_id, {r("entry_price * 1.0025::DOUBLE", "paid")}, {r("exit_price * 0.9975::DOUBLE", "got")} FROM trades"""
TRADES = f"""WITH {WALK}, {MA}, {run()}, {trades()}
SELECT asset_key, trade_id, CAST(entry_date AS DATE) AS entry_date, CAST(exit_date AS DATE) AS exit_date, {rs("entry_price", "exit_price")}, bars_held, {r("ret")} FROM trades"""
SHOWN = f"{rs('total_return', 'cagr', 'volatility', 'sharpe', 'max_drawdown')}, coalesce(num_trades, 0) AS num_trades, {rs('win_rate', 'avg_trade_return', 'profit_factor')}"
METRICS = f"WITH {WALK}, {MA}, {run()}, {trades()}, {metrics()}, {STATS_OF.format(keys='asset_key')} SELECT asset_key, {SHOWN} FROM metrics LEFT JOIN stats_of USING (asset_key)"
SEGMENT = """walk_parts AS (SELECT *, CASE WHEN CAST(date AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'dev' WHEN CAST(date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'oos' END AS segment FROM walk)"""
KS = "asset_key, segment"
OOS = f"""WITH {WALK}, {SEGMENT}, {MA.replace("asset_key", KS).replace("FROM walk)", "FROM walk_parts WHERE segment IS NOT NULL)")}, {run(KS)}, {trades(KS)}, {metrics(KS)}, {STATS_OF.format(keys=KS)}
SELECT asset_key, segment, {SHOWN} FROM metrics LEFT JOIN stats_of USING (asset_key, segment)"""
KINDS = (("benchmark", "benchmark", "ret"), ("gross", "gross_equity", "gross_ret"), ("net", "equity", "net_ret"))


def by_metric(kind: str) -> str:
    """The nine metrics of a kind, a row each."""
    parts = [f"SELECT asset_key, '{m}' AS metric, '{kind}' AS kind, {m} AS value FROM m_{kind}" for m in ("total_return", "cagr", "volatility", "sharpe", "max_drawdown")]
    for m in ("win_rate", "num_trades", "avg_trade_return", "profit_factor"):
        value = "NULL" if kind == "benchmark" else m
        if m == "num_trades":
            value = "1" if kind == "benchmark" else "coalesce(num_trades, 0)"
        parts.append(f"SELECT asset_key, '{m}', '{kind}', ({value})::DOUBLE FROM m_{kind} LEFT JOIN stats_of USING (asset_key)")
    return " UNION ALL ".join(parts)


METRICS_TABLE = f"""WITH {WALK}, {MA}, {run()}, {trades()}, {", ".join(metrics("asset_key", e, x, f"m_{k}") for k, e, x in KINDS)}, {STATS_OF.format(keys="asset_key")},
listed AS ({" UNION ALL ".join(by_metric(k) for k, _, _ in KINDS)})
SELECT asset_key, metric, {", ".join(r(f"max(value) FILTER (kind = '{k}')", k) for k, _, _ in KINDS)} FROM listed GROUP BY 1, 2"""

QUARTERS = "quarters AS (SELECT CAST(min(o_orderdate) AS DATE) AS date FROM orders GROUP BY date_trunc('quarter', o_orderdate))"
STUDY = f"""{WALK}, {QUARTERS},
rows_of AS (SELECT asset_key, date, close AS price, row_number() OVER {W} AS rn FROM walk),
placed AS (SELECT r.asset_key, CAST(q.date AS TIMESTAMP) AS event_date, max(rn) AS t0 FROM quarters q JOIN rows_of r ON r.date <= q.date GROUP BY 1, 2),
met AS (SELECT p.asset_key, event_date, CAST(rn - t0 AS INTEGER) AS "offset", r.date, price FROM placed p JOIN rows_of r ON r.asset_key = p.asset_key AND rn BETWEEN t0 - 5 AND t0 + 5),
windows AS (SELECT *, price / max(CASE WHEN "offset" = 0 THEN price END) OVER (PARTITION BY asset_key, event_date) - 1 AS cum_ret,
            price / lag(price) OVER (PARTITION BY asset_key, event_date ORDER BY "offset") - 1 AS ret FROM met)"""
EVENT_WINDOWS = f"""WITH {STUDY} SELECT asset_key, CAST(event_date AS DATE) AS event_date, "offset", {DAY}, {rs("price", "cum_ret", "ret")} FROM windows"""
EVENT_STUDY = f"""WITH {STUDY} SELECT asset_key, CAST(event_date AS DATE) AS event_date, {r('max(ret) FILTER ("offset" = 0)', "ret_t0")},
{r('coalesce(product(1 + ret) FILTER ("offset" < 0 AND ret IS NOT NULL), 1) - 1', "ret_pre")}, {r('coalesce(product(1 + ret) FILTER ("offset" > 0), 1) - 1', "ret_post")},
{r('stddev_samp(ret) FILTER ("offset" < 0)', "vol_pre")}, {r('stddev_samp(ret) FILTER ("offset" > 0)', "vol_post")},
{r('arg_max(price, "offset") / arg_min(price, "offset") - 1', "price_move")} FROM windows GROUP BY asset_key, windows.event_date"""
EVENT_PATH = f"""WITH {STUDY} SELECT asset_key, "offset", {r("avg(cum_ret)", "mean_cum_ret")}, count(cum_ret) AS n_events FROM windows GROUP BY 1, 2"""
FED = EVENT_TYPES[0]
EVENTS_IMPORT = f"""WITH {QUARTERS}, months AS (SELECT CAST(min(o_orderdate) AS DATE) AS date FROM orders GROUP BY date_trunc('month', o_orderdate)),
listed AS (SELECT date, 1.0::DOUBLE AS actual, 0 AS s FROM quarters UNION ALL SELECT date, 2.0, 1 FROM months)
SELECT date, 'US' AS country, '{FED}' AS event, NULL::DOUBLE AS expected, arg_min(actual, s) AS actual, NULL::DOUBLE AS previous FROM listed GROUP BY date"""
EVENTS_LATEST = f"WITH {QUARTERS} SELECT date, 'US' AS country, '{FED}' AS event FROM quarters"
EVENTS_SEED = f"""WITH {QUARTERS}, listed AS (SELECT date FROM quarters UNION SELECT unnest([{", ".join(f"DATE '{d}'" for d in FOMC_DATES)}]))
SELECT 'US' AS country, '{FED}' AS event, CAST(year(date) AS INTEGER) AS year, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM listed GROUP BY year(date)"""
EVENTS_LOG = f"""WITH {QUARTERS}, months AS (SELECT CAST(min(o_orderdate) AS DATE) AS date, round(max(o_totalprice), 2) AS actual FROM orders GROUP BY date_trunc('month', o_orderdate)),
listed AS (SELECT date, NULL::DOUBLE AS actual FROM quarters UNION ALL SELECT * FROM months WHERE date NOT IN (SELECT date FROM quarters) UNION ALL SELECT DATE '1995-01-01', 1.0)
SELECT date, 'US' AS country, '{FED}' AS event, NULL::DOUBLE AS expected, actual, NULL::DOUBLE AS previous FROM listed"""

CHANGE = f"{at(0)} / {at(1)} - 1"
TAPE = f"WITH {BACK} SELECT asset_key, {r(at(0), 'last')}, {r(CHANGE, 'change')}, CASE WHEN {CHANGE} > 0 THEN 'up' WHEN {CHANGE} < 0 THEN 'down' ELSE 'flat' END AS direction FROM back GROUP BY 1"
P = "(PARTITION BY asset_key)"
SPARK = f"""WITH {WALK} SELECT asset_key, {DAY}, {r(f"(row_number() OVER {W} - 1) * 260.0::DOUBLE / greatest(count(*) OVER {P} - 1, 1)", "x")},
{r(f"(1 - (close - min(close) OVER {P}) / CASE WHEN max(close) OVER {P} = min(close) OVER {P} THEN 1 ELSE max(close) OVER {P} - min(close) OVER {P} END) * 64.0::DOUBLE", "y")} FROM walk"""


def body(ctes: str) -> str:
    """CTEs without those of WALK."""
    return ctes.removeprefix(WALK).lstrip(",\n ")


PARTS = f"""{WALK}, {body(BACK)}, {body(REALIZED)}, {body(REG)}, {body(TRENDS)},
now_regime AS (SELECT asset_key, arg_max(regime, date) AS regime FROM regimes GROUP BY 1), now_trend AS (SELECT asset_key, arg_max(trend, date) AS trend FROM trends GROUP BY 1)"""
DEEPEST = "printf('deepest drawdown of the window %.1f%%', max_drawdown * 100)"
SAID = f"""concat_ws(' ', asset_key || ': trend is ' || lower(trend) || ' (' || CASE trend WHEN 'Bullish' THEN 'price over SMA50 over SMA200' WHEN 'Bearish' THEN 'price under SMA50 under SMA200' ELSE 'price and averages out of line' END || ').',
  'Volatility regime: ' || regime || '; 20-day volatility ' || coalesce(printf('%.1f%%', vol * 100), '—') || ' a year.',
  printf('RSI(14) at %.0f, ', rsi) || CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END || '.',
  CASE WHEN current_drawdown <= -0.001 THEN printf('%.1f%% from the peak; ', current_drawdown * 100) ELSE 'At or near the peak; ' END || {DEEPEST} || '.',
  printf('%+.1f%% since the start of the year.', ret_ytd * 100))"""
SNAPSHOT = f"""WITH {PARTS}, {body(RSIS)}, {body(STATS)}, y AS (SELECT asset_key, {YTD} AS ret_ytd FROM back GROUP BY 1), now_rsi AS (SELECT asset_key, arg_max(rsi, date) AS rsi FROM rsis GROUP BY 1)
SELECT asset_key, trend, regime, {rs("rsi", "ret_ytd", "max_drawdown", "current_drawdown")}, {r("vol", "vol_20d")},
       CAST(2 + CAST(rsi IS NOT NULL AS INTEGER) + CAST(current_drawdown IS NOT NULL AS INTEGER) + CAST(ret_ytd IS NOT NULL AS INTEGER) AS INTEGER) AS n_observations, {SAID} AS said
FROM now_trend JOIN now_regime USING (asset_key) JOIN now_rsi USING (asset_key) JOIN y USING (asset_key) JOIN stats USING (asset_key) JOIN realized USING (asset_key)"""
OVERVIEW = f"""WITH {PARTS}, t AS (SELECT asset_key, {at(0)} AS price, {", ".join(f"{at(0)} / {at(n)} - 1 AS ret_{n}" for n in (1, 5, 21))}, {YTD} AS ret_ytd FROM back GROUP BY 1)
SELECT asset_key, {rs("price", "ret_1", "ret_5", "ret_21", "ret_ytd")}, {r("vol", "vol_20d")}, trend, regime
FROM t JOIN realized USING (asset_key) JOIN now_trend USING (asset_key) JOIN now_regime USING (asset_key)"""
STREAM_BARS = f"WITH {HOURS} SELECT asset_key, date, {rs('open', 'high', 'low', 'close')}, {r('close', 'adj_close')}, {r('volume')} FROM hours"
LISTED = """listed(asset_key, name, asset_class, display_order) AS (VALUES ('A', 'Alpha', 'Equity Index', 0), ('Z', 'Zeta', 'Commodity', 1), ('N', 'Nu', 'FX', 2))"""
OVERVIEW_NAMED = OVERVIEW.replace("WITH ", f"WITH {LISTED}, ", 1).replace(", trend, regime\nFROM", ", trend, regime, coalesce(name, asset_key) AS name, asset_class, display_order\nFROM") + " LEFT JOIN listed USING (asset_key)"
CARDS = f"SELECT asset_key, name, price, ret_1 FROM ({OVERVIEW_NAMED}) ORDER BY display_order NULLS LAST, asset_key LIMIT 2"
LOOKUP = """SELECT CAST(p_partkey AS VARCHAR) AS asset_key, 'class' AS by FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'all' FROM part"""
LOADED = f"""WITH {RAW}, kept AS (SELECT asset_key, date, {filled("close")} AS close FROM staged WHERE kept AND asset_key IN ('click', 'view'))
SELECT asset_key, date, {r("close")}, {r(f"CASE WHEN lag(close) OVER {W} <> 0 THEN close / lag(close) OVER {W} - 1 END", "ret")} FROM kept"""
LOAD_ERRORS = f"WITH {RAW} SELECT asset_key, 'no usable rows' AS error FROM (VALUES ('click'), ('view'), ('missing')) AS v(asset_key) WHERE asset_key NOT IN (SELECT asset_key FROM staged WHERE kept)"
IN_RANGE = f"WITH {HOURS} SELECT asset_key, count(*) AS n, min(date) AS first, max(date) AS last FROM hours WHERE date >= DATE '2015-01-01' AND date < current_date + 1 GROUP BY 1"
PROVIDER = f"WITH {HOURS} SELECT asset_key, date, {rs('open', 'close')}, {r('close', 'adj_close')}, {r('volume')} FROM hours"
EVENTS_ADDED = f"""WITH {QUARTERS} SELECT date, 'US' AS country, '{FED}' AS event, NULL::DOUBLE AS expected, NULL::DOUBLE AS actual, NULL::DOUBLE AS previous FROM quarters
UNION ALL SELECT DATE '2030-01-02', NULL, 'US CPI', 0.2, 0.3, NULL"""
EVENT_KINDS = "SELECT DISTINCT event_type AS event FROM events"
TEXTS = f"""WITH {WALK}, rounded AS (SELECT asset_key, {DAY}, close, round(ret, 9) + 0.0 AS ret FROM walk)
SELECT asset_key, date, coalesce(printf('%+.2f%%', ret * 100), '—') AS change, format('{{:,.2f}}', round(close * 100, 6)) AS price,
       CASE WHEN day(date) = 1 THEN '∞' ELSE coalesce(printf('%.2f', ret * 7), '—') END AS factor,
       CASE WHEN ret > 0 THEN 'up' WHEN ret < 0 THEN 'down' ELSE 'flat' END AS moved FROM rounded"""

LONG_SERIES = f"""WITH ticks AS (SELECT 'ALL' AS asset_key, CAST(l_shipdate AS TIMESTAMP) + to_seconds(l_orderkey % 86400) AS date,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)) AS close FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER {W} AS k FROM ticks),
windows AS (SELECT *, close / first_value(close) OVER {U} - 1 AS cum_ret, max(close) OVER {U} AS peak, {sma(200, "sma_200")},
  list(close) OVER (PARTITION BY asset_key ORDER BY date ROWS 399 PRECEDING) AS recent FROM placed),
means AS (SELECT *, CASE WHEN k >= 20 THEN list_sum(list_transform(recent, lambda x, i: x * CASE WHEN i = 1 THEN 1.0 ELSE 2.0 / 21 END * pow(19.0 / 21, len(recent) - i))) END AS ema FROM windows)
SELECT date, {r("cum_ret", digits=4)}, {r("peak", digits=4)}, {r("close / peak - 1", "drawdown", 4)}, {r("sma_200", digits=4)}, {r("ema", digits=4)} FROM means"""
ASOF = """WITH placed AS (SELECT o_custkey AS user_id, TIMESTAMP '2024-01-01' + to_seconds(1080 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS placed_at,
  max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
met AS (SELECT event_id, ts, p.o_orderkey AS prior, p.placed_at AS prior_at FROM events e ASOF LEFT JOIN placed p ON e.user_id = p.user_id AND e.ts >= p.placed_at),
after AS (SELECT event_id, p.o_orderkey AS next FROM events e ASOF LEFT JOIN placed p ON e.user_id = p.user_id AND e.ts < p.placed_at),
upto AS (SELECT event_id, p.o_orderkey AS k, p.placed_at FROM events e ASOF LEFT JOIN placed p ON e.user_id = p.user_id AND e.ts <= p.placed_at),
both_near AS (SELECT event_id, prior, next, CASE WHEN epoch_us(ts) - epoch_us(prior_at) <= 21600000000 THEN epoch_us(ts) - epoch_us(prior_at) END AS a,
  CASE WHEN epoch_us(placed_at) - epoch_us(ts) <= 21600000000 THEN epoch_us(placed_at) - epoch_us(ts) END AS b, k FROM met JOIN after USING (event_id) JOIN upto USING (event_id))
SELECT event_id, prior, next, CASE WHEN b IS NOT NULL AND (a IS NULL OR b < a) THEN k WHEN a IS NOT NULL THEN prior END AS near FROM both_near"""
CORR_WIDE = f"""WITH walk AS (SELECT CAST(l_suppkey AS VARCHAR) AS asset_key, date_trunc('week', l_shipdate) AS date, sum(round(l_discount * 100)) AS ret FROM lineitem GROUP BY 1, 2),
{PAIRS}, half AS (SELECT a, b, {PEARSON} AS corr, count(*) AS n FROM pairs GROUP BY 1, 2), {MIRROR} SELECT a, b, {r("corr")}, n FROM whole"""
SNAPSHOTS = f"""WITH {HOURS} SELECT asset_key, how, count(*) AS n, {r("max(high)", "high")}, {r("sum(volume)", "volume")}
FROM hours, (VALUES ('fresh'), ('stale')) kinds(how) GROUP BY 1, 2"""
STORED = f"""WITH {WALK}, part AS (SELECT * FROM walk WHERE asset_key IN ('A', 'N') AND date >= DATE '1996-03-01' AND date < DATE '1998-11-01')
SELECT asset_key, {DAY}, {r("close")}, {r(f"product(1 + coalesce(ret, 0)) OVER {U} - 1", "cum_ret")} FROM part"""
LOAD_ASSET = f"""WITH {RAW}, counters AS (SELECT asset_key, count(*) AS rows_in, count(*) FILTER (kept) AS rows_out, count(*) FILTER (again) AS duplicates_removed,
  CAST(sum(CASE WHEN kept THEN CAST(open IS NULL AS INTEGER) ELSE 0 END) AS BIGINT) AS missing_filled, count(*) FILTER (bad) AS invalid_ohlc_rows,
  max(date) FILTER (kept) AS date, arg_max(close, date) FILTER (kept) AS close FROM staged GROUP BY 1)
SELECT asset_key, rows_in, rows_out, duplicates_removed, missing_filled, invalid_ohlc_rows, date, {r("close")}, from_cache, false AS stale
FROM counters JOIN (VALUES ('click', false), ('view', false), ('click', true)) loads(key, from_cache) ON asset_key = key"""
STRATEGY = f"""WITH {WALK}, s AS (SELECT *, CASE WHEN close > avg(close) OVER {U} THEN 1.0 ELSE 0.0 END AS signal FROM walk),
p AS (SELECT *, coalesce(lag(signal) OVER {W}, 0) AS position, coalesce(close / lag(close) OVER {W} - 1, 0) AS r0 FROM s),
t AS (SELECT *, position * r0 - abs(position - coalesce(lag(position) OVER {W}, 0)) * 0.0007 AS net FROM p)
SELECT asset_key, {DAY}, signal, position, {r(f"100000 * product(1 + net) OVER {U}", "equity", 4)} FROM t"""
