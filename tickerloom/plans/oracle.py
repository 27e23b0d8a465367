"""The registered queries restated as SQL, as a second opinion on their results.

Each statement is assembled from named common table expressions.  Recursive
averages are recursive CTEs here, ranks and quantiles are plain window
functions, so the two sides share definitions but not methods.
"""

from __future__ import annotations

from tickerloom.plans.fixtures import PRICE_SQL, SYMBOL_SQL

BY = "PARTITION BY symbol ORDER BY date"


def roll(fn: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    w = f"({BY} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"
    return f"CASE WHEN count({x}) OVER {w} >= {n if least is None else least} THEN {fn}({x}) OVER {w} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def div_or(a: str, b: str, z: float) -> str:
    return f"CASE WHEN ({b}) = 0 THEN {z} ELSE ({a}) / nullif({b}, 0) END"


def chg(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0) - 1.0) * 100.0"


def yes(c: str) -> str:
    return f"coalesce({c}, false)"


def bit(c: str) -> str:
    return f"CAST(coalesce({c}, false) AS BIGINT)"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


def rounded(names: str, source: str, tail: str = "") -> str:
    """SELECT list: plain names pass through, names ending in ~ are rounded, # become BIGINT."""
    out = []
    for n in names.split():
        if n.endswith("~"):
            out.append(f"{r4(n[:-1])} AS {n[:-1]}")
        elif n.endswith("#"):
            out.append(f"CAST({n[:-1]} AS BIGINT) AS {n[:-1]}")
        else:
            out.append(n)
    return f"SELECT {', '.join(out)} FROM {source} {tail}"


def _bars(price: str) -> str:
    return f"""trades AS (
  SELECT {SYMBOL_SQL.format(text="VARCHAR")} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         CAST({PRICE_SQL[price]} AS DOUBLE) AS px, l_quantity AS q, l_extendedprice AS a,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
bars0 AS (
  SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(q) AS volume, sum(a) AS amount, symbol || '.txt' AS file FROM trades GROUP BY symbol, date),
bars AS (SELECT *, row_number() OVER ({BY}) AS bar FROM bars0)"""


KLINE = f"""kline AS (
  SELECT *, {chg('close', 'prev_close')} AS daily_return_pct, {chg('close', 'open')} AS intraday_return_pct,
         {div('high - low', 'prev_close')} * 100.0 AS amplitude_pct, {div('close - open', 'prev_close')} * 100.0 AS body_pct,
         abs({div('close - open', 'prev_close')} * 100.0) AS body_abs_pct,
         {div('high - greatest(open, close)', 'prev_close')} * 100.0 AS upper_shadow_pct,
         {div('least(open, close) - low', 'prev_close')} * 100.0 AS lower_shadow_pct,
         {bit('close > open')} AS is_red_k, {bit('close < open')} AS is_green_k, {bit('close = open')} AS is_flat_k
  FROM (SELECT *, lag(close) OVER ({BY}) AS prev_close, lag(volume) OVER ({BY}) AS prev_volume FROM bars))"""

_hh4, _ll4 = roll("max", "high", 4), roll("min", "low", 4)
FACTS = f"""facts AS (
  SELECT *, {', '.join(f"{roll('avg', 'close', w, max(1, w // 3))} AS ma{w}" for w in (5, 10, 20, 60))},
         {', '.join(f"{roll('avg', 'volume', w, max(1, w // 3))} AS volume_ma{w}" for w in (5, 10))},
         {', '.join(f"{roll('avg', 'close', w, w)} AS fma{w}" for w in (3, 5, 6, 10, 12, 20, 24, 60))},
         {', '.join(f"{roll('avg', 'volume', w, w)} AS fvolume_ma{w}" for w in (5, 10))},
         ({' + '.join('(' + roll('avg', 'close', w, 1) + ')' for w in (5, 10, 20, 60))}) / 4.0 AS z_long_trend_line,
         {roll('max', 'high', 9, 3)} AS hh9l, {roll('min', 'low', 9, 3)} AS ll9l,
         {roll('max', 'high', 9)} AS hh9, {roll('min', 'low', 9)} AS ll9,
         {_hh4} AS hh4, {_ll4} AS ll4,
         {roll('min', 'low', 20, 6, 1)} AS previous_20d_low,
         {roll('max', 'high', 60, 20)} AS range_60d_high, {roll('min', 'low', 60, 20)} AS range_60d_low,
         {roll('max', 'high', 20)} AS rh20, {roll('min', 'low', 20)} AS rl20, {roll('min', 'low', 20, 20, 1)} AS pnlow,
         {roll('max', 'high', 20, 20, 20)} AS rh20b, {roll('min', 'low', 20, 20, 20)} AS rl20b
  FROM kline)"""

INPUTS = f"""inputs AS (
  SELECT *, {div('volume', 'prev_volume')} AS volume_ratio_prev1,
         {div('volume', 'volume_ma5')} AS volume_ratio_ma5, {div('volume', 'volume_ma10')} AS volume_ratio_ma10,
         {chg('close', 'previous_20d_low')} AS close_to_previous_20d_low_pct, {chg('low', 'previous_20d_low')} AS low_to_previous_20d_low_pct,
         {chg('close', 'ma20')} AS close_to_ma20_pct, {chg('close', 'ma60')} AS close_to_ma60_pct,
         {chg('range_60d_high', 'range_60d_low')} AS range_60d_pct,
         {div('close - range_60d_low', 'range_60d_high - range_60d_low')} * 100.0 AS close_position_60d_pct,
         {bit('rh20 < rh20b * 0.99 AND rl20 < rl20b * 0.97')} AS b1_structure_downtrend_20,
         CASE WHEN hh9l - ll9l <> 0 THEN greatest(0.0, least(100.0, (close - ll9l) / (hh9l - ll9l) * 100.0)) END AS rsv_loose,
         ({div_or('close - ll9', 'hh9 - ll9', 0.0)}) * 100.0 AS rsv_strict,
         {div('hh4 - close', 'hh4 - ll4')} * 100.0 - 90.0 AS from_top, {div('close - ll4', 'hh4 - ll4')} * 100.0 AS from_bottom
  FROM facts)"""


def _ew(prev: str, x: str, span: int) -> str:
    return f"({x} * 2.0 / {span + 1}.0 + {prev} * {span - 1}.0 / {span + 1}.0)"


def _hold(prev: str, x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN {prev} WHEN {prev} IS NULL THEN {x} ELSE ({x} + {n - 1}.0 * {prev}) / {n}.0 END"


RECURSION = f"""rec AS (
  SELECT symbol, bar, close AS e12, close AS e26, CAST(0.0 AS DOUBLE) AS dea, close AS z1, close AS z2, close AS zsl,
         CAST(rsv_loose AS DOUBLE) AS kl, CAST(1.0 AS DOUBLE) AS kl_old, CAST(rsv_loose AS DOUBLE) AS dl,
         CAST(rsv_strict AS DOUBLE) AS ks, CAST(rsv_strict AS DOUBLE) AS ds,
         CAST(from_top AS DOUBLE) AS bd, CAST(from_bottom AS DOUBLE) AS bm, CAST(from_bottom AS DOUBLE) AS bu
  FROM inputs WHERE bar = 1
  UNION ALL
  SELECT symbol, bar, n12, n26, {_ew('dea', '(n12 - n26)', 9)}, nz1, {_ew('z2', 'nz1', 10)}, nzsl, nkl, nold,
         {_hold('dl', 'nkl', 3)}, nks, {_hold('ds', 'nks', 3)}, nbd, nbm, {_hold('bu', 'nbm', 6)}
  FROM (
    SELECT i.symbol, i.bar, {_ew('r.e12', 'i.close', 12)} AS n12, {_ew('r.e26', 'i.close', 26)} AS n26, r.dea,
           {_ew('r.z1', 'i.close', 10)} AS nz1, r.z2, {_ew('r.zsl', 'i.close', 21)} AS nzsl,
           CASE WHEN i.rsv_loose IS NULL THEN r.kl WHEN r.kl IS NULL THEN i.rsv_loose
                ELSE (r.kl_old * (2.0 / 3.0) * r.kl + i.rsv_loose / 3.0) / (r.kl_old * (2.0 / 3.0) + 1.0 / 3.0) END AS nkl,
           CASE WHEN i.rsv_loose IS NULL THEN r.kl_old * (2.0 / 3.0) ELSE 1.0 END AS nold, r.dl,
           {_hold('r.ks', 'i.rsv_strict', 3)} AS nks, r.ds,
           {_hold('r.bd', 'i.from_top', 4)} AS nbd, {_hold('r.bm', 'i.from_bottom', 6)} AS nbm, r.bu
    FROM rec r JOIN inputs i ON i.symbol = r.symbol AND i.bar = r.bar + 1))"""

TABLE = f"""tab AS (
  SELECT i.*, e12 - e26 AS macd_dif, dea AS macd_dea, e12 - e26 - dea AS macd_hist,
         CASE WHEN (bu + 100.0) - (bd + 100.0) > 4 THEN (bu + 100.0) - (bd + 100.0) - 4 ELSE 0.0 END AS renko_value,
         z2 AS z_short_trend_line, zsl, kl AS kdj_k, dl AS kdj_d, 3.0 * kl - 2.0 * dl AS kdj_j,
         ks, ds, 3.0 * ks - 2.0 * ds AS js
  FROM inputs i JOIN rec USING (symbol, bar))"""

_H = range(1, 21)
LABELS = f"""lab0 AS (
  SELECT symbol, date, close AS c0, {', '.join(f"lead(date, {h}) OVER ({BY}) AS t{h}_date, lead(open, {h}) OVER ({BY}) AS t{h}_open, lead(high, {h}) OVER ({BY}) AS t{h}_high, lead(low, {h}) OVER ({BY}) AS t{h}_low, lead(close, {h}) OVER ({BY}) AS t{h}_close" for h in _H)}
  FROM bars),
lab AS (
  SELECT * EXCLUDE (c0), {', '.join(f"CASE WHEN t1_open > 0 THEN (t{h}_close / t1_open - 1.0) * 100.0 END AS fwd_return_pct_T{h}" for h in _H)},
         {', '.join(f"CASE WHEN t1_open > 0 THEN t{h}_close > t1_open END AS fwd_up_T{h}" for h in _H)},
         CASE WHEN t1_date IS NULL OR NOT coalesce(t1_open > 0, false) OR t1_close IS NULL THEN 'missing_t1'
              WHEN t20_date IS NULL OR t20_close IS NULL THEN 'partial_missing' ELSE 'ok' END AS forward_data_status
  FROM lab0)"""

STAGE = f"""stage AS (
  SELECT *, {bit('kdj_j < 14')} AS b1_j_low, lag(kdj_j) OVER ({BY}) AS b1_tminus1_j,
         {bit('low >= previous_20d_low * 0.98 AND close >= previous_20d_low')} AS b1_not_break_previous_20d_low,
         {bit('ma20 > ma60 AND close_to_ma60_pct >= -3 AND close_to_ma20_pct <= 3')} AS is_uptrend_pullback,
         {bit('range_60d_pct <= 35 AND close_position_60d_pct <= 35')} AS is_range_low,
         {chg('close', 'z_short_trend_line')} AS t0_close_to_z_short_trend_line_pct,
         {chg('close', 'z_long_trend_line')} AS t0_close_to_z_long_trend_line_pct,
         CAST(z_short_trend_line > z_long_trend_line AS BIGINT) AS z_short_trend_above_z_long_trend_line
  FROM tab),
b1v0 AS (SELECT *, {bit("b1_not_break_previous_20d_low = 1 AND (is_uptrend_pullback = 1 OR is_range_low = 1)")} AS b1_stage_low_valid,
         'b1_stage_low_select_strategy_v0' AS selection_strategy FROM stage JOIN lab USING (symbol, date) WHERE b1_j_low = 1),
b1v1 AS (SELECT * REPLACE ('b1_stage_low_select_strategy_v1' AS selection_strategy) FROM b1v0 WHERE b1_structure_downtrend_20 = 0)"""

CONFIRM = f"""cf0 AS (
  SELECT * EXCLUDE (ma5, ma10, ma20, ma60, volume_ma5, volume_ma10, volume_ratio_ma5, volume_ratio_ma10, kdj_k, kdj_d, kdj_j, macd_hist),
         fma5 AS ma5, fma10 AS ma10, fma20 AS ma20, fma60 AS ma60, fvolume_ma5 AS volume_ma5, fvolume_ma10 AS volume_ma10,
         {div('volume', 'fvolume_ma5')} AS volume_ratio_ma5, {div('volume', 'fvolume_ma10')} AS volume_ratio_ma10,
         ks AS kdj_k, ds AS kdj_d, js AS kdj_j, macd_hist * 2.0 AS macd_hist,
         (fma3 + fma6 + fma12 + fma24) / 4.0 AS bbi,
         CASE WHEN bar >= 20 THEN (SELECT count(*) FROM bars p WHERE p.symbol = tab.symbol AND p.bar BETWEEN tab.bar - 19 AND tab.bar AND p.volume >= tab.volume) END AS lowvc
  FROM tab),
cf1 AS (
  SELECT *, {div_or('rh20 - rl20', 'rl20', 999.0)} AS rw20, {div_or('close - rl20', 'rh20 - rl20', 999.0)} AS pos20,
         {div_or('close - pnlow', 'pnlow', 999.0)} AS dplow, {div_or('abs(close - ma20)', 'ma20', 999.0)} AS dma20,
         {div_or('abs(close - bbi)', 'bbi', 999.0)} AS dbbi, {div_or('abs(close - zsl)', 'zsl', 999.0)} AS dzsl,
         {div_or('high - greatest(open, close)', 'high - low', 999.0)} AS upsh FROM cf0),
cf2 AS (
  SELECT *, ({yes('pos20 <= 0.25')} OR {yes('abs(dplow) <= 0.02')} OR {yes('dma20 <= 0.02')} OR {yes('dbbi <= 0.02')} OR {yes('dzsl <= 0.02')})
         AND {yes('kdj_j <= 14')} AND ({yes('lowvc >= 16')} OR {yes('volume_ratio_ma5 <= 0.70')})
         AND {yes('low >= pnlow * 0.98')} AND {yes('close >= pnlow')} AS sig FROM cf1),
cf3 AS (
  SELECT *, coalesce(bool_or(sig) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS recent,
         max(CASE WHEN sig THEN bar END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sig_bar,
         max(CASE WHEN sig THEN date END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b1_date FROM cf2)"""

FROM_POOL = f"""b1marks AS (SELECT symbol, date, true AS b1 FROM b1v1),
fp AS (
  SELECT t.*, max(CASE WHEN b1 THEN bar END) OVER (PARTITION BY t.symbol ORDER BY t.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b1_bar,
         max(CASE WHEN b1 THEN t.date END) OVER (PARTITION BY t.symbol ORDER BY t.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b1_date
  FROM tab t LEFT JOIN b1marks m ON m.symbol = t.symbol AND m.date = t.date)"""

_CHAIN = [KLINE, FACTS, INPUTS, RECURSION, TABLE]


def query(final: str, *ctes: str, price: str = "wide", chain: bool = False, labels: bool = False) -> str:
    parts = [_bars(price)]
    parts += _CHAIN if chain else []
    parts += [LABELS] if labels else []
    return "WITH RECURSIVE " + ",\n".join([*parts, *ctes]) + "\n" + final


def pool_query(final: str, *ctes: str, price: str = "narrow") -> str:
    return query(final, STAGE, *ctes, price=price, chain=True, labels=True)


# --------------------------------------------------------------------------
# factor analysis
# --------------------------------------------------------------------------

def factor_rows(factors, targets, source: str = "b1v0") -> str:
    xs = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, '{t}' AS target_col, CAST({f} AS DOUBLE) AS x, CAST({t} AS DOUBLE) AS y, date, symbol FROM {source} WHERE {f} IS NOT NULL AND {t} IS NOT NULL"
        for f in factors for t in targets
    )
    return f"fr AS ({xs})"


def detected_rows(candidates, targets, source: str = "b1g") -> str:
    """``fr`` over the candidates that are factors: enough numbers and at least two values."""
    def listed(names, key: str, value: str) -> str:
        return "[" + ", ".join(f"{{'{key}': '{c}', '{value}': CAST({c} AS DOUBLE)}}" for c in names) + "]"

    return f"""b1g AS (SELECT *, CASE WHEN close > 0 THEN {chg('t1_open', 'close')} END AS t1_open_gap_pct FROM b1v0),
fl AS (SELECT symbol, date, {listed(targets, 'target_col', 'y')} AS ys, unnest({listed(candidates, 'factor', 'x')}) AS f FROM {source}),
seen AS (SELECT f.factor AS factor FROM fl GROUP BY 1 HAVING count(f.x) >= 0.3 * count(*) AND min(f.x) < max(f.x)),
ft AS (SELECT f.factor AS factor, f.x AS x, date, symbol, unnest(ys) AS t FROM fl WHERE f.x IS NOT NULL AND f.factor IN (SELECT factor FROM seen)),
fr AS (SELECT factor, t.target_col AS target_col, x, t.y AS y, date, symbol FROM ft WHERE t.y IS NOT NULL)"""


def quantile_at(k: int, q: int, x: str = "x", no: str = "no", n: str = "n") -> str:
    low = f"((({n}) - 1) * {k}) // {q}"
    rest = f"((({n}) - 1) * {k}) % {q}"
    lo = f"max(CASE WHEN {no} - 1 = {low} THEN {x} END)"
    hi = f"max(CASE WHEN {no} - 1 = {low} + CASE WHEN {rest} > 0 THEN 1 ELSE 0 END THEN {x} END)"
    return f"({lo} + ({hi} - {lo}) * (max({rest}) / {float(q)}))"


def median(x: str, cond: str = "true") -> str:
    return f"median(CASE WHEN {cond} THEN {x} END)"


def cuts(keys: str, q: int, source: str = "fr") -> str:
    edges = ", ".join(quantile_at(k, q) for k in range(q + 1))
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS no, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
cuts AS (
  SELECT {keys}, count(*) AS sample_count, count(DISTINCT x) AS distinct_count, list_sort(list(DISTINCT x)) AS levels,
         list_distinct([{edges}]) AS edges FROM numbered GROUP BY {keys})"""


BUCKETED = """bucketed AS (
  SELECT r.*, c.distinct_count, CASE WHEN c.distinct_count <= {q} THEN len(list_filter(c.levels, lambda v: v <= r.x))
         ELSE greatest(1, len(list_filter(c.edges, lambda v: v < r.x))) END AS bucket
  FROM fr r JOIN cuts c USING ({keys}) WHERE c.sample_count >= {least} AND c.distinct_count >= 2)"""

DETAIL = """detail AS (
  SELECT factor, target_col, bucket, count(*) AS sample_count, min(x) AS min_factor, max(x) AS max_factor, avg(x) AS mean_factor,
         avg(y) AS mean_return, median(y) AS median_return, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS up_ratio,
         count(*) FILTER (WHERE y > 0) AS win_count, count(*) FILTER (WHERE y <= 0) AS loss_count
  FROM bucketed GROUP BY factor, target_col, bucket)"""

IC = """ranked AS (
  SELECT factor, target_col, x, y, rank() OVER (PARTITION BY factor, target_col ORDER BY x) + (count(*) OVER (PARTITION BY factor, target_col, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY factor, target_col ORDER BY y) + (count(*) OVER (PARTITION BY factor, target_col, y) - 1) / 2.0 AS ry FROM fr),
ic AS (SELECT factor, target_col, count(*) AS n, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS spearman_ic, corr(x, y) AS pearson_ic FROM ranked GROUP BY factor, target_col)"""

SHAPE = """s0 AS (
  SELECT factor, target_col, count(*) AS bucket_count_actual, min(bucket) AS bottom_bucket, max(bucket) AS top_bucket,
         arg_min(mean_return, bucket) AS bottom_mean_return, arg_max(mean_return, bucket) AS top_mean_return,
         arg_min(up_ratio, bucket) AS bottom_up_ratio, arg_max(up_ratio, bucket) AS top_up_ratio,
         arg_max(bucket, row(mean_return, -bucket)) AS best_bucket, arg_min(bucket, row(mean_return, bucket)) AS worst_bucket,
         max(mean_return) AS best_bucket_mean_return, min(mean_return) AS worst_bucket_mean_return,
         arg_max(up_ratio, row(mean_return, -bucket)) AS best_bucket_up_ratio, arg_min(up_ratio, row(mean_return, bucket)) AS worst_bucket_up_ratio
  FROM detail GROUP BY factor, target_col HAVING count(*) >= 2),
s1 AS (
  SELECT s0.*, (SELECT avg(mean_return) FROM detail d WHERE d.factor = s0.factor AND d.target_col = s0.target_col
                AND (s0.bucket_count_actual < 3 OR (d.bucket > s0.bottom_bucket AND d.bucket < s0.top_bucket))) AS middle_mean_return,
         (SELECT avg(up_ratio) FROM detail d WHERE d.factor = s0.factor AND d.target_col = s0.target_col
                AND (s0.bucket_count_actual < 3 OR (d.bucket > s0.bottom_bucket AND d.bucket < s0.top_bucket))) AS middle_up_ratio FROM s0),
s2 AS (
  SELECT s1.*, c.sample_count, c.distinct_count, ic.spearman_ic, ic.pearson_ic,
         top_mean_return - bottom_mean_return AS top_minus_bottom_return, top_up_ratio - bottom_up_ratio AS top_minus_bottom_up_ratio,
         top_mean_return - middle_mean_return AS top_vs_middle_return, top_up_ratio - middle_up_ratio AS top_vs_middle_up_ratio,
         bottom_mean_return - middle_mean_return AS bottom_vs_middle_return, bottom_up_ratio - middle_up_ratio AS bottom_vs_middle_up_ratio,
         best_bucket_mean_return - worst_bucket_mean_return AS best_minus_worst_return, best_bucket_up_ratio - worst_bucket_up_ratio AS best_minus_worst_up_ratio
  FROM s1 JOIN cuts c USING (factor, target_col) LEFT JOIN ic USING (factor, target_col)),
s3 AS (
  SELECT *, CASE WHEN spearman_ic > 0.005 THEN 1 WHEN spearman_ic < -0.005 THEN -1 ELSE 0 END AS vote_spearman,
         CASE WHEN pearson_ic > 0.005 THEN 1 WHEN pearson_ic < -0.005 THEN -1 ELSE 0 END AS vote_pearson,
         CASE WHEN top_minus_bottom_return > 0.05 THEN 1 WHEN top_minus_bottom_return < -0.05 THEN -1 ELSE 0 END AS vote_tail_return,
         CASE WHEN top_minus_bottom_up_ratio > 0.005 THEN 1 WHEN top_minus_bottom_up_ratio < -0.005 THEN -1 ELSE 0 END AS vote_tail_up_ratio,
         vote_spearman + vote_pearson + vote_tail_return + vote_tail_up_ratio AS monotonic_votes,
         (top_vs_middle_return < -0.05 OR top_vs_middle_up_ratio < -0.005 OR worst_bucket = bucket_count_actual) AS top_bad,
         (bottom_vs_middle_return < -0.05 OR bottom_vs_middle_up_ratio < -0.005 OR worst_bucket = 1) AS bottom_bad,
         best_minus_worst_return > 0.05 AS spread, best_bucket > 1 AND best_bucket < bucket_count_actual AS mid FROM s2),
s4 AS (
  SELECT *, CASE WHEN monotonic_votes >= 3 THEN 'higher_better' WHEN monotonic_votes <= -3 THEN 'lower_better' ELSE 'mixed_or_weak' END AS monotonic_bias, CASE
    WHEN distinct_count = 2 AND ((top_minus_bottom_return > 0.05 AND NOT top_minus_bottom_up_ratio < -0.005) OR (top_minus_bottom_up_ratio > 0.005 AND NOT top_minus_bottom_return < -0.05)) THEN 'binary_true_better'
    WHEN distinct_count = 2 AND ((top_minus_bottom_return < -0.05 AND NOT top_minus_bottom_up_ratio > 0.005) OR (top_minus_bottom_up_ratio < -0.005 AND NOT top_minus_bottom_return > 0.05)) THEN 'binary_false_better'
    WHEN distinct_count = 2 THEN 'binary_no_clear_edge'
    WHEN monotonic_votes >= 3 AND NOT top_bad THEN 'higher_better'
    WHEN monotonic_votes <= -3 AND NOT bottom_bad THEN 'lower_better'
    WHEN spread AND mid AND top_bad AND bottom_bad THEN 'middle_both'
    WHEN spread AND top_bad THEN 'high_extreme_risk'
    WHEN spread AND bottom_bad THEN 'low_extreme_risk'
    WHEN spread AND mid THEN 'middle_plain'
    ELSE 'weak_or_unclear' END AS shape FROM s3)"""


def described(shapes: dict[str, tuple[str, str, str]], order: list[str], columns: str) -> str:
    """Rounded summary rows with pattern, hint, side and reason of each shape, and the place in the report."""
    def pick(i: int) -> str:
        return "CASE shape " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in shapes.items()) + " END"

    rank = "CASE bucket_pattern " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(order)) + " END"
    return f"""s5 AS (SELECT * REPLACE (CASE WHEN shape LIKE 'middle%' THEN 'middle_range_best' ELSE shape END AS shape), shape AS bucket_pattern_raw, {pick(0)} AS action_hint, {pick(1)} AS risk_side, {pick(2)} AS pattern_reason FROM s4),
s6 AS ({rounded(columns, "(SELECT *, shape AS bucket_pattern FROM s5)")}),
s7 AS (SELECT *, row_number() OVER (ORDER BY {rank}, best_minus_worst_return DESC NULLS LAST, abs(monotonic_votes) DESC, abs(spearman_ic) DESC NULLS LAST, factor, target_col) AS place FROM s6)"""


def analysis(final: str, candidates, targets, q: int, least: int, *more: str) -> str:
    keys = "factor, target_col"
    return pool_query(final, detected_rows(candidates, targets), cuts(keys, q), BUCKETED.format(q=q, keys=keys, least=least), DETAIL, *more)


def rank_bucket(no: str, n: str, q: str) -> str:
    return f"CASE WHEN {n} = 1 THEN 1 ELSE greatest(1, (({no} - 1) * least({q}, {n}) + {n} - 2) // ({n} - 1)) END"


# --------------------------------------------------------------------------
# alpha
# --------------------------------------------------------------------------

def _lagret(k: int) -> str:
    return chg("close", f"lag(close, {k}) OVER ({BY})")


PANEL = f"""p0 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars_n FROM bars) WHERE bars_n >= 80),
p1 AS (
  SELECT *, {', '.join(f'{_lagret(k)} AS ret_{k}d_pct' for k in (1, 3, 5, 10, 20))},
         {', '.join(f"{roll('avg', 'close', w)} AS ma{w}" for w in (5, 10, 20, 60))},
         {roll('max', 'high', 20)} AS high20, {roll('min', 'low', 20)} AS low20, {roll('avg', 'volume', 20)} AS volume_ma20,
         {', '.join(f"lead(close, {h}) OVER ({BY}) / close - 1.0 AS ret_T{h}" for h in (1, 2, 3))},
         avg({_lagret(1)}) OVER () AS unused FROM p0),
p2 AS (
  SELECT *, close / ma5 AS close_to_ma5, close / ma20 AS close_to_ma20, {div('close - low20', 'high20 - low20')} AS close_pos20,
         {div('volume', 'volume_ma20')} AS volume_ratio20, {roll('stddev_samp', 'ret_1d_pct', 20)} AS volatility20,
         avg(ret_1d_pct) OVER (PARTITION BY date) AS market_ret_1d_pct FROM p1),
panel AS (
  SELECT *, {roll('sum', 'excess_1d_pct', 5)} AS excess_5d_pct, {roll('sum', 'excess_1d_pct', 20)} AS excess_20d_pct
  FROM (SELECT *, ret_1d_pct - market_ret_1d_pct AS excess_1d_pct FROM p2))""".replace(f",\n         avg({_lagret(1)}) OVER () AS unused", "")


def pct_rank(x: str, name: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END AS {name}"
    )


# Other boards are cut before means and ranks.
MAIN_PANEL = PANEL.replace("AS bars_n FROM bars)", "AS bars_n FROM bars WHERE substr(symbol, 1, 2) IN ('00', '60'))", 1)

SCORE = f"""sc0 AS (SELECT *, -volatility20 AS r1, -abs(close_to_ma20 - 1.03) AS r2, -ret_10d_pct AS r3, -ret_3d_pct AS r4, -ret_5d_pct AS r5 FROM panel),
sc1 AS (SELECT *, {pct_rank('r1', 'rank_volatility_contract')}, {pct_rank('r2', 'rank_pullback_ma20')}, {pct_rank('r3', 'rank_cooldown_10d')},
        {pct_rank('r4', 'rank_cooldown_3d')}, {pct_rank('r5', 'rank_cooldown_5d')} FROM sc0),
sc2 AS (SELECT *, CASE WHEN rank_volatility_contract IS NOT NULL THEN 3.0 ELSE 0 END + CASE WHEN rank_pullback_ma20 IS NOT NULL THEN 1.2 ELSE 0 END
        + CASE WHEN rank_cooldown_10d IS NOT NULL THEN 0.3 ELSE 0 END AS wt FROM sc1),
score AS (SELECT *, CASE WHEN wt > 0 THEN (coalesce(rank_volatility_contract, 0) * 3.0 + coalesce(rank_pullback_ma20, 0) * 1.2
        + coalesce(rank_cooldown_10d, 0) * 0.3) / wt * 100.0 END AS alpha_score FROM sc2),
uni AS (SELECT * FROM score WHERE close BETWEEN 3 AND 80 AND bar >= 80 AND alpha_score IS NOT NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY alpha_score DESC, symbol) AS alpha_rank FROM uni) WHERE alpha_rank <= 5)"""

HORIZONS = """flagged AS (
  SELECT u.*, t.symbol IS NOT NULL AS is_top, f.symbol IS NOT NULL AS is_formal FROM uni u
  LEFT JOIN (SELECT DISTINCT date, symbol FROM top) t ON t.date = u.date AND t.symbol = u.symbol
  LEFT JOIN (SELECT DISTINCT date, symbol FROM formal) f ON f.date = u.date AND f.symbol = u.symbol),
hz AS (""" + " UNION ALL ".join(
    f"SELECT date, symbol, 'T{h}' AS horizon, ret_T{h} AS ret, is_top, is_formal FROM flagged WHERE ret_T{h} IS NOT NULL" for h in (1, 2, 3)
) + """),
grid AS (SELECT date, horizon FROM (SELECT DISTINCT date FROM uni), (VALUES ('T1'), ('T2'), ('T3')) v(horizon))"""


def random_ctes(top_n: int, trials: int, seed: int) -> str:
    """Draws by the same hash; the k-th draw takes the last candidate when its pick is taken."""
    steps = []
    pick = "CAST('0x' || substr(md5('{seed}|' || CAST(date AS VARCHAR) || '|' || horizon || '|' || trial || '|' || {k}), 1, 12) AS BIGINT)"
    source = f"(SELECT date, horizon, n, least({top_n}, n) AS size, trial FROM (SELECT date, horizon, count(*) AS n FROM hz GROUP BY date, horizon), (SELECT unnest(range(1, {trials + 1})) AS trial))"
    for k in range(1, top_n + 1):
        taken = "CAST([] AS BIGINT[])" if k == 1 else "nos"
        p = pick.format(seed=seed, k=k) + f" % (n - size + {k}) + 1"
        grown = f"list_append({taken}, CASE WHEN list_contains({taken}, {p}) THEN n - size + {k} ELSE {p} END)"
        cols = "date, horizon, n, size, trial"
        steps.append(f"dr{k} AS (SELECT {cols}, CASE WHEN {k} <= size THEN {grown} ELSE {taken} END AS nos FROM {source})")
        source = f"dr{k}"
    return ",\n".join(steps) + f""",
drawn AS (SELECT date, horizon, trial, size, unnest(nos) AS no FROM dr{top_n}),
nums AS (SELECT date, horizon, ret, row_number() OVER (PARTITION BY date, horizon ORDER BY symbol) AS no FROM hz),
rnd AS (SELECT date, horizon, max(size) AS random_count, avg(m) * 100.0 AS random_avg_return_pct, stddev_pop(m * 100.0) AS random_std_return_pct
  FROM (SELECT d.date, d.horizon, d.trial, max(size) AS size, avg(ret) AS m FROM drawn d JOIN nums x ON x.date = d.date AND x.horizon = d.horizon AND x.no = d.no GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


_G = {"alpha_top": "is_top", "market": "true", "formal_union": "is_formal"}
DAILY = "daily AS (SELECT *, alpha_top_avg_return_pct - market_avg_return_pct AS excess_vs_market_pct, alpha_top_avg_return_pct - random_avg_return_pct AS excess_vs_random_pct, alpha_top_avg_return_pct - formal_union_avg_return_pct AS excess_vs_formal_union_pct, alpha_top_up_ratio - market_up_ratio AS excess_up_ratio_vs_market FROM (SELECT g.date, strftime(g.date, '%Y-%m') AS month, g.horizon, " + ", ".join(
    f"count(ret) FILTER (WHERE {c}) AS {g}_count, count(*) FILTER (WHERE {c} AND ret > 0) AS {g}_up_count, "
    f"avg(CASE WHEN {c} AND ret > 0 THEN 1.0 WHEN {c} AND ret <= 0 THEN 0.0 END) AS {g}_up_ratio, avg(CASE WHEN {c} THEN ret END) * 100.0 AS {g}_avg_return_pct, "
    f"median(CASE WHEN {c} THEN ret END) * 100.0 AS {g}_median_return_pct" for g, c in _G.items()
) + """, max(coalesce(random_count, 0)) AS random_count, max(random_avg_return_pct) AS random_avg_return_pct, max(random_std_return_pct) AS random_std_return_pct
  FROM grid g LEFT JOIN hz ON hz.date = g.date AND hz.horizon = g.horizon LEFT JOIN rnd ON rnd.date = g.date AND rnd.horizon = g.horizon GROUP BY g.date, g.horizon))"""

MONTHLY = """monthly AS (SELECT month, horizon, count(*) AS trading_days, avg(alpha_top_avg_return_pct) AS alpha_top_avg_return_pct,
  avg(market_avg_return_pct) AS market_avg_return_pct, avg(random_avg_return_pct) AS random_avg_return_pct, avg(formal_union_avg_return_pct) AS formal_union_avg_return_pct,
  avg(excess_vs_market_pct) AS excess_vs_market_pct, avg(excess_vs_random_pct) AS excess_vs_random_pct, avg(excess_vs_formal_union_pct) AS excess_vs_formal_union_pct,
  count(*) FILTER (WHERE excess_vs_market_pct > 0) AS positive_excess_days, count(excess_vs_market_pct) AS valid_excess_days,
  avg(CASE WHEN excess_vs_market_pct > 0 THEN 1.0 WHEN excess_vs_market_pct <= 0 THEN 0.0 END) AS positive_excess_day_ratio FROM daily GROUP BY month, horizon)"""

_FEATURES = ("alpha_score", "rank_volatility_contract", "rank_pullback_ma20", "rank_cooldown_10d", "rank_cooldown_3d", "rank_cooldown_5d")
FEATURE_IC = "fx AS (" + " UNION ALL ".join(
    f"SELECT date, 'T{h}' AS horizon, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, ret_T{h} AS y FROM uni WHERE ret_T{h} IS NOT NULL AND {f} IS NOT NULL"
    for h in (1, 2, 3) for f in _FEATURES
) + """),
fxr AS (SELECT *, rank() OVER (PARTITION BY date, horizon, feature ORDER BY x) + (count(*) OVER (PARTITION BY date, horizon, feature, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY date, horizon, feature ORDER BY y) + (count(*) OVER (PARTITION BY date, horizon, feature, y) - 1) / 2.0 AS ry FROM fx),
fic AS (SELECT date, strftime(date, '%Y-%m') AS month, horizon, feature, count(*) AS count,
        CASE WHEN count(*) >= 10 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) END AS rank_ic
        FROM fxr GROUP BY date, horizon, feature),
ric AS (SELECT g.date, strftime(g.date, '%Y-%m') AS month, g.horizon, coalesce(f.count, 0) AS count, f.rank_ic
        FROM grid g LEFT JOIN fic f ON f.date = g.date AND f.horizon = g.horizon AND f.feature = 'alpha_score')"""
