"""Forward labels.

Three different labels exist and keep different names:

* ``fwd_return_pct_T{h}``: buy at the next open, sell at the close h bars on;
* ``t{2,3}_return_pct``: the same trade over the whole market, in the
  single-factor view;
* ``ret_T{h}``: close to close, used by the alpha probe.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.rolling import BY_SYMBOL_SQL
from tickerloom.functions.scalars import change_pct, extend, ratio

HORIZON_MAX = 20


def forward_columns(horizons: int = HORIZON_MAX, with_range: bool = False) -> list[str]:
    raw = ("date", "open", "high", "low", "close") if with_range else ("date", "open", "close")
    hs = range(1, horizons + 1)
    return [
        *[f"t{h}_{c}" for h in hs for c in raw],
        *[f"fwd_return_pct_T{h}" for h in hs],
        *[f"fwd_up_T{h}" for h in hs],
        "forward_data_status",
    ]


def _raw(with_range: bool) -> tuple[str, ...]:
    return ("date", "open", "high", "low", "close") if with_range else ("date", "open", "close")


def next_bars(horizons: int = HORIZON_MAX, with_range: bool = False) -> dict[str, str]:
    """The next ``horizons`` bars as one struct each: a single window step for all of them."""
    bar = f"struct({', '.join(_raw(with_range))})"
    return {f"_t{h}": f"lead({bar}, {h}) OVER ({BY_SYMBOL_SQL})" for h in range(1, horizons + 1)}


def label_columns(df: DataFrame, horizons: int = HORIZON_MAX, with_range: bool = False) -> DataFrame:
    """Turn the structs of :func:`next_bars` into label columns; pure projection."""
    made = set(forward_columns(horizons, with_range))
    hs = range(1, horizons + 1)
    nexts = {f"_t{h}" for h in hs}
    kept = [c for c in df.columns if c not in made and c not in nexts]
    can_buy = "coalesce(_t1.open > 0, false)"
    out = [f"_t{h}.{c} AS t{h}_{c}" for h in hs for c in _raw(with_range)]
    out += [
        f"CASE WHEN {can_buy} THEN (_t{h}.close / _t1.open - 1.0D) * 100.0D END AS fwd_return_pct_T{h}" for h in hs
    ]
    out += [f"CASE WHEN {can_buy} THEN _t{h}.close > _t1.open END AS fwd_up_T{h}" for h in hs]
    if with_range:
        status = "CASE WHEN _t1.open IS NULL THEN 'missing_t1' ELSE 'ok' END"
    else:
        later = " OR ".join(f"_t{h}.date IS NULL OR _t{h}.close IS NULL" for h in range(2, horizons + 1)) or "false"
        status = (
            f"CASE WHEN _t1.date IS NULL OR _t1.close IS NULL OR NOT {can_buy} THEN 'missing_t1'"
            f" WHEN {later} THEN 'partial_missing' ELSE 'ok' END"
        )
    return df.select(*kept, *[F.expr(e) for e in out], F.expr(status).alias("forward_data_status"))


def forward_labels(bars: DataFrame, horizons: int = HORIZON_MAX, with_range: bool = False) -> DataFrame:
    """Prices of the next ``horizons`` bars, returns from the T+1 open, and a data status.

    Must run on complete bars, before any selection drops rows.  With
    ``with_range`` highs and lows are added and the status only tells a missing
    T+1 from the rest.
    """
    return label_columns(extend(bars, next_bars(horizons, with_range)), horizons, with_range)


def market_labels(bars: DataFrame) -> DataFrame:
    """T+1 open to T+2 and T+3 close for every bar that has a next open."""
    df = bars.selectExpr(
        "symbol",
        "date",
        f"lead(open, 1) OVER ({BY_SYMBOL_SQL}) AS t1_open",
        f"lead(close, 2) OVER ({BY_SYMBOL_SQL}) AS t2_close",
        f"lead(close, 3) OVER ({BY_SYMBOL_SQL}) AS t3_close",
    ).filter("t1_open IS NOT NULL")
    return extend(df, {f"t{h}_return_pct": change_pct(f"t{h}_close", "t1_open") for h in (2, 3)})


def close_labels(bars: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Close-to-close forward returns; a missing return is not up."""
    hs = list(horizons)
    df = extend(bars, {f"future_close_T{h}": f"lead(close, {h}) OVER ({BY_SYMBOL_SQL})" for h in hs})
    df = extend(df, {f"ret_T{h}": f"{ratio(f'future_close_T{h}', 'close')} - 1.0D" for h in hs})
    return extend(df, {
        **{f"ret_T{h}_pct": f"ret_T{h} * 100.0D" for h in hs},
        **{f"up_T{h}": f"coalesce(ret_T{h} > 0, false)" for h in hs},
    })
