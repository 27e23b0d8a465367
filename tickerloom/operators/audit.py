"""Contract for user indicators: they may only add finite numeric facts."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.scratch import materialize

# Words and names that belong to strategies, not to indicators.
FORBIDDEN_WORDS = (
    "selected", "score", "rank", "signal", "xg", "buy", "sell", "position", "strategy", "pool", "market_regime",
    "close_to", "distance", "gap", "above", "below", "cross",
)
FORBIDDEN_NAMES = ("renko_color", "renko_is_red", "renko_is_green", "renko_is_flat")
BASE = ("symbol", "file", "date", "open", "high", "low", "close", "volume", "amount")
SPARSE_SHARE = 0.8


@dataclass(frozen=True)
class Audit:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def named_like_judgements(columns) -> list[str]:
    return [c for c in columns if c.lower() in FORBIDDEN_NAMES or any(w in c.lower() for w in FORBIDDEN_WORDS)]


def value_metrics(columns) -> list[Column]:
    """Aggregates over new numeric columns, for :func:`value_problems`; any job may compute them."""
    return [F.count(F.lit(1)).alias("rows"), *[F.expr(
        f"struct(count_if(`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE))) AS n, count_if(abs(CAST(`{c}` AS DOUBLE)) = double('inf')) AS inf) AS `value:{c}`") for c in columns]]


def value_problems(columns, seen: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) about the values of new columns."""
    rows = seen.get("rows") or 0
    if not rows:
        return [], []
    empty = [c for c in columns if seen[f"value:{c}"]["n"] == 0]
    infinite = [c for c in columns if seen[f"value:{c}"]["inf"] > 0]
    sparse = [c for c in columns if 1 - seen[f"value:{c}"]["n"] / rows > SPARSE_SHARE]
    errors = [f"new columns without a value: {empty}"] * bool(empty) + [f"infinite values in new columns: {infinite}"] * bool(infinite)
    return errors, [f"new columns with few values: {sparse}"] * bool(sparse)


def check_kernels(kernels, columns) -> None:
    """Names of user kernels: none may shadow a column, another kernel's, or read like a judgement."""
    errors, taken = [], set(columns)
    for k in kernels:
        twice = [c for c in k.columns if c in taken]
        if twice:
            errors.append(f"{k.name} would replace {twice}")
        if named := named_like_judgements(k.columns):
            errors.append(f"{k.name} names columns like a judgement: {named}")
        taken |= set(k.columns)
    if errors:
        raise ValueError("user indicators failed their audit:\n" + "\n".join(f"- {e}" for e in errors))


def _fingerprints(df: DataFrame, columns: list[str]):
    """Row count and an order-free checksum per column, tied to its (symbol, date)."""
    return df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.sum(F.xxhash64("symbol", "date", c).cast("decimal(38,0)")).alias(c) for c in columns
    ]).first()


def audit(before: DataFrame, after: DataFrame) -> Audit:
    """Compare an indicator's input and output: one aggregate over each."""
    added = [c for c in after.columns if c not in before.columns]
    errors, warnings = [], []
    if len(set(after.columns)) != len(after.columns):
        twice = sorted({c for c in after.columns if after.columns.count(c) > 1})
        return Audit([f"column names occur twice: {twice}"], [], added, [])
    deleted = [c for c in before.columns if c not in after.columns]
    if deleted:
        errors.append(f"columns of the input are gone: {deleted}")
    missing = [c for c in BASE if c not in after.columns]
    if missing:
        errors.append(f"a bar needs {missing}")
    named = named_like_judgements(added)
    if named:
        errors.append(f"new columns named like a judgement: {named}")
    kinds = {f.name: f.dataType for f in after.schema.fields}
    flags = [c for c in added if isinstance(kinds[c], T.BooleanType)]
    other = [c for c in added if c not in flags and not isinstance(kinds[c], T.NumericType)]
    if flags:
        errors.append(f"new columns hold truth values: {flags}")
    if other:
        errors.append(f"new columns hold no numbers: {other}")

    shared = [c for c in before.columns if c in after.columns]
    modified: list[str] = []
    if {"symbol", "date"} <= set(shared):
        old, new = _fingerprints(before, shared), _fingerprints(after, shared)
        if old["_rows"] != new["_rows"]:
            errors.append(f"{old['_rows']} rows became {new['_rows']}")
        modified = [c for c in shared if old[c] != new[c]]
        if modified:
            errors.append(f"values of the input changed in {modified}")
    numeric = [c for c in added if c not in flags and c not in other]
    if numeric:
        found, warnings = value_problems(numeric, after.agg(*value_metrics(numeric)).first().asDict())
        errors += found
    return Audit(errors, warnings, added, modified)


def apply_audited(df: DataFrame, indicators: dict[str, Callable[..., DataFrame]], options: dict | None = None) -> DataFrame:
    """Run user indicators one after another; the first that breaks the contract raises.

    An indicator gets those of ``options`` that its signature names.  Each result is
    stored once, so an audit reads tables and never repeats earlier indicators.
    """
    if indicators:
        df = materialize(df, "indicators")
    for name, fn in indicators.items():
        wanted = inspect.signature(fn).parameters
        after = materialize(fn(df, **{k: v for k, v in (options or {}).items() if k in wanted}), f"indicator-{len(df.columns)}")
        result = audit(df, after)
        if not result.ok:
            raise ValueError(f"indicator {name} failed its audit:\n" + "\n".join(f"- {e}" for e in result.errors))
        df = after
    return df
