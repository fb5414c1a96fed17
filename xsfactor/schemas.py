"""Table layouts, constants and null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL, HIGH, EXTREME, UNCLASSIFIED = "NORMAL", "HIGH", "EXTREME", "UNCLASSIFIED"
#: Labels that input tables use for the regimes.
REGIME_LABELS = {"正常": NORMAL, "高波动": HIGH, "极高波动": EXTREME, "未分类": UNCLASSIFIED}
#: Column names that bar files use.
BAR_ALIASES = {
    "日期": "date", "股票代码": "entity", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume",
    "成交额": "amount", "换手率": "turnover", "code": "entity", "stock_code": "entity", "turnover_rate": "turnover",
}
BARS = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("entity", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover")),
])


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def pad_code(c: Column, width: int = 6) -> Column:
    """Zero-padded on the left; longer codes stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def rename_known(df: DataFrame, aliases: dict[str, str] = BAR_ALIASES) -> DataFrame:
    """Known alternative column names become the canonical ones, unless those are there already."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def with_columns_of(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Exactly these columns, null where df has none; values that don't parse become null."""
    have = set(df.columns)
    pick = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return df.select(*(pick(f).alias(f.name) for f in fields))
