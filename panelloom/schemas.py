"""The eight lake datasets: columns, keys and partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LEVELS = ("bronze", "silver", "gold")
# Older names of the three levels.
LEVEL_ALIASES = {"raw": "bronze", "canonical": "silver", "published": "gold"}

_TYPES = {
    "string": T.StringType(),
    "float64": T.DoubleType(),
    "int64": T.LongType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    level: str
    partition: str
    kinds: dict[str, str]
    primary_key: tuple[str, ...]
    temporal: str
    open_schema: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[k]) for c, k in self.kinds.items()])

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)


def level_name(level: str) -> str:
    resolved = LEVEL_ALIASES.get(level, level)
    if resolved not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return resolved


def _spec(name, level, partition, columns, key, temporal, open_schema=False):
    kinds = dict(item.split(":") for item in columns.split())
    return DatasetSpec(name, level, partition, kinds, tuple(key.split()), temporal, open_schema)


# Dataset definitions.
DATASETS = {
    spec.name: spec
    for spec in (
        _spec(
            "returns_daily", "gold", "dt",
            "dt:date instrument:string return:float64 px_t:float64 px_t_1:float64",
            "dt instrument", "dt",
        ),
        _spec(
            "cot_z_weekly", "gold", "week",
            "week:string contract:string group:string net_pos:int64 zscore:float64",
            "week contract group", "week",
        ),
        _spec(
            "policy_features", "gold", "dt",
            "dt:date implied_cut_prob_3m:float64 implied_cut_prob_6m:float64 "
            "term_front_slope:float64 terminal_shift_30d:float64 source:string",
            "dt", "dt",
        ),
        _spec(
            "macro_asof_monthly", "gold", "month",
            "month_end:date", "month_end", "month_end", open_schema=True,
        ),
        _spec(
            "market_prices", "silver", "dt",
            "vendor:string dt:date instrument:string px_last:float64 currency:string "
            "source_id:string fetch_ts:timestamp",
            "dt instrument vendor", "dt",
        ),
        _spec(
            "cot_weekly", "silver", "week",
            "dt_ingest:date report_date:date contract:string group:string net_pos:int64 "
            "long:int64 short:int64 open_interest:int64",
            "report_date contract group", "report_date",
        ),
        _spec(
            "policy_curve", "silver", "dt",
            "dt:date tenor_days:int64 implied_rate:float64 source:string",
            "dt tenor_days", "dt",
        ),
        _spec(
            "macro_releases", "silver", "dt",
            "dt_ingest:date series_id:string period:date release_date:date value:float64 "
            "unit:string source:string vintage_id:string notes:string",
            "dt_ingest series_id period vintage_id", "dt_ingest",
        ),
    )
}


def dataset(name: str) -> DatasetSpec:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}")
    return DATASETS[name]
