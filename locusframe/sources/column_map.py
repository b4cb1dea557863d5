"""Column maps: a TOML file that declares what a collection's columns mean."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tabular import Fields, HeaderError, assembled, text_table

REQUIRED = ["chromosome", "position", "effect_allele", "other_allele"]
KNOWN = {
    "chromosome": "chromosome", "position": "position", "effect_allele": "effect", "other_allele": "other", "rsid": "rsid", "beta": "beta", "odds_ratio": "odds_ratio", "z": "z",
    "standard_error": "se", "ci_lower": "low", "ci_upper": "high", "p_value": "p", "effect_allele_frequency": "eaf", "sample_size": "n", "imputation_score": "info",
}


@dataclass(frozen=True)
class ColumnMap:
    name: str
    columns: dict[str, str]
    optional: dict[str, str]
    ignored: frozenset[str]


def parse(text: str) -> ColumnMap:
    data = tomllib.loads(text)
    if data.get("column_map_version") != 1:
        raise HeaderError("column_map_version must be 1")
    columns, optional = data.get("columns", {}), data.get("optional_columns", {})
    if unknown := sorted({*columns, *optional} - set(KNOWN)):
        raise HeaderError(f"unknown meanings: {', '.join(unknown)}")
    if lacking := [c for c in REQUIRED if c not in columns]:
        raise HeaderError(f"not mapped: {', '.join(lacking)}")
    sources = [*columns.values(), *optional.values()]
    if repeated := sorted({s for s in sources if sources.count(s) > 1}):
        raise HeaderError(f"mapped twice: {', '.join(repeated)}")
    return ColumnMap(data["name"], columns, optional, frozenset(data.get("ignored_columns", [])))


def read(spark: SparkSession, path: str, own: ColumnMap) -> DataFrame:
    """A table under its map; a column that is neither mapped nor ignored is refused, as is one that is missing."""
    raw = text_table(spark, path)
    header = [c for c in raw.columns if c not in ("source", "row")]
    mapped = {**own.columns, **{k: v for k, v in own.optional.items() if v in header}}
    if lacking := [v for v in own.columns.values() if v not in header]:
        raise HeaderError(f"{own.name}: the header lacks {', '.join(lacking)}")
    if extra := [c for c in header if c not in own.ignored and c not in mapped.values() and c not in own.optional.values()]:
        raise HeaderError(f"{own.name}: not mapped and not ignored: {', '.join(extra)}")
    return assembled(raw, Fields(**{KNOWN[k]: F.col(f"`{v}`") for k, v in mapped.items()}))
