"""Rules that a release must hold to; each is a query for what breaks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import variants as V
from ..operators import reads, windows


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def tier_differences(rows: DataFrame, tier: DataFrame, threshold: float) -> DataFrame:
    """How many rows are in a tier or in the recomputed one, but not in both."""
    keys = ["analysis_index", "variant_index", "z"]
    own, again = tier.select(*keys), rows.where(reads.significant(threshold)).select(*keys)
    return own.exceptAll(again).union(again.exceptAll(own)).agg(F.count("*").alias("differences"))


def observed_view(source: DataFrame, completed: DataFrame, cell: tuple[str, ...] = ("alid", "analysis_id")) -> DataFrame:
    """Observed cells of the source that a completed release lacks or changed; all of them, not a sample."""
    keys = [*cell]
    c = completed.select(*keys, *[F.col(x).alias(f"c_{x}") for x in ("z", "se", "eaf", "status")])
    joined = source.where("status = 'observed'").join(c, keys, "left")
    same = F.col("c_status").eqNullSafe(F.lit("observed"))
    for x in ("z", "se", "eaf"):
        same = same & F.col(x).eqNullSafe(F.col(f"c_{x}"))
    return joined.where(~same)


def _states(store) -> DataFrame:
    rows = store.associations().withColumn("imputed", (F.col("status") == "imputed").cast("int"))
    return rows.where(~S.states(F.col("z"), F.col("se"), F.col("imputed")).isin("observed", "imputed", "missing"))


def _axis_order(store) -> DataFrame:
    rank = V.contig_rank(F.col("chromosome"))
    keyed = store.variants().withColumn("_k", F.struct(rank, F.col("position"), F.col("effect_allele"), F.col("other_allele")))
    return windows.order_breaks(keyed, "chromosome", "variant_index", "_k")


def _orphans(key: str, table: str) -> Callable:
    return lambda store: store.associations().join(store.table(table).select(key), key, "left_anti").select(key).distinct()


def _tiers(store) -> DataFrame:
    names = ["associations", *(["overflow"] if store.manifest.layout == "hybrid" else [])]
    parts = [tier_differences(store.table(n), store.table(f"{n}_tiers"), 5e-4).withColumn("table", F.lit(n)) for n in names]
    got = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return got.where("differences > 0")


def _by_variant(store) -> DataFrame:
    n = lambda t: t.groupBy("variant_index").agg(F.count("*").alias("n"))
    a, b = n(store.associations()), n(store.associations(by_variant=True))
    return a.exceptAll(b).union(b.exceptAll(a))


#: name: rows that break the rule.
RULES: dict[str, Callable] = {
    "variant_table.unique_keys": lambda s: repeated_keys(s.variants(), "alid"),
    "variant_table.unique_numbers": lambda s: repeated_keys(s.variants(), "variant_index"),
    "variant_table.order": _axis_order,
    "variant_table.alleles": lambda s: s.variants().where(V.allele(F.col("effect_allele")).isNull() | V.allele(F.col("other_allele")).isNull()),
    "variant_table.key_matches": lambda s: s.variants().where(F.col("alid") != F.concat_ws(":", "chromosome", "position", "effect_allele", "other_allele")),
    "analyses.unique_ids": lambda s: repeated_keys(s.analyses(), "analysis_id"),
    "associations.states": _states,
    "associations.unique_cells": lambda s: s.associations().groupBy("analysis_index", "variant_index").count().where("count > 1"),
    "associations.known_variants": _orphans("variant_index", "variants"),
    "associations.known_analyses": _orphans("analysis_index", "analyses"),
    "associations.finite": lambda s: s.associations().where("isnan(z) OR isnan(se) OR abs(z) = double('infinity') OR se <= 0"),
    "associations.eaf": lambda s: s.associations().where("eaf IS NOT NULL AND (eaf <= 0 OR eaf >= 1)"),
    "associations.se_range": lambda s: s.associations().where(F.col("se") > S.SE_LIMIT),
    "completion.no_imputed_before": lambda s: s.associations().where(F.lit(not s.manifest.completed) & (F.col("status") == "imputed")),
    "top_hits.tiers": _tiers,
    "by_variant.counts": _by_variant,
}


def validate(store, names: set[str] | None = None, sample: int = 5) -> dict[str, list]:
    """The rules that do not hold, each with a few of the rows that break it."""
    unknown = (names or set()) - set(RULES)
    if unknown:
        raise KeyError(", ".join(sorted(unknown)))
    found = {name: rule(store).limit(sample).collect() for name, rule in RULES.items() if names is None or name in names}
    return {name: rows for name, rows in found.items() if rows}
