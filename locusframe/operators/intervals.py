"""Joins on genomic intervals: bins make them equi joins; containment is checked after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 1_000_000


def _binned(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))


def overlaps(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Pairs of (chromosome, start, end) intervals that overlap, bounds inclusive; right's columns get r_.

    A pair that shares several bins is taken in the first only, so nothing is made distinct.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b = _binned(left, "start", "end", size), _binned(r, "r_start", "r_end", size).withColumnRenamed("_bin", "_r_bin")
    on = (F.col("chromosome") == F.col("r_chromosome")) & (F.col("_bin") == F.col("_r_bin")) & (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end"))
    first = F.floor(F.greatest("start", "r_start") / size) == F.col("_bin")
    return a.join(b, on & first).drop("_bin", "_r_bin")


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str], size: int = BIN) -> DataFrame:
    """Intervals of the left that overlap none of the right."""
    return left.join(overlaps(left, right, size).select(*keys).distinct(), keys, "left_anti")


def inside(points: DataFrame, regions: DataFrame, by: list[str], size: int = BIN) -> DataFrame:
    """Points (chromosome, position and ``by``) in some region of the same ``by``."""
    binned = _binned(regions.select(*by, "chromosome", "start", "end"), "start", "end", size).select(*[F.col(c).alias(f"r_{c}") for c in (*by, "chromosome", "start", "end")], "_bin")
    own = points.withColumn("_at", F.floor(F.col("position") / size))
    on = (F.col("_at") == F.col("_bin")) & (F.col("chromosome") == F.col("r_chromosome")) & F.col("position").between(F.col("r_start"), F.col("r_end"))
    for c in by:
        on = on & (F.col(c) == F.col(f"r_{c}"))
    return own.join(binned, on, "left_semi").drop("_at")


def lifted(sites: DataFrame, chain: DataFrame, size: int = BIN) -> DataFrame:
    """Sites (chromosome, position) with new_chromosome, new_position and strand, null where no block holds them.

    chain: blocks (chromosome, start, end, to_chromosome, to_start, strand, score), ends
    inclusive; of several, the best score, then the first block, counts.
    """
    blocks = _binned(chain, "start", "end", size).select(*[F.col(c).alias(f"c_{c}") for c in chain.columns], "_bin")
    keyed = sites.select("chromosome", "position").distinct().withColumn("_at", F.floor(F.col("position") / size))
    on = (F.col("_at") == F.col("_bin")) & (F.col("chromosome") == F.col("c_chromosome")) & F.col("position").between(F.col("c_start"), F.col("c_end"))
    moved = F.col("position") - F.col("c_start")
    place = F.when(F.col("c_strand") == "-", F.col("c_to_start") - moved).otherwise(F.col("c_to_start") + moved)
    found = keyed.join(blocks, on).groupBy("chromosome", "position").agg(
        F.max_by(F.struct(F.col("c_to_chromosome").alias("new_chromosome"), place.alias("new_position"), F.col("c_strand").alias("strand")), F.struct("c_score", -F.col("c_start"))).alias("m")
    )
    return sites.join(found.select("chromosome", "position", "m.*"), ["chromosome", "position"], "left")


def require_lift_rate(sites: DataFrame, most: float = 0.01) -> None:
    """Raises if more than this share of the sites was not lifted."""
    share = sites.agg(F.avg(F.col("new_position").isNull().cast("double"))).first()[0] or 0.0
    if share > most:
        raise ValueError(f"{share:.2%} of the sites could not be lifted; at most {most:.2%} may fail")


def cross_assembly_collisions(keys: DataFrame) -> DataFrame:
    """Keys (key, assembly) that several assemblies declare."""
    return keys.groupBy("key").agg(F.countDistinct("assembly").alias("n")).where("n > 1").select("key")


def block_ends(blocks: DataFrame) -> DataFrame:
    """Blocks (block_id, chromosome, start, end) whose end is the start of exactly one other block: (block_id, successor)."""
    after = blocks.select("chromosome", F.col("start").alias("end"), F.col("block_id").alias("successor"))
    pairs = blocks.join(after, ["chromosome", "end"]).where("block_id <> successor")
    return pairs.groupBy("block_id").agg(F.count("*").alias("n"), F.min("successor").alias("successor")).where("n = 1").select("block_id", "successor")


def ceded(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(block_id, successor, alid): variants at a block's end that the one block starting there holds too, and owns.

    blocks: as of block_ends; members: (block_id, position, alid).
    """
    ends = block_ends(blocks).join(blocks.select("block_id", F.col("end").alias("position")), "block_id")
    mine = ends.join(members, ["block_id", "position"])
    theirs = members.select(F.col("block_id").alias("successor"), "position", "alid")
    return mine.join(theirs, ["successor", "position", "alid"]).select("block_id", "successor", "alid")


def block_observations(rows: DataFrame, members: DataFrame, least: int = 4, key: str = "alid") -> DataFrame:
    """(block_id, analysis_index, n): analyses with at least this many observations at a block's variants (block_id, key)."""
    return rows.join(members.select("block_id", key), key).groupBy("block_id", "analysis_index").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lifted_allele_faults(lifted_sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Lifted sites whose pair of alleles (a1, a2) the reference has none of at that place; places it doesn't know pass.

    reference: (chromosome, position, a1, a2).
    """
    pair = F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2"))
    known = reference.groupBy(F.col("chromosome").alias("new_chromosome"), F.col("position").alias("new_position")).agg(F.collect_set(pair).alias("pairs"))
    return lifted_sites.join(known, ["new_chromosome", "new_position"]).where(~F.array_contains("pairs", pair)).drop("pairs")


def lifted_trait_positions(lifted_sites: DataFrame) -> DataFrame:
    """Trait positions after a lift; blank where it fails or leaves the chromosome."""
    same = F.col("new_chromosome") == F.col("chromosome")
    return lifted_sites.withColumn("trait_chr", F.when(same, F.col("chromosome"))).withColumn("trait_bp", F.when(same, F.col("new_position")))


def lift_reasons(lifted_sites: DataFrame, primary: list[str]) -> DataFrame:
    """Rows with why a lift loses them (unmapped, off_primary), or null."""
    reason = F.when(F.col("new_position").isNull(), "lift_unmapped").when(~F.col("new_chromosome").isin(primary), "lift_off_primary")
    return lifted_sites.withColumn("reason", reason)


def union_axis(variants: DataFrame, panel: DataFrame, site: tuple[str, ...] = ("alid",)) -> DataFrame:
    """The variants of a release and its panel (alid, chromosome, position, effect_allele, other_allele); names carry over, and on_panel marks what may be filled.

    site: the columns by which a variant is told from others.
    """
    site = [*site]
    keys = [*site, *(c for c in ("alid", "chromosome", "position", "effect_allele", "other_allele") if c not in site)]
    own = variants.select(*keys, "rsid").withColumn("_own", F.lit(True))
    theirs = panel.select(*keys).dropDuplicates(site).withColumn("on_panel", F.lit(True))
    new = theirs.join(own.select(*site), site, "left_anti").withColumn("rsid", F.lit(".")).select(*keys, "rsid", "on_panel")
    old = own.join(theirs.select(*site, "on_panel"), site, "left").select(*keys, "rsid", F.coalesce("on_panel", F.lit(False)).alias("on_panel"))
    return old.unionByName(new)


def off_reference_keys(sources: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, assemblies): distinct keys (key, assembly number) that the reference lacks, with a bit for each declaring assembly."""
    bits = F.bit_or(F.expr("shiftleft(1L, cast(assembly as int))")).alias("assemblies")
    return sources.groupBy("key").agg(bits).join(reference.select("key"), "key", "left_anti")
