"""Order MinHash fingerprints: DataFrame operations only.

A document's k-mers are K consecutive pieces of at most eight characters between white
space, numbered by occurrence, so that repeated ones stay apart.  Their hashes lie on a circle
of 2 ** 33 places; each of the signature's rows begins at a point of its own, and takes the
TUPLE k-mers of least hash from there on (a hash of its own for each row, but one sort for
all), puts them back into text order and hashes the tuple.  All k-mers of a text take part.
Two texts agree in a row if it takes the same k-mers in the same order, so moved passages
count as edits.

Null texts are empty; empty texts have equal fingerprints.  Repeated rows have equal
fingerprints, and follow one another.  Rows without doc_id come last, by hash of the text.
Very long texts are one array of longs while they are worked on.  Other columns are ignored.
An empty table gives no rows; the next document of a single one is itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, TUPLE, ROWS = 2, 2, 32
#: A long holds a hash of 33 bits over a place; an array has no more places.
PLACE_BITS = 31
PLACES = 1 << PLACE_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(h: Column, place: Column) -> Column:
    """33 bits of a hash over a place: longs sort much faster than structs."""
    return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(PLACES - 1))


def _steps(n: Column) -> Column:
    """Powers of two, largest first, that add up to any number up to n."""
    return F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def _numbered(kmers: Column) -> Column:
    """The sorted packed k-mers, hashed anew where an equal one comes before: equal ones differ by their occurrence."""

    def same(i: Column, kmer: Column) -> Column:
        return F.shiftright(F.get(kmers, i), PLACE_BITS) == F.shiftright(kmer, PLACE_BITS)

    def numbered(kmer: Column, i: Column) -> Column:
        # Equal k-mers are neighbours: the largest distance at which an equal one stands, bit by bit.
        far = F.aggregate(_steps(i), F.lit(0), lambda d, step: F.when((i - d - step >= 0) & same(i - d - step, kmer), d + step).otherwise(d))
        return F.when((i > 0) & same(i - 1, kmer), _packed(F.xxhash64(F.shiftright(kmer, PLACE_BITS), far), kmer)).otherwise(kmer)

    return F.transform(kmers, numbered)


def signature(text: Column, rows: int = ROWS) -> Column:
    """``rows`` 32-bit integers."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,8}"), F.lit(0))
    kmers = let(parts, lambda w: F.sort_array(F.transform(w, lambda x, i: _packed(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]), i))))
    ordered = let(kmers, lambda s: F.sort_array(_numbered(s)))
    points = F.array(*[F.lit(-(1 << 63) + j * ((1 << 64) // rows)).cast("long") for j in range(rows)])

    def row(point: Column, s: Column, steps: Column) -> Column:
        n = F.size(s)
        begin = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(s, at + step - 1) < point), at + step).otherwise(at))
        taken = [F.get(s, F.pmod(begin + k, F.greatest(n, F.lit(1)))) for k in range(TUPLE)]
        # Place first, then what tells the k-mer.
        in_order = F.sort_array(F.array(*[F.shiftleft(x.bitwiseAND(PLACES - 1), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS)) for x in taken]))
        return F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND((1 << (64 - PLACE_BITS)) - 1))).bitwiseAND(0xFFFFFFFF)

    return let(ordered, lambda s: let(_steps(F.size(s)), lambda steps: F.transform(points, lambda point: row(point, s, steps))))


def shown(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of rows in which two signatures agree."""
    return let(F.zip_with(a, b, lambda x, y: x == y), lambda same: F.size(F.filter(same, lambda x: x)) / F.size(same))


def with_next(docs: DataFrame, rows_per_bucket: int = 1000, most_buckets: int = 20_000) -> DataFrame:
    """docs (doc_id, text) with ``rows``, its signature, and ``next``: text and rows of the document that follows in descending order of doc_id.

    Buckets of neighbouring ids are ordered independently; each gets one more row, the first
    of the bucket after it, so that no global order is needed.  The ids at which buckets
    part, and one id for each bucket, are all that the driver sees, 20,000 of either at most;
    beyond 20 million rows buckets grow.
    """
    n = docs.select(F.count("*")).first()[0]
    n_buckets = max(1, min(most_buckets, n // rows_per_bucket))
    bounds = docs.select(F.percentile_approx("doc_id", [i / n_buckets for i in range(1, n_buckets)] or [0.5], 10 * most_buckets)).first()[0] or []
    bounds = sorted(set(bounds))
    steps = F.array(*[F.lit(1 << b) for b in range(15, -1, -1)])
    ends = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    at_ = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(ends, at + step - 1) < F.col("doc_id")), at + step).otherwise(at))
    # Rows without an id go to 256 buckets below all others, by their text's hash.
    none = F.xxhash64("text").bitwiseAND((1 << 63) - 1)
    bucket = F.when(F.col("doc_id").isNull(), F.shiftright(none, 55).cast("int") - 256).otherwise(at_)
    order = F.when(F.col("doc_id").isNull(), none).otherwise(F.col("doc_id"))
    own = docs.withColumn("bucket", bucket).withColumn("order", order)
    tops = own.groupBy("bucket").agg(F.max("order").alias("order")).collect()
    parts = sorted(((r.bucket, r.order) for r in tops), reverse=True)
    if not parts:
        return own.withColumn("rows", signature(F.col("text"))).withColumn("next", F.struct("text", "rows")).drop("bucket", "order")
    # The first rows of buckets go to the bucket before theirs too; the very first one goes to the last bucket.
    goes = [(first, parts[i - 1][0], b) for i, (b, first) in enumerate(parts)]
    target = docs.sparkSession.createDataFrame(goes, "top long, goes_to int, of int")
    extra = own.join(F.broadcast(target), (F.col("bucket") == F.col("of")) & (F.col("order") == F.col("top"))).groupBy("goes_to").agg(F.max("text").alias("text"))
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("goes_to").alias("bucket"), F.lit(None).cast("long").alias("order"), F.lit(1).alias("extra"))
    both = own.withColumn("extra", F.lit(0)).unionByName(extra).withColumn("rows", signature(F.col("text")))
    down = Window.partitionBy("bucket").orderBy("extra", F.desc("order"), F.desc("text"))
    return both.withColumn("next", F.lead(F.struct("text", "rows")).over(down)).where("extra = 0").drop("bucket", "extra", "order")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the following text."""
    n = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def query(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    got = with_next(own).select("doc_id", "text", "rows", F.col("next.rows").alias("next_rows"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    got = got.select("doc_id", F.length("text").cast("long").alias("n_chars"), "rows", "next_rows", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_rows"))
    return got.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("rows")).alias("fingerprint"), shown(F.col("edited_rows")).alias("edited_fingerprint"),
        likeness(F.col("rows"), F.col("edited_rows")).alias("near_edited"), likeness(F.col("rows"), F.col("next_rows")).alias("near_next"),
    )
