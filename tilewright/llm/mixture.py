"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over the training time t in [0, 1]: linear,
from ``1 + tilt`` times its share at t = 0 to ``1 - tilt`` times at t = 1, the
tilt running from +0.5 for the first source to -0.5 for the last. Integrating
the schedule gives the words demanded of the source up to t,
``target * ((1 + tilt) * t - tilt * t * t)``; inverting it gives the time at
which the source's running word count is reached. A source's documents follow
each other in a hashed order, repeat after repeat; a repeat's training position
is the time at which the demand reaches the middle of its words, and a repeat
that no time reaches is not taken. Range sorting by position gives the training
order.

Sizes are numbers of runs of characters other than blanks and U+0009 to U+000D.
Null text has size 0; a null source is a source of its own, the last. Repeated
rows are documents of their own; equal (doc_id, text) rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import hinted, written

WEIGHTS = (5, 2, 1)
#: Words in the mix and most repeats, in units of all words and of a source's words.
SHARE = (3, 2)
REPEATS = 2
ROWS_PER_BUCKET = 2_000


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size`` (words) to the documents."""
    return docs.withColumn("size", F.expr(r"CAST(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS BIGINT)"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target, place, n_sources`` by water filling.

    ``totals`` has source and source_size. Sources are capped in the order of
    size per weight: once a source's cap lies above the level that the rest
    would get, so do all after it. One row per source, so one window.
    """
    listed = ", ".join(map(str, weights))
    top, bottom = share
    return totals.selectExpr(
        "source", "source_size", "CAST(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS INT) AS place",
        "count(1) OVER () AS n_sources", "sum(source_size) OVER () AS words",
    ).withColumn("w", F.expr(f"CAST(element_at(array({listed}), place % {len(weights)} + 1) AS BIGINT)")).withColumn(
        "capped", F.expr(
            f"coalesce(sum({repeats} * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        )
    ).withColumn(
        "open_w", F.expr("sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    ).withColumn(
        # The level of this and all later sources if every earlier one is capped, as a fraction.
        "fits", F.expr(f"{repeats} * source_size * {bottom} * open_w >= w * ({top} * words - {bottom} * capped)")
    ).withColumn(
        "at", F.expr("min(CASE WHEN fits THEN struct(source_size / w AS r, place AS p, capped AS c, open_w AS o) END) OVER ()")
    ).selectExpr(
        "source", "source_size", "place", "n_sources",
        f"CASE WHEN at IS NULL OR struct(source_size / w AS r, place AS p) < struct(at.r AS r, at.p AS p) "
        f"THEN CAST({repeats} * source_size AS DOUBLE) "
        f"ELSE CAST(w * ({top} * words - {bottom} * at.c) AS DOUBLE) / ({bottom} * at.o) END AS target",
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, takes, times`` of every document row.

    ``takes`` is how often the mix takes the document, ``times`` when. ``key``
    (a hash of the text) tells rows of one doc_id apart. Running counts are
    taken inside (source, bucket of the hashed order), and shifted by the
    bucket totals before it, so a huge source is many small tasks.
    """
    narrow = sized(docs).selectExpr("doc_id", "source", "xxhash64(text) AS key", "size", "md5(concat('mix:', coalesce(CAST(doc_id AS STRING), ''))) AS h")
    narrow = written(narrow, "mix-sizes")
    totals = narrow.groupBy("source").agg(F.expr("sum(size) AS source_size"), F.expr("count(1) AS n"))
    digits = 0
    most = totals.agg(F.expr("max(n)")).first()[0] or 0
    while ROWS_PER_BUCKET * 16**digits < most:
        digits += 1
    plan = targets(totals.select("source", "source_size"), weights, share, repeats)
    placed = narrow.withColumn("bucket", F.expr(f"substring(h, 1, {digits})"))
    shifts = placed.groupBy("source", "bucket").agg(F.expr("sum(size) AS words")).selectExpr(
        "source", "bucket",
        "coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift",
    )
    shifts = shifts.join(plan, shifts["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    shifts = shifts.withColumnsRenamed({"source": "_source", "bucket": "_bucket"})
    inside = (
        "coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY h, doc_id, key "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    counted = placed.withColumn("inside", F.expr(inside))
    on = counted["source"].eqNullSafe(shifts["_source"]) & (counted["bucket"] == shifts["_bucket"])
    tilt = "(CASE WHEN n_sources > 1 THEN 0.5D - place / (n_sources - 1) ELSE 0D END)"
    # The share of the source's demand that is met at the middle of the repeat; beyond 1 no time meets it.
    at = f"((inside + shift + size / 2 + e * source_size) / target)"
    # Inverse of (1 + a) t - a t^2, written so that a = 0 needs no case of its own.
    time = f"2 * {at} / ((1 + {tilt}) + sqrt((1 + {tilt}) * (1 + {tilt}) - 4 * {tilt} * {at}))"
    positions = f"filter(transform(sequence(0, {repeats - 1}), e -> CASE WHEN size > 0 AND {at} < 1 THEN {time} END), t -> t IS NOT NULL)"
    placed = counted.join(shifts, on).withColumn("times", F.expr(positions)).withColumn("takes", F.expr("size(times)"))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", "takes", "times")


def _ranges(df: DataFrame, time: str) -> DataFrame:
    """``df`` by its times: the i-th partition holds the i-th part of the training, sorted.

    Words are spread nearly evenly over the training, so no sample of the rows
    is needed to find the parts. Rows without a time come last.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    part = f"CAST(least({parts - 1}, coalesce(floor({time} * {parts}), {parts - 1})) AS INT)"
    return df.repartitionById(parts, F.expr(part)).sortWithinPartitions(F.expr(time).asc_nulls_last())


def by_position(mix: DataFrame) -> DataFrame:
    """The plan, range-sorted by each document's first position (column ``train_at``)."""
    return _ranges(mix.withColumn("train_at", F.expr("get(times, 0)")), "train_at")


def in_training_order(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents, each as often as taken, range-sorted by training time (column ``train_at``).

    Positions are settled on the narrow plan; a text meets them once and moves
    once for each time it is taken. Rows equal in id and text are told apart by
    number alone, so one of them carries the positions of all.
    """
    taken = mix.filter("takes > 0").selectExpr("doc_id AS _mix_id", "key AS _mix_key", "times AS _mix_times")
    one = taken.groupBy("_mix_id", "_mix_key").agg(F.expr("flatten(collect_list(_mix_times)) AS _mix_times"))
    repeated = mix.groupBy("doc_id", "key").agg(F.expr("count(1) AS n")).filter("n > 1").selectExpr("doc_id AS _mix_id", "key AS _mix_key")
    keyed = docs.withColumn("_mix_hash", F.expr("xxhash64(text)"))

    def same(right: DataFrame):
        return keyed["doc_id"].eqNullSafe(right["_mix_id"]) & (keyed["_mix_hash"] == right["_mix_key"])

    repeated = hinted(written(repeated, "mix-repeated"))
    if not repeated.isEmpty():
        first = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_mix_hash"])
        keyed = keyed.join(repeated, same(repeated), "left_anti").unionByName(first)
    one = hinted(written(one, "mix-positions"))
    placed = keyed.join(one, same(one)).select(*[f"`{c}`" for c in docs.columns if c != "train_at"], F.explode("_mix_times").alias("train_at"))
    return _ranges(placed, "train_at")
