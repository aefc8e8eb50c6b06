"""A corpus from raw documents to token files, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import catalog
from tilewright.llm.dart_minhash import near_classes
from tilewright.llm.decontaminate import contamination, judged
from tilewright.llm.language import UNDETERMINED, identified, learn
from tilewright.llm.mixture import in_training_order, mixed
from tilewright.llm.shared import hinted, on_id, written
from tilewright.llm.token_frames import read_tokens, write_tokens


#: Least likeness to the nearest language profile, from 0 (no n-gram near its place) to 1.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Documents in a known language, or in one of ``wanted``.

    A text goes if it is null or has no letter, if no language's profile comes
    near it, or if the nearest language is not wanted. Ties go to the smaller
    name; repeated rows are judged alike. Without a labelled row no language is
    known, and all documents go.
    """
    # Columns that have the results' names are kept under others meanwhile.
    aside = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    kept = identified(docs.withColumnsRenamed(aside), learn(docs)).filter(f"lang_pred <> '{UNDETERMINED}' AND score >= {LEAST_SCORE}")
    if wanted is not None:
        kept = kept.filter(F.col("lang_pred").isin(list(wanted)))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def _without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents but those whose id was dropped."""
    return on_id(docs, hinted(dropped), key, "left_anti")


def _distinctly(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_id``: the doc_id, or a new number where that is null or several rows' own.

    Rows equal in doc_id and text share a number. Numbers are written before
    they are used, so that repeated tasks cannot deal them anew.
    """
    counts = docs.groupBy("doc_id").agg(F.expr("count(1) AS n"))
    repeated = hinted(written(counts.filter("n > 1 OR doc_id IS NULL").select("doc_id"), "pipeline-repeated"))
    own = docs.withColumn("_row_id", F.expr("CAST(doc_id AS BIGINT)"))
    if repeated.isEmpty():
        return own
    ends = docs.agg(F.expr("coalesce(max(doc_id), 0) AS high"), F.expr("coalesce(min(doc_id), 0) AS low")).first()
    first, step = (ends["high"] + 1, 1) if ends["high"] < 1 << 62 else (ends["low"] - 1, -1)
    if ends["low"] < -(1 << 62) and step < 0:
        raise ValueError("document ids leave no room for new numbers")
    keyed = docs.withColumn("_text_key", F.expr("xxhash64(text)"))
    odd = on_id(keyed, repeated, "doc_id", "left_semi")
    numbers = odd.select("doc_id", "_text_key").distinct().withColumn("_number", F.monotonically_increasing_id())
    numbers = written(numbers, "pipeline-numbers").selectExpr("doc_id AS _id", "_text_key AS _key", f"{first} + {step} * _number AS _row_id")
    same = odd["doc_id"].eqNullSafe(numbers["_id"]) & (odd["_text_key"] == numbers["_key"])
    named = odd.join(hinted(numbers), same).select(*[odd[c] for c in docs.columns], "_row_id")
    return on_id(own, repeated, "doc_id", "left_anti").unionByName(named)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id.

    Rows that share a doc_id, or have none, are documents of their own, after
    all others in that order; of rows equal in doc_id and text one stays. Texts
    without words, nulls among them, are like no other text.
    """
    rows = _distinctly(docs)
    verdict = written(near_classes(rows.select(F.col("_row_id").alias("doc_id"), "text")), "pipeline-near")
    counts = verdict.groupBy("doc_id").agg(F.expr("count(1) AS n"), F.expr("bool_or(kept) AS kept"))
    dropped = written(counts.filter("NOT kept").select(F.col("doc_id").alias("_row_id")), "pipeline-dropped")
    copied = written(counts.filter("kept AND n > 1").select(F.col("doc_id").alias("_row_id")), "pipeline-copied")
    kept = _without(rows, dropped, "_row_id")
    if not copied.isEmpty():
        copied = hinted(copied)
        once = on_id(kept, copied, "_row_id", "left_semi").dropDuplicates(["_row_id"])
        kept = on_id(kept, copied, "_row_id", "left_anti").unionByName(once)
    return kept.drop("_row_id")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark passage.

    Rows that share a doc_id, or have none, are judged one by one. Null texts
    have no words and stay; without benchmark items everything stays.
    """
    rows = _distinctly(docs)
    found = judged(contamination(rows.select(F.col("_row_id").alias("doc_id"), "text"), catalog.table(spark, sf_dir, "benchmark")))
    dropped = written(found.filter("contaminated").select(F.col("doc_id").alias("_row_id")).distinct(), "pipeline-contaminated")
    return _without(rows, dropped, "_row_id").drop("_row_id")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null and wordless texts have no words to take. A null source is a source of
    its own; rows equal in doc_id and text are interchangeable.
    """
    return in_training_order(docs, written(mixed(docs), "pipeline-mix")).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token files, read back: place, length and checksum of each.

    Null texts are empty ones; no documents give no files and no rows.
    """
    manifest = write_tokens(docs, catalog.tokenizer_path())
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixture),
    ("token output", token_files),
]

#: Language distances, similarities over hashed bands and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
