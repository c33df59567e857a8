"""The corpus pipeline: five stages over documents, each judged on what the one before kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, jaccard, quality, secrets
from gridloom.llm.common import private, public, read_file, table
from gridloom.runtime import dropped, recorded, scratch_dir, written

#: Hit words from which a span is cut out, and the share of hit words from which a document goes.
LEAST_SPAN, MOST_COVERAGE = 1, 0.5
RANKS = "byte_bpe_50k.tiktoken"


#: Scratch folders of the stage before.
_LEFT: list[str] = []


def _stage(f):
    """Deletes what the stage before left in scratch, once its result is a table of its own: that is what ``docs`` reads."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        still = [p for p in _LEFT if any(p.rsplit("/", 1)[1] in f for f in files)]
        for path in set(_LEFT) - set(still):
            dropped(spark, path)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _LEFT[:] = [*still, *made]
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, null and empty texts among them.

    Repeated rows are judged alike; a null language or source is a value like any
    other; an empty table stays empty; other columns come through whatever their names.
    """
    inner, names = private(docs)
    out = quality.apply_rules(inner, text_col=names["text"], lang_col=names["lang"], source_col=names["source"])
    return public(out.where("kept"), names, [])


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents: that of the smallest id, ids before null, then by the row's hash.

    Rows are told apart by all their values, so rows of one id with different texts
    are documents of their own; rows equal in all columns are one document.  Texts
    without words (null, empty or blank) link with nothing: their rows all stay.
    """
    inner, names = private(docs)
    own = [F.col(c) for c in inner.columns]
    key = F.struct(F.col(names["doc_id"]).isNull().alias("none"), F.col(names["doc_id"]).alias("id"), F.xxhash64(*own).alias("one"), F.xxhash64(F.lit(1), *own).alias("two"))
    keyed = inner.withColumn("_key", key)
    out = jaccard.link_components(keyed, id_col="_key", text_col=names["text"])
    # a row without words is its own component and no other's
    lead = out.where("n_shingles > 0 and _key = component_id").select("_key").distinct()
    kept = keyed.join(lead, "_key", "left_semi").dropDuplicates(["_key"])
    blank = keyed.where(~F.coalesce(F.col(names["text"]), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return public(kept.unionByName(blank), names, [])


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops documents that mostly consist of them.

    A null text stays null and hits nothing; repeated rows are judged alike; an
    empty table stays empty; other columns come through whatever their names.
    """
    inner, names = private(docs)
    out = decontaminate.decontaminate(inner, table(spark, sf_dir, "benchmark"), id_col=names["doc_id"], text_col=names["text"], keep_text=True, least_span=LEAST_SPAN)
    return _counted(public(out.where(F.col("n_hit") <= MOST_COVERAGE * F.col("n_words")), names, []))


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no row goes.  Null texts stay null; other columns come through whatever their names."""
    ranks = read_file(public_tokenizers.path(RANKS))
    inner, names = private(docs)
    out = secrets.scan_secrets(inner, ranks, public_tokenizers.PATTERN, id_col=names["doc_id"], text_col=names["text"], keep_text=True)
    return _counted(public(out, names, []))


@_stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of ids and decoded bytes; a null text has none, other columns go."""
    ranks = read_file(public_tokenizers.path(RANKS))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date with the text, in its type; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE encoding", encode_stage),
]

#: SQL can express neither the concentration steps nor BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read back."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{path}/{k}")
    return docs
