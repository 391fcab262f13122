"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`, extra ones among them, whatever their names (those that
begin with two underscores and "sx" are reserved). Null texts count as empty; empty tables pass through; texts of any length are
taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm import jaccard, linededup, mixing, packing, quality
from strandex.llm.base import BLANKS, forget, written


def _whole(docs: DataFrame):
    """All columns of `docs` as one, so that none clashes with what a stage adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__sx_row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps, unchanged.

    Null and empty texts have too few words and go. Repeated rows, with an id or without, are judged each.
    """
    rows = quality.judged(quality.ledger(docs.select(_whole(docs), "text"), keep=("__sx_row",)))
    return rows.where("kept").select("__sx_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that an earlier document holds; n_chars follows, and texts left empty go.

    Null and empty texts lose nothing and stay. Rows without an id are the earliest, and take part like others. Of equal ids the smaller hash
    of the text is the earlier; repeated rows of one id and text are one text, and all keep what it keeps.
    """
    out = linededup.dedup_lines(docs.select("doc_id", "text", _whole(docs)))
    out = out.where((F.col("n_lines_removed") == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_lines_removed") == 0, F.col("__sx_row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"__sx_row.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies: five words, similarity 0.8. It stays unchanged.

    Null, empty and blank texts are near nothing, and rows without an id can't be named, so that both stay. Rows that share an id
    are one document: all stay or all go.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), k=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Clean tokens stay as they are; the others are brought to their weights beside them. By this stage every document has passed the
#: rules and is the only one of its kind, and a clean one is worth more than a share met to the last token: shares are met by
#: repeating or leaving out the others. The query of the operator, op6, mixes all domains.
TARGETS = tuple(mixing.Domain(d.name, d.where, {"clean": 0.96, "toxic": 0.01, "low": 0.03}[d.name]) for d in mixing.DOMAINS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, with an id or without, as often as its rate says, by the target weights of the domains.

    Null and empty texts have no tokens and the priors. Repeated rows of one id and text get the same number of copies each.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.withColumn("__sx_th", F.xxhash64("text"))  # tells rows of one id apart, those without an id too
    n = mixing.mix(own, labels, TARGETS, at_present=("clean",), most=2.0, keep=("doc_id", "__sx_th")).groupBy("doc_id", "__sx_th").agg(F.max("copies").alias("__sx_copies"))
    n = n.where("__sx_copies > 0").select(F.col("doc_id").alias("__sx_id"), F.col("__sx_th").alias("__sx_th2"), "__sx_copies")
    out = own.join(n, F.col("doc_id").eqNullSafe(F.col("__sx_id")) & (F.col("__sx_th") == F.col("__sx_th2")))
    return out.withColumn("__sx_copy", F.explode(F.sequence(F.lit(1), "__sx_copies"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 2048 tokens. Null and empty texts are their end id; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mixing_sources),
    ("packing", packing_sequences),
]

#: The classifier's and the solver's sums are floating point, and a BPE tokenizer isn't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table is deleted as soon as the next one's is written."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), name.replace(" ", "-"))
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
