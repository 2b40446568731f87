"""The corpus pipeline: stages that each apply one operator to what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm import chosen_path, packing, pii, quality, toxicity
from cumulus.llm import queries as Q
from cumulus.llm.staging import staged


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that no operator adds, and these names by the old ones."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(new).alias(old) for old, new in names.items()])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, does not reject as toxic."""
    apart, names = _apart(docs)
    labels = Q.categories(Q.table(spark, sf_dir, "labels")).withColumnRenamed("doc_id", names["doc_id"])
    judged = toxicity.judge(apart, labels, ["junk", "toxic"], "toxic", id_col=names["doc_id"], text=names["text"])
    return _back(judged.where("NOT rejected"), names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie near their language and source."""
    apart, names = _apart(docs)
    judged = quality.judge(apart, text=names["text"], lang=names["lang"], source=names["source"])
    return _back(judged.where("kept"), names)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity of 0.8 or more).

    The smallest id stays; of rows that repeat it, the smallest by their other
    columns.  Documents without id belong to no group and stay.
    """
    found = chosen_path.components(docs, words=5, similarity=0.8)
    stay = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    one = one.join(stay, "doc_id", "left_semi").select(
        *[F.col("doc_id") if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in docs.columns])
    return one.unionByName(docs.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts under pseudonyms; n_chars is that of the new text."""
    out = pii.pseudonymise(docs, Q.KEY, count=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed."""
    return packing.pack(docs, Q.RANKS, specials=Q.SPECIALS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the stages (a trained classifier, robust estimates, keyed permutations).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read back."""
    docs = Q.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "_"))
    return docs
