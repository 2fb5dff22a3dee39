"""The training-corpus pipeline: toxic documents go, one document of each near-duplicate group stays, the
mix is brought to its target weights, and what is left is packed into sequences.

Each stage reads what the one before kept. The tables that a stage wrote for itself are deleted when the next
stage begins, since its result has been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.jaccard_join import jaccard_join
from lexiloom.llm.packing import pack
from lexiloom.llm.pu_toxicity import fit, score
from lexiloom.llm.soft_mixing import soft_mix
from lexiloom.llm.words import release
from lexiloom.plans.lineage import forget, materialise, recorded, tidy

TOXIC = 0.7
WORDS, SIMILARITY = 5, 80
#: Target shares of the tokens. No document's rate falls below one, so the mix is reached by repeating.
WEIGHTS = {"high": 0.90, "low": 0.10}

_own: list = []


def _begins(spark: SparkSession) -> None:
    forget(_own)
    _own.clear()
    recorded()
    release()  # the driver keeps nothing of the stage before
    tidy(spark)


def _ends(df: DataFrame) -> DataFrame:
    _own.extend(recorded())
    return df


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC; learned from all labelled ones.

    Rows of null or empty text or of null id, and repeated rows, are judged like others. Without toxic labels every document stays.
    """
    _begins(spark)
    toxic = _fresh(docs, "toxicity")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, F.lit(True))
    return _ends(score(docs, model, into=toxic).where(F.col(toxic) < TOXIC).drop(toxic))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group. Rows with a null doc_id, and
    rows of null or empty text, stay; rows that repeat a doc_id are documents of their own, of which the first in text order comes first, and of rows that repeat both one stays."""
    _begins(spark)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1").limit(1).count():
        # sorted, so that numbers follow doc_id and text; written, so that they stay
        row = _fresh(docs, "row")
        own = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        rows = materialise(own.orderBy("doc_id", "text").withColumn(row, F.monotonically_increasing_id()))
        found = jaccard_join(rows, id_=row, width=WORDS, percent=SIMILARITY)
        gone = found.where(F.col(row) != F.col("component_id")).select(row)
        kept = rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)
        return _ends(kept.unionByName(docs.where("doc_id is null")))
    found = jaccard_join(docs, width=WORDS, percent=SIMILARITY)
    gone = found.where("doc_id <> component_id").select("doc_id")
    # what goes grows with the documents, so at no size is it broadcast
    return _ends(docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, once at least.

    Copies of a document are equal rows. A null doc_id has no rate and stays once; rows that share a doc_id are repeated alike.
    Null and empty texts have a rate by their labels and the end token alone.
    """
    _begins(spark)
    copies, copy = _fresh(docs, "copies"), _fresh(docs, "copy")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    rated = soft_mix(docs, labels, quality, WEIGHTS, least=1.0, shrink=False)
    more = materialise(rated.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(copies)))
    times = F.greatest(F.coalesce(copies, F.lit(1)), F.lit(1))
    mixed = docs.join(more.hint("merge"), "doc_id", "left").withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return _ends(mixed.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of each document's copies.

    Copies are packed like documents of their own; their pieces carry one doc_id, null where it is null. A null or empty
    text is its end token.
    """
    _begins(spark)
    return _ends(pack(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned scores, near-duplicate groups and packings are not SQL's to say; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            recorded()
    return docs
