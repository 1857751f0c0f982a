"""A corpus from documents to tokens: language, near duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns a row of token counts and digests for each document. Null texts and texts without letters go at the first
stage. Near duplicates and benchmark passages are decided by row, by a hash of id and text, whether ids are null or stand
with other texts too: rows that repeat both are one document after the second stage. Of near duplicates the least id
stays, a null one only where there is no other, then the least hash. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, sanitise
from tidemark.llm.common import checkpoint, table


#: Keys that are broadcast at most, so that texts needn't be shuffled; more are joined: 8 bytes each.
BROADCAST_KEYS = 2_000_000
KEY = "_stage_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """A hash of id and text instead of an id. Null ids have the hashes of their texts alone."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose keys aren't among those given (_gone)."""
    keys = checkpoint(keys)
    keys = keys.hint("broadcast") if keys.count() <= BROADCAST_KEYS else keys
    return keyed.join(keys, keyed[KEY] == keys["_gone"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters in a language that is told from the others."""
    return language_id.keep_languages(docs, language_id.fit_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of five-word shingle similarity 0.8 or more."""
    keyed = _keyed(docs)
    groups = jaccard_join.jaccard_components(keyed, KEY).groupBy(KEY, "component_id").agg(F.count(F.lit(1)).alias("n"))
    ids = keyed.select(F.col(KEY).alias("_own"), "doc_id").distinct()
    groups = checkpoint(groups.join(ids, F.col(KEY) == F.col("_own")).select(KEY, "component_id", "n", "doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    stays = groups.groupBy(F.col("component_id").alias("_component")).agg(F.min_by(KEY, order).alias("_stays"))
    gone = groups.join(stays, F.col("component_id") == F.col("_component")).where(F.col(KEY) != F.col("_stays"))
    kept = _without(keyed, gone.select(F.col(KEY).alias("_gone")))
    twice = checkpoint(groups.where("n > 1").select(F.col(KEY).alias("_gone")))
    if twice.isEmpty():
        return kept.drop(KEY)
    again = kept.join(twice, kept[KEY] == twice["_gone"], "left_semi").dropDuplicates([KEY])
    return _without(kept, twice).unionByName(again).drop(KEY)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of ten words of the benchmark."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), KEY)
    return _without(keyed, found.where(F.size("spans") > 0).select(F.col(KEY).alias("_gone"))).drop(KEY)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data and what gives it away generalised in their texts."""
    out = sanitise.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", remove_personal_data),
    ("encoding", encode),
]

#: Language models and graph components have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
