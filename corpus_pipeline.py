"""A training corpus from raw documents, in stages that each call one operator.

Every stage but the last returns the columns of documents, extra ones of any name as they were. Their models learn from what they are given: the languages from
the labelled rows among the documents, the personal-data field from its labelled table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.llm import languages, pii
from timeloom.llm.common import load, materialize
from timeloom.llm.components import components
from timeloom.llm.near_copies import near_copies
from timeloom.llm.packing import pack_documents
from timeloom.llm.simhash import simhash_near_dups
from timeloom.llm.substrings import substring_dedup

#: A text of which no language has this share of the n-grams is in none of the known languages.
LEAST_SCORE = 0.2


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of other names, which no operator's results or helpers have, and the new name of each."""
    inner = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), inner


def _back(found: DataFrame, inner: dict[str, str], text=None) -> DataFrame:
    """The columns of docs under their names, with another text and its length if there is one."""
    new = {} if text is None else {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in inner.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or in no known language go. Without a labelled row to learn from, all stay."""
    rows, inner = _apart(docs)
    names = {"id_col": inner["doc_id"], "text_col": inner["text"]}
    model = languages.train(rows.where(~languages.held_out(inner["doc_id"])), lang_col=inner["lang"], **names)
    if not model.languages:
        return docs
    judged = languages.identify(rows, model, keep=tuple(rows.columns), **names)
    return _back(judged.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), inner)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays: those that links of operator 1's fingerprints connect, or links of similarity 0.8
    or more of their sets of five-word shingles, which fingerprints alone don't all tell. A repeated row stays once; a row without an id stays if its group has no other."""
    rows, inner = _apart(docs)
    i, text = inner["doc_id"], inner["text"]
    whole = rows.withColumn("_key", F.xxhash64(i, text))
    prints = simhash_near_dups(whole, i, text, keep=("_key",)).select("_key", F.col("component_id").alias("_s")).distinct()
    found = materialize(near_copies(whole, i, text, keep=("_key",)), "near")
    # a group of either kind is a node, and each row connects its two groups
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c), F.when(F.col(c).isNull(), F.col("_key")))
    each = found.select("_key", F.col("component_id").alias("_g")).distinct()
    edges = materialize(each.join(prints, "_key").select("_g", node(0, "_g").alias("a"), node(1, "_s").alias("b")).distinct(), "edges")
    joined = edges.select("_g", "a").distinct().join(components(edges.select("a", "b").distinct()).withColumnRenamed("node", "a"), "a")
    least = joined.groupBy("root").agg(F.min("_g").alias("_least"))
    stays = joined.join(least, "root").where(F.col("_g").eqNullSafe(F.col("_least"))).select("a")
    first = found.where(F.col(i).eqNullSafe(F.col("component_id"))).withColumn("_g", F.col("component_id"))
    first = first.select("_key", node(0, "_g").alias("a")).distinct().join(stays, "a", "left_semi").select("_key").distinct()
    # texts move once, to their key; there repeated rows meet, too
    again = F.row_number().over(Window.partitionBy("_key", i, text).orderBy("_key"))
    return _back(whole.join(first, "_key", "left_semi").withColumn("_again", again).where("_again = 1"), inner)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out; other texts stay as they are."""
    rows, inner = _apart(docs)
    found = substring_dedup(rows, inner["doc_id"], inner["text"], keep=tuple(rows.columns))
    return _back(found, inner, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(inner["text"])))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind."""
    rows, inner = _apart(docs)
    found = pii.find_pii(rows, pii.train(pii.labelled_table(spark)), inner["doc_id"], inner["text"], keep=tuple(rows.columns))
    return _back(found, inner, F.col("masked"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens goes."""
    return pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("near-dedup by shared shingles", without_near_copies),
    ("substring dedup", without_repeats),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: SQL has none of the stages' hashes, models and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents, each one's result written to the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
