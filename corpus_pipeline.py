"""A corpus pipeline: each stage is one operator over all that its predecessor kept.

Languages are identified and texts without one go; one document of each
near-duplicate group stays; passages that repeat go; sources are mixed to
their weights; what is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id, mixing, near_dup, packing, substring_dedup
from sparkloom.llm.common import Scratch, read

#: Least share of the likelihood for a language to be accepted.
SURE = 0.5

#: Words of a passage that may not occur twice.
PASSAGE_WORDS = 50


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator looks at, all others in one struct, so that no name can clash."""
    return docs.select(*own, F.struct(*(docs[f"`{c}`"] for c in docs.columns if c not in own)).alias("_rest"))


def _together(out: DataFrame, columns: list[str], own: dict[str, Column]) -> DataFrame:
    """The columns in their old order: own ones as given, all others from the struct."""
    return out.select(*(own[c].alias(c) if c in own else F.col(f"_rest.`{c}`").alias(c) for c in columns))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with it in lang.

    Null, empty and letterless texts and those with no language of a share of
    SURE go; ties go to the first language in code-point order.  Repeated rows
    stay each for itself.  Long texts are read whole.  Columns of any other
    name keep their values.  An empty table stays empty.
    """
    found = language_id.identify(_apart(docs, "doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE))
    return _together(kept, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text"), "lang": F.col("lang_pred")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are similar to 0.8 or more, that of the smallest doc_id.

    Texts without words, null ones among them, are one group.  Null ids come
    last; among equal ids a hash of the row decides, so reruns agree.  Long
    texts are compared whole.  All columns are kept.  An empty table stays
    empty.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur again, and n_chars of what is left; those of which nothing is left go.

    Null and empty texts and those under PASSAGE_WORDS words stay as they are.
    Repeated rows repeat each other, so all their long passages go.  Columns
    of any other name keep their values.  An empty table stays empty.
    """
    out = substring_dedup.dedup_substrings(_apart(docs, "doc_id", "text"), PASSAGE_WORDS)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.n_chars"))
    return _together(out, docs.columns, own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of the one at its source's threshold the first words.

    Null and empty texts are not in the mix; a null source is one.  Repeated
    rows are taken alike.  All columns are kept, n_chars is that of the text.
    An empty table stays empty.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens at most.

    Null and empty texts have the ending id alone; long texts are cut over
    sequences; repeated rows are packed each for itself.  An empty table gives
    no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: Learned stages and a tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; stages before it are written to the shared folder."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
