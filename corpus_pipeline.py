"""From raw documents to token ids: five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Documents whose language can't be told go; of each group of near duplicates one document stays; runs of words that an
earlier document has go; sources are mixed to their target weights; what is left is encoded to token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm import bpe, jaccard, language, mixing, repeats
from docgraph.llm.common import materialize, table

#: The stages learn from the corpus and deal slots by a seed: SQL can't express them.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language.keep_identified(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are linked, that of the smallest doc_id; documents without words stay."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of runs that an earlier document has; those with nothing left go."""
    return repeats.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes words of them, cut where a source's last pass stops."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids); docs are rows of files, as run() and the check write each stage's result."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, settled=True).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("mix", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
