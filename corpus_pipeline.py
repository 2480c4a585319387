"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next stage's ``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnhelm.llm import jaccard, language, mixing, packing
from tarnhelm.llm.common import keep, small_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts that are null or have no letter go.

    Every text with a letter is given a language if any row is labelled, so all of these stay,
    very long and repeated ones too; without labelled rows none does. Ties go to the least
    language name. An empty table stays empty. Other columns are kept whatever their names.
    """
    small_batches(spark)
    path = language.vocabulary()
    train = docs.where(~language.held_out(docs["doc_id"]))
    langs, probs = language.fit(train, path)
    names = {c: c if c == "text" else f"_d_{i}" for i, c in enumerate(docs.columns)}
    judged = language.predict(
        docs.select(*[docs[c].alias(n) for c, n in names.items()]), langs, probs, path)
    found = judged.where(judged["lang_pred"] != language.UNDETERMINED)
    return found.select(*[found[n].alias(c) for c, n in names.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of linked near-duplicates.

    Null texts and texts without words are linked with nothing and stay, as do rows without an
    id. Of rows that repeat an id and its text one stays. Whole texts are compared. An empty
    table stays empty. Other columns are kept whatever their names.
    """
    small_batches(spark)
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is a source of its own, the last. Null texts and texts without words have size
    0 and are taken as often as others of their source and place. Rows that share an id share
    their place and are taken alike. An empty table
    stays empty. Other columns are kept whatever their names.
    """
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the training sequences.

    A null or empty text is the end mark alone; long texts are cut into pieces. Repeated rows are
    packed each. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed),
    ("pack", packed),
]

#: Language models and token ids are beyond SQL; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
