"""The corpus pipeline: what goes into training, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of documents. ``run`` writes every stage's rows to the shared
folder as Parquet, so a stage is computed once and a lost executor repeats only its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import discard, materialise, packed, table, unpacked
from peptora.llm.packing import pack_documents
from peptora.llm.quality import score_documents as score_quality
from peptora.llm.resemblance import one_of_each
from peptora.llm.substring import remove_repeats
from peptora.llm.toxicity import score_documents as score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go (operator 5, learnt from the labels of the folds that it may learn from).

    Null and empty texts have no evidence and stay, and so do rows with a null doc_id that aren't toxic. Long texts are
    scored whole, by their mean evidence a word. A score at the threshold is toxic. Repeated rows fall or stay together.
    Without labels of both classes nothing goes. An empty table gives none; other columns pass through, whatever their names.
    """
    return unpacked(score_toxicity(packed(docs), table(spark, sf_dir, "labels")).where("predicted = 0"), docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't accept go (operator 2).

    Null and empty texts have the intercept's score, which decides for all of them alike. Long texts are scored whole. A
    score at the threshold is accepted. Repeated rows and rows with a null doc_id are judged by their texts. Without labels
    every score is a half, which isn't accepted. An empty table gives none; other columns pass through, whatever their names.
    """
    return unpacked(score_quality(packed(docs), table(spark, sf_dir, "labels")).where("predicted = 1"), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard index of 0.8 or more of their five-word shingles one row stays, that of the smallest doc_id.

    Candidates come from operator 1's fingerprints and anchors, and from minima for what its 4 bits don't reach; every link is
    checked on the whole texts. Null, empty and wordless texts are copies of each other; a text under five words is one
    shingle. Ties in doc_id: the least fingerprint, then the least row hash. Equal rows count once; a repeated doc_id with
    unlinked texts keeps a row of each; a null doc_id comes last. An empty table gives none; other columns pass through.
    """
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has too are cut out (operator 7), and n_chars follows.

    A text that loses nothing stays as it is, to the byte; of others the kept words are joined by one space. Null and empty
    texts, and texts under 50 words, lose nothing, nor do rows with a null doc_id. Rows of one doc_id are judged each by
    its own words and never against one another. An empty table gives none; other columns pass through, whatever their names.
    """
    cut = F.size("removed") > 0
    before = [c for c in docs.columns if c not in ("doc_id", "text")].index("n_chars")
    n_chars = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest")[f"c{before}"])
    return unpacked(remove_repeats(packed(docs)), docs.columns, n_chars=n_chars, text=F.when(cut, F.col("kept")).otherwise(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2,048 ids and the sequences that they go to (operator 4): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Longer documents are cut, others never. Repeated rows, and rows with a null
    doc_id, take a place each. Of equal lengths the hash of a piece and then its doc_id decide who comes first. An empty table gives none.
    """
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near duplicates", keep_one_of_each), ("repeated passages", cut_repeats), ("packing", pack)]

#: Trained models and tokenizer ids are nothing that SQL computes; tests hold each stage and run() against versions in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
