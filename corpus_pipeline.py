"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents:

1. toxicity: documents that are predicted to be toxic go;
2. near_duplicates: of each component of pairs whose five-word shingle sets have a Jaccard
   similarity of 0.8 or more the document with the smallest id stays; pairs are found by SimHash,
   and by prefix filtering where their fingerprints are too far apart;
3. decontamination: documents that hold a window of 13 words of the benchmark verbatim go, however long
   they are, and documents of which items shorter than that are a twentieth or more;
4. pii: personal data and terms that disclose it are replaced in the text;
5. sentencepiece: texts become ids, and decoding them is checked.

Null and empty texts pass stages 1 and 3, are one component in stage 2, and have no ids. Empty tables give empty results. Columns beside
those of documents are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm.common import materialize, spread, table
from chronoframe.llm.decontaminate import decontaminate
from chronoframe.llm.pii import sanitise
from chronoframe.llm.sentencepiece_codec import encode_documents, model_path
from chronoframe.llm.similarity import JaccardLinks
from chronoframe.llm.simhash import keep_one
from chronoframe.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = spread(docs)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, JaccardLinks())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, model_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither XXH64 nor the scans and models of these stages; brute force tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
