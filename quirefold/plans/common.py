"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators import postings, search
from quirefold.sources.shared import fresh_path
from quirefold.sources.tables import table

QUERY = "the reand and thstea of onthe ingti reinan the"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_indexes: dict[tuple[str, str], str] = {}


def search_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The stored index of all documents, built by the first query of a session that needs it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        path = fresh_path(spark, "postings")
        postings.build(search.index_terms(docs(spark, sf_dir), "doc_id"), path)
        _indexes[key] = path
    return postings.opened(spark, _indexes[key])
