"""Work on rows with nested values, or on the ordered rows of each group, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that are Python objects at a time.
ROWS = 500


def each_row(df: DataFrame, schema: str, work: Callable[[dict], list[tuple]]) -> DataFrame:
    """work(row) -> rows of the schema. df's rows are dealt out first, by their first column, as they are small and the work isn't."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = [out for row in batch.slice(at, ROWS).to_pylist() for out in work(row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(run, kind)


def by_group(df: DataFrame, key: str, columns: list[str], schema: str, work: Callable[[object, list], list[tuple]]) -> DataFrame:
    """work(key, rows in order of columns) -> tuples; the result has the key and, by schema, the tuples' fields.

    A group's rows are gathered as an array, so that a batch brings many small groups at once.
    """
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    return each_row(gathered, f"{key} {dict(df.dtypes)[key]}, {schema}", lambda row: [(row[key], *out) for out in work(row[key], row["_rows"])])
