"""What several operators of this subpackage share: the shared folder, written tables, and cutting text into chunks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark is local.

    A path without a scheme is one of Spark's default file system, which other readers have to be told.
    """
    if told := spark.conf.get("spark.checkpoint.dir", None):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        return ("" if ":" in told or default.startswith("file:") else default.rstrip("/")) + told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quirefold-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirefold-{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes made inside drop their shuffle files when they are done."""
    old = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has written, when nothing is read from them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def map_batches(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """mapInArrow where fn takes and returns lists of columns: fn(iterator of dicts of lists) -> iterator of dicts."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, kind)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[dict[str, list]]:
    """Few rows at a time, so that a task holds a bounded share of a batch as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df, in any case of letters, doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def commonest(df: DataFrame, n: str, key: str, most: int) -> DataFrame:
    """About the ``most`` rows of a stored df with the largest counts n; of the last that are as common, some by a hash of key.

    Counts are told apart to a hundredth part. What the driver sees is a row for each such step; no row is moved.
    """
    step = F.floor(F.log(F.col(n)) * 100).cast("long")
    sizes = df.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total = 0
    for r in sizes:
        if total + r[1] > most:
            some = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 20)) < int((most - total) / r[1] * (1 << 20))
            return df.where((step > r.step) | (step == r.step) & some)
        total += r[1]
    return df


_BLANK_THEN_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks(text: str) -> tuple[str, list[str]]:
    """text as a first chunk and further ones, each of which follows a space that isn't given.

    The cuts lie between a character that is no white space and a space, where the split pattern of the byte-level
    vocabularies always ends a match; so the chunks can be encoded one by one. A blank before a space forbids that
    cut, and such a text takes the slower way, whose chunks may hold several blanks.
    """
    if _BLANK_THEN_SPACE.search(text) is None:
        if text[:1] == " ":
            return "", text[1:].split(" ")
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _CUT.split(text)
    return first, [x[1:] for x in rest]


def utf8(column) -> F.Column:
    """Bytes of a text, none for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


class Recent:
    """What was made for keys of late: up to twice ``half`` entries, of which those that aren't used again go first."""

    def __init__(self, half: int):
        self.half, self.now, self.old = half, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Those of the distinct keys that have to be made and put into ``now``; all others are there."""
        keys = list(keys)
        if len(self.now) + len(keys) > self.half:
            self.now, self.old = {}, self.now
        now, old, out = self.now, self.old, []
        for key in keys:
            if key not in now:
                found = old.get(key)
                if found is None:
                    out.append(key)
                else:
                    now[key] = found
        return out


#: What a Python worker keeps for its next tasks, by name.
KEPT: dict = {}


def kept_in_worker(name, make):
    if name not in KEPT:
        KEPT.clear()  # one thing at a time, so that workers stay small
        KEPT[name] = make()
    return KEPT[name]
