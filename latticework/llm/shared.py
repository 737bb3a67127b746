"""Tables written in the folder that driver and executors share, columns picked by name, and Python passes over a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import _text

#: Arrow batches have so many bytes at most, not Spark's 64 MB: tasks hold several copies of a batch. A session's own setting is kept.
BATCH_BYTES = 4 << 20
_BATCHES, _BATCHES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests on one machine, a temporary folder of this process; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="latticework-"))
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and lost executors don't undo it. options: of the Parquet writer."""
    where = path(df.sparkSession, name)
    df.write.options(**options).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
            where.getFileSystem(hadoop).delete(where, True)


def position(df: DataFrame, name: str) -> int:
    """Where a column stands: that of exactly this name, else one that differs in case."""
    names = df.columns
    return names.index(name) if name in names else [x.lower() for x in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, .., so that dots, blanks and clashes in names don't matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """New columns from df's columns of the given names."""
    return numbered(df).select(*[F.col(f"c{position(df, old)}").alias(new) for new, old in columns.items()])


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches of a bounded size; workers give their memory back when a task ends."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, _BATCHES_DEFAULT) == _BATCHES_DEFAULT:
        conf.set(_BATCHES, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _text.release()

    return df.mapInArrow(bounded, schema)


def annotated(docs: DataFrame, text: str, schema: str, measure: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with the columns of ``schema``, which measure makes from the text column of a batch. One pass, no shuffle.

    Columns of docs that have the name of a new one are replaced by it; others pass through whatever their names.
    """
    new = T._parse_datatype_string(schema)
    taken = {c.lower() for c in new.names}
    at = position(docs, text)
    if docs.columns[at].lower() in taken:
        raise ValueError(f"the text column can't be named {text}")
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in taken]
    rows = numbered(docs).select(*[F.col(f"c{i}").cast("string") if i == at else f"c{i}" for i in keep])
    own = keep.index(at)
    fields = [T.StructField(docs.columns[i], rows.schema[k].dataType) for k, i in enumerate(keep)]
    names = [f.name for f in fields] + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *measure(batch.column(own))], names=names)

    return mapped(rows, run, T.StructType([*fields, *new.fields]))


def filtered(docs: DataFrame, text: str, keep: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of docs for whose text keep gives true, with all columns as they are, whatever their names. One pass, no shuffle."""
    at = position(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(keep(batch.column(at)))

    return mapped(numbered(docs), run, numbered(docs).schema).toDF(*docs.columns)
