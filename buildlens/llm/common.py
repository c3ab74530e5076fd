"""What the corpus operators share: the word pattern, column names that clash with none,
and functions of one text in Python workers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import reach_workers, shared_dir, table, written  # noqa: F401

#: A word is a run of characters other than space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def limit_batches(spark: SparkSession) -> None:
    """Batches of the Parquet reader and of Arrow are small in rows, so that very long
    texts do not become one huge batch; and workers find this package."""
    reach_workers(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def collect_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's collector finds
    that nothing refers to them; this asks for it, as a small driver heap may wait long."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    files, jvm = df.inputFiles(), df.sparkSession.sparkContext._jvm
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells its rows apart. For rows that are read from files it is
    file and place, which stay the same however often they are read; others are written."""
    try:
        return docs.select("*", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias(name))
    except AnalysisException:
        return written(docs, with_row_id=name)


def with_python(df: DataFrame, column: str, make, fields: list[tuple[str, str]], setup=None) -> DataFrame:
    """df without `column`, plus the fields that make(value) returns as a tuple.

    Python sees one Arrow batch at a time and works on it in slices, so memory is
    bounded by a batch. Rows are independent, so a lost task is simply run again.
    setup() runs once in each worker; its result is then make's second argument."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    source = df.select(*kept, column)
    limit_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        state = (setup(),) if setup else ()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [make(x, *state) for x in part.column(len(kept)).to_pylist()]
                made = [pa.array(list(c), arrow.field(len(kept) + i).type) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(i).cast(arrow.field(i).type) for i in range(len(kept))] + made, schema=arrow)

    return source.mapInArrow(run, schema)
