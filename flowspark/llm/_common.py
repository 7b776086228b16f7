"""What the training-data operators share: reading, written tables, text kernels."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper-case ASCII to lower case in UTF-8 bytes; all other bytes stay.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (in tests) one of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if at := spark.sparkContext.getCheckpointDir():
        return at.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete an action's shuffle files when the action is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; the session's setting is put back after."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage so that lost executors
    cost a read, not a recomputation. What was shuffled on the way is deleted."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables by name; `put` deletes the table that had the name before, `drop` those that
    nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, name)
        rows = written(df, name, path)
        self.drop(name)
        self.at[name] = path
        return rows

    def move(self, name: str, new: str) -> None:
        """Gives a table another name."""
        self.at[new] = self.at.pop(name)

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.at.pop(n) for n in names if n in self.at))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by `_` until df has no column called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more, on whatever file system they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # a leftover folder is no failure
            at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Arrow batches through fn, which takes the columns as lists and returns the new ones.

    Batches are cut to at most 512 rows before they become Python objects, so that memory
    stays bounded when texts are long.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                made = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)



def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    digit = "(instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i + {1}, 1)) - 1)"
    byte = f"{digit.format(text, 1)} * 16 + {digit.format(text, 2)}"
    steps = f"flatten(list_transform(range(strlen({text})), lambda i: [({byte})::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {bit}), 4294967295::BIGINT)"
