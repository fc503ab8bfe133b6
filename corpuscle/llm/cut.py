"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session, else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids up to which a table is broadcast rather than shuffled; a row of two numbers takes 40 to 80 bytes there.
#: The driver gathers and serves each such table, and several are held at once.
BROADCAST_ROWS = 100_000


def within(table: DataFrame) -> DataFrame:
    """``table``, written already, of rows of a few numbers, to be broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Bits of a filter at most, in rows of 32,768: 8 MB are broadcast, however many ids they stand for.
FILTER_BITS = 1 << 26


def filter_bits(ids: int) -> int:
    """16 to 32 bits an id, so that a filter of few ids is small."""
    return min(FILTER_BITS, max(1 << 15, 1 << (16 * ids).bit_length()))


def perhaps_within(rows: DataFrame, column: str, ids: DataFrame, bits: int | None = None) -> DataFrame:
    """``rows`` less most of those whose ``column`` (a hash, as long) is not in ``ids`` (a written table of that column).

    For what is joined with ``ids`` next by a shuffle: rows that the filter keeps by chance go there.
    """
    bits = bits or filter_bits(ids.count())
    place = F.pmod(F.col(column), F.lit(bits))
    marks = ids.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_marks"))
    own = rows.withColumn("_b", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_b")
    at = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.where(F.getbit(octet, (at % 8).cast("int")) == 1).drop("_b", "_marks")


class Scratch:
    """Tables in the shared folder, as Parquet, that go when the work that needs them is done.

    Smaller than checkpoints, and read by column. Use it as a context; what leaves it must
    have been computed by then, by ``cut``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, below: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + below)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def read(spark, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
