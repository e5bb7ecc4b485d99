"""Shared pieces: text normalisation, tables in the cluster's shared folder, stable hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A pure ASCII value takes the built-in lower(), which then does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, then) -> Column:  # noqa: ANN001
    """then(x), where x is value, evaluated once. Without it, an expression that is used in a lambda runs for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on a local master,
    as in tests; on a cluster, where a folder of one machine would be no good, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that written() made in this application, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe when executors are lost.

    The table lies under <spark.checkpoint.dir>/tidelog/<application id>/ until release() or until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


BITMAP_BITS = 32_768  # of Spark's bitmap functions
#: A filter is broadcast up to this size and joined by bitmap number beyond it.
FILTER_BYTES = 32 << 20


def bitmap_number(position: Column) -> Column:
    return F.bitmap_bucket_number(position + 1)  # it counts from 1


def bitmaps(positions: DataFrame) -> DataFrame:
    """number and bits: the column at of positions as 4 KB bitmaps, one for each 32,768 bits."""
    at = F.col("at")
    return positions.groupBy(bitmap_number(at).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether the bit is set in its bitmap; a missing bitmap has no bits."""
    at = F.pmod(position, F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substr(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))


def looked_up(rows: DataFrame, filter_: DataFrame, filter_bits: int, position: Column, name: str) -> DataFrame:
    """rows with a boolean column that tells whether the position is set. The filter has filter_bits bits, which bound its size."""
    own = filter_.select(F.col("number").alias("number_"), F.col("bits").alias("bits_"))
    own = F.broadcast(own) if filter_bits // 8 <= FILTER_BYTES else own
    placed = rows.withColumn("at_", position)
    return placed.join(own, bitmap_number(F.col("at_")) == F.col("number_"), "left").withColumn(name, has_bit(F.col("bits_"), F.col("at_"))).drop("at_", "number_", "bits_")


#: Groups of over total / HOT_GROUPS rows are joined by broadcast; there are fewer than HOT_GROUPS of them.
HOT_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the group that has their keys, inner. size: the groups' column of row counts, which add up to total at most.

    The few large groups are broadcast, so that their rows stay where they are; the rest are joined by a shuffle.
    """
    large = F.col(size) > max(1, total // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(large)), groups.where(~large)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def texts(batch) -> list[bytes]:  # noqa: ANN001
    """The UTF-8 bytes of an Arrow column of strings; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.cast(pa.binary()).to_pylist()]


def trained_on(remainder: int, modulus: int, id_col: str = "doc_id") -> Column:
    """Whether a row may be learned from: crc32 of the id as text, modulo modulus, isn't remainder. A null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) != remainder
