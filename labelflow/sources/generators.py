"""CSV sources and generators of the demo applications; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_transactions(lines: DataFrame, value: str = "value") -> DataFrame:
    """entity_id, transaction_id, state, sensitivity of ``entity,transaction,state`` lines; shorter lines go.

    sensitivity is 0 to 2, drawn by a hash of the transaction.
    """
    p = F.split(value, ",")
    t = lines.where(F.size(p) >= 3).select(p[0].alias("entity_id"), p[1].alias("transaction_id"), p[2].alias("state"))
    return t.withColumn("sensitivity", F.pmod(F.xxhash64("transaction_id"), F.lit(3)))


def js_int(c: Column) -> Column:
    """A leading whole number as parseInt reads it, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def js_float(c: Column) -> Column:
    """A leading decimal number as parseFloat reads it, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def parse_plugs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Readings of ``id,timestamp,value,property,plug,household,house`` lines; lines of another length go."""
    p = F.split(value, ",", -1)
    return lines.where(F.size(p) == 7).select(p[0].alias("id"), js_int(p[1]).alias("ts"), js_float(p[2]).alias("value"), js_int(p[3]).alias("property"), p[4].alias("plug"), p[5].alias("household"), p[6].alias("house"))


def camera(spark: SparkSession, frames: int, fps: int = 15, identified: float = 0.5, seed: int = 1) -> DataFrame:
    """ts (ms), person, data of generated frames; a person is seen in a share of them."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    return spark.range(frames).select(F.floor(F.col("id") * 1000 / fps).alias("ts"), F.when(u < identified, "resident-1").otherwise("").alias("person"), F.base64(F.encode(F.concat(F.lit("frame-"), F.col("id").cast("string")), "UTF-8")).alias("data"))


def wearable(spark: SparkSession, records: int, hz: int = 2, patient: str = "resident-1", seed: int = 2) -> DataFrame:
    """patient_id, ts (ms), vitals of a generated wearable."""
    u = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(n))
    v = F.struct(F.lit("wearable").alias("kind"), (60 + u(0, 45)).cast("int").alias("heart_rate"), (92 + u(1, 8)).cast("int").alias("spo2"), (u(2, 1000) / 1000).alias("accel"))
    return spark.range(records).select(F.lit(patient).alias("patient_id"), F.floor(F.col("id") * 1000 / hz).alias("ts"), v.alias("vitals"))


def write_json(df: DataFrame, path: str) -> None:
    """A JSON line per record."""
    df.write.mode("errorifexists").json(path)


def read_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines profile logs of all runs below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
