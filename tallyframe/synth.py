"""Synthetic station;temperature[;sensor] lines, drawn by Spark from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stations(n: int = 104) -> list[tuple[str, float]]:
    """n station names with mean temperatures spread between -15 and 30 degrees."""
    first = ("North", "South", "East", "West", "Upper", "Lower", "Old", "New", "Port", "Mount", "Saint", "Fort", "Lake")
    second = ("haven", "field", "bridge", "mouth", "ford", "gate", "wick", "holm")
    names = [f"{a}{b}" for a in first for b in second]
    return [(names[i % len(names)] + (str(i // len(names)) if i >= len(names) else ""), -15.0 + 45.0 * i / max(1, n - 1)) for i in range(n)]


def readings(spark: SparkSession, rows: int, seed: int = 42, stddev: float = 10.0, sensors: int = 0, partitions: int | None = None) -> DataFrame:
    """station, temperature (one decimal) and, with sensors > 0, sensor_id."""
    table = stations()
    pick = (F.rand(seed) * len(table)).cast("int")
    df = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    df = df.select(pick.alias("i"), F.randn(seed + 1).alias("z"), F.rand(seed + 2).alias("u"))
    names, means = F.array(*(F.lit(n) for n, _ in table)), F.array(*(F.lit(m) for _, m in table))
    columns = [F.get(names, "i").alias("station"), F.round(F.get(means, "i") + F.col("z") * stddev, 1).alias("temperature")]
    if sensors:
        columns.append(F.concat(F.lit("sensor-"), (F.col("u") * sensors).cast("bigint")).alias("sensor_id"))
    return df.select(*columns)


def write_text(df: DataFrame, path: str, delimiter: str = ";") -> None:
    """Headerless delimited lines; numbers with one decimal."""
    cells = [F.format_string("%.1f", c) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(delimiter, *cells).alias("value")).write.mode("overwrite").text(path)
