"""Range reads of sequences from a table of fixed chunks.

A genome is written once as chunks of so many bases, dealt to folders by a hash of chromosome and stretch. Ranges
name the chunks they touch by arithmetic, so a join on folder, chromosome and chunk prunes folders at run time
(dynamic partition pruning) and row groups by their statistics before any sequence is read; what is read grows with
the ranges, not with the genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of a chunk, chunks of a stretch that lies in one folder, and folders.
CHUNK, STRETCH, FOLDERS = 1 << 16, 64, 256


def _folder(chromosome: Column, chunk: Column, folders: Column | int) -> Column:
    return F.pmod(F.xxhash64(chromosome.cast("string"), F.floor(chunk / STRETCH)), F.lit(folders) if isinstance(folders, int) else folders).cast("int")


def write_chunks(genome: DataFrame, path: str, chunk: int = CHUNK, folders: int = FOLDERS) -> None:
    """Write (chr, seq), upper-cased, as a table of chunks. Sequences are ASCII; empty ones have no chunk."""
    whole = genome.filter(F.length("seq") > 0).select("chr", F.upper("seq").cast("binary").alias("bytes"))
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("bytes") - 1) / chunk))
    cut = F.transform(starts, lambda i: F.struct(i.alias("chunk"), F.substr("bytes", (i * chunk + 1).cast("int"), F.lit(chunk)).cast("string").alias("bases")))
    rows = whole.select("chr", F.explode(cut).alias("c")).select("chr", "c.*", _folder(F.col("chr"), F.col("c.chunk"), folders).alias("folder"))
    rows.repartition("folder").sortWithinPartitions("folder", "chr", "chunk").write.partitionBy("folder").parquet(f"{path}/chunks")
    genome.sparkSession.createDataFrame([(chunk, folders)], "chunk int, folders int").coalesce(1).write.parquet(f"{path}/sizes")


def touched(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """ranges with the chunks that each of them touches: chunk and bases, a row a chunk."""
    chunk, folders = spark.read.parquet(f"{path}/sizes").first()
    asked = ranges.filter((F.col("start") <= F.col("stop")) & (F.col("stop") > 0))
    number = lambda at: F.floor((F.greatest(at, F.lit(1)) - 1) / chunk)
    named = asked.withColumn("chunk", F.explode(F.sequence(number(F.col("start")), number(F.col("stop")))))
    named = named.withColumn("folder", _folder(F.col("chr"), F.col("chunk"), folders))
    return named.join(spark.read.parquet(f"{path}/chunks"), ["folder", "chr", "chunk"]).drop("folder")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, chr, start, stop and more, 1-based and closed) with seq, seq_start and seq_stop.

    Bounds are clamped to the sequence; a range that holds none of it, or has a null bound, has a null seq. keys
    tell the ranges apart.
    """
    chunk = spark.read.parquet(f"{path}/sizes").first()["chunk"]
    parts = touched(spark, path, ranges.select(*keys, "chr", "start", "stop"))
    joined = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "bases"))).alias("parts"), F.first("start").alias("s"), F.first("stop").alias("e"))
    first = F.col("parts")[0]["chunk"] * chunk + 1
    low = F.greatest(F.col("s"), F.lit(1))
    bases = F.array_join(F.transform("parts", lambda p: p["bases"]), "")
    cut = joined.select(*[F.col(k).alias(f"__{k}") for k in keys], low.cast("long").alias("seq_start"), F.substr(bases, (low - first + 1).cast("int"), (F.col("e") - low + 1).cast("int")).alias("seq"))
    found = ranges.join(cut.filter("seq <> ''"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    return found.withColumn("seq_stop", F.col("seq_start") + F.length("seq") - 1)
