"""Writers of id lists, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import shard
from .delimited import read_strict


def id_lists(population: DataFrame, pairs: DataFrame, entity: str, target: str, name: str = "matched_ids", within: Column | None = None) -> DataFrame:
    """One row for each entity of the population with its sorted distinct targets as a comma list; '' for none.

    ``within`` orders the list in another way (its least value for each target) instead.
    """
    if within is None:
        joined = pairs.select(entity, F.col(target).cast("string").alias("_t")).distinct().groupBy(entity).agg(F.array_join(F.sort_array(F.collect_list("_t")), ",").alias(name))
    else:
        first = pairs.groupBy(entity, target).agg(F.min(within).alias("_o"))
        joined = first.groupBy(entity).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", F.col(target).cast("string").alias("_t")))), lambda x: x["_t"]), ",").alias(name))
    return population.select(entity).join(joined, entity, "left").select(entity, F.coalesce(name, F.lit("")).alias(name))


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def write_verified(df: DataFrame, path: str) -> None:
    """Write as Parquet, read back and compare contents; the writer's commit makes the files appear at once."""
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if tuple(content_digest(df).first()) != tuple(content_digest(back).first()):
        raise ValueError(f"{path} does not hold what was written")


def content_digest(df: DataFrame) -> DataFrame:
    """rows, digest: of all rows in any order."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0)).alias("digest"))


def fingerprints(spark, path: str) -> DataFrame:
    """path, bytes, sha256, crc32 of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def list_columns_as_json(df: DataFrame) -> DataFrame:
    return df.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def outside(pairs: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """The pairs that are not among the allowed ones: empty for a subset."""
    return pairs.select(*on).distinct().join(allowed.select(*on).distinct(), on, "left_anti")


def same_population(seen: DataFrame, expected: DataFrame, entity: str) -> None:
    """Both have the same ids, each once; anything else is an error."""
    counts = seen.select(entity, F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionByName(expected.select(entity, F.lit(0).alias("_s"), F.lit(1).alias("_e"))).groupBy(entity).agg(F.sum("_s").alias("seen"), F.sum("_e").alias("expected"))
    if bad := counts.filter("seen <> 1 or expected <> 1").orderBy(entity).limit(3).collect():
        raise ValueError(f"populations differ: {[tuple(r) for r in bad]}")


def write_checked(df: DataFrame, path: str, population: DataFrame) -> None:
    """Write as a delimited file, then read it strictly: the same rows, and every id of the population once. The writer's commit makes files appear whole."""
    write_delimited(df, path)
    back = read_strict(df.sparkSession, path, tuple(df.columns))
    entity = df.columns[0]
    same_population(back, population.select(F.col(population.columns[0]).cast("string").alias(entity)), entity)
    written = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    if tuple(content_digest(written).first()) != tuple(content_digest(back).first()):
        raise ValueError(f"{path} does not hold what was written")


def upsert(base: DataFrame, changes: DataFrame, key: list[str], newest: str) -> DataFrame:
    """Rows by key, those of ``changes`` before those of ``base``, of several changes the one with the greatest ``newest``: an aggregation, so rows of a key never meet in a window."""
    rest = [c for c in base.columns if c not in key]
    rows = base.withColumn("_from", F.lit(0)).unionByName(changes.select(*base.columns).withColumn("_from", F.lit(1)))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_from", newest)).alias("_r"))
    return last.select(*(F.col(c) if c in key else F.col("_r").getField(c).alias(c) for c in base.columns))


def insert_ignore(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """The base, with the rows of ``more`` whose key it lacks (one of each key)."""
    return base.unionByName(more.select(*base.columns).dropDuplicates(key).join(base.select(*key).distinct(), key, "left_anti"))


def resumable(entities: DataFrame, entity: str, step, path: str, shards: int) -> DataFrame:
    """``step`` of each shard of the entities, written to a folder of its own; shards that an earlier run has finished are not done again. All shards' results.

    A shard is a remainder of the entity's hash, so it has the same rows in every run. Its folder counts once its writer has committed it.
    """
    spark = entities.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [f"{path}/shard={k}-of-{shards}" for k in range(shards)]
    for k, folder in enumerate(folders):
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            step(entities.filter(shard(F.col(entity), shards, k))).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*folders)
