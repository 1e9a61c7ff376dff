"""Stand-in frames over the test tables, in Spark and in SQL.

VOX holds each embedding as an 8 by 8 slice of the subject its label names; REC adds the healthy mean
and the residual, SEG a segmentation. Subjects 0 to 6 are healthy, 7 to 9 test, 6 is validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconstruct
from ..operators.prefix import ranked_by

SIDE = 8
MASK_CUT = 0.15
BLOCK = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """subject, slice_index, vec_id, pixels."""
    rows = ranked_by(table(spark, folder, "embeddings"), ["label"], "vec_id", bucket=F.floor(F.col("vec_id") / BLOCK))
    return rows.select(F.col("label").cast("bigint").alias("subject"), F.col("_before").cast("bigint").alias("slice_index"), "vec_id", F.col("embedding").cast("array<double>").alias("pixels"))


def vox(spark: SparkSession, folder: str) -> DataFrame:
    rows = slices(spark, folder).select("subject", "slice_index", F.posexplode("pixels").alias("pos", "v"))
    return rows.select("subject", "slice_index", F.col("pos").cast("bigint").alias("pos"), F.floor(F.col("pos") / SIDE).alias("y"), F.pmod("pos", F.lit(SIDE)).cast("bigint").alias("x"), "v")


def seg_of(v: Column) -> Column:
    return F.when(v > 0.20, 4).when(v > 0.15, 2).when(v > 0.10, 1).otherwise(0).cast("bigint")


def healthy_means(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, recon) over the healthy subjects; a mean needs no slice numbers, so one scan does."""
    rows = table(spark, folder, "embeddings").filter("label <= 6").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    return reconstruct.healthy_mean(rows.withColumn("pos", F.col("pos").cast("bigint")), F.lit(True))


def full(spark: SparkSession, folder: str) -> DataFrame:
    """VOX with recon, residual, seg, gt and the flat index of a volume."""
    rows = vox(spark, folder)
    joined = reconstruct.with_residual(rows, healthy_means(spark, folder))
    return joined.withColumn("seg", seg_of(F.col("v"))).withColumn("gt", (F.col("seg") > 0).cast("bigint")).withColumn("flat", F.col("slice_index") * SIDE * SIDE + F.col("pos"))


def scr(spark: SparkSession, folder: str) -> DataFrame:
    """Scored samples: doc_id, y, toxic, score, score_t (with many ties), grp, fold."""
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    fold = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("bigint"), F.lit(5))
    return joined.select("doc_id", F.col("quality").cast("bigint").alias("y"), F.col("toxic").cast("bigint").alias("toxic"), F.col("n_chars").cast("double").alias("score"), F.round(F.ln("n_chars"), 1).alias("score_t"), F.col("source").alias("grp"), fold.alias("fold"))


def run(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("run"), F.col("ts").alias("stamp"), F.col("event_type").alias("model"), F.col("props").alias("config"), F.col("value").alias("metric"))


def cell(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Declared (brand, flag) cells, one flag of which never occurs, and the observed mean discount."""
    part = table(spark, folder, "part")
    flags = spark.createDataFrame([("A",), ("N",), ("R",), ("X",)], "flag string")
    declared = part.select(F.col("p_brand").alias("brand")).distinct().crossJoin(F.broadcast(flags))
    items = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    observed = items.groupBy(F.col("p_brand").alias("brand"), F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return declared, observed


VOX_SQL = """
WITH sl AS (
  SELECT CAST(label AS BIGINT) AS subject, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slice_index, vec_id, embedding FROM embeddings
), vox AS (
  SELECT subject, slice_index, p AS pos, p // 8 AS y, p % 8 AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM sl, (SELECT unnest(range(64)) AS p) AS g
), means AS (
  SELECT pos AS mpos, round(avg(v), 6) AS recon FROM vox WHERE subject <= 6 GROUP BY pos
), f AS (
  SELECT vox.*, recon, abs(v - recon) AS residual, CASE WHEN v > 0.20 THEN 4 WHEN v > 0.15 THEN 2 WHEN v > 0.10 THEN 1 ELSE 0 END AS seg,
         CASE WHEN v > 0.10 THEN 1 ELSE 0 END AS gt, slice_index * 64 + pos AS flat
  FROM vox JOIN means ON pos = mpos
)
"""
SCR_SQL = """
WITH scr AS (
  SELECT d.doc_id, CAST(quality AS BIGINT) AS y, CAST(toxic AS BIGINT) AS toxic, CAST(n_chars AS DOUBLE) AS score, round(ln(n_chars), 1) AS score_t, source AS grp,
         CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 5 AS fold
  FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id
)
"""
RUN_SQL = "WITH run AS (SELECT event_id AS run, ts AS stamp, event_type AS model, props AS config, value AS metric FROM events)\n"
CELL_SQL = """
WITH declared AS (SELECT brand, flag FROM (SELECT DISTINCT p_brand AS brand FROM part) AS b, (VALUES ('A'), ('N'), ('R'), ('X')) AS t(flag)),
observed AS (SELECT p_brand AS brand, l_returnflag AS flag, round(avg(l_discount), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS (SELECT d.brand, d.flag, o.score, CASE WHEN o.score IS NULL THEN 'not evaluated' END AS na_reason FROM declared AS d LEFT JOIN observed AS o ON d.brand = o.brand AND d.flag = o.flag)
"""
