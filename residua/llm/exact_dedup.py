"""Exact dedup by content sort.

Sampled splitters range-partition the documents by content (start, length, middle, then the whole
normalised text), an external sort inside each partition puts equal texts next to each other, and
each text is compared whole with its neighbour: a run of equal neighbours is a group. Cells of
content that are too heavy for one task are cut by a salt; the runs at such cuts are joined by
comparing their texts. Hashes only say where rows go, never which texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side, whole

SAMPLE_CHARS = 16
#: A row costs so much beside its text's bytes.
ROW_COST = 1000
#: A cell is cut when it costs more than this and more than this share of all, so there are fewer than
#: 65536 such cells, of 12 bytes each, which may be broadcast.
HEAVY_COST = 1 << 20
HEAVY_SHARE = 1 / 65536

#: Rows that each partition adds to the sample of splitters.
SPLITTER_SAMPLE = 20

_CELL = ("_start", "_length", "_middle")


def _with_cells(rows: DataFrame) -> DataFrame:
    """Content keys, and the weight of a row."""
    middle = F.col("_text").substr((F.length("_text") / 2).cast("int") + 1, F.lit(SAMPLE_CHARS))
    return rows.withColumns({
        "_start": ascii_lower(F.substring("_text", 1, SAMPLE_CHARS)), "_length": F.length("_text"), "_middle": ascii_lower(middle),
        "_cost": (F.octet_length("_text") + ROW_COST).cast("bigint"),
    }).withColumn("_place", F.xxhash64(*_CELL))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _best(keep: str) -> tuple[Column, Column]:
    """The order in which the row that stays comes first, and the same for runs as a struct to minimise or maximise."""
    if keep == "smallest":
        return F.col("_id").asc_nulls_last(), F.min(F.struct(F.col("_run_best").isNull(), "_run_best", "_run"))
    return F.col("_id").desc_nulls_last(), F.max(F.struct(F.col("_run_best").isNotNull(), "_run_best", "_run"))


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, heavy_cost: int = HEAVY_COST) -> DataFrame:
    """One row per input row: _id, _run, _head (first of its run), _run_best, _run_size, _cut, _digest, and _border.

    A run is a set of equal neighbours of the sort, the row that stays first. `_cut` says that its cell
    is salted, so that equal texts may lie in several runs; `_border` is then the text of the run's head.
    """
    rows = _with_cells(docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")))
    total = rows.agg(F.sum("_cost")).first()[0] or 0
    limit = max(heavy_cost, int(total * HEAVY_SHARE))
    cells = rows.groupBy("_place").agg(F.sum("_cost").alias("_cell_cost"), F.count(F.lit(1)).alias("_n"))
    heavy = cells.filter((F.col("_cell_cost") > limit) & (F.col("_n") > 1)).select("_place", F.ceil(2 * F.col("_cell_cost") / limit).cast("int").alias("_salts"))
    salted = rows.join(F.broadcast(heavy), "_place", "left")
    salted = salted.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("_id", "_cost", F.monotonically_increasing_id()), F.col("_salts"))).otherwise(0))
    part = [*_CELL, "_salt"]
    placed = salted.select("_id", F.col("_salts").isNotNull().alias("_cut"), *part, "_text").repartitionByRange(*part)
    placed = placed.select("_id", "_cut", *part, ascii_lower(F.col("_text")).alias("_norm"), F.monotonically_increasing_id().alias("_row"))

    # Windows over what the range partitioning has put together: neighbours of the sort, no other exchange.
    order, _ = _best(keep)
    neighbours = Window.partitionBy(*part).orderBy("_norm", order)
    compared = placed.withColumn("_new", ~F.lag("_norm").over(neighbours).eqNullSafe(F.col("_norm")))
    so_far = neighbours.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = compared.withColumn("_run", F.last(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).over(so_far))
    narrow = runs.select(
        "_id", "_cut", *part, "_run", F.col("_new").alias("_head"), F.sha2(F.col("_norm").cast("binary"), 256).alias("_digest"), F.when(F.col("_cut") & F.col("_new"), F.col("_norm")).alias("_border")
    )
    run = Window.partitionBy(*part, "_run")
    best = F.min if keep == "smallest" else F.max
    with _setting(docs.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SPLITTER_SAMPLE)):
        return materialize(
            narrow.select("_id", "_cut", "_run", "_head", "_digest", "_border", best("_id").over(run).alias("_run_best"), F.count(F.lit(1)).over(run).alias("_run_size"))
        )


def joined_runs(runs: DataFrame, keep: str) -> DataFrame:
    """_run, keep_id, group_size, _first for the runs of cut cells: those with equal texts are one group."""
    heads = runs.filter("_cut and _head").select("_run", "_run_best", "_run_size", "_border")
    same = Window.partitionBy("_border")  # a row per run: no more than a text's cell has salts
    joined = heads.select("_run", _best(keep)[1].over(same).alias("_won"), F.sum("_run_size").over(same).alias("group_size"))
    return joined.select("_run", F.col("_won._run_best").alias("keep_id"), "group_size", F.col("_won._run").alias("_first"))


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", heavy_cost: int = HEAVY_COST) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. `keep` says whether the smallest or the
    largest identifier of equal texts stays. A null text counts as empty, and empty texts equal each
    other. A null identifier loses against any other. Of rows repeated with one identifier one is
    kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    runs = sorted_runs(docs, id_col, text_col, keep, heavy_cost)
    size = F.col("group_size").cast("bigint").alias("group_size")
    whole_groups = runs.filter("not _cut").select(F.col("_id").alias(id_col), F.col("_run_best").alias("keep_id"), F.col("_run_size").cast("bigint").alias("group_size"), F.col("_head").alias("kept"), F.col("_digest").alias("text_sha256"))
    cut = runs.filter("_cut").select("_id", "_run", "_head", "_digest").join(small_side(materialize(joined_runs(runs, keep))), "_run")
    return whole_groups.unionByName(cut.select(F.col("_id").alias(id_col), "keep_id", size, (F.col("_head") & (F.col("_run") == F.col("_first"))).alias("kept"), F.col("_digest").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", heavy_cost: int = HEAVY_COST) -> DataFrame:
    """One row of each set of equal texts, with all columns; equality and the row that stays as above.

    Rows that repeat an identifier stay or go together.
    """
    judged = content_sort_dedup(docs, id_col, text_col, keep, heavy_cost)
    gone = materialize(judged.groupBy(F.col(id_col).alias("_loser")).agg(F.max("kept").alias("_stays")).filter("not _stays").select("_loser"))
    return docs.join(small_side(gone), docs[id_col].eqNullSafe(gone["_loser"]), "left_anti")
