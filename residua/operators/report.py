"""Sinks: results as Parquet, CSV, JSON and Markdown."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import SPLIT, ArtifactError, ConfigError
from ..sources.committed import save_document, write_text

#: The places of a run that tie its numbers to it, and the columns of stored sweeps.
IDENTITY = ("mode", "model", "loss", "split", "split_hash", "run_id", "results_run_id")
SWEEP = ("strategy", "param", "value", "dice_mean", "dice_std", "n_volumes", "split")
PARAMS = {"percentile": "percentile", "absolute": "value", "otsu": ""}
CONTEXT_NOTE = "PSNR and SSIM tell how well healthy tissue is rebuilt; they are context and rank nothing."


def save_volumes(slices: DataFrame, root: str) -> None:
    """Slice rows under root, partitioned by run_id, so that runs never collide."""
    if "run_id" not in slices.columns:
        raise ConfigError("results need a run_id")
    slices.write.mode("append").partitionBy("run_id").parquet(root)


def save_csv(rows: DataFrame, path: str, header: Sequence[str]) -> None:
    """A CSV with a fixed header; a missing column is an error, never an empty field."""
    missing = [c for c in header if c not in rows.columns]
    if missing:
        raise ArtifactError(f"columns are missing: {missing}")
    rows.select(*header).write.mode("overwrite").option("header", True).csv(path)


def save_json(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def save_report(rows: DataFrame, path: str, header: Sequence[str]) -> None:
    """A short CSV with a fixed header as one committed file; a missing column is an error."""
    missing = [c for c in header if c not in rows.columns]
    if missing:
        raise ArtifactError(f"columns are missing: {missing}")
    save_document(rows.select(*header), path, "csv")


def aggregate_document(metrics: DataFrame, published: float, identity: Mapping[str, str | None] | None = None) -> DataFrame:
    """One row: what ties it to its run, headline and context apart, and the change against a published value.

    `identity`, which a stored document needs, must name every field of IDENTITY; only results_run_id
    and run_id may be null. The cell is the model and the loss.
    """
    needed = [f"{m}_{s}" for m in ("dice", "iou", "psnr_db", "ssim") for s in ("mean", "std")]
    told = dict.fromkeys(IDENTITY, "") if identity is None else identity
    missing = [c for c in needed if c not in metrics.columns] + [c for c in IDENTITY if c not in told or told[c] is None and "run_id" not in c]
    if missing:
        raise ArtifactError(f"aggregate lacks {missing}")
    part = lambda names: [F.struct(F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")).alias(n) for n in names]
    delta = F.struct(F.lit(published).alias("published"), F.col("dice_mean").alias("corrected"), (F.col("dice_mean") - published).alias("delta")).alias("baseline_delta")
    fields = [] if identity is None else [*(F.lit(told[c]).cast("string").alias(c) for c in IDENTITY), F.lit(f"{told['model']}__{told['loss']}").alias("cell_id")]
    return metrics.select(*fields, F.col("n").alias("n_volumes"), F.struct(*part(["dice", "iou"])).alias("headline"), F.struct(*part(["psnr_db", "ssim"]), F.lit(CONTEXT_NOTE).alias("note")).alias("context_only"), delta)


#: The columns of per_volume.csv, in which metrics that rank nothing say so.
PER_VOLUME = ("volume_id", "dice", "iou", "psnr_db_context_only", "ssim_context_only")


def context_only(rows: DataFrame) -> DataFrame:
    """The rows of volume metrics with the names under which they are stored."""
    return rows.withColumnsRenamed({name: f"{name}_context_only" for name in ("psnr_db", "ssim")})


def save_per_volume(rows: DataFrame, path: str) -> None:
    """per_volume.csv: a row per volume, as Spark writes it."""
    save_csv(context_only(rows), f"{path}/per_volume.csv", PER_VOLUME)


def save_aggregate(metrics: DataFrame, published: float, identity: Mapping[str, str | None], path: str) -> None:
    """aggregate.json of a run."""
    save_document(aggregate_document(metrics, published, identity), f"{path}/aggregate.json")


def write_manifest(path: str, model: str, loss: str, split: str, n_volumes: int, split_hash: str) -> None:
    """All five fields for every split."""
    document = {"model": model, "loss": loss, "split": split, "n_volumes": n_volumes, "split_hash": split_hash}
    write_text(path, json.dumps(document, indent=2, sort_keys=True) + "\n")


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A report table; reports are short, and a longer frame is an error rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ArtifactError(f"a report table holds {most} rows at most")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in found])


def splice(text: str, block: str, begin: str, end: str) -> str:
    """Replace what stands between two markers; absent, doubled or inverted markers are errors. Idempotent."""
    marks = re.findall(f"{re.escape(begin)}|{re.escape(end)}", text)
    if marks != [begin, end]:
        raise ArtifactError(f"markers must occur once each and in order, found {marks}")
    between = re.compile(f"(?<={re.escape(begin)}).*(?={re.escape(end)})", re.DOTALL)
    return between.sub(lambda _: f"\n{block}\n", text)


@contextmanager
def run_record(root: str, config: dict, seed: int) -> Iterator[dict]:
    """A run's record, written even when the run fails. Metrics and timers are filled in by the caller."""
    stamp = datetime.now(UTC)
    record: dict = {"run_id": stamp.strftime("%Y%m%dT%H%M%S_%fZ"), "seed": seed, "config": config, "metrics": {}, "timers": {}, "started": stamp.isoformat(), "error": None}
    try:
        yield record
    except BaseException as error:
        record["error"] = repr(error)
        raise
    finally:
        record["finished"] = datetime.now(UTC).isoformat()
        write_text(f"{root}/{record['run_id']}/run_meta.json", json.dumps(record, indent=2, sort_keys=True, default=str))


@contextmanager
def timer(record: dict, name: str) -> Iterator[None]:
    """Add the seconds spent inside to the record's timer of that name."""
    began = time.perf_counter()
    try:
        yield
    finally:
        record["timers"][name] = record["timers"].get(name, 0.0) + time.perf_counter() - began


def save_split(spark: SparkSession, path: str, seed: int, parts: dict[str, dict[str, list[str]]]) -> None:
    """A split as one JSON row: its seed and, per data set, the ids of each part. Ids are subjects, so few."""
    rows = [(seed, parts)]
    spark.createDataFrame(rows, SPLIT).coalesce(1).write.mode("overwrite").json(path)


def with_param(sweep: DataFrame, split: str) -> DataFrame:
    """The sweep with the name of each strategy's parameter and the split that it ran on; an unknown strategy raises when read."""
    known = F.create_map(*(F.lit(x) for pair in PARAMS.items() for x in pair))
    param = F.coalesce(F.element_at(known, F.col("strategy")), F.raise_error(F.concat(F.lit("no such strategy: "), F.col("strategy"))).cast("string"))
    return sweep.withColumn("param", param).withColumn("split", F.lit(split))


def save_sweep(sweep: DataFrame, chosen: DataFrame, path: str, model: str, split: str) -> None:
    """threshold_sweep_<model>.csv with every point of a threshold sweep, and sweep_summary.json with the chosen one."""
    best = with_param(chosen, split)
    save_report(with_param(sweep, split).orderBy("strategy", "value"), f"{path}/threshold_sweep_{model}.csv", SWEEP)
    named = (F.col(c).alias(f"best_{c}") for c in ("strategy", "param", "value", "dice_mean", "dice_std"))
    save_document(best.select(F.lit(model).alias("model"), "n_volumes", "split", *named), f"{path}/sweep_summary.json")


def sweep_document(sweep: DataFrame, chosen: DataFrame, path: str, split: str) -> None:
    """tnoise_sweep.csv with the best point of each noise level, and tnoise_selection.json with the chosen one."""
    save_report(with_param(sweep, split).orderBy("t_noise"), f"{path}/tnoise_sweep.csv", ["t_noise", *SWEEP])
    best = with_param(chosen, split)
    named = (F.col(c).alias(f"threshold_{c}") for c in ("strategy", "param", "value"))
    save_document(best.select("t_noise", *named, "dice_mean", "dice_std", "n_volumes", "split"), f"{path}/tnoise_selection.json")
