"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is
compressed in blocks with each; the difference of the compressed sizes per byte of text becomes a
score by logistic calibration on other labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, whole

DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 1024
LEVEL = 3
#: Bounds of the labelled sample: documents of each class whose texts train a dictionary, documents that
#: calibrate, and the length above which a text does neither (none is cut).
TRAIN_ROWS = 1000
CALIBRATION_ROWS = 4000
TRAIN_MAX_CHARS = 20_000
#: COVER's segment size and d-mer size.
COVER_K, COVER_D = 256, 8


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; where they are too few to train on, as much of the texts themselves as a dictionary holds."""
    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=COVER_K, d=COVER_D).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES]


class Differ:
    """Compressed-size differences under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compressors = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content) if content else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """(bytes under bad - bytes under good) / bytes of the text; 0 for an empty text."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        good, bad = ((sum(len(c.compress(raw[i : i + BLOCK_BYTES])) for i in range(0, len(raw), BLOCK_BYTES))) for c in self.compressors)
        return (bad - good) / len(raw)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y), by Newton's method with a small ridge."""
    if len(x) == 0:
        return 0.0, 0.0
    scale, centre = x.std() or 1.0, x.mean()
    design = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weights = np.zeros(2)
    ridge = np.diag([1.0, 0.01])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    slope = weights[0] / scale
    return float(slope), float(weights[1] - slope * centre)


def differences(docs: DataFrame, id_col: str, text_col: str, good: bytes, bad: bytes, slope: float = 0.0, intercept: float = 0.0) -> DataFrame:
    """_id, difference, score for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(good, bad)
        for batch in slices(batches):
            x = np.array([differ.difference(t) for t in batch.column(1).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(s)], ["_id", "difference", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(score, f"_id {kind}, difference double, score double")


def held_out(id_col: str):
    """Rows that no model may learn from: crc32 of the identifier as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS, max_chars: int = TRAIN_MAX_CHARS) -> Model:
    """Learn from rows outside the held-out third, in one scan of the texts.

    The sample is bounded. A hash halves the labelled documents: of one half `train_rows` of each
    class train the dictionaries, of the other `calibration_rows` of all classes, in their natural
    shares, calibrate. Of these, documents with more than `max_chars` characters are left out, so a
    class may learn from fewer. Documents labelled more than once count once, with the highest label;
    of rows that repeat an identifier one text counts, the first by a hash; null labels and identifiers are left out. With a class or all labels missing the score is a constant.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.withColumn("_order", F.xxhash64("_id")).withColumn("_half", F.pmod(F.shiftright("_order", 20), F.lit(2)))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    roles = ("bad", train_rows, (F.col("_half") == 0) & (F.col("_label") == 0)), ("good", train_rows, (F.col("_half") == 0) & (F.col("_label") == 1)), ("calibrate", calibration_rows, F.col("_half") == 1)
    # The first rows by a hash for each role: the bounds hold for what is collected and broadcast.
    picked = [(r["_id"], r["_label"], role) for role, most, wanted in roles for r in known.filter(wanted).orderBy("_order", "_id").limit(most).collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, f"_id {kind}, _label int, _role string"))
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).filter(F.length("_text") <= max_chars)
    # One text per identifier, however often it repeats: of several the first by a hash.
    single = texts.join(chosen, "_id").groupBy("_id", "_label", "_role").agg(F.min(F.struct(F.xxhash64("_text").alias("_h"), "_text"))["_text"].alias("_text"))
    sample = materialize(single.select(F.col("_label").cast("bigint").alias("_label"), "_role", "_text"))

    trained = sample.filter("_role <> 'calibrate'").select("_role", "_text").collect()
    by_role = {role: sorted(r["_text"].encode("utf-8", "surrogatepass") for r in trained if r["_role"] == role) for role in ("bad", "good")}
    bad, good = train_dictionary(by_role["bad"]), train_dictionary(by_role["good"])
    rest = sample.filter("_role = 'calibrate'")
    found = differences(rest, "_label", "_text", good, bad).select("difference", F.col("_id").alias("_label")).toPandas().sort_values(["difference", "_label"])
    if not (by_role["bad"] and by_role["good"]) or found["_label"].nunique() < 2:
        share = (len(by_role["good"]) + 0.5) / (len(by_role["bad"]) + len(by_role["good"]) + 1)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    return Model(good, bad, *calibrate(found["difference"].to_numpy(), found["_label"].to_numpy()))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= 0.5, else 0), difference.

    A null or empty text has difference 0 and the score that goes with it. Only the text is an input
    of the score. Repeated rows stay. An empty table gives an empty result.
    """
    scored = differences(docs, id_col, text_col, model.good, model.bad, model.slope, model.intercept)
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    names = docs.columns
    at = names.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(model.good, model.bad)
        for batch in slices(batches):
            x = np.array([differ.difference(t or "") for t in batch.column(at).to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, docs.schema)
