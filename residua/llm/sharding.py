"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each document starts with the label of a hash of its row, so
the copies of a text lie all over the shards and the counts are about even. Then labels propagate in
rounds of Spark joins: the copies of a text move together to one shard, where most of them are or,
where the quota there is used up, where there is room; the largest texts, which are hardest to place,
move first. A text beyond a shard's quota moves in parts, and what fits nowhere whole is split over the
largest rooms. Each round lowers the cut; the last one leaves nothing that could move. Documents
without links then fill what is left, those of like sizes all over the shards, so the row counts of the
shards differ by one at most (law `rows`) and their bytes by little.

Neighbours of one text are alike, so the state of the propagation is the number of a text's copies in
each shard: a row per (text, shard), never a row per pair of copies.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, materialize, running_sum, whole

SHARDS = 40
#: Bytes a document costs beside its text.
OVERHEAD = 16

log = logging.getLogger(__name__)


def _rooms(quotas: DataFrame, placed: DataFrame) -> DataFrame:
    """(_to, _room): what the quotas leave free, a row per shard."""
    load = placed.groupBy("_shard").agg(F.sum("_n").alias("_load"))
    return F.broadcast(quotas.join(load, "_shard", "left").select(F.col("_shard").alias("_to"), (F.col("_quota") - F.coalesce("_load", F.lit(0))).alias("_room")))


def _ask_neighbours(parts: DataFrame, rooms: DataFrame, buckets: int) -> DataFrame:
    """Each text asks for the shard where most of its copies are; a shard accepts while its quota lasts. Adds _to and _moved."""
    asked = running_sum(parts.withColumn("_to", F.col("_label")), ["_to"], ["_group", "_part"], "_ahead", buckets, "_n")
    fits = F.col("_ahead") + F.col("_n") <= F.col("_room")
    return asked.join(rooms, "_to").withColumn("_moved", F.when(fits, F.col("_n")).otherwise(0)).drop("_ahead", "_room")


def _ask_rooms(parts: DataFrame, rooms: DataFrame, buckets: int) -> DataFrame:
    """Parts in order of size, largest first, are laid along the rooms, largest first; a part that lies inside one moves there.

    What lies across the end of a room stays: fewer parts than there are shards.
    """
    sizes = parts.groupBy("_n").agg(F.count(F.lit(1)).alias("_m"))  # fewer rows than the square root of twice the documents
    larger = Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_n", F.coalesce(F.sum(F.col("_n") * F.col("_m")).over(larger), F.lit(0)).alias("_start"))
    along = Window.orderBy(F.desc("_room"), "_to").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.broadcast(rooms.withColumn("_end", F.sum("_room").over(along)))
    ranked = running_sum(parts, ["_n"], ["_group", "_part"], "_rank", buckets).join(starts, "_n").withColumn("_at", F.col("_start") + F.col("_rank") * F.col("_n"))
    inside = (F.col("_at") >= F.col("_end") - F.col("_room")) & (F.col("_at") + F.col("_n") <= F.col("_end"))
    found = ranked.join(ends, inside, "left")
    return found.withColumn("_moved", F.when(F.col("_to").isNull(), 0).otherwise(F.col("_n"))).drop("_start", "_rank", "_at", "_room", "_end")


def _ask_in_turn(parts: DataFrame, rooms: DataFrame) -> DataFrame:
    """The largest part asks for the largest room, the next for the next, and moves if it fits; where none fits, each takes what its room holds."""
    turn = Window.orderBy(F.desc("_n"), "_group", "_part")  # fewer parts than shards
    ranked = parts.withColumn("_turn", F.row_number().over(turn))
    free = F.broadcast(rooms.filter("_room > 0").withColumn("_turn", F.row_number().over(Window.orderBy(F.desc("_room"), "_to"))))
    asked = ranked.join(free, "_turn", "left")
    fits = F.coalesce(F.col("_n") <= F.col("_room"), F.lit(False))
    any_fits = F.max(fits).over(Window.partitionBy(F.lit(0)))
    return asked.withColumn("_moved", F.when(fits, F.col("_n")).when(~any_fits, F.least("_n", F.coalesce("_room", F.lit(0)))).otherwise(0)).drop("_turn", "_room")


def propagate(start: DataFrame, quotas: DataFrame, singles: int, shards: int, buckets: int) -> tuple[DataFrame, list[int]]:
    """Pieces (_group, _shard, _n) after the rounds, and the cut (pieces beyond one per text) before and after each round.

    start: (_group, _shard, _n), where the copies are at first. Texts with no more copies than the
    documents without links leave free in a shard on average go to their neighbours and are never cut,
    as some shard always has room for one; larger ones, which such texts could block, are placed before.
    """
    own = start.groupBy("_group").agg(F.sum("_n").alias("_members"), F.max_by("_shard", F.struct("_n", (-F.col("_shard")).alias("_s"))).alias("_label"), F.count(F.lit(1)).alias("_spread"))
    least = quotas.agg(F.min("_quota")).first()[0] or 1
    full = F.floor(F.col("_members") / max(least, 1))
    sizes = F.transform(F.sequence(F.lit(0).cast("bigint"), full), lambda i: F.when(i < full, F.lit(max(least, 1)).cast("bigint")).otherwise(F.col("_members") % max(least, 1)))
    parts = materialize(own.select("_group", "_label", "_spread", "_members", F.posexplode(sizes).alias("_part", "_n")).filter("_n > 0"))
    placed = parts.select("_group", F.col("_label").alias("_shard"), "_n").filter("false")
    texts = own.count()
    history = [start.count() - texts]
    share = singles // shards

    def go(asked: DataFrame) -> DataFrame:
        """Carry one round out; what is left to move."""
        nonlocal placed
        asked = materialize(asked)
        placed = materialize(placed.unionByName(asked.filter("_moved > 0").select("_group", F.col("_to").cast("int").alias("_shard"), F.col("_moved").alias("_n"))))
        rest = materialize(asked.withColumn("_n", F.col("_n") - F.col("_moved")).filter("_n > 0").select(parts.columns))
        return rest

    def cut(waiting: list[DataFrame]) -> int:
        still = waiting[0].select("_group", "_spread")
        for w in waiting[1:]:
            still = still.unionByName(w.select("_group", "_spread"))
        still = still.distinct()
        done = placed.join(still, "_group", "left_anti").agg(F.count_distinct("_group", "_shard") - F.count_distinct("_group")).first()[0]
        return done + (still.agg(F.sum(F.col("_spread") - 1)).first()[0] or 0)

    large, small = parts.filter(F.col("_members") > share), parts.filter(F.col("_members") <= share)
    for stage, others in ((large, [small]), (small, [])):
        left, ask = stage, "neighbours" if stage is small else "rooms"
        while count := left.count():
            rooms = _rooms(quotas, placed)
            left = go(_ask_neighbours(left, rooms, buckets) if ask == "neighbours" else _ask_rooms(left, rooms, buckets) if ask == "rooms" else _ask_in_turn(left, rooms))
            history.append(cut([left, *others]))
            log.info("asked %s: %d parts, cut %d to %d", ask, count, history[-2], history[-1])
            ask = "rooms" if ask == "neighbours" else "turn"
    return placed.groupBy("_group", "_shard").agg(F.sum("_n").alias("_n")), history


def stride_of(places: int) -> int:
    """A stride near the golden section of so many places, without a common divisor with their number."""
    stride = max(1, round(places * 0.6180339887498949))
    while math.gcd(stride, max(places, 1)) > 1:
        stride += 1
    return stride


def balanced_label_propagation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, group_rows, group_shards.

    Size is the text's UTF-8 bytes plus 16; a null text counts as empty and is linked with empty
    texts. Shards differ by one row at most, whatever the groups; a text with more copies than a
    shard has room for is spread over as few as the rounds find. Repeated rows and null
    identifiers are rows like any other. An empty table gives an empty result. grown_shard is null,
    as the law is not `key`.
    """
    spark = docs.sparkSession
    text = whole(text_col)
    # A number of the row, fixed once written, deals out rows that are alike in all else.
    base = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    rows = base.count()
    buckets = bucket_count(rows)
    quotas = materialize(spark.range(shards).select(F.col("id").cast("int").alias("_shard"), (F.lit(rows // shards) + (F.col("id") < rows % shards).cast("int")).cast("bigint").alias("_quota")))

    # Copies of one text are counted, numbered and joined by (text, bucket), never by the text alone.
    dealt = base.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    per_bucket = materialize(dealt.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    linked = materialize(per_bucket.groupBy("_group").agg(F.sum("_n").alias("_members")).filter("_members > 1"))
    spread = per_bucket.join(linked, "_group", "left_semi").groupBy("_group", F.pmod("_bucket", F.lit(shards)).cast("int").alias("_shard")).agg(F.sum("_n").alias("_n"))
    members = linked.agg(F.sum("_members")).first()[0] or 0
    pieces, _ = propagate(materialize(spread), quotas, rows - members, shards, buckets)
    pieces = materialize(pieces)

    # Copies are interchangeable: the n-th copy of a text goes to the piece that holds n.
    running = Window.partitionBy("_group").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("_end", F.sum("_n").over(running)).groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_end", "_shard"))).alias("_pieces"), F.sum("_n").alias("_members"))
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.join(ends, "_group").select("_group", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), "_pieces", "_members")
    judged = materialize(dealt.join(materialize(starts), ["_group", "_bucket"], "left"))
    nth = F.col("_start") + F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_row")) - 1
    placed = judged.filter("_pieces is not null").withColumn("_nth", nth).select(
        "_id", "_row", "size", "text_crc32", F.filter("_pieces", lambda p: p["_end"] > F.col("_nth"))[0]["_shard"].alias("shard"), F.col("_members").alias("group_rows"), F.size("_pieces").alias("group_shards")
    )
    # A row per shard: what the linked documents leave free.
    load = pieces.groupBy("_shard").agg(F.sum("_n").alias("_load"))
    free = quotas.join(load, "_shard", "left").orderBy("_shard").select("_shard", (F.col("_quota") - F.coalesce("_load", F.lit(0))).alias("_free")).collect()
    total, limits = 0, []
    for r in free:
        total += r["_free"]
        limits.append(F.struct(F.lit(total).cast("bigint").alias("_end"), F.lit(r["_shard"]).cast("int").alias("_shard")))
    # Documents of a size class (eight to a doubling) follow each other and are dealt by a stride near
    # the golden section of the places, which meets each place once: so each shard gets its share of each class.
    single = judged.filter("_pieces is null").select("_id", "_row", "size", "text_crc32", F.floor(F.log2("size") * 8).cast("int").alias("_class"))
    smaller = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)  # some hundred classes
    classes = single.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).select("_class", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_first"))
    place = (F.col("_nth") + F.col("_first")).cast("decimal(18,0)") * F.lit(stride_of(total)).cast("decimal(18,0)") % F.lit(max(total, 1)).cast("decimal(18,0)")
    ranked = running_sum(single, ["_class"], ["_row"], "_nth", buckets).join(F.broadcast(classes), "_class").withColumn("_place", place.cast("bigint"))
    filled = ranked.select(
        "_id", "_row", "size", "text_crc32", F.filter(F.array(*limits), lambda p: p["_end"] > F.col("_place"))[0]["_shard"].alias("shard"), F.lit(1).cast("bigint").alias("group_rows"), F.lit(1).alias("group_shards")
    )
    sharded = materialize(placed.unionByName(filled))
    slotted = running_sum(sharded, ["shard"], ["_row"], "slot", buckets)
    return slotted.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows", "group_shards"
    )
