"""Shards of equal bytes, tokens and rows by vector bin packing over groups of equal texts.

A group stays together unless it is larger than a shard may be; such a group is dealt by
hash into parts of a quarter shard. Groups above a set share of a shard are few by their
sum and are placed first, one after the other. All others are dealt into cells of bounded
size; a cell gets its part of what the shards have left and a task places its groups,
largest first, each where the dot product of its load with the residual capacity is
highest. Only sums and the few large groups reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import settle

LARGE = 64  # a group above 1/64 of a shard, in any measure, is placed on its own
PARTS = 4  # parts a shard's worth of a split group makes
CELL_GROUPS = 4096
SLOT_ROWS = 50_000
LOADS = ("bytes", "tokens", "rows")


def place(loads: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each load (rows: groups, columns: measures), and the capacity left.

    Loads are taken as shares of a whole shard, so that the measures weigh alike. Of equal
    loads the first is placed first, of equally good shards the first is taken.
    """
    scale = np.maximum(capacity.mean(0), 1e-9)
    left, need = capacity / scale, loads / scale
    shards = np.zeros(len(loads), np.int64)
    for i in np.argsort(-need.sum(1), kind="stable").tolist():
        shards[i] = best = int(np.argmax(left @ need[i]))
        left[best] -= need[i]
    return shards, left * scale


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every row.

    A row's size is the UTF-8 bytes of its text plus 1. Null texts are empty texts.
    Repeated rows are members of their group like others; other columns are not read.
    No rows, no shards.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("check"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    whole = np.array([float(total[m] or 0) for m in LOADS])
    share = np.maximum(whole / shards, 1.0)
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = settle(rows.groupBy("key", "check").agg(*sums), "shard-groups")
    most = F.greatest(*(F.col(m) / float(s) for m, s in zip(LOADS, share)))
    # at most three times as many groups as shards can be larger than one
    split = groups.where(most > 1).select("key", "check", F.ceil(most * PARTS).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(split), ["key", "check"], "left").withColumn("part", part).drop("parts")
    units = settle(rows.groupBy("key", "check", "part").agg(*sums), "shard-units")
    large = units.where(most > 1 / LARGE).orderBy("key", "check", "part").toArrow()
    capacity = np.tile(whole / shards, (shards, 1))
    loads = np.stack([large.column(m).to_numpy().astype(float) for m in LOADS], 1) if large.num_rows else np.zeros((0, len(LOADS)))
    chosen, left = place(loads, capacity)
    left = np.maximum(left, 0)
    rest = units.where(most <= 1 / LARGE)
    cells = max(1, -(-rest.count() // CELL_GROUPS))
    weights = left / np.maximum(left.sum(0), 1e-9)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("check", "ascending"), ("part", "ascending")])
        loads = np.stack([table.column(m).to_numpy().astype(float) for m in LOADS], 1)
        found, _ = place(loads, weights * loads.sum(0))
        return table.select(["key", "check", "part"]).append_column("shard", pa.array(found.astype(np.int32)))

    schema = "key long, check long, part int, shard int"
    small = rest.withColumn("cell", F.pmod(F.xxhash64("check", "key", "part"), F.lit(cells))).groupBy("cell").applyInArrow(fill, schema)
    first = large.select(["key", "check", "part"]).append_column("shard", pa.array(chosen.astype(np.int32)))
    placed = small.unionByName(docs.sparkSession.createDataFrame(first).select("key", "check", F.col("part").cast("int"), F.col("shard").cast("int")))
    return rows.join(settle(placed, "shard-places"), ["key", "check", "part"]).select("doc_id", "size", "text_crc32", "shard")


def number(rows: DataFrame, by: str, order: list[str], n_rows: int) -> DataFrame:
    """A column ``slot``, gapless from 0 within each value of ``by``.

    Rows are dealt into blocks by hash; blocks are counted, and a row's slot is the rows
    of earlier blocks plus its place in its own, so no task orders a whole shard. Rows alike
    in ``order`` are numbered in any order; no rows, no numbers.
    """
    blocks = max(1, n_rows // SLOT_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = rows.groupBy(by, "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by, "block", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(by, "block").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(starts, [by, "block"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("block", "place", "before")
