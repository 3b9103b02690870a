"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

Records are hashed into a fixed number of virtual slots. Bytes are summed for each slot, and a versioned
slot-to-shard map, stored as Parquet, says where each slot lives; rebalancing edits the map and moves
whole slots, never rehashing a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.llm.common import shared_path, staged

SLOTS = 4096
#: Each slot's records are numbered in this many runs, so that numbering needs no large group.
RUNS = 16


def record_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, number) of each record; number tells repeated rows apart, and is another one when docs are read again."""
    raw = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    size = (F.octet_length(raw) + F.lit(1)).cast("long").alias("size")
    return docs.select(F.col(id_col).alias("doc_id"), size, F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("number"))


def repeated(facts: DataFrame) -> DataFrame:
    """(r_id, r_crc32, r_size) of records that are equal in all three."""
    return facts.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("r_id"), F.col("text_crc32").alias("r_crc32"), F.col("size").alias("r_size"))


def slot_facts(facts: DataFrame, again: DataFrame, slots: int = SLOTS) -> DataFrame:
    """record_facts with virtual_slot and run. The hash takes id, checksum and size, so null ids spread out, and for those in again the number, so that equal rows do."""
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_crc32") == F.col("r_crc32")) & (F.col("size") == F.col("r_size"))
    h = F.xxhash64("doc_id", "text_crc32", "size", F.when(F.col("r_crc32").isNotNull(), F.col("number")).otherwise(F.lit(0)))
    salted = facts.join(again, same, "left").withColumn("h", h).drop("r_id", "r_crc32", "r_size", "number")
    return salted.withColumns({"virtual_slot": F.pmod("h", F.lit(slots)).cast("int"), "run": F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(RUNS - 1)).cast("int")}).drop("h")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (virtual_slot, shard), dealt in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def edited_map(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The map after rebalancing to that many shards: (virtual_slot, shard, bytes).

    Slots are taken by falling bytes. One stays where it is as long as its shard does not exceed the mean;
    otherwise it goes to the shard with the fewest bytes so far. The fold runs over one row for each slot,
    a fixed number whatever the input, inside a SQL aggregate().
    """
    rows = slot_map.select("virtual_slot", "shard").join(F.broadcast(slot_bytes), "virtual_slot", "left").select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"), F.ceil(F.sum("bytes") / shards).cast("long").alias("mean"))
    fold = f"""aggregate(slots,
      named_struct('loads', array_repeat(0L, {shards}), 'put', cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint>>)),
      (s, x) -> transform(
        array(if(x.shard < {shards} and try_element_at(s.loads, x.shard + 1) - x.less <= mean, x.shard, cast(array_position(s.loads, array_min(s.loads)) - 1 as int))),
        t -> named_struct(
          'loads', transform(s.loads, (v, i) -> if(i = t, v - x.less, v)),
          'put', concat(s.put, array(named_struct('virtual_slot', x.virtual_slot, 'shard', t, 'bytes', -x.less)))))[0]).put"""
    return one.select(F.inline(F.expr(fold)))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Adds a version to the stored maps; older ones stay readable."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest unless one is named."""
    maps = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).drop("version")


def shard(docs: DataFrame, shards: int = 8, map_path: str | None = None) -> DataFrame:
    """Every record of docs (doc_id, text, ...) with its shard and its place there.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, law ("bytes"), shard,
    slot (the record's place in its shard, gapless from 0), grown_shard (null under this law) and virtual_slot.
    Versions 0 and 1 of the map are stored under map_path (default: a new one in the shared folder).
    Records equal in doc_id and text are spread over the virtual slots like others; null ids are hashed by their
    text. No input rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    facts = staged(record_facts(docs), "slot-facts")
    # Written, so that Spark knows its size and can split a hot record's rows where it does not broadcast it.
    facts = slot_facts(facts, staged(repeated(facts), "repeated"))
    map_path = map_path or shared_path(spark, "slot-map")
    runs = facts.groupBy("virtual_slot", "run").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    save_map(first_map(spark, shards).withColumn("bytes", F.lit(None).cast("long")), map_path, 0)
    save_map(edited_map(load_map(spark, map_path, 0), runs.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")), shards), map_path, 1)
    slot_map = load_map(spark, map_path).select("virtual_slot", "shard")
    # At most SLOTS * RUNS rows, so both may be broadcast.
    before = Window.partitionBy("shard").orderBy("virtual_slot", "run").rowsBetween(Window.unboundedPreceding, -1)
    places = runs.join(F.broadcast(slot_map), "virtual_slot").select("virtual_slot", "run", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = facts.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(places), ["virtual_slot", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def rebalanced(spark: SparkSession, map_path: str, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """Edits the latest stored map for another number of shards or other bytes, stores it as the next version and returns it."""
    maps = spark.read.option("basePath", map_path).parquet(map_path)
    version = maps.agg(F.max("version")).first()[0]
    save_map(edited_map(load_map(spark, map_path, version), slot_bytes, shards), map_path, version + 1)
    return load_map(spark, map_path, version + 1)
