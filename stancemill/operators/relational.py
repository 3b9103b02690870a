"""Relational operators over pages, pairs and labels."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has the columns; an error that names the missing ones otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def add_if_absent(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def keep_ids(df: DataFrame, ids: DataFrame, column: str, id_col: str = "answer_id") -> DataFrame:
    """Rows whose column is among the ids, each once; a null matches a null id."""
    return df.join(ids.select(F.col(id_col).alias("_id")).distinct(), F.col(column).eqNullSafe(F.col("_id")), "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str, id_col: str = "answer_id") -> DataFrame:
    """Rows whose column is not among the ids; a null stays unless null is an id."""
    return df.join(ids.select(F.col(id_col).alias("_id")).distinct(), F.col(column).eqNullSafe(F.col("_id")), "left_anti")


def filter_by_id(pages: DataFrame, pairs: DataFrame, ids: DataFrame, whitelist: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages and pairs whose ids are all in (whitelist) or all outside of ids; a pair with one in and one out is in neither."""
    f = keep_ids if whitelist else drop_ids
    return f(pages, ids, "answer_id"), f(f(pairs, ids, "answer_id_1"), ids, "answer_id_2")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on a single machine a temporary one, on a cluster an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="stancemill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that steps that read it twice compute it once and survive the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evidence_ids(df: DataFrame, least: int, answer: str, query: str = "search_query") -> DataFrame:
    """Ids of the yes and no rows of queries with least yes answers, or least no answers. Rows without query don't count. Reads df twice."""
    enough = df.filter(F.col(query).isNotNull()).groupBy(query).agg(F.count_if(F.col(answer) == "yes").alias("y"), F.count_if(F.col(answer) == "no").alias("n")).filter((F.col("y") >= least) | (F.col("n") >= least))
    return df.filter(F.col(answer).isin("yes", "no")).join(enough.select(query), query, "left_semi").select("answer_id").distinct()


def filter_pair_thresh(df: DataFrame, least: int, answer: str = "stance") -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows of df whose answer_id is one of evidence_ids, and those ids.

    df is read twice, first for the three columns that decide, which are written to the shared folder. Where it has a model's
    answers that may change, write it before.
    """
    ids = evidence_ids(settled(df.select("answer_id", "search_query", answer)), least, answer)
    return keep_ids(df, ids, "answer_id"), ids


class StageCounts:
    """Rows of the stages of a flow, counted as they pass, without a job of their own."""

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def passing(self, df: DataFrame, stage: str) -> DataFrame:
        """df, whose rows are counted under the name of the stage when an action reads it."""
        self.observed[stage] = Observation(stage)
        return df.observe(self.observed[stage], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """By stage, in order. Waits for actions that run; before any action it would wait on."""
        return {stage: o.get["rows"] for stage, o in self.observed.items()}


def one_to_many(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which nulls match nulls; an error at run time if a key repeats on the left."""
    seen = left.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(F.col(c)).alias(c) for c in left.columns if c not in keys))
    seen = seen.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("keys repeat on the left side"))).filter("_ok is null").drop("_n", "_ok")
    r = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return seen.join(r, on).drop(*(f"_{k}" for k in keys))


def unpivot_statements(df: DataFrame) -> DataFrame:
    """Two rows for each, one a statement; null statements stay."""
    return df.unpivot(["category", "search_query"], ["yes_statement", "no_statement"], "search_type", "search_engine_input")


def paired(pairs: DataFrame, column: str) -> DataFrame:
    """x: difference of the column's two sides; y: of their probabilities."""
    return pairs.select((F.col(f"{column}_1") - F.col(f"{column}_2")).alias("x"), (F.col("eval_1_prob") - F.col("eval_2_prob")).alias("y"))


def singular(pairs: DataFrame, column: str) -> DataFrame:
    """Two rows for each pair: x, y of side 1 and of side 2."""
    sides = [F.struct(F.col(f"{column}_{i}").alias("x"), F.col(f"eval_{i}_prob").alias("y")) for i in (1, 2)]
    return pairs.select(F.inline(F.array(*sides)))


def unseen(inputs: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """Inputs that the cache does not hold; inputs repeated within one run stay repeated."""
    return drop_ids(inputs, cache, column, column)


def dense_ids(df: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """df with gapless ids from 0 in the given order, without bringing all rows to one task: rows are numbered within ranges, whose sizes are summed up."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_start")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in the given order; Spark drops others before the shuffle, so a large key costs k rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def pairs_within(df: DataFrame, key: str, id_col: str, columns: list[str]) -> DataFrame:
    """Pairs of rows of a key, the smaller id first, as key, id_1, id_2 and each column's two sides. Null keys and ids pair with nothing. Keys are small groups: a group of n gives n * (n - 1) / 2 rows."""
    side = lambda n: df.select(F.col(key).alias(f"_key_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in [id_col, *columns]))
    on = (F.col("_key_1") == F.col("_key_2")) & (F.col(f"{id_col}_1") < F.col(f"{id_col}_2"))
    return side(1).join(side(2), on).withColumnRenamed("_key_1", key).drop("_key_2")


def range_part(row: Column, rows: Column | int, parts: int) -> Column:
    """The part of row number row (from 0) when so many rows are cut into parts ranges, of which number d begins at d * rows div parts."""
    return F.call_function("div", (row + 1) * parts - 1, F.lit(rows)).cast("int")


def agreed_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """answer_id of rows on which label_a and label_b are equal; null equals nothing."""
    return a.select("answer_id", "label_a").join(b.select("answer_id", "label_b"), "answer_id").filter("label_a = label_b").select("answer_id")


def inverted_index(df: DataFrame, stem: Column, word: str) -> DataFrame:
    """stem and the distinct words in lower case that have it, sorted."""
    words = df.select(F.lower(F.col(word)).alias("word")).distinct()
    return words.groupBy(stem.alias("stem")).agg(F.array_sort(F.collect_set("word")).alias("words"))
