"""Benchmark decontamination by spaced-seed hashing, with DataFrame and SQL functions only.

Fixed masks ignore some positions of a run of eight words. A document and a benchmark item that share a
masked hash are aligned there, and the overlap around the hit is verified word by word: they overlap if
some WINDOW consecutive words of the alignment agree in all but SUBSTITUTIONS. The two masks together
fit into every such window whatever words are substituted, so no such overlap is missed. Items of SPAN to
WINDOW - 1 words are windows of their own length with one substitution, for which more masks make it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import staged
from stancemill.llm.neardup import text_hashes

WINDOW = 13
SUBSTITUTIONS = 2
SPAN = 8
#: Positions that count; for every choice of 2 of 13 words, one of the masks fits beside them.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: Those of items of SPAN to WINDOW - 1 words; whichever of SPAN words is substituted, one of the masks leaves it out.
SHORT_MASKS = (*MASKS, (2, 3, 4, 5, 6, 7), (0, 1, 2, 4, 5, 7), (0, 1, 2, 3, 4, 5))
SHORT_SUBSTITUTIONS = 1
#: Seeds of the benchmark are broadcast up to this many rows (24 bytes each); beyond, Spark joins by shuffle.
BROADCAST_SEEDS = 2_000_000


def word_array(text: str) -> str:
    """SQL for the hashes of the words of a column: runs of letters and digits, in lower case."""
    return f"transform(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w))"


def seed_array(words: str, masks: tuple = MASKS) -> str:
    """SQL for the masked hashes of an array of word hashes: those of the first mask at each position, then those of the next."""
    each = [f"transform(sequence(0, size({words}) - {SPAN}), i -> xxhash64({k}, {', '.join(f'{words}[i + {o}]' for o in m)}))" for k, m in enumerate(masks)]
    return f"if(size({words}) < {SPAN}, cast(array() as array<bigint>), concat({', '.join(each)}))"


def run_array(words: str, lengths: list[int]) -> str:
    """SQL for (hash, start) of all runs of these numbers of words, for items too short for a mask."""
    each = [f"if(size({words}) < {n}, cast(array() as array<struct<seed:bigint,at:int>>), transform(sequence(0, size({words}) - {n}), i -> named_struct('seed', xxhash64(-{n}, slice({words}, i + 1, {n})), 'at', i)))" for n in lengths]
    return f"concat({', '.join(each)})"


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once; a column's expression might be copied into a lambda and evaluated for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def seeds(df: DataFrame, key: list[str], least: int, masks: tuple = MASKS) -> DataFrame:
    """(key..., seed, at) of the rows of df (key..., words) that have least words or more."""
    body = f"named_struct('places', size(h) - {SPAN - 1}, 'seeds', if(size(h) < {least}, cast(array() as array<bigint>), {seed_array('h', masks)}))"
    many = df.select(*key, F.expr(let("words", "h", body)).alias("s"))
    return many.select(*key, "s.places", F.posexplode("s.seeds").alias("at", "seed")).select(*key, "seed", (F.col("at") % F.col("places")).alias("at"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, h1, h2, item_id, overlap_words, doc_start, item_start) for each document and benchmark item that overlap.

    overlap_words is the number of words from the first to the last window that passes on the longest such
    alignment, doc_start and item_start (from 0) where that begins; ties go to the smallest start. Items of
    fewer than WINDOW words must occur whole, with SHORT_SUBSTITUTIONS from SPAN words on and unchanged below;
    items and documents without words overlap with nothing. Rows that repeat a doc_id are told apart by text (h1, h2: its hashes), equal rows count once.
    Items with the same id are items of their own, of which the longest overlap counts. Null ids are kept.
    No documents or no items give no rows; other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_hashes(), F.expr(word_array("text")).alias("words"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.expr(word_array("text")).alias("words")).filter("size(words) > 0"), "items")
    lengths = [r[0] for r in items.select(F.size("words")).filter(f"size(words) < {WINDOW}").distinct().collect()]  # WINDOW - 1 values at most
    masks = SHORT_MASKS if any(n >= SPAN for n in lengths) else MASKS
    lengths = [n for n in lengths if n < SPAN]
    probes = staged(item_seeds(items, lengths), "seeds")
    small = probes.count() <= BROADCAST_SEEDS
    key = ["doc_id", "h1", "h2"]
    mine = seeds(d, key, SPAN, masks)
    if lengths:
        mine = mine.unionByName(d.select(*key, F.inline(F.expr(let("words", "h", run_array("h", lengths))))))
    # One row for each document and item, so that its words are held once; it has as many shifts as the two have words at most.
    hits = mine.join(F.broadcast(probes) if small else probes, "seed")
    hits = staged(hits.select("doc_id", "h1", "h2", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct().groupBy("doc_id", "h1", "h2", "item").agg(F.collect_list("shift").alias("shifts")), "hits")
    keys = hits.select("doc_id", "h1", "h2").distinct()
    texts = d.withColumnRenamed("doc_id", "id").join(keys, F.col("id").eqNullSafe(keys["doc_id"]) & (d["h1"] == keys["h1"]) & (d["h2"] == keys["h2"]), "left_semi").dropDuplicates(["id", "h1", "h2"])
    texts = texts.select("id", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("dw"))
    pairs = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).join(items.withColumnRenamed("words", "iw"), "item")
    pairs = pairs.withColumn("width", F.least(F.lit(WINDOW), F.size("iw")))
    # For each shift the stretch of the item that lies in the document, and in it the windows that pass.
    wanted = f"width - case when width < {SPAN} then 0 when width < {WINDOW} then {SHORT_SUBSTITUTIONS} else {SUBSTITUTIONS} end"
    same = "transform(sequence(r.low, r.high - 1), i -> if(iw[i] = dw[i + r.shift], 1, 0))"
    passing = let(same, "same", f"filter(sequence(0, r.high - r.low - width), s -> aggregate(slice(same, s + 1, width), 0, (n, x) -> n + x) >= {wanted})")
    stretches = "transform(shifts, z -> named_struct('shift', z, 'low', greatest(0, -z), 'high', least(size(iw), size(dw) - z)))"
    windows = f"transform(filter({stretches}, r -> r.high - r.low >= width), r -> named_struct('shift', r.shift, 'low', r.low, 'windows', {passing}))"
    ends = f"transform(filter({windows}, r -> size(r.windows) > 0), r -> named_struct('shift', r.shift, 'first', r.low + r.windows[0], 'words', cast(element_at(r.windows, -1) - r.windows[0] + width as bigint)))"
    found = pairs.select("doc_id", "h1", "h2", "item_id", F.inline(F.expr(ends))).withColumnRenamed("words", "overlap_words")
    best = F.min(F.struct((-F.col("overlap_words")).alias("less"), (F.col("first") + F.col("shift")).cast("long").alias("doc_start"), F.col("first").cast("long").alias("item_start")))
    return found.groupBy("doc_id", "h1", "h2", "item_id").agg(best.alias("b")).select("doc_id", "h1", "h2", "item_id", (-F.col("b.less")).alias("overlap_words"), "b.doc_start", "b.item_start")


def item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item, seed, item_at) of benchmark items: seeds of those that have SPAN words or more, the one whole run of the others."""
    out = seeds(items, ["item"], WINDOW).unionByName(seeds(items.filter(F.size("words") < WINDOW), ["item"], SPAN, SHORT_MASKS))
    for n in lengths:
        whole = items.filter(F.size("words") == n).select("item", F.expr(f"xxhash64(-{n}, words)").alias("seed"), F.lit(0).alias("at"))
        out = out.unionByName(whole)
    return out.select("item", "seed", F.col("at").alias("item_at"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that overlap with no benchmark item."""
    found = staged(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct(), "leaks")
    h1, h2 = text_hashes()
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), h1, h2)
    return mine.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_anti").select("row.*")
