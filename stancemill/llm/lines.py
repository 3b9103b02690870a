"""Fuzzy line deduplication by MinHash over character shingles.

Lines are compared in lower case with runs of white space as one space. Equal lines are one item; items
whose sets of five-character shingles have a Jaccard similarity of the threshold or more are linked,
and of each connected component the first line, by (doc_id, line number), stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.llm.common import dropped, mix, small_batches, staged
from stancemill.llm.neardup import SPREAD, TEN_BITS, band_keys, near_components, packed_ten, scattered, text_hashes

WIDTH = 5
ROWS = 6
#: At a similarity of 0.8, 26 bands of six find 99.96 % of the pairs themselves; components need only a path.
REGISTERS = 156
#: Characters of a step: its arrays of four bytes a character are read once for each register.
STEP = 1 << 18
#: Rows of a batch of lines.
ROWS_OUT = 1 << 14
#: Members of a block of a large bucket.
BLOCK = 1024
FACTORS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
#: What str.split() takes as white space, but for the space and the line feed.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACES = [c for c in SPACES if c.isascii()]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """normal() of each line; a text without white space to change is lowered as a whole."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in ("  ", " \n", "\n ")) or any(c in text for c in (ASCII_SPACES if text.isascii() else SPACES)):
        return [normal(x) for x in text.split("\n")]
    return text.lower().split("\n")


def char_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of WIDTH characters of each line, with bounds; a shorter line is filled up to one run."""
    lines = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines]
    at = np.cumsum([0, *map(len, lines)])
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(chars) - WIDTH + 1
    h = chars[:n].copy()
    for k in range(1, WIDTH):
        h *= np.uint32(0x9E3779B1)
        h += chars[k : k + n]
    inside = np.ones(len(chars), bool)
    for k in range(1, WIDTH):
        inside[at[1:] - k] = False
    h = h[inside[:n]]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    return h ^ (h >> np.uint32(16)), at - np.arange(len(at)) * (WIDTH - 1)


def minhash(lines: list[str]) -> np.ndarray:
    """The low 10 bits of the MinHash registers of lines, each the least product of a shingle's hash and an odd factor.

    Lines without a common shingle agree in a band by chance with probability 2 ** -60, which only adds candidates for verification.
    """
    h, bounds = char_shingles(lines)
    out = np.empty((REGISTERS, len(lines)), np.uint32)
    row = np.empty_like(h)
    for k in range(REGISTERS):
        np.multiply(h, FACTORS[k], out=row)
        np.minimum.reduceat(row, bounds[:-1], out=out[k])
    return np.ascontiguousarray(out.T.astype(np.uint16) & np.uint16(1023))


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line in rising order: the characters themselves, 12 bits each; with others a 64-bit hash."""
    lines = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines]
    at = np.cumsum([0, *map(len, lines)])
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(chars) - WIDTH + 1
    h = chars[:n]
    for k in range(1, WIDTH):
        h = (h << np.uint64(12)) | chars[k : k + n]
    if chars.max() >= 4096:
        most, other = chars[:n], chars[:n]
        for k in range(1, WIDTH):
            most = np.maximum(most, chars[k : k + n])
            other = other * np.uint64(0xD6E8FEB86659FD93) + chars[k : k + n]
        h = np.where(most < 4096, h, mix(other) | np.uint64(1 << 63))
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        one = np.sort(h[i : j - WIDTH + 1])
        new = one[1:] != one[:-1]
        out.append(one if new.all() else one[np.concatenate(([True], new))])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (len(both) - common)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that is not blank. Of equal lines of a batch the first has its text and is keyed by its hash; the others are gone, with a key of their own, so that they do not meet."""
    for batch in batches:
        ids, ones, twos = (batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2"))
        row, number, line, best = [], [], [], {}
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        texts = batch.column("text").to_pylist()
        for k in order:
            for n, x in enumerate(normal_lines(texts[k] or "")):
                if x:
                    at = len(row)
                    row.append(k)
                    number.append(n)
                    line.append(x)
                    other = best.setdefault(x, at)
                    # Rows come by id, so an earlier one loses only to a row with the same id.
                    if other != at and ids[row[other]] == ids[k] and (n, ones[k], twos[k]) < (number[other], ones[row[other]], twos[row[other]]):
                        best[x] = at
        if not line:
            continue
        holder = np.array([best[x] for x in line])
        first = holder == np.arange(len(line))
        place = lambda k: (ids[row[k]], number[k], ones[row[k]], twos[row[k]])
        # Rows equal in id and text have one place.
        again = [k for k in np.flatnonzero(~first).tolist() if place(k) == place(holder[k])]
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace") if f else b"%d %d %d" % (ones[r], twos[r], n)) for x, f, r, n in zip(line, first.tolist(), row, number)), "<i8").reshape(-1, 2)
        stay = np.ones(len(line), bool)
        stay[again] = False
        take = pa.array(row)
        for k in range(0, len(line), ROWS_OUT):
            part = slice(k, k + ROWS_OUT)
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take[part]) for c in ("doc_id", "h1", "h2")), pa.array(number[part], pa.int32()), pa.array(keys[part, 0]), pa.array(keys[part, 1]), pa.array(~first[part]), pa.array([x if f else None for x, f in zip(line[part], first[part].tolist())], pa.string())],
                names=["doc_id", "h1", "h2", "line", "k1", "k2", "gone", "text"],
            )
            yield out if not again else out.filter(pa.array(stay[part]))


def signatures(lines: list[str]) -> np.ndarray:
    """minhash() of lines in steps of STEP characters."""
    out, run, size = [np.zeros((0, REGISTERS), np.uint16)], [], 0
    for x in lines:
        run.append(x)
        size += len(x)
        if size >= STEP:
            out.append(minhash(run))
            run, size = [], 0
    if run:
        out.append(minhash(run))
    return np.concatenate(out)


def _bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and band keys of lines."""
    return batch.column("id").to_numpy(), band_keys(signatures(batch.column("text").to_pylist()), ROWS).view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = packed_ten(signatures(batch.column("text").to_pylist()))
        yield batch.append_column("sig", pa.array([x.tobytes() for x in packed], pa.binary()))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", spread: float = SPREAD) -> DataFrame:
    """docs with its own columns, the text without repeated lines, and n_lines and n_removed (long).

    Blank lines stay and are not counted. Of equal or similar lines the first by (doc_id, line number,
    text hashes) stays, null ids first. Rows equal in doc_id and text share one fate, as one row. A null text stays
    null with no lines; a text all of whose lines go becomes what blank lines it had, at least empty.
    A text or line of any length is taken whole. Columns named n_lines or n_removed are replaced; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_hashes(text_col), F.col(text_col).cast("string").alias("text"))
    lines = d.mapInArrow(_lines, "doc_id long, h1 long, h2 long, line int, k1 long, k2 long, gone boolean, text string")
    # Of equal lines of all batches the first is an item, with its text; the others are gone, but for those of equal rows.
    equal = Window.partitionBy("k1", "k2").orderBy("doc_id", "line", "h1", "h2")
    lines = lines.withColumns({"number": F.row_number().over(equal), "rank": F.rank().over(equal)}).filter("gone or number = 1 or rank > 1")
    lines = lines.withColumn("gone", F.col("gone") | (F.col("rank") > 1))
    lines = staged(lines.select(F.monotonically_increasing_id().alias("id"), "doc_id", "h1", "h2", "line", "gone", F.when(~F.col("gone"), F.col("text")).alias("text")), "lines")
    items = lines.filter("not gone")
    known: list[DataFrame] = []

    def sigs(needed: DataFrame) -> DataFrame:
        # The filter on ids tells Spark that the side is selective: it sends a Bloom filter ahead of the shuffle of texts.
        some = items.select("id", "text").join(needed.filter("id >= 0"), "id", "left_semi")
        known.append(staged(some.mapInArrow(_signed, "id long, text string, sig binary"), "needed"))
        return known[-1]

    def texts(needed: DataFrame) -> DataFrame:
        return known[0].select("id", "text").join(needed, "id", "left_semi")

    packed = scattered(items.select("id", "text"), _bands, REGISTERS // ROWS)
    found = near_components(packed, sigs, texts, shingle_sets, jaccard, threshold, REGISTERS, ROWS, TEN_BITS, BLOCK, spread)
    dropped(*known)
    where = F.struct("doc_id", "line", "h1", "h2")
    near = staged(items.select("id", where.alias("first")).join(found.withColumnRenamed("node", "id").filter("id >= 0"), "id").select("root", "first"), "near")
    # Written, so that the join's own exchange can split a component that holds many of the lines.
    keepers = staged(near.groupBy("root").agg(F.min("first").alias("keep")), "keepers")
    similar = near.join(keepers, "root").filter(~F.col("first").eqNullSafe(F.col("keep"))).select("first.doc_id", "first.h1", "first.h2", "first.line")
    marks = lines.filter("gone").select("doc_id", "h1", "h2", "line").unionByName(similar)
    per = staged(marks.groupBy("doc_id", "h1", "h2").agg(F.collect_set("line").alias("gone")), "gone")
    dropped(found, near, keepers, lines)

    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    h1, h2 = text_hashes(text_col)
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(id_col).cast("long").alias("_id"), h1, h2)
    per = per.withColumnRenamed("doc_id", "_key")
    # Of the two sides only the short lists are built into tables: no task sorts its texts.
    mine = mine.join(per.hint("shuffle_hash"), mine["_id"].eqNullSafe(per["_key"]) & (mine["h1"] == per["h1"]) & (mine["h2"] == per["h2"]), "left")
    kept_text = F.col("row")[text_col].cast("string")

    def not_blank(x: Column) -> Column:
        # A line that begins with a visible ASCII character needs no pattern.
        return ((x >= "!") & (x < "\x7f")) | x.rlike(r"(?U)[^\s\x1c-\x1f]")

    def rest_of(v: Column) -> Column:
        parts, gone = v["parts"], v["gone"]
        stay = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone))
        left = F.when(gone.isNull(), v["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
        return F.struct(left.alias("text"), F.size(F.filter(parts, not_blank)).cast("long").alias("n"))

    # Bound as a lambda's variable, the lines are split once, not for each line.
    bound = F.array(F.struct(kept_text.alias("text"), F.split(kept_text, "\n", -1).alias("parts"), F.col("gone").alias("gone")))
    mine = mine.withColumn("_new", F.transform(bound, rest_of)[0])
    columns = [F.col("_new.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest]
    n_lines = F.when(kept_text.isNotNull(), F.col("_new.n")).otherwise(F.lit(0)).cast("long")
    return mine.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))
