"""Near-duplicate documents by ProbMinHash, and the banding and verification that texts and lines share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import CHUNK_BYTES, GOLDEN, MASK64, chunks, dropped, mix, shingles, small_batches, staged, word_hashes
from stancemill.llm.components import components

REGISTERS = 64
ROWS = 4
WIDTH = 5
#: Members of a block of a large bucket, whose texts a task holds.
BLOCK = 512
#: Registers that a strip of comparisons within a block takes.
STRIP = 1 << 22
#: Keys of a slot, about: a task holds a slot's different keys.
SLOT_KEYS = 1 << 19
#: Keys that a task gathers before it packs them.
HELD_KEYS = 1 << 21
#: The dtype of packed_ten().
TEN_BITS = "u10"


def weighted_shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text in rising order, their counts, and bounds by text."""
    words, bounds = word_hashes(texts)
    h, bounds = shingles(words, bounds, width)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.searchsorted(doc[first], np.arange(len(texts) + 1))


def prob_minhash(h: np.ndarray, weights: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each text: two texts agree in a register with their probability Jaccard similarity.

    Element e of weight w sends arrivals of a Poisson process of rate w, each to a random register, where the
    earliest wins. An element stops once its last arrival is later than all registers of its text, which for
    most is the first. All texts are worked on at once, arrival by arrival.
    """
    n = len(bounds) - 1
    earliest, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    text, element, rate, time = np.repeat(np.arange(n), np.diff(bounds)), h, weights.astype(float), np.zeros(len(h))
    k = 0
    while len(element):
        k += 1
        bits = mix(element + np.uint64(k * int(GOLDEN) & MASK64))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        at = text * registers + (mix(bits ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = time == earliest[at]
        winner[at[won]] = element[won]
        last = earliest.reshape(n, registers).max(axis=1)
        going = time < last[text]
        text, element, rate, time = text[going], element[going], rate[going], time[going]
    return winner.reshape(n, registers)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of rows registers, with the run's number."""
    n, m = signatures.shape
    h = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, m // rows)).copy()
    for r in range(rows):
        h = mix(h * GOLDEN + signatures[:, r::rows][:, : m // rows].astype(np.uint64))
    return h.view(np.int64)


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (rising elements, weights): the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, wa), (hb, wb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i].astype(float), wb[j].astype(float)
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    from_x = np.cumsum(x) + wa.sum() - x.sum()
    from_y = y.sum() - np.cumsum(y) + wb.sum() - y.sum()
    return float((1 / (from_x / x + from_y / y)).sum())


def shingle_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    h, w, bounds = weighted_shingles(texts)
    return [(h[i:j], w[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]


def prepared(texts: dict, prepare: Callable) -> dict:
    """prepare() of the texts by their keys, a run of texts at a time."""
    keys, out = list(texts), {}
    for start, run in chunks(list(texts.values())):
        out.update(zip(keys[start : start + len(run)], prepare(run)))
    return out


def verified(pairs: DataFrame, texts: DataFrame, prepare: Callable, measure: Callable, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) measure threshold or more; prepare(list of texts) gives what is measured."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, run, held, size = [], [], {}, 0
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            for k, pair in enumerate(zip(a, b)):
                run.append(pair)
                for i, text in zip(pair, (ta[k], tb[k])):
                    if i not in held:
                        held[i] = text
                        size += len(text)
                if size >= CHUNK_BYTES or k == len(a) - 1:
                    sets = dict(zip(held, prepare(list(held.values()))))
                    keep += [measure(sets[i], sets[j]) >= threshold for i, j in run]
                    run, held, size = [], {}, 0
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


#: Standard deviations below the threshold at which a candidate's signatures rule it out unread; infinity has every candidate's text read.
SPREAD = 4.0


def least_agreement(registers: int, threshold: float, spread: float = SPREAD) -> int:
    """Registers that a pair at the threshold agrees in, less so many standard deviations."""
    return max(0, int(np.floor(registers * threshold - min(spread, registers) * np.sqrt(registers * threshold * (1 - threshold))))) if np.isfinite(spread) else 0


def packed_ten(signatures: np.ndarray) -> np.ndarray:
    """Registers of 10 bits as bytes: of each four the low bytes, then a byte of their high bits."""
    four = signatures.reshape(len(signatures), -1, 4)
    high = ((four >> 8) << np.array([0, 2, 4, 6], np.uint16)).sum(axis=2, keepdims=True)
    return np.concatenate((four & 255, high), axis=2).astype("u1").reshape(len(signatures), -1)


def signatures_of(column: pa.Array, registers: int, dtype: str) -> np.ndarray:
    if dtype == TEN_BITS:
        raw = np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, registers // 4, 5).astype(np.uint16)
        return (raw[:, :, :4] | ((raw[:, :, 4:] >> np.array([0, 2, 4, 6], np.uint16)) & 3) << 8).reshape(-1, registers)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, registers)


def _promising(registers: int, dtype: str, least: int):
    """Pairs whose signatures agree enough to be worth reading their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (signatures_of(batch.column("sa"), registers, dtype) == signatures_of(batch.column("sb"), registers, dtype)).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return work


def block_pairs(batch: pa.RecordBatch, sig: np.ndarray, rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(registers that agree, i, j) of the promising pairs of members of different components in each of the batch's blocks (runs of equal key, one and two).

    Where one and two differ, members of the one are paired with those of the other. A pair is taken in the first band that
    it shares, and in no other. Pairs are made in strips, so that memory does not grow with the square of a block.
    """
    key, one, two, block, comp, band = (batch.column(c).to_numpy() for c in ("key", "one", "two", "block", "comp", "band"))
    n, found = len(key), []
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    size = np.diff(np.append(first, n))
    later = np.repeat(first + size, size) - np.arange(n) - 1
    total = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STRIP // sig.shape[1], "right")))
        i = np.repeat(np.arange(at, to), later[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        at = to
        apart = (comp[i] != comp[j]) & ((one[i] == two[i]) | (block[i] != block[j]))
        i, j = i[apart], j[apart]
        same = sig[i] == sig[j]
        agree = np.count_nonzero(same, axis=1)
        close = agree >= least
        i, j, agree, same = i[close], j[close], agree[close], same[close]
        here = same.reshape(len(i), sig.shape[1] // rows, rows).all(axis=2).argmax(axis=1) == band[i]
        found.append((agree[here], i[here], j[here]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_block(registers: int, dtype: str, visit: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    """visit() of whole blocks (rows of equal key, one and two, which come together), as many as a batch holds, and their signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, one, two = (batch.column(c).to_numpy() for c in ("key", "one", "two"))
            last = np.flatnonzero((key != key[-1]) | (one != one[-1]) | (two != two[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                done = batch.slice(0, cut)
                yield visit(done, signatures_of(done.column("sig"), registers, dtype))
            held = batch.slice(cut)
        if held is not None:
            yield visit(held, signatures_of(held.column("sig"), registers, dtype))

    return work


def _hopeful(rows: int, least: int):
    """Ids of the members of promising pairs."""

    def visit(batch: pa.RecordBatch, sig: np.ndarray) -> pa.RecordBatch:
        _, i, j = block_pairs(batch, sig, rows, least)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.unique(np.concatenate((i, j)))))], names=["id"])

    return visit


def _linked(prepare: Callable, measure: Callable, threshold: float, rows: int, least: int):
    """Links that join components within the blocks: at most one fewer than they have members."""

    def visit(batch: pa.RecordBatch, sig: np.ndarray) -> pa.RecordBatch:
        ids, comp = batch.column("id").to_pylist(), batch.column("comp").to_pylist()
        root, a, b = {c: c for c in comp}, [], []

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        agree, i, j = block_pairs(batch, sig, rows, least)
        some = np.unique(np.concatenate((i, j)))
        sets = prepared(dict(zip(some.tolist(), batch.column("text").take(pa.array(some)).to_pylist())), prepare)
        for k in np.lexsort((j, i, -agree)):
            m, n = int(i[k]), int(j[k])
            x, y = top(comp[m]), top(comp[n])
            if x != y and measure(sets[m], sets[n]) >= threshold:
                root[max(x, y)] = min(x, y)
                a.append(ids[m])
                b.append(ids[n])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return visit


def scattered(items: DataFrame, keys: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], bands: int) -> DataFrame:
    """The items' band keys, packed by slot: few rows to shuffle, eight bytes a key. keys(batch) gives ids and their band keys (a column for each band).

    A slot is a band and some low bits of its keys; a row has 32 further bits of each key and the ids, as distances from base where these fit into 32 bits.
    """
    parts = 1 << max(0, items.count() // SLOT_KEYS).bit_length()

    def packed(ids: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        slots, out = [], []
        for band in range(bands):
            part = (key[:, band] & np.uint64(parts - 1)).astype(np.uint16 if parts <= 1 << 16 else np.uint64)
            order = np.argsort(part, kind="stable") if parts > 1 else np.arange(len(ids))
            part, mine = part[order], ids[order]
            some = (key[order, band] >> np.uint64(32)).astype(np.uint32)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                base = int(mine[i:j].min())
                far = int(mine[i:j].max()) - base >= 1 << 32
                slots.append(band * parts + int(part[i]))
                out.append((base, some[i:j].tobytes(), (mine[i:j] - base).astype(np.int64 if far else np.uint32).tobytes()))
        base, some, ids = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(base, pa.int64()), pa.array(some, pa.binary()), pa.array(ids, pa.binary())], names=["slot", "base", "keys", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(keys(batch))
                n += held[-1][1].size
            if n >= HELD_KEYS:
                yield packed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held)))

    rows = items.mapInArrow(work, "slot long, base long, keys binary, ids binary")
    return rows.repartition("slot").sortWithinPartitions("slot", "base").withColumn("band", (F.col("slot") / parts).cast("int"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows in order of slot: (key, band, id, hub) of every item whose key an earlier one, the hub, has.

    Of each key only the hub is held until the slot ends, so that a bucket of any size takes the room of one member.
    """
    key, hub = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    fresh, waiting, now, of_band = [], 0, None, 0

    def merged() -> pa.RecordBatch:
        nonlocal key, hub, fresh, waiting
        some = np.concatenate([key, *(k for k, _ in fresh)])
        ids = np.concatenate([hub, *(i for _, i in fresh)])
        # Sorted with their places, equal keys stay in order of arrival.
        order = (np.sort(some.astype(np.uint64) << np.uint64(32) | np.arange(len(some), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some, ids = some[order], ids[order]
        new = np.concatenate(([True], some[1:] != some[:-1]))
        first = np.flatnonzero(new)
        owner = ids[first][np.cumsum(new) - 1]
        member = ~new & (ids != owner)
        key, hub, fresh, waiting = some[first], ids[first], [], 0
        full = (np.int64(now) << np.int64(32)) | some[member].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), of_band, np.int32)), pa.array(ids[member]), pa.array(owner[member])], names=["key", "band", "id", "hub"])

    for batch in batches:
        slots, bases, bands = (batch.column(c).to_pylist() for c in ("slot", "base", "band"))
        for k, slot in enumerate(slots):
            if slot != now:
                if fresh:
                    yield merged()
                key, hub, now, of_band = key[:0], hub[:0], slot, bands[k]
            some = np.frombuffer(batch.column("keys")[k].as_buffer(), np.uint32)
            raw = batch.column("ids")[k].as_buffer()
            fresh.append((some, np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(some) else np.int64).astype(np.int64) + bases[k]))
            waiting += len(some)
            if waiting >= max(SLOT_KEYS, len(key)):
                yield merged()
    if fresh:
        yield merged()


def near_components(packed: DataFrame, sigs: Callable[[DataFrame], DataFrame], texts: Callable[[DataFrame], DataFrame], prepare: Callable, measure: Callable, threshold: float, registers: int, rows: int, dtype: str, block: int = BLOCK, spread: float = SPREAD) -> DataFrame:
    """(node, root) of all items that have a link: a text pair that shares a band key and measures threshold or more.

    packed: scattered() items. sigs gives (id, sig) for ids (registers, or their low bits, as bytes of dtype, or by packed_ten()) and texts (id, text), both staged.

    In each bucket of a band key one member, the hub, is compared with every other, and verified unless their
    signatures lie spread standard deviations below the threshold. That joins groups of copies in one round. What is
    left are buckets whose other members belong to several components: there each pair of members of different
    components is compared by signature, in blocks of bounded size, and verified on the spot under the same
    condition. No pairs leave a block but those that join two components.
    """
    least = least_agreement(registers, threshold, spread)
    stars = staged(packed.mapInArrow(_stars, "key long, band int, id long, hub long"), "stars")
    pairs = staged(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    needed = staged(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    known = sigs(needed)
    side = lambda c: known.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_promising(registers, dtype, least), "a long, b long")
    close = staged(close, "close")
    dropped(pairs, needed)
    held = texts(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct())
    links = staged(verified(close, held, prepare, measure, threshold), "links")
    found = components(links)
    dropped(close, links)

    placed = stars.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low <> high")
    # Written, so that the join's own exchanges can split a large bucket.
    mixed = staged(mixed.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mixed")
    rest = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.join(known.select("id", "sig"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "comp", "sig")
    rest = staged(rest, "rest")
    together = lambda df: df.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    hopeful = staged(together(rest).mapInArrow(_by_block(registers, dtype, _hopeful(rows, least)), "id long").distinct(), "hopeful")
    rest_texts = texts(hopeful)
    late = together(rest.join(rest_texts, "id")).mapInArrow(_by_block(registers, dtype, _linked(prepare, measure, threshold, rows, least)), "a long, b long")
    late = staged(late, "links")
    dropped(stars, mixed, rest, hopeful)
    if not late.isEmpty():
        before, found = found, components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
        dropped(before)
    dropped(late)
    return found


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, run in chunks(texts):
            h, w, bounds = weighted_shingles(run)
            sig = prob_minhash(h, w, bounds)
            some = np.flatnonzero(np.diff(bounds))
            keys = band_keys(sig[some], ROWS)
            part = batch.slice(start, len(run)).select(["doc_id", "h1", "h2"])
            low = sig.astype(np.uint32)
            full = np.zeros(len(run), bool)
            full[some] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * keys.shape[1]))), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([low[k].tobytes() for k in range(len(run))], pa.binary())], names=["doc_id", "h1", "h2", "bands", "sig"])


def _own_bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and band keys of the items that have any."""
    some = pa.compute.greater(pa.compute.fill_null(batch.column("bands").value_lengths(), 0), 0)
    return batch.column("id").filter(some).to_numpy(), batch.column("bands").flatten().to_numpy().view(np.uint64).reshape(-1, REGISTERS // ROWS)


def near_documents(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", spread: float = SPREAD) -> DataFrame:
    """(h1, h2, root, class_id, copies): for each distinct text, its class (root) and how many rows have it. h1, h2 are the text's hashes, see text_hashes().

    Texts are linked when the probability Jaccard similarity of their five-word shingles, weighted by how
    often they occur, is threshold or more, by exact computation on whole texts; classes are the connected
    components of the links and are named by their smallest doc_id. Equal texts always share a class. Texts
    of fewer words are a single shingle; texts without words (null, empty, white space) link with nothing,
    but equal ones share a class. Rows that repeat a doc_id count as copies; null ids name no class. Of no
    rows there are no classes; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), *text_hashes(text_col), F.col(text_col).alias("text"))
    rows = d.select("doc_id", "h1", "h2", "text").mapInArrow(_signatures, "doc_id long, h1 long, h2 long, bands array<long>, sig binary")
    rows = staged(rows, "signatures")
    # Equal texts have equal signatures, so any of them will do.
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    items = staged(groups.withColumn("id", F.monotonically_increasing_id()), "texts")

    known: list[DataFrame] = []

    def sigs(needed: DataFrame) -> DataFrame:
        known.append(staged(items.select("id", "sig").join(needed.filter("id >= 0"), "id", "left_semi"), "sigs"))
        return known[-1]

    def texts(needed: DataFrame) -> DataFrame:
        keys = staged(items.select("id", "h1", "h2").join(needed.filter("id >= 0"), "id", "left_semi"), "keys")
        known.append(staged(d.select("h1", "h2", "text").join(keys.filter("id >= 0"), ["h1", "h2"]).select("id", "text").dropDuplicates(["id"]), "needed"))
        dropped(keys)
        return known[-1]

    packed = scattered(items.select("id", "bands"), _own_bands, REGISTERS // ROWS)
    found = near_components(packed, sigs, texts, shingle_sets, prob_jaccard, threshold, REGISTERS, ROWS, "<u4", spread=spread)
    dropped(rows, *known)
    named = items.join(found.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "least", "copies", F.coalesce("root", "id").alias("root"))
    # Written, so that the join's own exchange can split a class that holds many of the texts.
    names = staged(named.groupBy("root").agg(F.min("least").alias("class_id")), "names")
    return named.join(names, "root").select("h1", "h2", "root", "class_id", "copies")


def text_hashes(text_col: str = "text") -> list:
    """Two 64-bit hashes of the text, null counting as empty: together, the identity of a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def classes(docs: DataFrame, threshold: float = 0.8, spread: float = SPREAD) -> DataFrame:
    """doc_id and class_id of each row of docs, and kept: whether its doc_id names the class."""
    found = staged(near_documents(docs, threshold, spread=spread), "classes")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes())
    out = d.join(found, ["h1", "h2"], "left").select("doc_id", "class_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, threshold: float = 0.8, spread: float = SPREAD) -> DataFrame:
    """docs with one row of each class: one with the class's smallest doc_id. Columns stay as they are.

    Rows that repeat that doc_id within the class are told apart by text; of rows equal in both, one stays.
    A class whose ids are all null keeps one row.
    """
    found = staged(near_documents(docs, threshold, spread=spread), "classes")
    h1, h2 = text_hashes()
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), h1, h2, F.col("doc_id").cast("long").alias("key"))
    mine = mine.join(found, ["h1", "h2"]).filter("key <=> class_id")
    # Only rows with the class's own id are left: repeated ids are the sole reason for more than one.
    return mine.dropDuplicates(["root"]).select("row.*")
