"""Exact n-gram Jaccard join: documents whose shingle sets overlap by a given share.

Sets are of 64-bit hashes of word n-grams. Documents of equal sets form a class that is compared
once. Linked sets x and y share at least ``need(|x|)`` elements, so among the first
``|x| - need(|x|) + l`` elements of x in hash order at least l are in y as well:

1. Each class deals out the first FIRST of its elements; those that another class deals out too are
   counted, and classes with fewer than l of them are linked with nothing.
2. The rest deal out the first elements for l = 1; classes that meet in an element and are of like
   size are joined into candidate groups, whose members alone are compared.
3. A group is cut into tiles by size band (a band spans the factor 1 / similarity, so partners are in
   the same or the next band) and, where a band holds more than TILE classes or ELEMENTS elements, by
   hash into parts that meet pairwise. In a tile, hashed bitmaps bound the overlap from above by a bit count; pairs
   that pass and are not yet in one component are intersected as sorted arrays, exactly.
4. Components of the links are found from each tile's spanning edges.

Candidates never leave a tile as pairs and no partner is dropped. Elements travel as packed arrays, a
row for each bucket and LOT of a task's entries. Within a lot, what a common element would bring
together is combined before it is dealt out: in step 1 an element of several classes is counted for
them at once and travels as itself alone; in step 2 its classes are chained in order of size, and
only the links of the chain travel, some 70 for each lot however many classes share it. (A class that is
in several lots may so be counted too high in step 1, which only lets it into step 2.) Two n-grams share a hash, or two sets both class hashes, with a
chance of 2^-64 for a pair.

Defined results: text is lower-cased A-Z and split at white space (space, \\t to \\r); a text of
fewer than n words is one shingle of all its words; a null or wordless text has the empty set and is
linked with nothing; a row whose doc_id is null is linked with nothing and its component is null;
rows that repeat a doc_id are each compared, and share the component's id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, marked, released, sliced, text_of, written
from gridloom.llm.components import components, forest

WORDS, PERCENT = 5, 75
#: The share of a set's elements that is dealt out first, in percent.
FIRST = 40
#: Classes and elements in a tile part, and entries of a task that are combined and dealt out at once.
TILE, ELEMENTS, LOT = 2048, 1 << 20, 1 << 18
#: Documents whose words are hashed at once, and bytes of text at once.
BATCH, BATCH_BYTES = 512, 1 << 19

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below n. They are not kept: workers stay for later tasks of other operators."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_BASE, _INVERSE))


def shingle_sets(texts: pa.Array, n_words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=len(texts) + 1)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]  # a slice's texts begin within the buffer
    if not len(raw):
        return [np.empty(0, np.uint64)] * len(texts)
    data = _LOWER[raw]
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)  # where a text begins
    first[offsets] = True
    starts = np.flatnonzero(solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]])))
    stops = np.flatnonzero(solid & (first[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    up, down = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up)])
    words = _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    grams = np.zeros(max(0, len(words) - n_words + 1), np.uint64)
    for k in range(n_words):
        grams += words[k : k + len(grams)] * _FACTORS[k]
    grams = _mix(grams + U(n_words))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n_words:
            out.append(np.unique(grams[a : b - n_words + 1]))
        elif b > a:
            few = words[a:b] * _FACTORS[: b - a]
            out.append(_mix(few.sum(keepdims=True, dtype=np.uint64) + U(1000 + b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(elements: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit integer."""
    if not len(elements):
        return 0
    both = np.array([elements.sum(dtype=np.uint64), np.bitwise_xor.reduce(elements), U(len(elements))])
    return int(_mix((_mix(both) * _FACTORS[:3]).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def need(size: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of this size with a linked set: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
DEALT_SQL = "bucket int, kind int, a binary, b binary, c binary"


def _dealt(n_buckets: int, kind: int, by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """One row for each bucket: the packed columns of the entries that fall into it."""
    bucket = (by >> U(33)).astype(np.int64) % n_buckets
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    placed = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield (k, kind, *(c[edges[k] : edges[k + 1]].tobytes() for c in placed), *[None] * (3 - len(columns)))


def _lots(batches: Iterator[pa.RecordBatch], columns: int, entries, lot: int) -> Iterator[list[np.ndarray]]:
    """entries(batch) makes columns of a batch's entries, counted by the last of them; those of batches put together, ``lot`` at a time."""
    held, n = [[] for _ in range(columns)], 0
    for batch in sliced(batches, "text", BATCH, BATCH_BYTES):
        for parts, column in zip(held, entries(batch)):
            parts.append(column)
        n += len(held[-1][-1])
        if n >= lot:
            yield [np.concatenate(c) for c in held]
            held, n = [[] for _ in range(columns)], 0
    if held[0]:
        yield [np.concatenate(c) for c in held]


def _packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), DEALT)], schema=DEALT)


def _deal_first(n_buckets: int, n_words: int, percent: int, lot: int):
    """Step 1: rows of kind 0 hold (set key, doc_id, size), of kind 1 (element, set key), of kind 2 elements of several sets of a lot, of kind 3 (set key, how many of its elements are of kind 2)."""

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        sets = shingle_sets(batch.column("text"), n_words)
        keys = np.array([set_key(s) for s in sets], np.int64)
        once = np.unique(keys, return_index=True)[1]
        take = [sets[k][: _first(len(sets[k]), percent)] for k in once]
        elements = (np.concatenate(take) if take else np.empty(0, np.uint64)).astype(np.uint64)
        return keys, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(s) for s in sets], np.int64), np.repeat(keys[once], [len(t) for t in take]), elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, sizes, owners, elements in _lots(batches, 5, entries, lot):
            # Documents go anywhere: those of one class must not meet.
            rows = list(_dealt(n_buckets, 0, _mix(ids.view(np.uint64)), keys, ids, sizes))
            elements, owners, many = _shared(elements, owners)
            found, n = np.unique(owners[many], return_counts=True)
            common = elements[many]
            common = common[np.concatenate([[True], common[1:] != common[:-1]])[: len(common)]]
            rows += _dealt(n_buckets, 1, elements[~many], elements[~many].astype(np.uint32), owners[~many])
            rows += _dealt(n_buckets, 2, common, common.astype(np.uint32))
            rows += _dealt(n_buckets, 3, _mix(found.view(np.uint64)), found, n.astype(np.int64))
            yield from _packed(rows)

    return run


def _shared(elements: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct entries (element, key), sorted, and whether an entry's element has several keys."""
    order = np.lexsort((keys, elements))
    elements, keys = elements[order], keys[order]
    new = np.concatenate([[True], (elements[1:] != elements[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)]
    elements, keys = elements[new], keys[new]
    bounds = _runs(elements)
    return elements, keys, np.repeat(np.diff(bounds) > 1, np.diff(bounds))


def _first(size: int, percent: int = PERCENT) -> int:
    """Elements that a set deals out in step 1."""
    return min(size, max(size - need(size, percent) + 1, -(-FIRST * size // 100)))


COUNTED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
COUNTED_SQL = "kind int, key long, doc_id long, n long"


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple]) -> dict[int, dict[int, list[np.ndarray]]]:
    """All packed columns of a task by bucket and kind."""
    held: dict[int, dict[int, list]] = {}
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            bucket, kind = columns[0][i].as_py(), columns[1][i].as_py()
            at = held.setdefault(bucket, {}).setdefault(kind, [[] for _ in kinds[kind]])
            for parts, column, dtype in zip(at, columns[2:], kinds[kind]):
                parts.append(np.frombuffer(column[i].as_buffer(), dtype))
    return {b: {k: [np.concatenate(c) for c in cs] for k, cs in ks.items()} for b, ks in held.items()}


def _runs(values: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values in a sorted array."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, a bucket at a time: documents (kind 0), and for each set key its shared elements here (kind 1)."""
    held = _gathered(batches, {0: (np.int64, np.int64, np.int64), 1: (np.uint32, np.int64), 2: (np.uint32,), 3: (np.int64, np.int64)})
    for at in held.values():
        if 0 in at:
            keys, ids, sizes = at[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys), pa.array(ids), pa.array(sizes)], schema=COUNTED)
        counts = [at[3]] if 3 in at else []
        if 1 in at:
            elements, keys, many = _shared(*at[1])
            if 2 in at:
                many |= np.isin(elements, at[2][0])
            counts.append(np.unique(keys[many], return_counts=True))
        for found, n in counts:
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array(found), pa.nulls(len(found), pa.int64()), pa.array(n.astype(np.int64))], schema=COUNTED)


def _deal_second(n_buckets: int, n_words: int, percent: int, lot: int):
    """Step 2: rows of kind 0 hold (element, set key, size) of the first elements, of kind 1 edges found within a lot."""

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        sets = shingle_sets(batch.column("text"), n_words)
        take = [s[: len(s) - need(len(s), percent) + 1] for s in sets]
        lengths = [len(t) for t in take]
        keys = np.repeat(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64), lengths)
        return keys, np.repeat(np.array([len(s) for s in sets], np.int64), lengths), np.concatenate(take)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, elements in _lots(batches, 3, entries, lot):
            elements, keys, sizes, a, b = chained(elements, keys, sizes, percent)
            nodes, roots = forest(a, b) if len(a) else (a, b)
            yield from _packed([*_dealt(n_buckets, 0, elements, elements, keys, sizes), *_dealt(n_buckets, 1, _mix(nodes.view(np.uint64)), nodes, roots)])

    return run


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def chained(elements: np.ndarray, keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Entries (element, key, size) of which some may stand for all, and edges (a, b) that join them to the rest.

    An element's classes stand in order of size. All within reach of the first hang from it, and the last
    of them is first of the next stretch; these alone stay. Whatever is in reach of one that hangs between
    two is in reach of one of the two: a smaller class of the first, a larger one of the first or the last.
    """
    order = np.lexsort((keys, sizes, elements))
    elements, keys, sizes = elements[order], keys[order], sizes[order]
    bounds = _runs(elements)
    first, last = bounds[:-1], bounds[1:] - 1
    stays = np.zeros(len(elements), bool)
    stays[first], stays[last] = True, True
    # Most elements' classes are all in reach of the first.
    near = 100 * sizes[first] >= percent * sizes[last]
    lengths = last - first
    begin = np.repeat(first[near], lengths[near])
    at = begin + 1 + np.arange(len(begin)) - np.repeat(np.concatenate([[0], np.cumsum(lengths[near])])[:-1], lengths[near])
    from_, to = [keys[at]], [keys[begin]]
    for a, b in zip(first[~near].tolist(), bounds[1:][~near].tolist()):
        while a < b - 1:
            stop = a + int(np.searchsorted(sizes[a:b], 100 * sizes[a] // percent, side="right"))
            if stop == a + 1:
                a += 1
            else:
                from_.append(keys[a + 1 : stop])
                to.append(np.full(stop - a - 1, keys[a]))
                a = stop - 1
            stays[a] = True
    return elements[stays], keys[stays], sizes[stays], np.concatenate(from_), np.concatenate(to)


def _meet(percent: int):
    """Step 2, a bucket at a time: a forest over the classes that meet in an element and are of like size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, {0: (np.uint64, np.int64, np.int64), 1: (np.int64, np.int64)})
        for at in held.values():
            a, b = at.get(1, [np.empty(0, np.int64)] * 2)
            if 0 in at:
                *_, c, d = chained(*at[0], percent)
                a, b = np.concatenate([a, c]), np.concatenate([b, d])
            nodes, roots = forest(a, b) if len(a) else (a, b)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=EDGES)

    return run


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set, bit h mod bits set for each element h."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for k, elements in enumerate(sets):
        places = (elements % U(bits)).astype(np.int64)
        flags = np.zeros(bits, bool)
        flags[places] = True
        out[k] = np.packbits(flags, bitorder="little")
    return out.view(np.uint64)


def tile_links(keys: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning links of the components that the sets of a tile form."""
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    keys = keys[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 1 << max(8, min(14, int(sizes[-1]).bit_length()))
    maps = bitmaps(sets, bits)
    filled = np.bitwise_count(maps).sum(1, dtype=np.int64)
    label = np.arange(n)
    links = []
    for i in range(n - 1):
        stop = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        if stop <= i + 1:
            continue
        near = np.flatnonzero(label[i + 1 : stop] != label[i]) + i + 1
        if not len(near):
            continue
        # Elements of one set without their bit in the other's map are surely not common.
        both = np.bitwise_count(maps[near] & maps[i]).sum(1, dtype=np.int64)
        bound = np.minimum(sizes[i] - (filled[i] - both), sizes[near] - (filled[near] - both))
        near = near[100 * bound >= percent * (sizes[i] + sizes[near] - bound)]
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if linked(common, len(sets[i]), len(sets[j]), percent):
                links.append((int(keys[i]), int(keys[j])))
                label[label == label[j]] = label[i]
    return links


def _link_tiles(n_words: int, percent: int):
    """Rows sorted by tile to spanning links; a tile may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            return tile_links(np.array(keys, np.int64), sets, percent) if len(keys) > 1 else []

        for batch in sliced(batches, "text", BATCH, BATCH_BYTES):
            found = []
            for tile, key, elements in zip(batch.column("tile").to_pylist(), batch.column("key").to_pylist(), shingle_sets(batch.column("text"), n_words)):
                if tile != now:
                    found += close()
                    now, keys, sets = tile, [], []
                keys.append(key)
                sets.append(elements)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found)], schema=EDGES)
        if found := close():
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found)], schema=EDGES)

    return run


def tiles(groups: DataFrame, percent: int = PERCENT, most: int = TILE, *, elements: int = ELEMENTS) -> DataFrame:
    """(key, tile) of (key, n, component): which tiles a class is compared in.

    A group of at most ``most`` classes and ``elements`` elements is a tile. A larger one is cut by size band, a
    band by hash into parts of about so many; every two parts of the same or adjacent bands share a tile.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("long")
    rows = groups.withColumn("band", band)
    parts_of = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / elements))
    in_group = rows.groupBy("component").agg(parts_of.alias("whole"))
    in_band = rows.groupBy("component", "band").agg(parts_of.alias("parts"))
    rows = rows.join(in_group, "component")
    small = rows.where(F.col("whole") <= 1).select("key", F.concat_ws("/", F.col("component")).alias("tile"))
    parts = in_band.select("component", "band", "parts")
    large = rows.where(F.col("whole") > 1).join(parts, ["component", "band"])
    next_up = parts.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    next_down = parts.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    large = large.join(next_up, ["component", "band"], "left").join(next_down, ["component", "band"], "left")
    own = F.pmod(F.xxhash64("key"), F.col("parts"))

    def named(low_band, low, high_band, high):
        return F.concat_ws("/", F.col("component"), low_band, low, high_band, high)

    count = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), c - 1)).otherwise(F.array().cast("array<bigint>"))
    b = F.col("band")
    within = F.transform(count(F.col("parts")), lambda k: named(b, F.least(k, own), b, F.greatest(k, own)))
    up = F.transform(count(F.col("above")), lambda k: named(b, own, b + 1, k))
    down = F.transform(count(F.col("below")), lambda k: named(b - 1, k, b, own))
    return small.unionByName(large.select("key", F.explode(F.concat(within, up, down)).alias("tile")))


@batches_of(BATCH)
def join(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = rows.where("doc_id is not null")

    dealt = known.mapInArrow(released(_deal_first(n_buckets, n_words, percent, LOT)), DEALT_SQL).repartition(n_buckets, "bucket")
    counted = written(dealt.mapInArrow(released(_count_shared), COUNTED_SQL), "jaccard-counts")
    listed = counted.where("kind = 0").select("key", "doc_id", "n")
    classes = listed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    shared = counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("shared"))
    # One less than l: partners' sizes are rounded up on their own.
    n = F.col("n")
    spare = n - F.ceil(n * percent / 100)
    least_shared = F.greatest(F.lit(1), F.least(n, F.greatest(spare + 1, F.ceil(n * FIRST / 100))) - spare - 1)
    suspects = written(classes.join(shared, "key").where(F.col("shared") >= least_shared).select("key", "doc_id", "n"), "jaccard-suspects")

    # Of the texts only those that a bitmap takes for suspects' are shuffled.
    some = marked(known.withColumn("hash", F.xxhash64("doc_id")), suspects.select(F.xxhash64("doc_id").alias("hash")), "maybe").where("maybe").select("doc_id", "text")
    texts = written(some.join(suspects.hint("merge"), "doc_id").select("key", "n", "text").mapInArrow(released(_own_text(n_words)), "key long, n long, text string"), "jaccard-texts")
    second = texts.select("key", "text").mapInArrow(released(_deal_second(n_buckets, n_words, percent, LOT)), DEALT_SQL).repartition(n_buckets, "bucket")
    groups = components(second.mapInArrow(released(_meet(percent)), "a long, b long"))
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    members = written(groups.unionByName(roots).join(suspects.select(F.col("key").alias("node"), "n"), "node").select(F.col("node").alias("key"), "n", "component"), "jaccard-groups")
    placed = tiles(members, percent).hint("merge").join(texts.select("key", "text"), "key").repartition("tile").sortWithinPartitions("tile")
    links = components(placed.select("tile", "key", "text").mapInArrow(released(_link_tiles(n_words, percent)), "a long, b long"))

    # A component's id is the least document of its classes.
    whole = links.unionByName(links.select(F.col("component").alias("node"), "component").distinct())
    least = whole.join(classes.select(F.col("key").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    of_key = whole.join(least, "component").select(F.col("node").alias("key"), "least_id")
    of_class = classes.join(of_key, "key", "left").select("key", F.coalesce("least_id", "doc_id").alias("component_id"))
    found = listed.join(of_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    unknown = rows.where("doc_id is null").mapInArrow(_sizes(n_words), "doc_id long, n_shingles long, component_id long")
    return found.unionByName(unknown)


def _own_text(n_words: int):
    """Drops rows that share a doc_id with a class's first document and hold another set."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH, BATCH_BYTES):
            own = [set_key(s) for s in shingle_sets(batch.column("text"), n_words)]
            same = pa.array(np.array(own, np.int64) == batch.column("key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in schema.names], schema=schema).filter(same)

    return run


def _sizes(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH, BATCH_BYTES):
            sizes = pa.array([len(s) for s in shingle_sets(batch.column("text"), n_words)], type=pa.int64())
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, sizes, none], names=["doc_id", "n_shingles", "component_id"])

    return run


def brute_force(texts: dict[int, str | None], n_words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id) by all pairs of sets of words: for tests."""
    import re

    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + n_words]) for k in range(len(words) - n_words + 1)} if len(words) >= n_words else ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and label[i] != label[j] and linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), percent):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


#: DuckDB SQL for the query: shared shingles of all pairs that share one, components by reaching out from every document.
ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
