"""Byte-level BPE with Spark's higher-order functions, each distinct word folded once.

1. Texts are split by the vocabulary's pattern and cut into blocks of documents. A block's documents
   are written as numbers into the block's list of distinct words; the list travels as packed rows,
   one for each bucket of words.
2. A bucket's lists, from all blocks, become its distinct words, which go on to a task that no Python
   function has run in before. There ``aggregate`` folds over a word's
   byte array the ranked merges, each step joining the adjacent pair of least rank, leftmost first;
   the rank map is a literal row of arrays. A step looks up only the two pairs that a merge makes.
   Words that are vocabulary entries are their own token.
3. The ids go back to the blocks, whose documents are put together by their numbers.

Texts are read once and never shuffled; a word crosses a shuffle once for each block that has it and
once more to be folded, and nothing reaches the driver. Decoding concatenates each id's bytes.

A word of over ``LONG_WORD`` bytes, for which the fold's time grows with the square, takes a
heap-ordered merge on its own; its document's other words are folded as all others. Documents with
characters that Java's Unicode tables do not know yet are split by the regex library, whose tables
are newer.

Defined results: a null text is empty and has no ids; repeated rows are encoded alike; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import batch_rows, delete, filesystem, new_folder, released, text_of, written

#: Bytes of a word from which it is encoded by the heap.
LONG_WORD = 512
#: Words of a block's documents, from which the block is closed; words put together at once; documents in an Arrow batch.
BLOCK_WORDS, SLICE_WORDS, BATCH = 1 << 22, 1 << 18, 500
#: In a fold, an element is a pair's rank, the piece's place in the word and the piece's id, in so many bits.
ID_BITS, PLACE_BITS = 25, 13
LATIN = "ISO-8859-1"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64(bytes) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode white space, as the vocabulary's own splitter has it."""
    space = r"\t\n\x0B\f\r \x85   -     　"
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class RankMap:
    """The merges as one literal row: which id two adjacent ids become, which is also the merge's rank.

    Rows of the pair table (a left id's merges) are laid over each other in one array, each at a
    displacement at which its entries meet free places, so that a pair is found by two array reads;
    an entry holds its left id beside the rank, and a pair that is no entry gives a larger number
    than any rank. The row is a scalar of the plan, in Spark's binary form: its arrays are read
    without an object for each entry.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.n_ids = max(ranks.values()) + 1
        if self.n_ids >= 1 << ID_BITS:
            raise ValueError(f"ids are held in {ID_BITS} bits")
        rows: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    rows.setdefault(a, {})[b] = rank
        place, table = self._laid(rows)
        folder = new_folder(spark, "bpe-ranks")
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        row = pa.table({"place": pa.array([place], pa.list_(pa.int32())), "table": pa.array([table], pa.list_(pa.int64())), "bytes": pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int64()))})
        pq.write_table(row, f"{root}/ranks.parquet", filesystem=fs)
        self.row = spark.read.parquet(folder).select(F.struct("place", "table", "bytes"))

    def _laid(self, rows: dict[int, dict[int, int]]) -> tuple[list[int], np.ndarray]:
        rng, free = np.random.default_rng(1), 1 << 62
        span = 4 * sum(map(len, rows.values())) + 64
        place, table = [0] * self.n_ids, np.full(span + self.n_ids, free, np.int64)
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            rights = np.fromiter(row, np.int64)
            while (table[(d := int(rng.integers(span))) + rights] != free).any():
                pass
            place[a] = d
            table[d + rights] = [a << 31 | row[b] for b in row]
        return place, table

    def fold(self, word: Column, maps: Column) -> Column:
        """A word's ids: merge the pair of least rank, the leftmost of such, until none is left. maps: the row, as a column."""
        none, ids, low = (1 << 63 - ID_BITS - PLACE_BITS) - 1, (1 << ID_BITS) - 1, (1 << ID_BITS + PLACE_BITS) - 1
        shift, rest = ID_BITS + PLACE_BITS, 1 << 30

        def bound(maps: Column) -> Column:
            # Bound once: each mention of the row would be evaluated and sent on its own.
            def cost(a: Column, b: Column) -> Column:
                entry = F.get(maps["table"], (F.get(maps["place"], a.cast("int")) + b).cast("int"))
                return F.least(entry.bitwiseXOR(F.shiftleft(a, 31)), F.lit(none).cast("bigint"))

            def merge(s: Column, least: Column, k: Column) -> Column:
                new = F.shiftright(least, shift)
                right = F.shiftleft(cost(new, F.get(s, k + 1).bitwiseAND(ids)), shift).bitwiseOR(least.bitwiseAND(low - ids)).bitwiseOR(new)
                left = let(F.get(s, k - 2), lambda x: F.shiftleft(cost(x.bitwiseAND(ids), new), shift).bitwiseOR(x.bitwiseAND(low)))
                return F.when(k == 1, F.concat(F.array(right), F.slice(s, 3, rest))).otherwise(F.concat(F.slice(s, 1, k - 2), F.array(left, right), F.slice(s, k + 2, rest)))

            def step(s: Column, _: Column) -> Column:
                return let(F.array_min(s), lambda m: F.when(m < (none << shift), let(F.array_position(s, m).cast("int"), lambda k: merge(s, m, k))).otherwise(s))

            def run(pieces: Column) -> Column:
                costs = F.zip_with(pieces, F.slice(pieces, 2, rest), cost)
                placed = F.transform(pieces, lambda p, i: F.shiftleft(i.cast("bigint"), ID_BITS).bitwiseOR(p))
                start = F.zip_with(placed, costs, lambda p, c: p.bitwiseOR(F.shiftleft(c, shift)))
                folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), start, step)
                return F.transform(folded, lambda x: x.bitwiseAND(ids).cast("int"))

            characters = F.split(F.decode(F.encode(word, "UTF-8"), LATIN), "")
            return let(F.transform(characters, lambda c: F.get(maps["bytes"], F.ascii(c))), run)

        return let(maps, bound)


def encode_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word."""
    whole = ranks.get(word)
    return merge_heap(word, ranks) if whole is None else [whole]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids that the merges lead to, by a heap of pairs: time in proportion to n log n."""
    n = len(word)
    stop = list(range(1, n + 1))  # where the piece that starts here ends; 0 for a start that is gone
    back = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if stop[a] != b or b >= n or stop[b] != end:
            continue
        stop[a], stop[b] = end, 0
        if end < n:
            back[end] = a
            if (r := ranks.get(word[a : stop[end]])) is not None:
                heapq.heappush(heap, (r, a, end, stop[end]))
        if (c := back[a]) >= 0 and (r := ranks.get(word[c:end])) is not None:
            heapq.heappush(heap, (r, c, a, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : stop[at]]])
        at = stop[at]
    return ids


def gathered(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of values, one after the other; run k is values[starts[k] : starts[k] + lengths[k]]."""
    n = lengths[which]
    ends = np.cumsum(n, dtype=np.int64)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - ends + n, n)
    return values[places]


def packed(strings: pa.Array) -> bytes:
    """Strings as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([strings], names=["w"]))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


WORDS = "bucket int, block long, n_words long, words binary"


def _blocks(folder: str, n_buckets: int, pattern: str):
    """Step 1: a block's documents go to a row group of the task's file, its distinct words out by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary())])
    stored = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])

    def closed(held: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]], block: int) -> tuple[pa.Table, pa.RecordBatch]:
        words = pa.chunked_array([h[1] for h in held]).unify_dictionaries().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        bucket = np.array([zlib.crc32(w.encode()) % n_buckets for w in words.dictionary.to_pylist()], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        # Documents hold a word's rank by frequency, which takes fewest bytes; the first row tells of the ranks' places.
        indices = words.indices.to_numpy()
        by_count = np.argsort(-np.bincount(indices, minlength=len(order)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[by_count] = np.arange(len(order), dtype=np.int32)
        lengths, n = np.concatenate([h[2] for h in held]), sum(len(h[2]) for h in held)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(rank[indices], pa.int32()))
        first = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(n + 1), 1).astype(np.int32) * len(order)), pa.array(place[by_count], pa.int32()))
        table = pa.Table.from_arrays([pa.chunked_array([h[0] for h in held]), lists, first], schema=stored)
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        listed = words.dictionary.take(pa.array(order))
        rows = [(k, block, int(edges[k + 1] - edges[k]), packed(listed.slice(edges[k], edges[k + 1] - edges[k]))) for k in np.flatnonzero(np.diff(edges)).tolist()]
        # A block without words is told of by an empty list.
        rows = rows or [(0, block, 0, packed(pa.array([], pa.string())))]
        return table, pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        fs, root = filesystem(folder)
        task, splitter = TaskContext.get().taskAttemptId(), regex.compile(pattern)
        writer, held, n_held, n_blocks = None, [], 0, 0

        def flush():
            nonlocal writer, held, n_held, n_blocks
            table, rows = closed(held, task << 24 | n_blocks)
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = pq.ParquetWriter(f"{root}/{task}.parquet", stored, filesystem=fs, compression="zstd", compression_level=5, use_dictionary=False, column_encoding={"words.list.element": "BYTE_STREAM_SPLIT"})
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            held, n_held, n_blocks = [], 0, n_blocks + 1
            return rows

        for batch in batches:
            if not batch.num_rows:
                continue
            odd = batch.column("odd").to_pylist()
            if any(t is not None for t in odd):
                words = pa.array([w if t is None else splitter.findall(t) for t, w in zip(odd, batch.column("words").to_pylist())], pa.list_(pa.string()))
            else:
                words = batch.column("words")
            lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # Neither is a part of the batch's memory, so the batch is let go of.
            held.append((batch.column("doc_id").take(pa.array(np.arange(batch.num_rows))), words.flatten().dictionary_encode(), lengths))
            n_held += int(lengths.sum())
            if n_held >= BLOCK_WORDS:
                yield flush()
        if held:
            yield flush()
        if writer is not None:
            writer.close()

    return run


POOLED = "task int, at long, bucket int, block long, word string, known array<int>, places binary"


def _place_type(n_words: int) -> str:
    """The type of a word's place among so many."""
    return "<u2" if n_words <= 1 << 16 else "<u4"


def _distinct(path: str):
    """Step 2: the distinct words of a task's lists, then, for each list, the places of its words among them; numbered by ``at``."""
    schema = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("bucket", pa.int32()), ("block", pa.int64()), ("word", pa.string()), ("known", pa.list_(pa.int32())), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks, rows = TaskContext.get().partitionId(), load_ranks(path), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "n_words")]
            rows += [(k, b, n, unpacked(w)) for k, b, n, w in zip(*columns, batch.column("words").to_pylist())]
        if not rows:
            return
        words = pa.chunked_array([r[3].dictionary_encode() for r in rows]).unify_dictionaries().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        for k in range(0, len(words.dictionary), 8192):
            some = words.dictionary.slice(k, 8192)
            whole = []
            for w in some.to_pylist():
                raw = w.encode()
                r = ranks.get(raw)
                whole.append([r] if r is not None else merge_heap(raw, ranks) if len(raw) > LONG_WORD else None)
            known = pa.array(whole, type=pa.list_(pa.int32()))
            # Words whose ids are known need not reach the fold.
            left = pa.array([w if x is None else None for w, x in zip(some.to_pylist(), whole)], pa.string())
            n = len(some)
            numbers = pa.array(np.arange(k, k + n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), numbers, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), left, known, pa.nulls(n, pa.binary())], schema=schema)
        places, at, n_words = words.indices.to_numpy(), 0, len(words.dictionary)
        for k, (bucket, block, n, _) in enumerate(rows):
            data = places[at : at + n].astype(_place_type(n_words)).tobytes()
            at += n
            own = [pa.array([task], pa.int32()), pa.array([n_words + k]), pa.array([bucket], pa.int32()), pa.array([block])]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.array([data])], schema=schema)

    return run


PACKS = "block long, bucket int, lengths binary, ids binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, after the fold: the ids of each list's words, one after the other."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())])
    lengths, values, table = [], [], None
    for batch in batches:
        of_words = batch.filter(batch.column("block").is_null())
        if of_words.num_rows:
            lengths.append(of_words.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            values.append(of_words.column("ids").flatten().to_numpy())
        of_lists = batch.filter(batch.column("block").is_valid())
        if of_lists.num_rows and table is None:
            n = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
            table = np.cumsum(n) - n, n, np.concatenate(values) if values else np.empty(0, np.int32)
        for bucket, block, places in zip(*(of_lists.column(c).to_pylist() for c in ("bucket", "block", "places"))):
            which = np.frombuffer(places, _place_type(len(table[1])))
            ids = gathered(*table, which)
            packs = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in (table[1][which], ids)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([packs[0]]), pa.array([packs[1]])], schema=schema)


ENCODED = "doc_id long, ids array<int>"


def _assembled(folder: str):
    """Step 3: a block's documents from its words' ids; rows come sorted by block and bucket."""

    def documents(block: int, packs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        n = np.concatenate([np.frombuffer(zlib.decompress(p[0]), "<u4") for p in packs]).astype(np.int32)
        values = np.concatenate([np.frombuffer(zlib.decompress(p[1]), "<u4") for p in packs]).astype(np.int32)
        starts = np.cumsum(n, dtype=np.int64) - n
        stored = pq.ParquetFile(f"{root}/{block >> 24}.parquet", filesystem=fs).read_row_group(block & (1 << 24) - 1)
        places = stored.column("places").chunk(0).flatten().to_numpy()
        n, starts = n[places], starts[places]  # by rank
        doc_ids, lists = stored.column("doc_id").combine_chunks(), stored.column("words").chunks
        which = np.concatenate([c.flatten().to_numpy() for c in lists])
        stops = np.concatenate([[0], np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in lists]), dtype=np.int64)])
        k = 0
        while k < len(doc_ids):
            stop = max(k + 1, int(np.searchsorted(stops, stops[k] + SLICE_WORDS, side="right")) - 1)
            some = which[stops[k] : stops[stop]]
            ends = np.concatenate([[0], np.cumsum(n[some], dtype=np.int64)])[stops[k : stop + 1] - stops[k]]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gathered(starts, n, values, some), pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids.slice(k, stop - k), ids], names=["doc_id", "ids"])
            k = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if (at := batch.column("block")[i].as_py()) != block:
                    if packs:
                        yield from documents(block, packs)
                    block, packs = at, []
                packs.append((batch.column("lengths")[i].as_py(), batch.column("ids")[i].as_py()))
        if packs:
            yield from documents(block, packs)

    return run


def _prepared(docs: DataFrame, path: str, pattern: str) -> tuple[DataFrame, str]:
    """The ids of the blocks' words, sorted by block, and the folder of the blocks."""
    spark = docs.sparkSession
    folder, n_buckets = new_folder(spark, "bpe-blocks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of()
    unknown = text.rlike(r"\p{Cn}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(unknown, text).alias("odd"), F.when(unknown, F.array().cast("array<string>")).otherwise(words_of(text, pattern)).alias("words"))
    with batch_rows(spark, BATCH):
        lists = written(texts.mapInArrow(released(_blocks(folder, n_buckets, pattern)), WORDS), "bpe-words", listed := new_folder(spark, "bpe-words"))
    pooled = lists.repartitionById(n_buckets, F.col("bucket")).mapInArrow(released(_distinct(path)), POOLED)
    # Dealt out anew, each task's rows to one other: two Python functions in a stage would be two workers a core, which stay in every executor.
    pooled = pooled.repartitionById(n_buckets, F.col("task")).sortWithinPartitions("task", "at")
    ranks = RankMap(spark, load_ranks(path))
    ids = F.coalesce("known", F.when(F.col("word").isNotNull(), ranks.fold(F.col("word"), F.col("maps"))))
    folded = pooled.withColumn("maps", ranks.row.scalar()).select("bucket", "block", ids.alias("ids"), "places")
    packs = written(folded.mapInArrow(released(_packs), PACKS), "bpe-packs")
    delete(spark, listed)  # the packs are all that is read of it
    return packs.repartition("block").sortWithinPartitions("block", "bucket"), folder


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""
    packs, folder = _prepared(docs, path, pattern)
    return packs.mapInArrow(released(_assembled(folder)), ENCODED)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the ids' bytes in one array."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(by_id), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids: each id's piece, concatenated."""
    return gathered(*_pieces(path), ids).tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [decode_ids(np.array(x, np.int64), path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values, stops = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
            hashes = [], []
            for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
                hashes[0].append(hashlib.sha256(values[a:b].astype("<u4").tobytes()).hexdigest())
                hashes[1].append(hashlib.sha256(decode_ids(values[a:b], path)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(h, pa.string()) for h in hashes)], schema=schema)

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text), the text decoded from the ids of encode()."""
    packs, folder = _prepared(docs, path, pattern)
    assembled, digested = _assembled(folder), _digested(path)
    return packs.mapInArrow(released(lambda batches: digested(assembled(batches))), DIGESTS)


def digests_of_text(texts: list[str | None], path: str, pattern: str) -> list[tuple[int, str, str]]:
    """What digests() returns, by the heap: for tests."""
    import regex

    out = []
    for text in texts:
        words = regex.findall(pattern, text or "")
        ids = [i for w in words for i in encode_heap(w.encode(), load_ranks(path))]
        out.append((len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out
