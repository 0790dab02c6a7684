"""Token ids in fixed-width, bit-packed files.

File format (little-endian): the magic ``GLBP0001``; blocks of ``BLOCK`` ids (the last may be
shorter), each id in the least bits that hold the vocabulary, a block padded to whole bytes; the
documents' ids (int64) and lengths (int64); the blocks' byte offsets (uint64, one more than
blocks); a footer of six int64: bits, ids, documents, blocks, whether ids may be null (then a
null doc_id is stored as the least int64), the place of the documents' table. Since all blocks but the last
hold the same number of ids, any span of ids is read by seeking to its blocks, and a block is
unpacked by numpy without a loop over ids.

Defined results: a null text is empty; an empty text holds the end id alone; documents are written
in ascending doc_id order (nulls first; rows that share an id are ordered by text); an empty table writes no file and reads back
no row; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, filesystem, new_folder, sliced, written

MAGIC = b"GLBP0001"
BLOCK = 1 << 16
NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, n_ids long, n_docs long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Distinct words in a generation of a worker's cache; two generations are kept.
CACHE_WORDS = 800_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class PackedWriter:
    """Writes documents one after the other; holds one block of ids and the documents' lengths."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets = [self.at]
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, stop, BLOCK):
            data = pack(ids[k : min(k + BLOCK, stop)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held = [ids[stop:]]
        self.n_held = len(ids) - stop

    def close(self) -> None:
        self._blocks(True)
        self.out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([self.bits, self.n_ids, len(self.doc_ids), len(self.offsets) - 1, 1, self.at], "<i8").tobytes())
        self.out.close()


class PackedReader:
    """Random access to a packed file opened as a seekable pyarrow file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 48)
        self.bits, self.n_ids, self.n_docs, n_blocks, _, table = np.frombuffer(source.read(48), "<i8").tolist()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a packed file")
        source.seek(table)
        self.doc_ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.lengths = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8")

    def block(self, k: int) -> np.ndarray:
        first, stop = int(self.offsets[k]), int(self.offsets[k + 1])
        self.source.seek(first)
        return unpack(self.source.read(stop - first), min(BLOCK, self.n_ids - k * BLOCK), self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start on."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * BLOCK :][:n]

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document's place, some of its ids, whether they are the last) in order, a block in memory."""
        doc, left = 0, int(self.lengths[0]) if self.n_docs else 0
        for k in range(len(self.offsets) - 1):
            block, at = self.block(k), 0
            while True:
                take = min(left, len(block) - at)
                left -= take
                yield doc, block[at : at + take], left == 0
                at += take
                if left:
                    break
                doc += 1
                if doc == self.n_docs:
                    return
                left = int(self.lengths[doc])
                if at == len(block) and left:
                    break


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word of Latin letters and the ASCII marks after it: the splitter parts them, and neither composes with the other.
_MARKED_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


class WordEncoder:
    """Whole texts to ids with the tokenizers library, each distinct word encoded once.

    Only blanks and line ends split a text here. The vocabulary's normaliser turns white space into
    blanks and its splitter drops them, so words on either side never share a token and the ids of a
    text are those of its words one after the other. A word of Latin letters, in lower case as the
    normaliser would have it, is one unit to the splitter and its last token alone carries the mark
    of a word's end; so such words are encoded many in a string and told apart by that mark.
    """

    def __init__(self, path: str, end_id: int | None):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = b"" if end_id is None else array("I", [end_id]).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {"": b""}, self.known
        get, rows, gaps, missing = self.known.get, [], [], set()
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            row = list(map(get, words))
            gap = [(k, words[k]) for k, found in enumerate(row) if found is None]
            missing.update([w for _, w in gap])
            rows.append(row)
            gaps.append(gap)
        self._learn(missing)
        known = self.known
        for row, gap in zip(rows, gaps):
            for k, word in gap:
                row[k] = known[word]
            row.append(self.end)
        return [np.frombuffer(b"".join(row), "<u4") for row in rows]

    def _learn(self, missing: set[str]) -> None:
        """Puts the words into the cache, from its older generation or encoded."""
        known, older = self.known, self.older
        if older:
            again = [w for w in missing if w in older]
            known.update(zip(again, map(older.__getitem__, again)))
            missing.difference_update(again)
        match, parts, odd = _MARKED_WORD.fullmatch, [], []
        plain = [w for w in missing if w.isascii() and w.isalpha() and w.islower()]
        for w in missing.difference(plain):
            if m := match(w):
                parts.append((w, m[1].lower(), m[2]))
            else:
                odd.append(w)
        self._encode_words(list({stem for _, stem, _ in parts if stem not in known}.union(plain)))
        self._encode(list({tail for _, _, tail in parts if tail not in known}))
        self._encode(odd)
        for word, stem, tail in parts:
            known[word] = known[stem] + known[tail]

    def _encode(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            self.known.update(zip(some, (array("I", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))

    def _encode_words(self, words: list[str]) -> None:
        """Words of Latin letters, many at once."""
        for k in range(0, len(words), 1024):
            some = words[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(stops) != len(some):
                self._encode(some)
                continue
            data = ids.tobytes()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *stops], stops))))


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int | None) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return WordEncoder(path, end_id)


def _write(folder: str, bits: int, make_encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]]):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(1_000_000)  # the cache's strings are no garbage
        task = TaskContext.get()
        fs, root = filesystem(folder)
        part, writer, encode = task.partitionId(), None, None
        path = f"{root}/{part:06d}-{task.taskAttemptId()}.bits"
        for batch in sliced(batches, "text", 500, 1 << 23):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer, encode = PackedWriter(fs.open_output_stream(path), bits), make_encoder()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_ids": [writer.n_ids], "n_docs": [len(writer.doc_ids)]}, schema=schema)

    return run


@batches_of(500)
def write_packed(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int | None, folder: str | None = None) -> DataFrame:
    """Encode (doc_id, text) and write packed files; the manifest (part, path, n_ids, n_docs) in doc_id order.

    Texts are dealt out by range of doc_id and sorted, so a file holds a run of documents and files
    follow each other by part. Names hold the attempt; only files in the manifest are read.
    """
    spark = docs.sparkSession
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write = _write(folder or new_folder(spark, "packed"), bits_for(vocabulary), lambda: _encoder(tokenizer_path, end_id))
    return written(placed.mapInArrow(write, MANIFEST), "packed-manifest")


def _read(folder_scheme: str):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder_scheme)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(path) as source:
                    reader = PackedReader(source)
                    crcs, crc = [], 0
                    for _, ids, last in reader.pieces():
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        if last:
                            crcs.append(crc)
                            crc = 0
                    crcs += [0] * (reader.n_docs - len(crcs))
                    starts = base + np.concatenate([[0], np.cumsum(reader.lengths)[:-1]])
                    ids = pa.array(reader.doc_ids, mask=reader.doc_ids == NULL_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts.astype(np.int64)), pa.array(reader.lengths), pa.array(crcs, type=pa.int64())], schema=schema)

    return run


def read_packed(manifest: DataFrame) -> DataFrame:
    """Per document its start, length and the ids' crc32, from the files; a task for each few files.

    The starts of files are summed over the manifest, which has a row for each file.
    """
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.cast("long").alias("base")).coalesce(1).repartition(max(1, manifest.count()))
    return files.mapInArrow(_read(new_folder(manifest.sparkSession, "x")), DOCS)
