"""Tokenizers that work on Arrow batches in Python workers, made once a worker and cut while they count."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodes texts: for each an iterable of ids, of which no more are taken than are wanted.
Encode = Callable[[list[str]], Iterable[Iterable[int]]]
TOKENIZED = "struct<ids: array<bigint>, p: int>"
_TOKENIZED = pa.struct([("ids", pa.list_(pa.int64())), ("p", pa.int32())])
#: Texts encoded at once.
BATCH = 256

_made: dict[str, Encode] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer by the function that makes it, which runs once in each Python worker.

    ``key`` names it in the worker's cache, so tokenizers that differ must have keys that differ; ``make`` must
    be importable or self-contained, as it is sent to the workers in place of what it makes. Calling it with
    columns (full, before) and the longest example gives a struct of the full text's ids, cut at longest, and
    the number of the prompt's tokens, counted up to longest. A null text has no ids.
    """

    key: str
    make: Callable[[], Encode] = field(repr=False)

    def encode(self) -> Encode:
        if self.key not in _made:
            _made[self.key] = self.make()
        return _made[self.key]

    def __call__(self, full: Column, before: Column, longest: int) -> Column:
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            encode = self.encode()
            for whole, prompt in batches:
                offsets, ids, counts = [0], [], []
                for k in range(0, len(whole), BATCH):
                    texts, prompts = ([t or "" for t in a.slice(k, BATCH).to_pylist()] for a in (whole, prompt))
                    for found, head in zip(encode(texts), encode(prompts), strict=True):
                        one = np.fromiter(islice(found, longest), np.int64)
                        ids.append(one)
                        offsets.append(offsets[-1] + len(one))
                        counts.append(sum(1 for _ in islice(head, longest)))
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.StructArray.from_arrays([lists, pa.array(counts, pa.int32())], fields=list(_TOKENIZED))

        # Spark tells the kind of an Arrow function by its annotations, which must be types and not texts.
        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, TOKENIZED)(full, before)


_WORD = re.compile(r"[^\t\n\x0B\f\r ]+")


def _words() -> Encode:
    known: dict[str, int] = {}

    def id_of(word: str) -> int:
        if word not in known:
            if len(known) > 1 << 20:
                known.clear()
            known[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:6], 16)
        return known[word]

    return lambda texts: ((id_of(m[0]) for m in _WORD.finditer(text)) for text in texts)


#: The stand-in of chat.word_ids: an id for each word, from its MD5.
WORDS = Tokenizer("words", _words)


@dataclass(frozen=True)
class _FromFile:
    path: str

    def __call__(self) -> Encode:
        from tokenizers import Tokenizer as Library

        library = Library.from_file(self.path)
        return lambda texts: (e.ids for e in library.encode_batch(texts, add_special_tokens=False))


def from_file(path: str) -> Tokenizer:
    """A model's own tokenizer, of a file that the tokenizers library reads and that all workers can open."""
    return Tokenizer(f"file:{path}", _FromFile(path))
