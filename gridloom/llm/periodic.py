"""Periodic runs of words: every maximal stretch that repeats itself, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least ``max(least, times * q)`` words, that no neighbouring word extends. All runs of a text are found
on a harmonic grid: a run of period p holds two grid points jp and (j+1)p, so for each p the longest
common extensions of these points forward and backward give every stretch of period p. An extension
forward is a range minimum over the common prefixes of neighbours in the suffix array, one backward
the same on the reversed words. A stretch of period p and at least two periods whose smallest period
is q has the same ends as q's own run, so of equal stretches the least period is the run's.

Grid points are first compared by a hash of WINDOW words: the first grid point in a run of at least
24 words and three periods matches over more than that, so only pairs that differ for certain are left
out. Texts in which no grid pair passes need no suffix array; others have theirs made together, a
batch at a time, with a word of its own after each text so that nothing extends across texts.

Everything is within rows: no shuffle, and a hot source, a large group of copies or a common passage
costs what its texts cost. Time is n log n operations of numpy for a text of n words, memory some 40
numbers a word of a batch; a batch is at most ``common.sliced``'s bytes or one text.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, compared exactly; a null, empty or wordless text has
no words, no run and collapses to the empty text; rows are taken one by one, so null and repeated
doc_ids and repeated texts have their own results; an empty table gives no rows; other columns,
whatever their names, are ignored by ``runs`` and ``digests`` and kept by ``collapsed``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import released, sliced, text_of

#: The least words of a run, and the least periods.
LEAST, TIMES = 24, 3
#: Words that grid points must share to be looked at; any run of LEAST words and TIMES periods has more.
WINDOW = 8
#: Grid pairs compared at once, and words whose suffix array is made at once (or one text).
PAIRS, WORDS = 1 << 21, 1 << 18
#: Values in a block of a range minimum.
BLOCK = 16

U = np.uint64
_MIX = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


class RangeMinimum:
    """Minima of ranges of an array: within blocks by running minima, over blocks by a sparse table."""

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // BLOCK)
        padded = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        blocks = padded.reshape(n, BLOCK)
        self.values = padded
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 ** len(self.table) <= n:
            half, last = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low..high], both ends within; low <= high."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.after[low], self.before[high])
        one = np.flatnonzero(first == last)
        if len(one):
            a, b = low[one], high[one]
            found = self.values[a]
            for k in range(1, BLOCK):
                found = np.minimum(found, self.values[np.minimum(a + k, b)])
            out[one] = found
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide] - 1
            level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                row = self.table[k]
                out[wide[at]] = np.minimum(out[wide[at]], np.minimum(row[a[at]], row[b[at] - 2**k + 1]))
        return out


class Extensions:
    """Longest common extensions of places of a sequence whose texts each end in a symbol of its own."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        levels = _ranked(ids)
        self.rank = levels[-1][: self.n]
        order = np.empty(self.n, np.int32)
        order[self.rank] = np.arange(self.n, dtype=np.int32)
        common, a, b = np.zeros(self.n, np.int32), order[:-1].copy(), order[1:].copy()
        # A level's ranks are equal where 2^level symbols are.
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        common[1:] = b - order[1:]
        self.least = RangeMinimum(common)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree; i and j differ and may be just past the end."""
        inside = (i < self.n) & (j < self.n)
        r, s = self.rank[np.where(inside, i, 0)].astype(np.int64), self.rank[np.where(inside, j, 0)].astype(np.int64)
        low, high = np.minimum(r, s) + 1, np.maximum(r, s)
        return np.where(inside, self.least(np.minimum(low, high), high), 0)


def _ranked(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... symbols, until all differ; -1 stands behind the end.

    A rank is the number of suffixes that are less, so ranks that are alone are final, and each round
    sorts only the others.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.concatenate([[True], np.diff(ids[order]) != 0])
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.concatenate([fresh[1:], [True]])
    open_, levels, k = order[~alone], [rank], 1
    while len(open_):
        # A suffix that still has an equal ends behind the next k symbols, as every text's end is its own.
        key = (rank[open_].astype(np.int64) << 32) | (rank[open_ + k].astype(np.int64) + 1)
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        at = np.arange(len(key))
        fresh = np.concatenate([[True], np.diff(key) != 0])
        group = np.concatenate([[True], np.diff(key >> 32) != 0])
        rank = rank.copy()
        rank[open_] += (np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))).astype(np.int32)
        levels.append(rank)
        open_ = open_[~(fresh & np.concatenate([fresh[1:], [True]]))]
        k *= 2
    return levels


def _windows(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW symbols from each place on; shorter by WINDOW - 1."""
    h, span = ids.astype(np.uint64), 1
    while span < WINDOW:
        h = h[:-span] * _MIX[0] + (h[span:] ^ (h[span:] >> U(29))) * _MIX[1]
        span *= 2
    return h


def _grid(h: np.ndarray, n: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the pairs jp, (j+1)p of a text of n words whose windows agree."""
    places, periods, p = [], [], 1
    while p <= min(n // times, n - WINDOW):
        # As many periods at once as make PAIRS pairs.
        stop = min(n // times, n - WINDOW, p + max(1, PAIRS * p // n)) + 1
        some = np.arange(p, stop)
        count = (n - WINDOW - some) // some + 1
        begin = np.concatenate([[0], np.cumsum(count)])
        period = np.repeat(some, count)
        place = (np.arange(begin[-1]) - np.repeat(begin[:-1], count)) * period
        same = np.flatnonzero(h[place] == h[place + period])
        places.append(place[same])
        periods.append(period[same])
        p = stop
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.empty(0, np.int64),) * 2


NO_RUNS = (np.empty(0, np.int64),) * 3


def find_runs(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, periods) of the runs of each list of words, by start, then period.

    least must be at least LEAST and times at least TIMES, for which the windows are made.
    """
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs have at least {LEAST} words and {TIMES} periods")
    out, known = [NO_RUNS] * len(texts), {}
    long = [k for k, words in enumerate(texts) if len(words) >= least]
    if not long:
        return out
    # Each text's words as numbers, and after them a number of its own.
    flat, starts = [], []
    for k in long:
        starts.append(len(flat))
        flat += [known.setdefault(w, len(known)) for w in texts[k]]
        flat.append(-1 - k)
    ids = np.array(flat, np.int64)
    ends = ids < 0
    ids[ends] = len(known) + np.arange(np.count_nonzero(ends))
    h = _windows(ids)
    # A text none of whose windows comes twice has no run.
    of = np.repeat(np.arange(len(long)), np.diff([*starts, len(ids)]))[: len(h)]
    order = np.argsort(h, kind="stable")
    twice = np.flatnonzero((np.diff(h[order].view(np.int64)) == 0) & (np.diff(of[order]) == 0))
    waiting, size = [], 0
    for t in np.unique(of[order[twice]]).tolist():
        k, a = long[t], starts[t]
        n = len(texts[k])
        place, period = _grid(h[a : a + n - WINDOW + 1], n, times)
        if len(place):
            waiting.append((k, ids[a : a + n + 1], place, period))
            size += n + 1
        if size >= WORDS:
            _extend(waiting, out, least, times)
            waiting, size = [], 0
    if waiting:
        _extend(waiting, out, least, times)
    return out


def _extend(waiting: list[tuple], out: list[tuple], least: int, times: int) -> None:
    """The runs at the grid pairs of some texts, into out."""
    ids = np.concatenate([w[1] for w in waiting])
    forward, backward, n = Extensions(ids), Extensions(ids[::-1]), len(ids)
    bounds = np.concatenate([[0], np.cumsum([len(w[1]) for w in waiting])])
    found = []
    for t, (_, _, place, period) in enumerate(waiting):
        for s in range(0, len(place), PAIRS):
            a, p = place[s : s + PAIRS] + bounds[t], period[s : s + PAIRS]
            b = a + p
            start = a - backward(n - a, n - b)
            length = b + forward(a, b) - start
            good = np.flatnonzero(length >= np.maximum(least, times * p))
            found.append((start[good], length[good], p[good], np.full(len(good), t)))
    i, lengths, p, text = (np.concatenate([f[k] for f in found]) for k in range(4))
    # Of the same stretch the least period.
    order = np.lexsort((p, lengths, i))
    i, lengths, p, text = i[order], lengths[order], p[order], text[order]
    first = np.concatenate([[True], (np.diff(i) != 0) | (np.diff(lengths) != 0)])[: len(i)]
    i, lengths, p, text = i[first], lengths[first], p[first], text[first]
    order = np.lexsort((p, i))
    i, lengths, p, text = i[order], lengths[order], p[order], text[order]
    for t, w in enumerate(waiting):
        a, b = np.searchsorted(text, [t, t + 1])
        if b > a:
            out[w[0]] = (i[a:b] - bounds[t], lengths[a:b], p[a:b])


def kept_words(n: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n words stay: not those that a run contains after its first period."""
    starts, lengths, periods = runs
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts + periods, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) == 0


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; bytes.split() parts at exactly these blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail of some made periodic, by the crc32 of the doc_id; a null one changes nothing."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * -(-(n - a) // len(piece)))[: n - a]


Change = Callable[[list[bytes], int | None], list[bytes]]


def _texts(batches: Iterator[pa.RecordBatch], change: Change | None, least: int, times: int) -> Iterator[tuple]:
    """(batch, words of its texts, runs of its texts)."""
    for batch in sliced(batches, "text"):
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        if change:
            words = [change(w, i) for w, i in zip(words, batch.column("doc_id").to_pylist())]
        yield batch, words, find_runs(words, least, times)


RUNS = "doc_id long, start long, length long, period long"
_RUNS = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Change | None = None) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each text of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _texts(batches, change, least, times):
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([f[k] for f in found] or [NO_RUNS[0]]), pa.int64()) for k in range(3))], schema=_RUNS)

    return _keyed(docs).mapInArrow(released(run), RUNS)


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs, all columns, with each text's repeats left out where it has runs; other texts stay as they are, null too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, found in _texts(batches, None, least, times):
            texts = batch.column("text").to_pylist()
            for k, f in enumerate(found):
                if len(f[0]):
                    texts[k] = b" ".join(w for w, stays in zip(words[k], kept_words(len(words[k]), f)) if stays).decode("utf-8", "surrogatepass")
            at = batch.schema.names.index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(released(run), docs.schema)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_DIGESTS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def digests(docs: DataFrame, change: Change | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of docs.

    The one run shown is that of the greatest length / period (of the smallest start, then period);
    without runs its four columns are null. As doubles two such quotients are equal only if they are
    equal exactly, for texts of fewer than 2^26 words.
    """
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, found in _texts(batches, change, least, times):
            rows = []
            for bag, (starts, lengths, periods) in zip(words, found):
                if not len(starts):
                    rows.append((0, None, None, None, None, sha(b""), sha(b" ".join(bag))))
                    continue
                best = np.lexsort((periods, starts, -(lengths / periods)))[0]
                start, length, period = int(starts[best]), int(lengths[best]), int(periods[best])
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(starts.tolist(), lengths.tolist(), periods.tolist()))
                kept = kept_words(len(bag), (starts, lengths, periods))
                rows.append((len(starts), start, length, period, 1000 * length // period, sha(lines.encode()), sha(b" ".join(w for w, stays in zip(bag, kept) if stays))))
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, list(_DIGESTS)[1:]))], schema=_DIGESTS)

    return _keyed(docs).mapInArrow(released(run), DIGESTS)
