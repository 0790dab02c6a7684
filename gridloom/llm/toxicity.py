"""Toxicity by a support vector machine on a subsequence string kernel, trained on labelled sentences.

Two strings are as similar as the gapped subsequences of four characters that they share, each
occurrence weighted by DECAY to the power of its span, spans up to SPAN (so up to two characters may
be inserted); ends and the blank between two words count as characters and a run of three or more of
a character as two. Strings are divided by the norm of their occurrences' weights. Subsequences are
hashed, so a string is a sparse vector and the kernel its dot product. Nyström landmarks are words of
the labelled sentences; a linear support vector machine (squared hinge) is trained in the space
K^-1/2 k(string, landmarks). The machine is linear in the kernel, so landmarks and weights fold into
one table of weights by subsequence, and scoring a string is a sum over its own subsequences.

A document's label is that of its worst sentence, and a sentence is judged by its worst part: a word,
or two words next to each other. Which part of which sentence makes a document toxic is found in
rounds (multiple instances): parts that toxic documents hold, more often than by chance, and next to
no clean ones, stand for toxicity and never against it; in a document without one its best-scoring
part does; and in each round a clean document's best-scoring parts stand against it. Parts sure to be
toxic also teach changed: with one character inserted at each inner place, with two at some, and with
one left out. An ordinary part weighs as often as clean documents hold it. Of two words that are ordinary one by
one, the pair is sure if it passes that test and neither word does; only pairs both of whose words are
like those of a sure pair are scored, as no others share subsequences across the blank with it and
both words' own. Labelled documents with the same three least word hashes and label (copies and most
near copies) teach once, as their chance words would look sure.

A sentence scores as its best part, a document as its best sentence, by a logistic fit: clean training
documents by their best part, each at REJECTED times the cost of a missed one, against the toxic
documents in which a part stands for toxicity and the changed parts (a toxic document in which nothing
does says nothing of how near a changed insult is to one). Words are runs of letters in lower case, marks and digits within them left out,
and runs of single letters parted by blanks joined into one.

Trained on at most ``most`` labelled rows of each class (by hash of doc_id), from documents of the
given table; every document is scored on its whole text. Labels, language, source and doc_id are
never inputs of a score; doc_id only decides which rows teach.

Defined results: null or empty text scores as no word at all (the fit's value for it); a null doc_id
is scored and never teaches; repeated rows score alike; without labels of both classes every score
is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_rows, hand_back, released, sliced, text_of

DECAY, SPAN = 0.7, 6
BINS = 1 << 21
#: Labelled rows of a class that teach; landmarks of either kind; rounds of choosing witnesses.
MOST_LABELLED, LANDMARKS, ROUNDS = 4000, 256, 4
#: A word is surely toxic if chance would put it so often into toxic documents once in ten to this power at most,
#: and its share of clean documents, as its count of them, is at most NOISE times that of toxic ones.
SURE, NOISE = 8, 0.1
THRESHOLD = 0.7
#: How many missed parts a clean document that is rejected is worth in the fit.
REJECTED = 12.0
#: The weight of an example with changed characters, how many are inserted at each place, and which.
VIRTUAL, VARIED, LETTERS = 1.0, 3, "abcdefghijklmnopqrstuvwxyz"
#: Words that a task keeps scored, words scored at once, words mapped at once and rows of the table multiplied at once: all bound a worker's memory.
CACHE_WORDS, LOT, MAPPED, ROWS = 200_000, 500, 100, 4096
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_GAPS = [(a, b, c) for a in range(1, SPAN) for b in range(1, SPAN) for c in range(1, SPAN) if a + b + c < SPAN]
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_SPACED = re.compile(r"(?<!\S)\S(?: \S(?!\S)){3,}")
_RUN = re.compile(r"(.)\1{2,}", re.S)
_MARK = re.compile(r"[^\w\s]|[\d_]")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case and without marks and digits."""
    low = _MARK.sub("", text.lower())
    words = low.split()
    return words + [run.replace(" ", "") for run in _SPACED.findall(low)]


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence."""
    return [words for part in _SENTENCE.split(text) if (words := words_of(part))]


def pairs_of(sentences: list[list[str]]) -> set[str]:
    """Two words next to each other in a sentence, with a blank between."""
    return {f"{a} {b}" for words in sentences for a, b in zip(words, words[1:])}


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, bin, weight) of every gapped subsequence, weights divided by the word's norm."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    words = [_RUN.sub(r"\1\1", w) for w in words]
    codes = np.frombuffer("".join("\x02" + w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    mixed = [codes * k for k in _K]
    mixed = [m ^ (m >> np.uint32(15)) for m in mixed]
    places, bins, weights = [], [], []
    for gaps in _GAPS:
        span = sum(gaps)
        n = len(codes) - span
        if n <= 0:
            continue
        same = np.flatnonzero(owner[:n] == owner[span:])
        h = mixed[0][same]
        for m, at, factor in zip(mixed[1:], np.cumsum(gaps).tolist(), (31, 1009, 65599)):
            h = h + m[same + at] * np.uint32(factor)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x5BD1E995)
        places.append(owner[same])
        bins.append(((h ^ (h >> np.uint32(15))) % np.uint32(BINS)).astype(np.int64))
        weights.append(np.full(len(same), DECAY ** (span + 1)))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    places, bins, weights = (np.concatenate(x) for x in (places, bins, weights))
    norms = np.sqrt(np.bincount(places, weights * weights, len(words)))
    return places, bins, weights / norms[places]


#: The kernel's least value between a word and a sure pair's word, at which a pair is scored.
LIKE = 0.35


@dataclass
class Model:
    """weights by subsequence, the machine's offset, the logistic fit (slope, offset) and the first and second words of sure pairs."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    firsts: tuple[str, ...] = ()
    seconds: tuple[str, ...] = ()

    def like(self, words: list[str], of: tuple[str, ...]) -> np.ndarray:
        """Whether each word is like one of these."""
        places, bins, weights = subsequences(words)
        best = np.zeros(len(words))
        for known in of:
            _, b, w = subsequences([known])
            table = np.zeros(BINS, np.float32)
            np.add.at(table, b, w)
            best = np.maximum(best, np.bincount(places, table[bins] * weights, len(words)))
        return best >= LIKE

    def words(self, words: list[str]) -> np.ndarray:
        places, bins, weights = subsequences(words)
        return np.bincount(places, self.weights[bins] * weights, len(words)) + self.bias

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -60, 60)))


RIDGE = 0.3
#: A document without words scores as its best word would at this value of the machine.
NO_WORD = -2.0


def _machine(rows: Callable[[int, int], np.ndarray], y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps over the active of the rows, of which rows(a, b) makes some: weights (the last is the offset) and the offset."""
    n = rows(0, 1).shape[1] + 1
    w = np.zeros(n) if start is None else start
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        gram, right = np.diag(penalty), np.zeros(n)
        for k in range(0, len(y), 2048):
            part = np.hstack([x := rows(k, k + 2048), np.ones((len(x), 1))])
            active = y[k : k + 2048] * (part @ w) < 1
            part, weighed = part[active], cost[k : k + 2048][active]
            gram += part.T @ (part * weighed[:, None])
            right += part.T @ (weighed * y[k : k + 2048][active])
        new = np.linalg.solve(gram, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w, float(w[-1])


def _logistic(s: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with softened targets, each row at its cost."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -60, 60)))
        g = np.array([(cost * (p - target) * s).sum() + 1e-3 * a, (cost * (p - target)).sum()])
        r = cost * p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(r * s * s).sum() + 1e-3, (r * s).sum()], [(r * s).sum(), r.sum()]]), g)
        scale = min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _surprise(n1: int, n0: int, rate: float) -> float:
    """Minus the decimal logarithm of Chernoff's bound on a chance of n1 or more toxic documents of n1 + n0, each toxic at this rate."""
    share = n1 / (n1 + n0)
    if share <= rate:
        return 0.0
    return float(n1 * np.log10(share / rate) + (n0 * np.log10((1 - share) / (1 - rate)) if n0 else 0.0))


@dataclass
class _Pairs:
    """Sure pairs' words; the candidate pairs of each document; in how many toxic and clean documents each is."""

    firsts: tuple[str, ...]
    seconds: tuple[str, ...]
    bags: list[set[str]]
    counts: dict[str, tuple[int, int]]


def _sure_pairs(texts: list[str], labels: np.ndarray, df1: Counter, df0: Counter) -> _Pairs:
    """Pairs of words that toxic documents hold more often than by chance and next to no clean ones, while their words are ordinary."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    rate = n1 / len(labels)
    ordinary = {w for w, n in df0.items() if n > NOISE * df1[w] * min(1.0, n0 / n1)}
    # A pair in so few toxic documents that chance explains it, even without a clean one, is never sure: pairs are first counted by hash alone.
    least = next((n for n in range(1, int(n1) + 1) if _surprise(n, 0, rate) >= SURE), int(n1) + 1)
    hashed = [np.array([zlib.crc32(p.encode()) for p in pairs_of(sentences_of(text))], np.uint32) for text, t in zip(texts, labels) if t]
    hashes, n = np.unique(np.concatenate(hashed), return_counts=True) if hashed else (np.empty(0, np.uint32),) * 2
    frequent = set(hashes[n >= least].tolist())
    del hashed, hashes, n
    in1: Counter = Counter()
    for text, t in zip(texts, labels):
        if t and frequent:
            in1.update(p for p in pairs_of(sentences_of(text)) if zlib.crc32(p.encode()) in frequent)
    often = {p for p, n in in1.items() if _surprise(n, 0, rate) >= SURE and ordinary.issuperset(p.split(" "))}
    if not often:
        return _Pairs((), (), [set()] * len(texts), {})
    in0: Counter = Counter()
    for text, t in zip(texts, labels):
        if not t:
            in0.update(often & pairs_of(sentences_of(text)))
    sure = {p for p in often if in0[p] <= NOISE * in1[p] * min(1.0, n0 / n1) and _surprise(in1[p], in0[p], rate) >= SURE}
    firsts, seconds = (tuple(sorted({p.split(" ")[k] for p in sure})) for k in (0, 1))
    if not sure:
        return _Pairs((), (), [set()] * len(texts), {})
    scorer = Model(np.zeros(BINS, np.float32), 0.0, 1.0, 0.0, firsts, seconds)
    bags = candidate_pairs(scorer, [sentences_of(t) for t in texts], {})
    both = [Counter(p for found, t in zip(bags, labels) if t == k for p in found) for k in (1, 0)]
    return _Pairs(firsts, seconds, bags, {p: (both[0][p], both[1][p]) for p in set(both[0]) | set(both[1])})


def candidate_pairs(model: Model, texts: list[list[list[str]]], known: dict[str, int]) -> list[set[str]]:
    """The pairs of each text's sentences whose words are like a sure pair's; known: what was found of words, 1 for firsts and 2 for seconds."""
    if not model.firsts:
        return [set()] * len(texts)
    fresh = list({w for sentences in texts for words in sentences for w in words}.difference(known))
    for k in range(0, len(fresh), LOT):
        some = fresh[k : k + LOT]
        known.update(zip(some, (model.like(some, model.firsts) + 2 * model.like(some, model.seconds)).tolist()))
    return [{f"{a} {b}" for words in sentences for a, b in zip(words, words[1:]) if known[a] & 1 and known[b] & 2} for sentences in texts]


def train(texts: list[str | None], toxic: list[int]) -> Model | None:
    """The model of labelled texts; None without both classes."""
    labels = np.array(toxic, int)
    if len(set(toxic)) < 2:
        return None
    bags, kept, seen, names = [], [], set(), {}
    for place, text in enumerate(texts):
        bag = sorted({names.setdefault(w, w) for words in sentences_of(text or "") for w in words})
        # Copies and most near copies teach once: their chance words would look sure.
        sketch = (toxic[place], *sorted(zlib.crc32(w.encode()) for w in bag)[:3])
        if sketch not in seen:
            seen.add(sketch)
            bags.append(bag)
            kept.append(place)
    labels = labels[kept]
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    df1, df0 = (Counter(w for bag, t in zip(bags, labels) if t == k for w in bag) for k in (1, 0))
    pairs = _sure_pairs([texts[k] or "" for k in kept], labels, df1, df0)
    for place, found in enumerate(pairs.bags):
        bags[place] = bags[place] + sorted(found)
    for w, (in1, in0) in pairs.counts.items():
        df1[w], df0[w] = in1, in0
    every = sorted(set(df1) | set(df0))
    number = {w: k for k, w in enumerate(every)}
    held = [np.array([number[w] for w in bag], np.int32) for bag in bags]
    del bags, names
    in1, in0 = (np.array([df[w] for w in every]) for df in (df1, df0))
    odds = np.where(in1 > 0, np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1)), -5.0)
    by = lambda values, among: [every[k] for k in among[np.argsort(values[among], kind="stable")].tolist()]
    clean = np.flatnonzero(in0)
    rank = by(-odds * np.minimum(in1, 50), np.flatnonzero(in1))[:LANDMARKS]
    common, spread = by(-in0, clean)[:200], by(np.array([zlib.crc32(w.encode()) for w in every], np.int64), clean)[:8000]
    marks = list(dict.fromkeys(rank + common[: LANDMARKS // 4] + spread[:LANDMARKS]))

    places, bins, weights = subsequences(marks)
    used, columns = np.unique(bins, return_inverse=True)
    phi = np.zeros((len(marks), len(used)), np.float32)
    np.add.at(phi, (places, columns), weights)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    kept = values > 1e-3 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    # table[:, k]: the weight that coordinate k of the Nyström space gives to each subsequence in use.
    table = phi.T @ root.astype(np.float32)
    del phi, values, vectors, root
    where = np.full(BINS, -1, np.int32)
    where[used] = np.arange(len(used))
    hand_back()

    known_rows: dict[str, np.ndarray] = {}

    def map_all(words: list[str]) -> None:
        """Puts the words' Nyström coordinates into known_rows, which keeps them from round to round."""
        fresh = [w for w in words if w not in known_rows]
        for k in range(0, len(fresh), MAPPED):
            some = fresh[k : k + MAPPED]
            out = np.zeros((len(some), table.shape[1]), np.float32)
            places, bins, weights = subsequences(some)
            known = np.flatnonzero(where[bins] >= 0)
            known = known[np.argsort(places[known], kind="stable")]
            if len(known):
                rows = table[where[bins[known]]] * weights[known, None].astype(np.float32)
                starts = np.flatnonzero(np.diff(places[known], prepend=-1))
                out[places[known][starts]] = np.add.reduceat(rows, starts)
            known_rows.update(zip(some, out))

    score = odds * np.minimum(1.0, in1 / 5)
    # Words that toxic documents hold too often for chance, and next to no clean ones, stand for them besides the witnesses.
    mostly = {w for w, n in df1.items() if df0[w] <= NOISE * n * min(1.0, n0 / n1)}
    sure = {w: df1[w] for w in mostly if _surprise(df1[w], df0[w], n1 / len(labels)) >= SURE}
    is_sure = np.array([w in sure for w in every], bool)
    model, w = None, None
    against: set[str] = set(common) | set(spread)
    for _ in range(ROUNDS):
        witnesses = []
        if model or not sure:
            for ids, t in zip(held, labels):
                if t and len(ids) and not is_sure[ids].any():
                    best = max(ids.tolist(), key=lambda k: (score[k], k))
                    if not sure or score[best] > 0:
                        witnesses.append(every[best])
        for ids, t in zip(held, labels):
            if not t and len(ids):
                ordinary = ids[~is_sure[ids]]
                against.update(every[k] for k in ordinary[np.lexsort((ordinary, -score[ordinary]))[:3]].tolist())
        positive = Counter(sure)
        positive.update(word for word in witnesses if word in mostly)
        negative = sorted(against.difference(positive))
        if not positive:
            break
        changed = variants(sorted(sure), number)
        rows = sorted(positive) + changed + negative
        y = np.array([1.0] * (len(positive) + len(changed)) + [-1.0] * len(negative))
        cost = np.array([float(min(positive[word], 20)) for word in sorted(positive)] + [VIRTUAL] * len(changed) + [float(min(max(df0[word], 1), 20)) for word in negative])
        cost[: len(positive)] *= max(1.0, len(negative) / max(1.0, cost[: len(positive)].sum())) ** 0.5
        map_all(rows)
        hand_back()
        w, bias = _machine(lambda a, b: np.array([known_rows[word] for word in rows[a:b]]), y, cost, start=w)
        flat = np.zeros(BINS, np.float32)
        for k in range(0, len(used), ROWS):  # the product widens the table's numbers: not all of them at once
            flat[used[k : k + ROWS]] = table[k : k + ROWS] @ w[:-1]
        model = Model(flat, bias, 1.0, 0.0, pairs.firsts, pairs.seconds)
        score = np.concatenate([model.words(every[k : k + LOT]) for k in range(0, len(every), LOT)])
    if model is None:
        return None
    # The fit is of what the machine can tell: toxic documents by a part that stands for toxicity, changed parts, and clean documents by their worst part.
    stands = np.array([word in positive for word in every], bool)
    told = [k for k, (ids, t) in enumerate(zip(held, labels)) if not t or (len(ids) and stands[ids].any())]
    best = np.array([score[held[k]].max(initial=NO_WORD) for k in told])
    if changed:
        best = np.concatenate([best, np.concatenate([model.words(changed[k : k + LOT]) for k in range(0, len(changed), LOT)])])
    y = np.concatenate([labels[told], np.ones(len(best) - len(told), int)])
    model.slope, model.offset = _logistic(best, y, np.where(y == 0, REJECTED, 1.0))
    return model


def variants(words: list[str], known: dict[str, int]) -> list[str]:
    """Words that are not known themselves, made of these by characters inserted at inner places (one, and two for a part of the places) and by one left out."""
    out = set()
    for w in (w for w in words if len(w) >= 4):
        h = zlib.crc32(w.encode())
        letter = lambda k: LETTERS[(h >> 3) % 26 - (h + 7 * k) % 26]
        for i in range(1, len(w)):
            out.update(w[:i] + letter(VARIED * i + k) + w[i:] for k in range(VARIED))
            j = 1 + (i + h) % (len(w) - 1)
            a, b = min(i, j), max(i, j)
            out.add(w[:a] + letter(a) + w[a:b] + letter(b + 3) + w[b:])
            if i < len(w) - 1:
                out.add(w[:i] + w[i + 1 :])
    return sorted(out.difference(known))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(label_id, text, toxic) of at most ``most`` teaching rows of each class; rows that repeat a doc_id teach once, by their least text."""
    teach = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    teach = teach.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 3 != 1).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    some = None
    for kind in (0, 1):
        part = teach.where(F.col("toxic") == kind).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        some = part if some is None else some.unionByName(part)
    # At most 2 * most rows of two numbers: a proven bound.
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).select("label_id", "text", "toxic")


_MODEL = pa.schema([("bins", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64()), ("firsts", pa.list_(pa.string())), ("seconds", pa.list_(pa.string()))])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("label_id", "text", "toxic")))), key=lambda r: (r[0], r[1] or ""))
    model = train([r[1] for r in rows], [r[2] for r in rows])
    if model:
        bins = np.flatnonzero(model.weights)
        packed = {"bins": [bins.astype("<u4").tobytes()], "weights": [model.weights[bins].astype("<f4").tobytes()]}
        yield pa.RecordBatch.from_pydict(packed | {"bias": [model.bias], "slope": [model.slope], "offset": [model.offset], "firsts": [list(model.firsts)], "seconds": [list(model.seconds)]}, schema=_MODEL)


def _score(model: Model | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for batch in sliced(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            if model is None:
                score = np.zeros(len(ids))
            else:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                if model.firsts:
                    parted = [sentences_of(t) for t in texts]
                    bags = [{w for words in sentences for w in words} for sentences in parted]
                    if len(kinds) > CACHE_WORDS:
                        kinds = {}
                    for bag, more in zip(bags, candidate_pairs(model, parted, kinds)):
                        bag |= more
                else:
                    bags = [set(words_of(t)) for t in texts]
                if len(known) > CACHE_WORDS:
                    known = {}
                fresh = list(set().union(*bags).difference(known))
                for k in range(0, len(fresh), LOT):
                    some = fresh[k : k + LOT]
                    known.update(zip(some, model.words(some).tolist()))
                get = known.__getitem__
                score = model.probability(np.array([max(map(get, bag), default=NO_WORD) for bag in bags]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """The model of the labelled rows among docs, trained by one task on its bounded sample; None without both classes."""
    kinds = "bins binary, weights binary, bias double, slope double, offset double, firsts array<string>, seconds array<string>"
    with batch_rows(docs.sparkSession, 512):
        rows = labelled(docs, labels, most).repartition(1).mapInArrow(released(_train), kinds).collect()
    if not rows:
        return None
    (row,) = rows
    weights = np.zeros(BINS, np.float32)
    weights[np.frombuffer(row["bins"], "<u4")] = np.frombuffer(row["weights"], "<f4")
    return Model(weights, row["bias"], row["slope"], row["offset"], tuple(row["firsts"]), tuple(row["seconds"]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(released(_score(model)), SCORED)


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""
    text = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _score(model)
        for batch in sliced(batches, text):
            some = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(batch.schema.names.index(text))], names=["doc_id", "text"])
            (found,) = scorer([some])
            yield batch.filter(pa.array(found.column("predicted").to_numpy() == 0))

    return docs.mapInArrow(released(run), docs.schema)
