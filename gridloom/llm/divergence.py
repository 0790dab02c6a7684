"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Sort-based streaming, in two passes over sorted rows:

1. Each task counts its documents' terms by (lang, source) and hands on (lang, term, source, documents,
   occurrences) when it holds HELD counters, so what is shuffled is combined first. Rows are dealt out
   by (lang, term) and sorted by (lang, term, source). A scan over the runs of equal (lang, term) adds
   up documents and occurrences; runs of at least LEAST documents are kept terms and are written.
2. Group totals are counted from the kept terms. Kept runs are dealt out by term again, each task's
   rows after a copy of the totals (the row before a language's terms), so nothing is collected or
   broadcast. The second scan turns runs into smoothed shares and adds them to partial sums of each
   pair of sources and to each group's best terms; both are combined once more after the scan.

A term that all documents hold has a row for each source and task of the first pass, never one for each
document. The sums of pairs that a task holds are square in the sources of one language, as the result
is; with more than SQUARE sources they are handed on after each slice of terms.

Exact: shares are whole numbers (``share_of`` divides in steps, so counts up to 9 * 10^15 do not
overflow), and sums of pairs are below 3 * 10^9 + 2 for each group by the shares' sums.

Defined results: null text, lang and source count as ''; each row is a document, also where doc_ids are
null or repeated; a document without terms still makes its (lang, source) group occur; a language
without kept terms has pairs of value 0 and no term rows; a language of one source has no pairs; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, released, sliced, written

#: Documents of its language that a term must be in, and terms of a group that are reported.
LEAST, TOP = 10, 10
#: Shares are in parts of SCALE, each count is raised by SMOOTH.
SCALE_DIGITS, SMOOTH = 9, 2
#: Counters that a task of the first pass holds.
HELD = 400_000
#: Numbers in a slice of the second pass, sources up to which pairs are held, kept rows for each of its tasks.
SLICE, SQUARE, TASK_ROWS = 1 << 20, 2048, 50_000

#: Bytes that are no part of a term become blanks, A-Z become a-z; bytes from 0x80 on are parts of letters.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def share_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^SCALE_DIGITS * count / total) for count <= total < 9 * 10^15."""
    out, rest = np.zeros_like(count), count
    for _ in range(SCALE_DIGITS // 3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


COUNTED = "lang string, source string, term string, documents long, count long"
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("documents", pa.int64()), ("count", pa.int64())])


def _counted(held: int):
    """Counts of (lang, source, term), and of documents of (lang, source) under the term ''."""

    def handed(counts: dict, documents: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), inside in documents.items():
            count, terms = counts[lang, source], list(inside)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([inside[t] for t in terms], pa.int64()), pa.array([count[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = {}, {}
        for batch in sliced(batches, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms, key = terms_of(text), (lang or "", source or "")
                counts.setdefault(key, Counter()).update(terms)
                documents.setdefault(key, Counter()).update({b"", *terms})
            if sum(map(len, documents.values())) >= held:
                yield from handed(counts, documents)
                counts, documents = {}, {}
        yield from handed(counts, documents)

    return run


def _changes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each row differs from the one before it in one of the columns; the first does."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    out[:1] = True
    return out


def _runs(batches: Iterator[pa.RecordBatch], summed: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole runs of (lang, term) of rows sorted by (lang, term, source), a row for each source, ``summed`` columns added up."""

    def merged(table: pa.Table) -> pa.Table:
        at = np.flatnonzero(_changes(table["lang"], table["term"], table["source"]))
        if len(at) == table.num_rows:
            return table
        out = table.take(pa.array(at))
        for c in summed:
            k = out.schema.get_field_index(c)
            out = out.set_column(k, out.schema.field(k), pa.array(np.add.reduceat(table[c].to_numpy(), at), pa.int64()))
        return out

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = merged(pa.concat_tables([left, table]) if left is not None else table).combine_chunks()
        # The last run may go on in the next batch.
        last = int(np.flatnonzero(_changes(table["lang"], table["term"]))[-1])
        if last:
            yield table.slice(0, last).combine_chunks().to_batches()[0]
        left = table.slice(last)
    if left is not None:
        yield left.combine_chunks().to_batches()[0]


KEPT = "lang string, source string, term string, count long, first boolean"
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("first", pa.bool_())])


def _kept(least: int):
    """Rows of the runs of at least ``least`` documents, and of the term ''; ``first`` marks a kept term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, ("documents", "count")):
            first = _changes(batch.column("lang"), batch.column("term"))
            at = np.flatnonzero(first)
            inside = np.repeat(np.add.reduceat(batch.column("documents").to_numpy(), at), np.diff([*at, len(first)]))
            named = pc.not_equal(batch.column("term"), "").to_numpy(zero_copy_only=False)
            keep = pa.array((inside >= least) | ~named)
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "term", "count")), pa.array(first & named)], schema=_KEPT)
            yield rows.filter(keep)

    return run


@batches_of(10_000)
def kept_terms(docs: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, source, term, count, first) of every kept term of each group of docs (lang, source, text), and of the term '' of every group; written."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(released(_counted(held)), COUNTED)
    runs = counted.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return written(runs.mapInArrow(released(_kept(least)), KEPT), "divergence-kept")


def group_totals(kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms) of every group: occurrences of kept terms in it, kept terms of its language."""
    totals = kept.groupBy("lang", "source").agg(F.sum(F.when(F.col("term") != "", F.col("count")).otherwise(0)).alias("total"), F.count_if("first").alias("firsts"))
    terms = totals.groupBy(F.col("lang").alias("of")).agg(F.sum("firsts").alias("terms"))
    return totals.join(terms, totals.lang == terms.of).select("lang", "source", "total", "terms")


SCORED = "lang string, source string, part string, item string, value long"
_SCORED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _scored(lang: pa.Array, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], schema=_SCORED)


class _Language:
    """What a task has found of one language: sums of pairs of its sources, and each source's best terms."""

    def __init__(self, name: str, totals: pa.RecordBatch, top: int):
        self.name, self.top = name, top
        self.sources = totals.column("source")
        terms = int(totals.column("terms")[0].as_py())
        group = totals.column("count").to_numpy()
        self.divisor = np.maximum(1, group + SMOOTH * terms)
        self.whole = np.array([max(1, int(group.sum()) + SMOOTH * terms)])
        # A language without kept terms never meets a term, and its shares are not used.
        self.unseen = share_of(np.minimum(SMOOTH, self.divisor), self.divisor)
        n = len(self.sources)
        self.sums = [np.zeros(n - 1 - a, np.int64) for a in range(n)]
        self.best: pa.RecordBatch | None = None

    def pairs(self) -> Iterator[pa.RecordBatch]:
        for a, sums in enumerate(self.sums):
            if len(sums):
                yield _scored(self.name, pa.array([self.sources[a].as_py()] * len(sums), pa.string()), "pair", self.sources[a + 1 :], sums)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Take in whole runs of the language, some terms at a time."""
        first = np.flatnonzero(_changes(rows.column("term")))
        step, bounds = max(16, SLICE // len(self.sources)), np.append(first, rows.num_rows)
        for k in range(0, len(first), step):
            a, b = bounds[k], bounds[min(k + step, len(first))]
            yield from self._slice(rows.slice(a, b - a), first[k : k + step] - a)

    def _slice(self, rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        count = rows.column("count").to_numpy()
        term = np.repeat(np.arange(len(first)), np.diff([*first, len(count)]))
        source = pc.index_in(rows.column("source"), self.sources).to_numpy()
        p = share_of(count + SMOOTH, self.divisor[source])
        shares = np.tile(self.unseen, (len(first), 1))
        shares[term, source] = p
        held = len(self.sources) <= SQUARE
        for a in range(len(self.sources) - 1):
            one = divergence(shares[:, a : a + 1], shares[:, a + 1 :]).sum(axis=0)
            if held:
                self.sums[a] += one
            else:
                yield _scored(self.name, pa.array([self.sources[a].as_py()] * len(one), pa.string()), "pair", self.sources[a + 1 :], one)
        q = share_of(np.add.reduceat(count, first) + SMOOTH, self.whole)[term]
        over = np.flatnonzero((count > 0) & (p > q))
        at = pa.array(over)
        found = _scored(self.name, rows.column("source").take(at), "term", rows.column("term").take(at), divergence(p[over], q[over]))
        if self.best is not None:
            found = pa.Table.from_batches([self.best, found]).combine_chunks().to_batches()
            found = found[0] if found else self.best
        # Terms come in their order, and a stable sort leaves equal values so.
        source, value = pc.index_in(found.column("source"), self.sources).to_numpy(), found.column("value").to_numpy()
        order = np.lexsort((-value, source))
        rank = np.arange(len(order)) - np.searchsorted(source[order], source[order])
        self.best = found.take(pa.array(np.sort(order[rank < self.top])))


def _compared(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Language | None = None
        for batch in _runs(batches, ()):
            bounds = [*np.flatnonzero(_changes(batch.column("lang"))).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                rows, name = batch.slice(a, b - a), batch.column("lang")[a].as_py()
                if here is None or here.name != name:
                    if here is not None:
                        yield from here.pairs()
                        if here.best is not None:
                            yield here.best
                    # The totals are the language's first run.
                    n = int(np.count_nonzero(pc.equal(rows.column("term"), "").to_numpy(zero_copy_only=False)))
                    here, rows = _Language(name, rows.slice(0, n), top), rows.slice(n)
                if rows.num_rows:
                    yield from here.add(rows)
        if here is not None:
            yield from here.pairs()
            if here.best is not None:
                yield here.best

    return run


@batches_of(10_000)
def compared(kept: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): partial sums of pairs, of the lesser source first, and candidates for each group's best terms; written."""
    totals = written(group_totals(kept), "divergence-totals")
    terms = kept.where("term <> ''")
    parts = max(1, -(-terms.count() // TASK_ROWS))
    number = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int")
    rows = terms.select("lang", "source", "term", "count", F.lit(0).cast("long").alias("terms"), number.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    heads = totals.select("lang", "source", F.lit("").alias("term"), F.col("total").alias("count"), "terms", every.alias("part"))
    dealt = rows.unionByName(heads).repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("lang", "term", "source")
    return written(dealt.mapInArrow(released(_compared(top)), SCORED), "divergence-parts")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text): for each group every other source of
    its language by divergence (part pair), and its ``top`` terms that are more frequent than in the language (part term)."""
    parts = compared(kept_terms(docs, least), top)
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("both"), "value").select("lang", "both.source", F.lit("pair").alias("part"), "both.item", "value")
    rows = pairs.unionByName(parts.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for audit()'s rows."""
    share = lambda count, total: f"(1 + (1000000000::HUGEINT * ({count} + {SMOOTH})) // ({total} + {SMOOTH} * v))"
    f = lambda p, q: f"((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM {table}),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM o GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST}),
t AS (SELECT g.lang, g.source, coalesce(s.total, 0)::HUGEINT AS total, coalesce(m.v, 0)::HUGEINT AS v, coalesce(m.total, 0)::HUGEINT AS whole FROM g
  LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang) m ON m.lang = g.lang),
x AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 't.total')} AS p, {share('k.n', 't.whole')} AS q
  FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum({f('x.p', 'y.p')}) AS value FROM x JOIN x y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, {f('p', 'q')}::BIGINT AS value FROM x WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
WHERE part = 'pair' OR rank <= {TOP}"""
