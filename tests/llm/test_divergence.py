"""Source divergence: the query against plain code and SQL, exact shares, slices and odd rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gridloom.llm import divergence, queries

DATA = "/root/testdata/sf0.001"


def expected(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of rows (lang, source, text), in plain code."""
    counts, inside, groups, out = defaultdict(Counter), defaultdict(Counter), defaultdict(set), []
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        inside[lang].update(set(terms))
    share = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    utf = lambda s: s.encode()
    for lang, sources in groups.items():
        kept = [t for t, n in inside[lang].items() if n >= least]
        v, whole = len(kept), {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept), v) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values()), v) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), utf(o), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -value, k + 1) for k, (value, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), utf(t), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -value, k + 1) for k, (value, _, t) in enumerate(terms)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sql(rows):
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
        if rows:
            c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        return sorted(c.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.oracle()})").fetchall())


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "Über", "x", "ñu", "Z", "日本") for b in ("", "s", "ed", "ß")] + ["a-b", "c_d", "3x4", "\x7f", "é'e"]
    return [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S10", "é", None]), " ".join(rng.choices(words, [1 + (k % 7) ** 3 for k in range(len(words))], k=rng.randrange(30))) if rng.random() < 0.95 else None) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_code_and_sql(spark, seed):
    rows = made(seed) + [("fr", "only", "seul"), ("it", "a", None), ("it", "b", "raro")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert told(divergence.audit(docs)) == expected(rows) == sql(rows)


def test_query_against_plain_code(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "source", "text").collect()]
    assert told(queries.op13_source_divergence(spark, DATA)) == expected(docs)


def test_slices_and_many_sources_change_nothing(spark, monkeypatch):
    rows = made(5)
    want = expected(rows)
    for name, value in (("SLICE", 8), ("SQUARE", 2), ("TASK_ROWS", 20)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert told(divergence.audit(docs)) == want
    # Few counters held: many rows of the same term and source meet in a run, over several Arrow batches.
    kept = divergence.kept_terms(docs, held=1).groupBy("lang", "source", "term").count()
    assert kept.where("count > 1").count() == 0


def test_runs_go_on_over_batches():
    import pyarrow as pa

    rows = [("de", s, t, 1, 2) for t in ("", "a", "b") for s in ("s", "s", "t", "u", "u", "u")]
    whole = pa.RecordBatch.from_pylist([dict(zip(divergence._COUNTED.names, r)) for r in [(l, s, t, d, c) for l, s, t, d, c in rows]], schema=divergence._COUNTED)
    for step in range(1, 19):
        out = [r for b in divergence._runs((whole.slice(k, step) for k in range(0, 18, step)), ("documents", "count")) for r in b.to_pylist()]
        assert [(r["term"], r["source"], r["documents"], r["count"]) for r in out] == [(t, s, n, 2 * n) for t in ("", "a", "b") for s, n in (("s", 2), ("t", 1), ("u", 3))]


def test_shares_are_exact():
    rng = random.Random(4)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(2000)] + [1, 2, 3, 8999999999999999]
    counts = [rng.randrange(t + 1) for t in totals]
    got = divergence.share_of(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + 10**9 * c // t for c, t in zip(counts, totals)]


def test_odd_rows(spark):
    schema = "lang string, source string, text string, term string, part string, rank string, count string, terms string, doc_id string"
    rows = [("en", f"s{k % 3}", "same words all over " + "long " * (20000 if k == 5 else 1)) for k in range(40)] + [(None, None, None), ("en", "quiet", ""), ("en", "s0", "Same words ALL over")]
    docs = spark.createDataFrame([(*r, *["e"] * 6) for r in rows], schema)
    assert told(divergence.audit(docs)) == expected(rows)
    assert divergence.audit(docs.limit(0)).count() == 0
    few = [("xx", "a", "one"), ("xx", "b", "two"), ("yy", "a", None)]
    assert told(divergence.audit(spark.createDataFrame(few, "lang string, source string, text string"))) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]
