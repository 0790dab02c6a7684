"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells (source, language, topic) of so many tokens. A cell's weight is the number
of its tokens that the sample is to hold in expectation, so it is never more than the cell has. All
weights begin at the same share of the cells' tokens; then they are scaled in turn to the goals of
sources, languages and topics, and cut at what the cells have within the loop, until all margins are
within ``CLOSE`` of their goals or come no nearer (looked at every ``STEP`` rounds). Weight over tokens is the
probability with which each document of the cell is kept: a uniform number made from its doc_id
falls under it.

Goals. A value's goal is its target share of the sample's tokens. Where a value has too few tokens
for that, the whole sample is made smaller, down to ``LEAST_SHARE`` of all tokens; a value that is
still short has all its tokens wanted, and the rest of the sample goes to the other values by their
targets. ``report`` tells each value's target, goal and expected share.

Only cells (combined on the map side) are shuffled for the fit; a task holds the cells of one value
at most, and goals are found by sums over values alone. Documents are read once to count and once to sample.

Defined results: null source or language is a value of its own, written ``(none)``; a null or empty
text has no tokens and the topic of plain text; a cell without tokens has probability one; a null
doc_id is drawn like the id -1; rows that repeat a doc_id are drawn alike; margins whose goals
cannot all be met together end as near as the last round brings them; an empty table gives no rows;
drawn() replaces columns named like its results, sample() leaves every column as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import text_of, written

#: Rounds at most, rounds between two looks at the margins, how near they must be, and what the farthest must fall to from look to look.
ROUNDS, STEP, CLOSE, FALL = 60, 3, 5e-3, 0.95
#: Tokens wanted in the sample, as a share of all, and the share under which it is not lowered to meet a target.
SHARE, LEAST_SHARE = 0.5, 0.25
NONE = "(none)"
#: Target shares by language; a language that is not named has OTHER.
LANGUAGES, OTHER = {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.20}, 0.05
#: Topics' shares are their tokens' to this power.
TEMPER = 0.5
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A topic from a text's marks."""
    return (
        F.when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("©")), "legal")
        .when(text.rlike("[|#$%&*]"), "markup")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) made from the id: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("-1")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def default_targets() -> dict[str, Callable[[Column, Column], Column]]:
    """For each dimension a share, up to a factor, of a value and its tokens: sources alike, languages as named, topics tempered."""
    named = F.lit(None).cast("double")
    for lang, share in LANGUAGES.items():
        named = F.coalesce(named, F.when(F.col("lang") == lang, F.lit(share)))
    return {
        "source": lambda value, tokens: F.lit(1.0),
        "lang": lambda value, tokens: F.coalesce(named, F.lit(OTHER)),
        "topic": lambda value, tokens: F.pow(tokens, F.lit(TEMPER)),
    }


def with_cells(docs: DataFrame, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    text = text_of()
    return docs.withColumns({
        "cell_source": F.coalesce(F.col("source"), F.lit(NONE)), "cell_lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "topic": topic(text), "n_tokens": tokens_of(text),
    })


def goals(cells: DataFrame, share: float = SHARE, targets: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """(dimension, value, held, target, goal) of every value of cells (source, lang, topic, tokens): tokens, share, tokens wanted."""
    targets, rows = targets or default_targets(), None
    for d in DIMENSIONS:
        margin = cells.where("tokens > 0").groupBy(d).agg(F.sum("tokens").cast("double").alias("held"))
        margin = margin.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "held", targets[d](F.col(d), F.col("held")).alias("raw"))
        rows = margin if rows is None else rows.unionByName(margin)
    margins = written(rows.where("raw > 0"), "mix-margins")
    # Three rows, of sums that are combined on the map side: no task holds a dimension's values.
    sums = {r["dimension"]: r for r in margins.groupBy("dimension").agg(F.sum("raw").alias("raw"), F.sum("held").alias("held")).collect()}

    def of(numbers: dict[str, float | None]) -> Column:
        out = F.lit(None).cast("double")
        for d, x in numbers.items():
            out = F.when(F.col("dimension") == d, F.lit(x).cast("double")).otherwise(out)
        return out

    rows = margins.select("dimension", "value", "held", (F.col("raw") / of({d: r["raw"] for d, r in sums.items()})).alias("target"))
    total = {d: r["held"] for d, r in sums.items()}
    met = rows.agg(F.min(F.col("held") / (of(total) * F.col("target")))).first()[0]
    wanted = max(min(share, LEAST_SHARE), min(share, share if met is None else met))
    # What exhausted values cannot give is dealt out by target among the others, which may exhaust more of them:
    # the rate only rises, and is final once it exhausts no more. It is kept from falling by a rounding error, which
    # would open a value again that is exhausted to the last digit, and shut it in the next round, for ever.
    rate: dict[str, float | None] = {d: wanted * t for d, t in total.items()}
    before: dict[str, int] = {}
    while True:
        short = F.col("held") < of(rate) * F.col("target")
        found = {r["dimension"]: r for r in rows.groupBy("dimension").agg(F.sum(F.when(short, F.col("held")).otherwise(0.0)).alias("given"), F.sum(F.when(short, 0.0).otherwise(F.col("target"))).alias("open"), F.count_if(short).alias("n")).collect()}
        counts = {d: r["n"] for d, r in found.items()}
        if all(n <= before.get(d, 0) for d, n in counts.items()):
            break
        before = counts
        rate = {d: max(rate[d], (wanted * total[d] - r["given"]) / r["open"]) if r["open"] > 0 else rate[d] for d, r in found.items()}
    return rows.withColumn("goal", F.least(F.col("held"), of(rate) * F.col("target"))).select("dimension", "value", "held", "target", "goal")


def fitted(cells: DataFrame, share: float = SHARE, targets: dict[str, Callable[[Column, Column], Column]] | None = None, rounds: int = ROUNDS, step: int = STEP, close: float = CLOSE) -> DataFrame:
    """cells (source, lang, topic, tokens) that have tokens, with their raked weight: the tokens wanted of each."""
    margins = written(goals(cells, share, targets), "mix-goals")
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens") * F.lit(share))
    for d in DIMENSIONS:
        out = out.join(margins.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}")), d)
    done, before = 0, float("inf")
    while done < rounds:
        for _ in range(step):
            for d in DIMENSIONS:
                sums = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"goal_{d}") / sums))
        done += step
        out = written(out, "mix-weights")
        off = [out.groupBy(d).agg(F.abs(F.sum("weight") / F.first(f"goal_{d}") - 1).alias("off")).select("off") for d in DIMENSIONS]
        worst = reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0]
        if worst is None or worst <= close or worst > FALL * before:
            break
        before = worst
    return out.select(*DIMENSIONS, "tokens", "weight")


def cells_of(docs: DataFrame, topic: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, lang, topic, tokens) of docs, written."""
    rows = with_cells(docs, topic or topic_of)
    return written(rows.groupBy(F.col("cell_source").alias("source"), F.col("cell_lang").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")), "mix-cells")


def report(docs: DataFrame, share: float = SHARE, targets=None) -> DataFrame:
    """(dimension, value, held, target, goal, expected): tokens, target share, tokens wanted and tokens expected of each value."""
    cells = cells_of(docs)
    weights, rows = written(fitted(cells, share, targets), "mix-report"), None
    for d in DIMENSIONS:
        part = weights.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("expected")).withColumn("dimension", F.lit(d))
        rows = part if rows is None else rows.unionByName(part)
    return goals(cells, share, targets).join(rows, ["dimension", "value"])


def drawn(docs: DataFrame, share: float = SHARE, targets=None, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """docs with topic, n_tokens, probability and kept."""
    base = docs.drop("topic", "n_tokens", "probability", "kept", "cell_source", "cell_lang")
    rows = with_cells(base, topic)
    weights = fitted(cells_of(base, topic), share, targets)
    chances = written(weights.select(*DIMENSIONS, F.round(F.col("weight") / F.col("tokens"), 6).alias("probability")), "mix-chances")
    chances = chances.select(F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), "topic", "probability")
    out = rows.join(chances, ["cell_source", "cell_lang", "topic"], "left")
    out = out.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("kept", uniform(F.col("doc_id")) < F.col("probability")).select(*[F.col(f"`{c}`") for c in base.columns], "topic", "n_tokens", "probability", "kept")


def sample(docs: DataFrame, share: float = SHARE, targets=None) -> DataFrame:
    """The drawn rows of docs, its columns as they were."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    return drawn(docs.select("doc_id", "text", "lang", "source", whole), share, targets).where("kept").select("whole.*")


def oracle(share: float = SHARE, table: str = "documents") -> str:
    """DuckDB SQL for doc_id, topic, n_tokens, probability and kept: the rounds are a recursive query."""
    named = " ".join(f"WHEN lang = '{k}' THEN {v}" for k, v in LANGUAGES.items())
    raw = {"source": "1.0", "lang": f"CASE {named} ELSE {OTHER} END", "topic": f"pow(sum(tokens), {TEMPER})"}
    margins = "\n  UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, sum(tokens)::DOUBLE AS held, {raw[d]}::DOUBLE AS raw FROM c GROUP BY {d}" for d in DIMENSIONS)
    body = "it"
    for k in range(STEP * len(DIMENSIONS)):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        keep = "i, before" if k else "i + 1 AS i, worst AS before"
        where = "" if k else f" WHERE worst > {CLOSE} AND worst <= {FALL} * before AND i < {ROUNDS // STEP}"
        body = f"(SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, {keep}, least(tokens, weight * goal_{d} / sum(weight) OVER (PARTITION BY {d})) AS weight FROM {body}{where})"
    off = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {d}) / goal_{d} - 1)" for d in DIMENSIONS)
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), '©') THEN 'legal'
       WHEN regexp_matches(coalesce(text, ''), '[|#$%&*]') THEN 'markup' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {table}),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
m AS (SELECT dimension, value, held, raw / sum(raw) OVER w AS target, sum(held) OVER w AS total FROM ({margins}) WINDOW w AS (PARTITION BY dimension)),
s AS (SELECT greatest({min(share, LEAST_SHARE)}, least({share}, min(held / (total * target)))) AS wanted FROM m),
r AS (SELECT m.*, (wanted * total - coalesce(sum(held) OVER p, 0)) / (sum(target) OVER (PARTITION BY dimension) - coalesce(sum(target) OVER p, 0)) AS rate FROM m, s
  WINDOW p AS (PARTITION BY dimension ORDER BY held / target, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT dimension, value, coalesce(least(held, target * max(CASE WHEN rate * target <= held THEN rate END) OVER (PARTITION BY dimension)), held) AS goal FROM r),
it AS (
  SELECT c.source, c.lang, c.topic, tokens, x.goal AS goal_source, y.goal AS goal_lang, z.goal AS goal_topic, 0 AS i, 1e9::DOUBLE AS worst, 2e9::DOUBLE AS before, tokens * {share} AS weight FROM c
  JOIN g x ON x.dimension = 'source' AND x.value = c.source JOIN g y ON y.dimension = 'lang' AND y.value = c.lang JOIN g z ON z.dimension = 'topic' AND z.value = c.topic
  UNION ALL
  SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, i, max(off) OVER () AS worst, before, weight FROM (SELECT *, greatest({off}) AS off FROM {body})
),
p AS (SELECT source, lang, topic, round(weight / tokens, 6) AS probability FROM it WHERE i = (SELECT max(i) FROM it))
SELECT d.doc_id, d.topic, d.n_tokens, coalesce(p.probability, 1.0) AS probability,
       ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '-1')), 1, 8))::BIGINT / 4294967296.0 < coalesce(p.probability, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
