"""Chat records to masked training examples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from gridloom.sources.tokenize import Tokenizer

# Source role names and what they become; the label of positions without loss; the longest example.
ROLES = {"human": "user", "gpt": "assistant", "system": "system"}
IGNORED = -100
LONGEST = 2048


def role_of(name: Column) -> Column:
    """The role of a source name; an unknown name is an error."""
    out = F.when(F.lit(False), F.lit(""))
    for source, role in ROLES.items():
        out = out.when(name == source, F.lit(role))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(name, F.lit("null")))))


def messages(records: Column) -> Column:
    """array<struct<role, content>> of array<struct<from, value>>."""
    return F.transform(records, lambda m: F.struct(role_of(m["from"]).alias("role"), m["value"].alias("content")))


def from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, conversations) of (conv_id, turn, from, value), in the order of turns."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "from", "value"))).alias("rows"))
    return rows.select("conv_id", F.transform("rows", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))).alias("conversations"))


def turn_template(message: Column) -> Column:
    """A stand-in template: a model's own is a parameter."""
    return F.concat(F.lit("<|im_start|>"), message["role"], F.lit("\n"), message["content"], F.lit("<|im_end|>\n"))


GENERATION_HEADER = "<|im_start|>assistant\n"


def render(msgs: Column, template: Callable[[Column], Column] = turn_template) -> Column:
    return F.array_join(F.transform(msgs, template), "")


def prompt(msgs: Column, template: Callable[[Column], Column] = turn_template, header: str = GENERATION_HEADER) -> Column:
    """All but the last message, and the header after which a model writes."""
    return F.concat(render(F.slice(msgs, 1, F.greatest(F.size(msgs) - 1, F.lit(0))), template), F.lit(header))


def word_ids(text: Column) -> Column:
    """A stand-in tokenizer: an id for each word, from its MD5."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("long"))


def example(full: Column, before: Column, tokenize: Callable[[Column], Column] = word_ids, longest: int = LONGEST) -> Column:
    """struct<input_ids, attention_mask, labels>: ids cut at longest; labels ignore as many places as the prompt has tokens.

    Where the ids are fewer than that, the labels are the longer array, as each prompt token has one.
    """
    return masked(F.slice(tokenize(full), 1, longest), F.least(F.size(tokenize(before)), F.lit(longest)))


def masked(ids: Column, p: Column) -> Column:
    """struct<input_ids, attention_mask, labels> of ids whose first p are a prompt."""
    labels = F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), p), F.slice(ids, p + 1, F.greatest(F.size(ids) - p, F.lit(0))))
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1).cast("long")).alias("attention_mask"), labels.alias("labels"))


def prepare(chats: DataFrame, tokenize: Callable[[Column], Column] = word_ids, longest: int = LONGEST) -> DataFrame:
    """(conv_id, input_ids, attention_mask, labels) of chats (conv_id, conversations)."""
    rows = chats.select("conv_id", messages(F.col("conversations")).alias("m")).select("conv_id", render(F.col("m")).alias("full"), prompt(F.col("m")).alias("before"))
    return rows.select("conv_id", example(F.col("full"), F.col("before"), tokenize, longest).alias("e")).select("conv_id", "e.*")


def prepare_arrow(chats: DataFrame, tokenizer: Tokenizer, longest: int = LONGEST) -> DataFrame:
    """prepare() by a tokenizer that works on batches in Python workers: texts are made by expressions, ids in Arrow batches."""
    rows = chats.select("conv_id", messages(F.col("conversations")).alias("m")).select("conv_id", render(F.col("m")).alias("full"), prompt(F.col("m")).alias("before"))
    found = rows.select("conv_id", tokenizer(F.col("full"), F.col("before"), longest).alias("t"))
    return found.select("conv_id", masked(F.col("t.ids"), F.col("t.p")).alias("e")).select("conv_id", "e.*")


def first(chats: DataFrame, n: int = 300) -> DataFrame:
    """The n chats of smallest id."""
    return chats.orderBy("conv_id").limit(n)


def first_turns(turns: DataFrame, n: int = 300) -> DataFrame:
    """The turns of the n conversations of smallest id, before anything is gathered.

    Ids alone are compared (distinct in each task, then a top n of each task); the n that are found, which
    is their bound, are sent to the turns, so only turns of these conversations are ever shuffled. Turns
    without a conv_id belong to no conversation.
    """
    ids = turns.where("conv_id is not null").select("conv_id").distinct().orderBy("conv_id").limit(n)
    return turns.join(F.broadcast(ids), "conv_id", "left_semi")


#: The numbers that watched() takes of prepared examples.
METRICS = ("n_examples", "n_truncated", "n_tokens", "n_kept", "n_masked", "longest")


def watched(prepared: DataFrame, observation: Observation, longest: int = LONGEST) -> DataFrame:
    """prepared as it is; whatever action runs on it also fills the observation with METRICS.

    n_examples, n_truncated (ids as long as ``longest``), n_tokens, n_kept and n_masked (labels with and without
    loss), longest (ids of the longest example). They are summed within the tasks that make the rows:
    no second read and no shuffle.
    """
    ids, labels = F.size("input_ids"), F.col("labels")
    kept = F.size(F.filter(labels, lambda x: x != IGNORED))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return prepared.observe(
        observation, F.count(F.lit(1)).alias("n_examples"), F.count_if(ids >= longest).alias("n_truncated"), total(ids).alias("n_tokens"),
        total(kept).alias("n_kept"), total(F.size(labels) - kept).alias("n_masked"), F.coalesce(F.max(ids), F.lit(0)).cast("long").alias("longest"),
    )


#: Tokens of a padded batch, and examples that are packed together.
BUDGET, PACKED = 16_384, 4096
_BATCHES = "conv_id long, batch_id string, place int, n_tokens int, padded int, batch_tokens int, batch_kept int, batch_masked int"
_BATCHED = pa.schema([("conv_id", pa.int64()), ("batch_id", pa.string()), *((c, pa.int32()) for c in ("place", "n_tokens", "padded", "batch_tokens", "batch_kept", "batch_masked"))])


def batches(prepared: DataFrame, budget: int = BUDGET, packed: int = PACKED) -> DataFrame:
    """(conv_id, batch_id, place, n_tokens, padded, batch_tokens, batch_kept, batch_masked): every example's batch.

    A batch is a rectangle: its examples are padded to the longest of them, and examples times that length
    is at most ``budget`` (an example of more tokens is a batch of its own). Examples are dealt out by hash of
    conv_id to groups of about ``packed``, counted first, and each group is packed in order of length, so
    examples of a batch are of like length and little is padding. batch_kept is the number of labels that
    have loss, by which a batch's loss is to be divided; batch_masked those that have none.

    Only lengths are shuffled, not tokens. The batches are the same whatever the partitions. Rows that repeat a
    conv_id are packed each; an example without tokens takes part with length 0.
    """
    kept = F.size(F.filter("labels", lambda x: x != IGNORED))
    sizes = prepared.select(F.col("conv_id").cast("long").alias("conv_id"), F.greatest(F.size("input_ids"), F.lit(0)).alias("n_tokens"), F.greatest(kept, F.lit(0)).alias("n_kept"), F.greatest(F.size("labels"), F.lit(0)).alias("n_labels"))
    groups = max(1, -(-prepared.count() // packed))
    digest = F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"))
    group = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % groups).cast("int")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("conv_id", "ascending"), ("n_kept", "ascending"), ("n_labels", "ascending")])
        sizes = table["n_tokens"].to_numpy()
        starts, k = [], 0
        while k < len(sizes):
            starts.append(k)
            k += max(1, int(budget // max(1, sizes[k])))
        lengths = np.diff([*starts, len(sizes)])
        batch = np.repeat(np.arange(len(starts)), lengths)
        total = lambda values: np.add.reduceat(values, starts)[batch]
        kept = total(table["n_kept"].to_numpy())
        return pa.table([
            table["conv_id"], pa.array([f"{key[0].as_py()}-{b}" for b in batch]), np.arange(len(sizes)) - np.repeat(starts, lengths), sizes, sizes[starts][batch], total(sizes), kept, total(table["n_labels"].to_numpy()) - kept,
        ], names=_BATCHED.names).cast(_BATCHED)

    return sizes.withColumn("group", group).groupBy("group").applyInArrow(pack, _BATCHES)
