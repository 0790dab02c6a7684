"""Which modules are quantized, by rule, over a flat table of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.quantize import group_size_of
from gridloom.sources.tables import written

# A path that holds one of these is left as it is; an embedding is taken if its path holds EMBED.
EXCLUDED = ("norm", "q_norm", "k_norm")
EMBED = "embed"
LINEAR, EMBEDDING = "linear", "embedding"
QUANT_LINEAR, QUANT_EMBEDDING = "quant_linear", "quant_embedding"
#: Projections that adapters attach to by default.
PROJECTIONS = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")


def child_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def parent_path(path: Column) -> Column:
    """The path without its last part; null for the root."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).when(path == "", F.lit(None)).otherwise(F.lit(""))


def walk(edges: DataFrame) -> DataFrame:
    """(node, path) of every node below the roots of edges (parent, node, name): its names from the root down, joined by dots.

    A root is a parent that is no node; it has no name and no row. Every row begins as the way from its
    parent; in each round the way to a row's top is put before it, so ways double in length and a tree of
    depth d takes log2(d) + 1 rounds of one join, however deep it is. Ways that begin at a root are not
    joined again. Rounds are written, so each is one job over the rows of the last.

    A node under several parents (a shared module) has a path for each way; edges that repeat count once; an
    edge without a parent, node or name is an error, as is a cycle; no edges give no rows.
    """
    bad = F.raise_error(F.lit("an edge lacks its parent, node or name"))
    whole = F.col("parent").isNotNull() & F.col("node").isNotNull() & F.col("name").isNotNull()
    checked = lambda c, name: F.when(whole, F.col(c).cast("string")).otherwise(bad).alias(name)
    ways = written(edges.select(checked("parent", "top"), checked("node", "node"), checked("name", "path")).distinct().withColumn("there", F.lit(False)), "tree-edges")
    longest, rounds = max(1, ways.select("node").distinct().count()), 0
    while ways.where("not there").count():
        if 2**rounds > 2 * longest:
            raise ValueError("the edges have a cycle")
        upper = ways.select(F.col("top").alias("higher"), F.col("node").alias("at"), F.col("path").alias("above"), F.col("there").alias("whole"))
        joined = ways.where("not there").join(upper, F.col("top") == F.col("at"), "left")
        # No way leads to a root, and a way that begins at one begins there with all that is put before it.
        there = F.col("at").isNull() | F.col("whole")
        step = joined.select(F.coalesce("higher", "top").alias("top"), "node", F.concat_ws(".", "above", "path").alias("path"), there.alias("there"))
        ways, rounds = written(ways.where("there").unionByName(step), "tree-ways"), rounds + 1
    return ways.select("node", "path")


def is_swapped_embedding(path: Column, kind: Column) -> Column:
    return (kind == EMBEDDING) & F.contains(path, F.lit(EMBED)) & (path != "")


def is_swapped_linear(path: Column, kind: Column) -> Column:
    free = F.lit(True)
    for word in EXCLUDED:
        free = free & ~F.contains(path, F.lit(word))
    return (kind == LINEAR) & free & (path != "")


def swap(modules: DataFrame, config: object | None = None) -> DataFrame:
    """The modules after quantization is switched on, with old_kind beside kind.

    Plain embeddings whose path holds EMBED and plain linear modules outside excluded paths change
    kind and take the config's group size; what is quantized already keeps its own; the root is
    never changed. A swapped module owns a fresh copy of its parameter, except that a head tied to
    the embedding table keeps the table's.
    """
    k = group_size_of(config)
    path, kind = F.col("path"), F.col("kind")
    emb, lin = is_swapped_embedding(path, kind), is_swapped_linear(path, kind)
    out = modules.withColumn("old_kind", kind)
    new_kind = F.when(emb, QUANT_EMBEDDING).when(lin, QUANT_LINEAR).otherwise(kind)
    size = F.when(emb | lin, F.lit(k)).otherwise(F.col("group_size"))
    tied_to = _tied_tables(modules)
    out = out.join(tied_to, out.path == tied_to.head_path, "left").drop("head_path")
    owner = F.when(F.col("table_param").isNotNull(), F.col("table_param")).when(emb | lin, F.col("param_id")).otherwise(F.col("owner_param_id"))
    return out.select(
        *[c for c in modules.columns if c not in ("kind", "group_size", "owner_param_id", "is_quantized")], "old_kind", new_kind.alias("kind"), size.alias("group_size"), owner.alias("owner_param_id"),
        (F.col("is_quantized") | emb | lin).alias("is_quantized"),
    )


def _tied_tables(modules: DataFrame) -> DataFrame:
    """(head_path, table_param): heads named lm_head that share the parameter of embed_tokens."""
    named = modules.select("path", "param_id", F.coalesce("owner_param_id", "param_id").alias("owner"))
    heads = named.where(F.col("path") == "lm_head").select(F.col("path").alias("head_path"), "owner")
    tables = named.where(F.col("path").isin("embed_tokens", "model.embed_tokens")).select(F.col("path").alias("table_path"), F.col("param_id").alias("table_param"), "owner")
    # Of two such tables that the head shares, the one of the shorter path.
    return heads.join(tables, "owner").groupBy("head_path").agg(F.min(F.struct(F.length("table_path"), "table_path", "table_param")).alias("t")).select("head_path", F.col("t.table_param").alias("table_param"))


def construct(modules: DataFrame, parameters: DataFrame) -> DataFrame:
    """(path, kind, group_size, n_in, n_out, row_idx, values): the rows that each quantized module of swap() owns or shares.

    modules has param_id and owner_param_id as swap() leaves them, parameters (param_id, row_idx,
    values) the masters, which stay as they are: a quantized module quantizes when it is evaluated.
    """
    rows = modules.where(F.col("kind").isin(QUANT_LINEAR, QUANT_EMBEDDING)).select("path", "kind", "group_size", F.coalesce("owner_param_id", "param_id").alias("owner"))
    shapes = parameters.groupBy("param_id").agg(F.max(F.size("values")).alias("n_in"), F.count("*").cast("int").alias("n_out"))
    shaped = rows.join(shapes, rows.owner == shapes.param_id).drop("param_id")
    return shaped.join(parameters, F.col("owner") == F.col("param_id")).select("path", "kind", "group_size", "n_in", "n_out", "row_idx", "values")


def describe(modules: DataFrame, parameters: DataFrame) -> DataFrame:
    """(path, description) of quantized linear modules, for display: inputs, outputs and that they are quantized."""
    shapes = parameters.groupBy("param_id").agg(F.max(F.size("values")).alias("n_in"), F.count("*").alias("n_out"))
    rows = modules.where(F.col("kind") == QUANT_LINEAR).select("path", F.coalesce("owner_param_id", "param_id").alias("owner"))
    return rows.join(shapes, rows.owner == shapes.param_id, "left").select("path", F.format_string("%s to %s, quantized", F.col("n_in"), F.col("n_out")).alias("description"))


def shapes(parameters: DataFrame) -> DataFrame:
    """(param_id, n_in, n_out, numel) of parameters (param_id, row_idx, values): the widest row, rows and values of each."""
    width = F.size("values")
    return parameters.groupBy("param_id").agg(F.max(width).alias("n_in"), F.count("*").cast("int").alias("n_out"), F.sum(width).cast("long").alias("numel"))


def with_shapes(modules: DataFrame, parameters: DataFrame) -> DataFrame:
    """modules with n_in, n_out and numel of the parameter that each owns or shares; a module without one has numel 0.

    Shapes are written, so parameters are read once however often the modules are.
    """
    known = written(shapes(parameters), "shapes").withColumnRenamed("param_id", "shape_of")
    rows = modules.drop("n_in", "n_out", "numel")
    joined = rows.join(known, F.coalesce(rows.owner_param_id, rows.param_id) == known.shape_of, "left").drop("shape_of")
    return joined.withColumn("numel", F.coalesce("numel", F.lit(0).cast("long")))


def parameter_counts(modules: DataFrame) -> DataFrame:
    """n_total and n_trainable values, a shared parameter counted once."""
    owned = modules.where("param_id is not null").groupBy(F.coalesce("owner_param_id", "param_id").alias("owner"))
    owned = owned.agg(F.max("numel").alias("numel"), F.max("requires_grad").alias("trains"))
    return owned.agg(F.coalesce(F.sum("numel"), F.lit(0)).alias("n_total"), F.coalesce(F.sum(F.when(F.col("trains"), F.col("numel"))), F.lit(0)).alias("n_trainable"))


def requantized_count(modules: DataFrame) -> DataFrame:
    """n: quantized modules that snapping visits, tied ones each."""
    return modules.where(F.col("kind").isin(QUANT_LINEAR, QUANT_EMBEDDING)).agg(F.count("*").alias("n"))
