"""Registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.functions import quantize as q
from gridloom.operators import adapters, evaluate, rewrite
from gridloom.sources import chat
from gridloom.sources.tables import new_folder, parameter_rows, read_parameters, table, write_parameters
from gridloom.sources.tokenize import WORDS
from gridloom.sources.weights import read_weights, write_weights

WIDTH = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"))


def _stats(k: int):
    return lambda spark, sf_dir: q.group_stats(_vectors(spark, sf_dir), "values", k, "vec_id")


def quant_codes(spark, sf_dir, k=32):
    return q.code_rows(_vectors(spark, sf_dir), "values", k, "vec_id").select("vec_id", "pos", "code")


def quant_values(spark, sf_dir, k=32):
    return q.code_rows(_vectors(spark, sf_dir), "values", k, "vec_id").select("vec_id", "pos", "q")


def quant_values_arrow(spark, sf_dir, k=32):
    rows = q.quantize_arrow(_vectors(spark, sf_dir), "values", k)
    return rows.select("vec_id", F.posexplode("values").alias("pos", "q")).withColumn("pos", F.col("pos").cast("long"))


def quant_idempotent(spark, sf_dir, k=32):
    once = _vectors(spark, sf_dir).select("vec_id", q.quantize(F.col("values"), k).alias("once"))
    both = once.select(F.explode(F.arrays_zip("once", q.quantize(F.col("once"), k).alias("twice"))).alias("v"))
    return both.agg(F.count("*").alias("n_total"), F.count_if(F.col("v.once") != F.col("v.twice")).alias("n_changed"))


def round_clamp(spark, sf_dir):
    """Codes of the account balances in thousands, and the gradient that passes through."""
    x = (F.col("c_acctbal") / 1000).alias("x")
    rows = table(spark, sf_dir, "customer").select("c_custkey", x)
    return rows.select("c_custkey", q.round_clamp(F.col("x")).cast("int").alias("code"), q.straight_through(F.col("x")).alias("gradient"))


def _weights(spark, sf_dir) -> DataFrame:
    """A row for each label: the largest value at each place, over all vectors of the label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("out_id"), F.posexplode("embedding").alias("at", "v"))
    largest = rows.groupBy("out_id", "at").agg(F.max("v").alias("v"))
    return largest.groupBy("out_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p")).select("out_id", F.transform("p", lambda s: s["v"]).alias("values"))


def linear_forward(spark, sf_dir, k=32, most=evaluate.BROADCAST_VALUES):
    weights = _weights(spark, sf_dir)
    bias = weights.select("out_id", (F.col("out_id") / 8).alias("bias"))
    x = _vectors(spark, sf_dir).select(F.col("vec_id").alias("x_id"), "values")
    y = evaluate.linear_forward(x, weights, k, bias, most)
    return y.select("x_id", "out_id", F.round("y", 5).alias("y"))


def embedding_gather(spark, sf_dir, k=32):
    """Customers as sequences of two tokens, their nation and the length of their name."""
    c = table(spark, sf_dir, "customer")
    tokens = c.select(F.col("c_custkey").alias("seq_id"), F.posexplode(F.array(F.col("c_nationkey").cast("long"), F.length("c_name").cast("long"))).alias("pos", "token_id"))
    rows = evaluate.embedding_lookup(tokens, _vectors(spark, sf_dir).withColumnRenamed("vec_id", "token_id"), k)
    rows = rows.select("seq_id", F.col("pos").cast("long").alias("pos"), F.posexplode("values").alias("dim", "q"))
    return rows.withColumn("dim", F.col("dim").cast("long"))


#: A model's modules: path, kind, param_id, owner_param_id, bias_id, is_quantized, group_size, requires_grad, numel.
REGISTRY = [
    ("", "model", None, None, None, False, None, False, 0),
    ("model", "model", None, None, None, False, None, False, 0),
    ("model.embed_tokens", "embedding", "p_embed", "p_embed", None, False, None, True, 64000),
    ("model.position", "embedding", "p_pos", "p_pos", None, False, None, True, 4096),
    ("model.layers.0.q_proj", "linear", "p_q0", "p_q0", "b_q0", False, None, True, 4096),
    ("model.layers.0.k_proj", "linear", "p_k0", "p_k0", None, False, None, True, 4096),
    ("model.layers.0.q_norm", "norm", "p_qn0", "p_qn0", None, False, None, True, 64),
    ("model.layers.0.norm_gate.proj", "linear", "p_ng0", "p_ng0", None, False, None, True, 4096),
    ("model.layers.0.Norm_out", "linear", "p_no0", "p_no0", None, False, None, False, 4096),
    ("model.layers.0.mlp.up_proj", "quant_linear", "p_up0", "p_up0", None, True, 32, True, 8192),
    ("model.layers.0.mlp.down_proj", "linear", "p_dn0", "p_dn0", None, False, None, False, 8192),
    ("model.norm", "norm", "p_norm", "p_norm", None, False, None, True, 64),
    ("lm_head", "linear", "p_head", "p_embed", None, False, None, True, 64000),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, schemas.MODULES)


#: Vectors of a layer in the model that the queries make of the embeddings.
LAYER = 16
#: Nodes: (node, parent, name, kind, parameter, parameter it shares, has a bias, is quantized, group size, trains).
TOP = [
    ("model", "root", "model", "model", None, None, False, False, None, False),
    ("embed", "model", "embed_tokens", "embedding", "p_embed", "p_embed", False, False, None, True),
    ("layers", "model", "layers", "model", None, None, False, False, None, False),
    ("norm", "model", "norm", "norm", "p_norm", "p_norm", False, False, None, True),
    ("head", "root", "lm_head", "linear", "p_head", "p_embed", False, False, None, True),
]
#: The same of each layer, below its node; parameters are a letter, and the layer's vectors that are its rows.
LAYER_NODES = [
    ("q", "", "q_proj", "linear", "q", True, False, None, True), ("k", "", "k_proj", "linear", "k", False, False, None, True),
    ("qn", "", "q_norm", "norm", "n", False, False, None, True), ("ng", "", "norm_gate", "model", None, False, False, None, False),
    ("ngp", "ng", "proj", "linear", "g", False, False, None, True), ("mlp", "", "mlp", "model", None, False, False, None, False),
    ("up", "mlp", "up_proj", "quant_linear", "u", False, True, 32, True), ("dn", "mlp", "down_proj", "linear", "d", False, False, None, False),
]
PARAMETER_ROWS = {"q": (0, 6), "k": (6, 10), "u": (10, 13), "d": (13, 16), "n": (0, 1), "g": (0, 2)}
_LAYER_NODE = [*((c, "string") for c in ("suffix", "below", "name", "kind", "letter")), ("has_bias", "boolean"), ("is_quantized", "boolean"), ("group_size", "int"), ("requires_grad", "boolean")]
_NODE = "node string, parent string, name string, kind string, param_id string, owner_param_id string, has_bias boolean, is_quantized boolean, group_size int, requires_grad boolean"


def _nodes(spark, sf_dir) -> DataFrame:
    """The nodes of a model that has a layer for every LAYER vectors: node, its parent and name, and what is known of its module."""
    layers = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / LAYER).cast("string").alias("l")).distinct()
    at = layers.select(F.concat(F.lit("L"), "l").alias("node"), F.lit("layers").alias("parent"), F.col("l").alias("name"), F.lit("model").alias("kind"))
    at = at.selectExpr("*", "cast(null as string) as param_id", "cast(null as string) as owner_param_id", "false as has_bias", "false as is_quantized", "cast(null as int) as group_size", "false as requires_grad")
    kinds = F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(node, _LAYER_NODE)]) for node in LAYER_NODES])).alias("k")
    inside = layers.select("l", kinds).select("l", "k.*")
    param = F.when(F.col("letter").isNotNull(), F.concat(F.lit("p_"), "letter", "l"))
    node, parent = F.concat(F.lit("L"), "l", F.lit("."), "suffix"), F.concat(F.lit("L"), "l", F.when(F.col("below") == "", "").otherwise(F.concat(F.lit("."), "below")))
    inside = inside.select(node.alias("node"), parent.alias("parent"), "name", "kind", param.alias("param_id"), param.alias("owner_param_id"), "has_bias", "is_quantized", "group_size", "requires_grad")
    return spark.createDataFrame(TOP, _NODE).unionByName(at).unionByName(inside)


def _model_parameters(spark, sf_dir) -> DataFrame:
    """The parameters of that model, written as weight files and read back: the table of all vectors, and each layer's."""
    rows = _vectors(spark, sf_dir)
    whole = parameter_rows(rows, "p_embed", "vec_id", "values").unionByName(parameter_rows(rows.where("vec_id = 0"), "p_norm", "vec_id", "values"))
    place = F.col("vec_id") % LAYER
    letters = [F.when((place >= a) & (place < b), F.struct(F.lit(letter).alias("letter"), (place - a).alias("row"))) for letter, (a, b) in PARAMETER_ROWS.items()]
    inside = rows.select("vec_id", "values", F.explode(F.filter(F.array(*letters), lambda x: x.isNotNull())).alias("of"))
    param = F.concat(F.lit("p_"), "of.letter", F.floor(F.col("vec_id") / LAYER).cast("string"))
    inside = inside.select(param.alias("param_id"), F.col("of.row").alias("row_idx"), F.col("values").cast("array<float>").alias("values"))
    path = new_folder(spark, "model")
    write_weights(whole.unionByName(inside), path)
    return read_weights(spark, path)


def _modules(spark, sf_dir) -> DataFrame:
    """The model's modules by their paths, walked from the edges, with the sizes of the written parameters."""
    nodes = _nodes(spark, sf_dir)
    rows = rewrite.walk(nodes.select("parent", "node", "name")).join(nodes, "node")
    bias = F.when(F.col("has_bias"), F.concat(F.col("param_id"), F.lit("_bias"))).alias("bias_id")
    return rewrite.with_shapes(rows.select("path", "kind", "param_id", "owner_param_id", bias, "is_quantized", "group_size", "requires_grad"), _model_parameters(spark, sf_dir))


def swap_plan(spark, sf_dir, k=64):
    out = rewrite.swap(_modules(spark, sf_dir), q.QuantConfig(k))
    return out.select("path", "old_kind", F.col("kind").alias("new_kind"), "group_size", "owner_param_id")


def param_counts(spark, sf_dir):
    return rewrite.parameter_counts(_modules(spark, sf_dir))


def requant_count(spark, sf_dir):
    return rewrite.requantized_count(rewrite.swap(_modules(spark, sf_dir), q.QuantConfig(64)))


def adapter_targets(spark, sf_dir):
    return adapters.attach(_modules(spark, sf_dir)).select("path", "kind", "n_in", "n_out")


#: Adapters' rank, scale and group size in the queries: 32 divides A's width (64) and not B's (2).
RANK, ALPHA, ADAPTER_K = 2, 4.0, 32


def _adapters(spark, sf_dir) -> DataFrame:
    """For each label a module: A holds the largest and least values at each place, B the first two values of each vector."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("module_path"), F.posexplode("embedding").alias("at", "v"))
    ends = rows.groupBy("module_path", "at").agg(F.max("v").alias("high"), F.min("v").alias("low"))
    packed = ends.groupBy("module_path").agg(F.array_sort(F.collect_list(F.struct("at", "high", "low"))).alias("p"))
    a = packed.select("module_path", F.posexplode(F.array(F.transform("p", lambda s: s["high"]), F.transform("p", lambda s: s["low"]))).alias("row_idx", "values"))
    b = e.select(F.col("label").cast("string").alias("module_path"), F.col("vec_id").alias("row_idx"), F.slice("embedding", 1, RANK).alias("values"))
    a = a.select("module_path", F.lit("default").alias("adapter_name"), F.lit("A").alias("side"), F.col("row_idx").cast("long").alias("row_idx"), "values")
    return a.unionByName(b.select("module_path", F.lit("default").alias("adapter_name"), F.lit("B").alias("side"), "row_idx", "values"))


def _base(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("module_path"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("values"))


def adapter_quant(spark, sf_dir):
    rows = adapters.quantize_adapters(_adapters(spark, sf_dir), ADAPTER_K)
    rows = rows.select(F.col("module_path").alias("module"), "side", F.col("row_idx").alias("row"), F.posexplode("values").alias("pos", "q"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def adapter_touch_count(spark, sf_dir):
    return adapters.touched_count(_adapters(spark, sf_dir), ADAPTER_K)


def _merged(spark, sf_dir) -> DataFrame:
    return adapters.merge(_base(spark, sf_dir), adapters.quantize_adapters(_adapters(spark, sf_dir), ADAPTER_K), ALPHA, RANK)


def adapter_merge(spark, sf_dir):
    rows = _merged(spark, sf_dir).select(F.col("module_path").alias("module"), F.col("row_idx").alias("row"), F.posexplode("values").alias("pos", "w"))
    return rows.select("module", "row", F.col("pos").cast("long").alias("pos"), F.round(F.col("w").cast("double"), 5).alias("w"))


def save_pipeline(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("path")).distinct()
    modules = labels.select("path", F.lit(rewrite.QUANT_LINEAR).alias("kind"), F.lit(ADAPTER_K).alias("group_size"))
    out = adapters.save_pipeline(_base(spark, sf_dir), _adapters(spark, sf_dir), modules, ALPHA, RANK, ADAPTER_K)
    rows = out.select(F.col("module_path").alias("module"), F.col("row_idx").alias("row"), F.posexplode("values").alias("pos", "q"))
    return rows.select("module", "row", F.col("pos").cast("long").alias("pos"), F.round(F.col("q").cast("double"), 5).alias("q"))


#: A second adapter of the same modules: its rank and alpha.
SECOND = 4, 3.0


def _two_adapters(spark, sf_dir) -> DataFrame:
    """The adapters of _adapters(), and a second one of another rank: A holds the modules' vectors of least ids, B places 5 to 8 of each vector."""
    first = _adapters(spark, sf_dir).withColumns({"r": F.lit(RANK), "alpha": F.lit(ALPHA)})
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("module_path"), "vec_id", "embedding")
    least = e.groupBy("module_path").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, SECOND[0]).alias("ids")).select("module_path", F.posexplode("ids").alias("row_idx", "vec_id"))
    a = least.join(e, ["module_path", "vec_id"]).select("module_path", F.lit("A").alias("side"), F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").alias("values"))
    b = e.select("module_path", F.lit("B").alias("side"), F.col("vec_id").alias("row_idx"), F.slice("embedding", 5, SECOND[0]).alias("values"))
    second = a.unionByName(b).withColumns({"adapter_name": F.lit("second"), "r": F.lit(SECOND[0]), "alpha": F.lit(SECOND[1])})
    return first.unionByName(second)


def adapter_merge_ranks(spark, sf_dir):
    """Two adapters of each module merged, each by its own rank and alpha."""
    rows = adapters.merge(_base(spark, sf_dir), adapters.quantize_adapters(_two_adapters(spark, sf_dir), ADAPTER_K))
    rows = rows.select(F.col("module_path").alias("module"), F.col("row_idx").alias("row"), F.posexplode("values").alias("pos", "w"))
    return rows.select("module", "row", F.col("pos").cast("long").alias("pos"), F.round(F.col("w").cast("double"), 5).alias("w"))


def save_pipeline_ranks(spark, sf_dir):
    """Two adapters of each module quantized and merged by their own scales, the result snapped and written."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("path")).distinct()
    modules = labels.select("path", F.lit(rewrite.QUANT_LINEAR).alias("kind"), F.lit(ADAPTER_K).alias("group_size"))
    out = adapters.save_pipeline(_base(spark, sf_dir), _two_adapters(spark, sf_dir), modules, k=ADAPTER_K, path=new_folder(spark, "saved"))
    rows = out.select(F.col("module_path").alias("module"), F.col("row_idx").alias("row"), F.posexplode("values").alias("pos", "q"))
    return rows.select("module", "row", F.col("pos").cast("long").alias("pos"), F.round(F.col("q").cast("double"), 4).alias("q"))


def _turns(spark, sf_dir) -> DataFrame:
    """conversations under source role names: the fixture has the roles that they become."""
    source = F.col("role")
    for name, role in chat.ROLES.items():
        source = F.when(F.col("role") == role, F.lit(name)).otherwise(source)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", source.alias("from"), F.col("text").alias("value"))


def _chats(spark, sf_dir) -> DataFrame:
    return chat.from_turns(_turns(spark, sf_dir))


def chat_role_map(spark, sf_dir):
    rows = _chats(spark, sf_dir).select("conv_id", F.posexplode(chat.messages(F.col("conversations"))).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


def chat_render(spark, sf_dir):
    rows = _chats(spark, sf_dir).select("conv_id", chat.messages(F.col("conversations")).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_msgs"), chat.render(F.col("m")).alias("full_text"), chat.prompt(F.col("m")).alias("prompt_text"))


def chat_labels(spark, sf_dir):
    rows = chat.prepare(_chats(spark, sf_dir)).select("conv_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "v"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("v.input_ids").alias("input_id"), F.col("v.labels").alias("label"))


def chat_labels_arrow(spark, sf_dir):
    """The same examples by a tokenizer in Arrow batches."""
    rows = chat.prepare_arrow(_chats(spark, sf_dir), WORDS).select("conv_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "v"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("v.input_ids").alias("input_id"), F.col("v.labels").alias("label"))


def chat_metrics(spark, sf_dir, longest=64):
    """What preparing the examples counted by the way."""
    seen = Observation("chat")
    chat.watched(chat.prepare(_chats(spark, sf_dir), longest=longest), seen, longest).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[m] for m in chat.METRICS)], ", ".join(f"{m} long" for m in chat.METRICS))


def chat_batches(spark, sf_dir, budget=chat.BUDGET):
    """Every example's batch, and how many tokens of the batch have loss."""
    return chat.batches(chat.prepare(_chats(spark, sf_dir)), budget)


def chat_first_300(spark, sf_dir, n=300):
    return chat.from_turns(chat.first_turns(_turns(spark, sf_dir), n)).select("conv_id", F.size("conversations").cast("long").alias("n_msgs"))


def _parameters(spark, sf_dir) -> DataFrame:
    """The embedding table as p_embed and the label weights as p_q0, written and read back."""
    path = new_folder(spark, "parameters")
    embed = parameter_rows(_vectors(spark, sf_dir), "p_embed", "vec_id", "values")
    write_parameters(embed.unionByName(parameter_rows(_weights(spark, sf_dir), "p_q0", "out_id", "values")), path)
    return read_parameters(spark, path)


def parameter_round_trip(spark, sf_dir):
    """Every value of the written parameters."""
    rows = _parameters(spark, sf_dir).select("param_id", "row_idx", F.posexplode("values").alias("pos", "w"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def weight_file_round_trip(spark, sf_dir):
    """The same values through weight files: written by range of (param_id, row_idx), read back by byte range."""
    path = new_folder(spark, "weights")
    embed = parameter_rows(_vectors(spark, sf_dir), "p_embed", "vec_id", "values")
    write_weights(embed.unionByName(parameter_rows(_weights(spark, sf_dir), "p_q0", "out_id", "values")), path)
    rows = read_weights(spark, path).select("param_id", "row_idx", F.posexplode("values").alias("pos", "w"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def construct_modules(spark, sf_dir, k=64):
    """What the quantized modules hold and give: the shared table, its head and a projection, quantized."""
    rows = rewrite.construct(rewrite.swap(registry(spark), q.QuantConfig(k)), _parameters(spark, sf_dir))
    rows = rows.select("path", "kind", "n_in", "n_out", "row_idx", F.posexplode(q.quantize(F.col("values"), k)).alias("pos", "q"))
    return rows.withColumns({"n_out": F.col("n_out").cast("long"), "pos": F.col("pos").cast("long")})


def describe_modules(spark, sf_dir):
    known = _parameters(spark, sf_dir)
    return rewrite.describe(rewrite.swap(registry(spark), q.QuantConfig(64)), known).where("path in ('lm_head', 'model.layers.0.q_proj')")


ADAPTER_R = 4


def adapter_rows(spark, sf_dir):
    """Fresh adapters of the model's targets that have parameters, of their shapes."""
    rows = adapters.init_adapters(_modules(spark, sf_dir).where("numel > 0"), ADAPTER_R, 8.0).select("module_path", "side", "row_idx", "r", "alpha", F.posexplode("values").alias("pos", "w"))
    return rows.withColumns({"pos": F.col("pos").cast("long"), "w": F.round(F.col("w").cast("double"), 6)})


def quant_default(spark, sf_dir):
    """Vectors of twice the width, each with its own values in reverse after them, at the default group size."""
    wide = _vectors(spark, sf_dir).select("vec_id", F.concat("values", F.reverse("values")).alias("values"))
    rows = wide.select("vec_id", F.posexplode(q.quantize(F.col("values"))).alias("pos", "q"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def linear_forward_default(spark, sf_dir):
    """The linear map at the default group size, on vectors and weights of twice the width."""
    double = lambda df, key, name: df.select(F.col(key).alias(name), F.concat("values", F.reverse("values")).alias("values"))
    y = evaluate.linear_forward(double(_vectors(spark, sf_dir), "vec_id", "x_id"), double(_weights(spark, sf_dir), "out_id", "out_id"), most=0)
    return y.select("x_id", "out_id", F.round("y", 5).alias("y"))


def chat_first_30(spark, sf_dir):
    return chat_first_300(spark, sf_dir, 30)


def chat_labels_64(spark, sf_dir, longest=64):
    rows = chat.prepare(_chats(spark, sf_dir), longest=longest).select("conv_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "v"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("v.input_ids").alias("input_id"), F.col("v.labels").alias("label"))


QUERIES = {
    "quant_group_stats_k64": _stats(64), "quant_group_stats_k32": _stats(32), "quant_group_stats_k16": _stats(16), "round_clamp": round_clamp,
    "quant_codes_k32": quant_codes, "quant_values_k32": quant_values, "quant_values_arrow_k32": quant_values_arrow, "quant_idempotent_k32": quant_idempotent,
    "linear_forward": linear_forward, "linear_forward_join": lambda spark, sf_dir: linear_forward(spark, sf_dir, most=0), "embedding_gather": embedding_gather,
    "swap_plan": swap_plan, "param_counts": param_counts, "requant_count": requant_count, "adapter_targets": adapter_targets,
    "adapter_quant": adapter_quant, "adapter_touch_count": adapter_touch_count, "adapter_merge": adapter_merge, "save_pipeline": save_pipeline,
    "adapter_merge_ranks": adapter_merge_ranks, "save_pipeline_ranks": save_pipeline_ranks,
    "chat_role_map": chat_role_map, "chat_render": chat_render, "chat_labels": chat_labels, "chat_labels_arrow": chat_labels_arrow, "chat_metrics": chat_metrics, "chat_batches": chat_batches, "chat_first_300": chat_first_300,
    "parameter_round_trip": parameter_round_trip, "weight_file_round_trip": weight_file_round_trip, "construct_modules": construct_modules, "describe_modules": describe_modules, "adapter_rows": adapter_rows,
    "quant_default": quant_default, "linear_forward_default": linear_forward_default, "chat_first_30": chat_first_30, "chat_labels_64": chat_labels_64,
}


def _long(k: int, source: str = "SELECT vec_id, embedding AS v FROM embeddings") -> str:
    """CTEs for a row for each value: vec_id, pos, w, alpha, code."""
    return f"""src AS ({source}),
cut AS (SELECT vec_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, unnest(v)::FLOAT AS w FROM src),
scaled AS (SELECT *, pos // {k} AS g, greatest(max(abs(w)) OVER (PARTITION BY vec_id, pos // {k}), 1e-8::FLOAT) AS alpha FROM cut),
coded AS (SELECT *, round_even(w::DOUBLE / alpha::DOUBLE, 0)::INTEGER AS code FROM scaled)"""


def _stats_sql(k: int) -> str:
    return f"WITH {_long(k)} SELECT vec_id, g, any_value(alpha) AS alpha, count(*) FILTER (code = -1) AS n_neg, count(*) FILTER (code = 0) AS n_zero, count(*) FILTER (code = 1) AS n_pos FROM coded GROUP BY vec_id, g"


_VALUES_SQL = f"WITH {_long(32)} SELECT vec_id, pos, (code * alpha)::FLOAT AS q FROM coded"


_show = lambda x: "NULL" if x is None else (str(x).lower() if isinstance(x, bool) else (f"'{x}'" if isinstance(x, str) else str(x)))
_values = lambda rows: ", ".join("(" + ", ".join(map(_show, r)) + ")" for r in rows)


def _rows_sql() -> str:
    return f"modules(path, kind, param_id, owner_param_id, bias_id, is_quantized, group_size, requires_grad, numel) AS (VALUES {_values(REGISTRY)})"


_SWAP_SQL = f"""WITH {_rows_sql()}, s AS (
  SELECT *, CASE WHEN path = '' THEN kind WHEN kind = 'embedding' AND path LIKE '%embed%' THEN 'quant_embedding'
                 WHEN kind = 'linear' AND path NOT LIKE '%norm%' THEN 'quant_linear' ELSE kind END AS new_kind FROM modules)
SELECT path, kind AS old_kind, new_kind, (CASE WHEN new_kind <> kind THEN 64 ELSE group_size END)::INTEGER AS group_size,
       CASE WHEN path = 'lm_head' THEN 'p_embed' WHEN new_kind <> kind THEN param_id ELSE owner_param_id END AS owner_param_id FROM s"""

_MODEL_SQL = f"""l AS (SELECT DISTINCT (vec_id // {LAYER})::VARCHAR AS l FROM embeddings),
t(node, parent, name, kind, param_id, owner, has_bias, is_quantized, group_size, requires_grad) AS (VALUES {_values(TOP)}),
i(suffix, below, name, kind, letter, has_bias, is_quantized, group_size, requires_grad) AS (VALUES {_values(LAYER_NODES)}),
nodes AS (SELECT * REPLACE (group_size::INTEGER AS group_size) FROM t UNION ALL SELECT 'L' || l, 'layers', l, 'model', NULL, NULL, false, false, NULL, false FROM l
  UNION ALL SELECT 'L' || l || '.' || suffix, 'L' || l || CASE WHEN below = '' THEN '' ELSE '.' || below END, name, kind, 'p_' || letter || l, 'p_' || letter || l, has_bias, is_quantized, group_size, requires_grad FROM l, i),
walked AS (SELECT node, name AS path FROM nodes WHERE parent = 'root' UNION ALL SELECT n.node, w.path || '.' || n.name FROM walked w JOIN nodes n ON n.parent = w.node),
pr(letter, a, b) AS (VALUES {_values((k, *v) for k, v in PARAMETER_ROWS.items())}),
pars AS (SELECT 'p_embed' AS param_id, len(embedding) AS n FROM embeddings UNION ALL SELECT 'p_norm', len(embedding) FROM embeddings WHERE vec_id = 0
  UNION ALL SELECT 'p_' || letter || vec_id // {LAYER}, len(embedding) FROM embeddings JOIN pr ON vec_id % {LAYER} >= a AND vec_id % {LAYER} < b),
sh AS (SELECT param_id, max(n)::INTEGER AS n_in, count(*)::INTEGER AS n_out, sum(n)::BIGINT AS numel FROM pars GROUP BY param_id),
modules AS (SELECT w.path, n.*, sh.n_in, sh.n_out, coalesce(sh.numel, 0) AS numel FROM walked w JOIN nodes n USING (node) LEFT JOIN sh ON sh.param_id = n.owner)"""
_MODEL_SWAP_SQL = f"""WITH RECURSIVE {_MODEL_SQL}, s AS (SELECT *, CASE WHEN kind = 'embedding' AND path LIKE '%embed%' THEN 'quant_embedding' WHEN kind = 'linear' AND path NOT LIKE '%norm%' THEN 'quant_linear' ELSE kind END AS new_kind FROM modules)
SELECT path, kind AS old_kind, new_kind, (CASE WHEN new_kind <> kind THEN 64 ELSE group_size END)::INTEGER AS group_size, CASE WHEN path = 'lm_head' THEN 'p_embed' WHEN new_kind <> kind THEN param_id ELSE owner END AS owner_param_id FROM s"""
_TARGETS_SQL = "regexp_matches(path, '(^|[.])(q_proj|k_proj|v_proj|o_proj|gate_proj|up_proj|down_proj)$')"

_ADAPTER_SQL = f"""e AS (SELECT label::VARCHAR AS module, vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::FLOAT AS v FROM embeddings),
ends AS (SELECT module, pos, max(v) AS high, min(v) AS low FROM e GROUP BY module, pos),
a AS (SELECT module, 0::BIGINT AS r, pos, high AS v FROM ends UNION ALL SELECT module, 1, pos, low FROM ends),
s AS (SELECT *, greatest(max(abs(v)) OVER (PARTITION BY module, r, pos // {ADAPTER_K}), 1e-8::FLOAT) AS alpha FROM a),
aq AS (SELECT module, r, pos, (round_even(v::DOUBLE / alpha::DOUBLE, 0) * alpha + 0.0)::FLOAT AS q FROM s),
b AS (SELECT module, vec_id, pos AS r, v FROM e WHERE pos < {RANK})"""
_MERGE_SQL = f"""{_ADAPTER_SQL},
m AS (SELECT e.module, e.vec_id, e.pos, (e.v::DOUBLE + (b0.v::DOUBLE * a0.q::DOUBLE + b1.v::DOUBLE * a1.q::DOUBLE) * {ALPHA / RANK})::FLOAT AS w FROM e
  JOIN b b0 ON b0.vec_id = e.vec_id AND b0.module = e.module AND b0.r = 0 JOIN b b1 ON b1.vec_id = e.vec_id AND b1.module = e.module AND b1.r = 1
  JOIN aq a0 ON a0.module = e.module AND a0.pos = e.pos AND a0.r = 0 JOIN aq a1 ON a1.module = e.module AND a1.pos = e.pos AND a1.r = 1)"""

_CHAT_SQL = """m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS body FROM conversations),
r AS (SELECT conv_id, any_value(n)::BIGINT AS n_msgs, string_agg(body, '' ORDER BY turn) AS full_text,
  coalesce(string_agg(body, '' ORDER BY turn) FILTER (k < n - 1), '') || '<|im_start|>assistant' || chr(10) AS prompt_text FROM m GROUP BY conv_id)"""

def _labels_sql(longest: int) -> str:
    return f"""WITH {_CHAT_SQL},
w AS (SELECT conv_id, list_filter(regexp_split_to_array(full_text, '\\s+'), lambda x: x <> '')[1:{longest}] AS ids,
  least(len(list_filter(regexp_split_to_array(prompt_text, '\\s+'), lambda x: x <> '')), {longest}) AS p FROM r),
x AS (SELECT conv_id, p, ids, unnest(range(greatest(len(ids), p))) AS pos FROM w),
y AS (SELECT conv_id, pos, p, ids, CASE WHEN pos < len(ids) THEN ('0x' || substr(md5(ids[pos + 1]), 1, 6))::BIGINT END AS input_id FROM x)
SELECT conv_id, pos::BIGINT AS pos, input_id, CASE WHEN pos < p THEN {chat.IGNORED} ELSE input_id END::BIGINT AS label FROM y"""


ORACLES = {
    **{f"quant_group_stats_k{k}": _stats_sql(k) for k in (64, 32, 16)},
    "round_clamp": "SELECT c_custkey, greatest(-1, least(1, round_even(c_acctbal / 1000, 0)))::INTEGER AS code, c_acctbal / 1000 AS gradient FROM customer",
    "quant_codes_k32": f"WITH {_long(32)} SELECT vec_id, pos, code FROM coded",
    "quant_values_k32": _VALUES_SQL,
    "quant_values_arrow_k32": _VALUES_SQL,
    "quant_idempotent_k32": "SELECT sum(len(embedding))::BIGINT AS n_total, 0::BIGINT AS n_changed FROM embeddings",
    "embedding_gather": f"""WITH {_long(32)},
t AS (SELECT c_custkey AS seq_id, 0::BIGINT AS pos, c_nationkey::BIGINT AS token_id FROM customer UNION ALL SELECT c_custkey, 1, length(c_name) FROM customer)
SELECT t.seq_id, t.pos, c.pos AS dim, (c.code * c.alpha)::FLOAT AS q FROM t JOIN coded c ON c.vec_id = t.token_id""",
    "swap_plan": _MODEL_SWAP_SQL,
    "param_counts": f"""WITH RECURSIVE {_MODEL_SQL}, o AS (SELECT owner, max(numel) AS numel, bool_or(requires_grad) AS t FROM modules WHERE param_id IS NOT NULL GROUP BY 1)
SELECT sum(numel)::BIGINT AS n_total, sum(numel) FILTER (t)::BIGINT AS n_trainable FROM o""",
    "requant_count": f"SELECT count(*) AS n FROM ({_MODEL_SWAP_SQL}) WHERE new_kind LIKE 'quant%'",
    "adapter_targets": f"WITH RECURSIVE {_MODEL_SQL} SELECT path, kind, n_in, n_out FROM modules WHERE {_TARGETS_SQL}",
    "adapter_quant": f"WITH {_ADAPTER_SQL} SELECT module, 'A' AS side, r AS row, pos, q FROM aq UNION ALL SELECT module, 'B', vec_id, r, v FROM b",
    "adapter_touch_count": "SELECT count(DISTINCT label) AS n FROM embeddings",
    "adapter_merge": f"WITH {_MERGE_SQL} SELECT module, vec_id AS row, pos, round(w::DOUBLE, 5) AS w FROM m",
    "save_pipeline": f"""WITH {_MERGE_SQL}, z AS (SELECT *, greatest(max(abs(w)) OVER (PARTITION BY vec_id, pos // {ADAPTER_K}), 1e-8::FLOAT) AS alpha FROM m)
SELECT module, vec_id AS row, pos, round((round_even(w::DOUBLE / alpha::DOUBLE, 0) * alpha)::FLOAT::DOUBLE, 5) + 0.0 AS q FROM z""",
    "chat_role_map": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn, role, text AS content FROM conversations",
    "chat_render": f"WITH {_CHAT_SQL} SELECT * FROM r",
    "chat_labels": _labels_sql(chat.LONGEST),
    "chat_labels_arrow": _labels_sql(chat.LONGEST),
    "chat_batches": f"""WITH RECURSIVE z AS (SELECT conv_id, count(input_id) AS n_tokens, count(*) FILTER (label <> {chat.IGNORED}) AS n_kept, count(*) AS n_labels FROM ({_labels_sql(chat.LONGEST)}) GROUP BY conv_id),
g AS (SELECT *, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {chat.PACKED})::BIGINT) FROM z) AS grp FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n_tokens DESC, conv_id, n_kept, n_labels) - 1 AS k FROM g),
s AS (SELECT grp, 0::BIGINT AS start, 0 AS b, greatest(1, {chat.BUDGET} // greatest(1, n_tokens)) AS size FROM o WHERE k = 0
  UNION ALL SELECT s.grp, s.start + s.size, b + 1, greatest(1, {chat.BUDGET} // greatest(1, o.n_tokens)) FROM s JOIN o ON o.grp = s.grp AND o.k = s.start + s.size)
SELECT conv_id, o.grp || '-' || b AS batch_id, (k - start)::INTEGER AS place, n_tokens::INTEGER AS n_tokens, (max(n_tokens) OVER w)::INTEGER AS padded, (sum(n_tokens) OVER w)::INTEGER AS batch_tokens,
  (sum(n_kept) OVER w)::INTEGER AS batch_kept, (sum(n_labels - n_kept) OVER w)::INTEGER AS batch_masked FROM o JOIN s ON o.grp = s.grp AND o.k >= s.start AND o.k < s.start + s.size WINDOW w AS (PARTITION BY o.grp, b)""",
    "chat_metrics": f"""SELECT count(DISTINCT conv_id) AS n_examples, (SELECT count(*) FILTER (n >= 64) FROM (SELECT count(input_id) AS n FROM ({_labels_sql(64)}) GROUP BY conv_id)) AS n_truncated, count(input_id) AS n_tokens,
  count(*) FILTER (label <> {chat.IGNORED}) AS n_kept, count(*) FILTER (label = {chat.IGNORED}) AS n_masked, (SELECT max(n) FROM (SELECT count(input_id) AS n FROM ({_labels_sql(64)}) GROUP BY conv_id))::BIGINT AS longest FROM ({_labels_sql(64)})""",
    "chat_labels_64": _labels_sql(64),
    "chat_first_30": "SELECT conv_id, count(*) AS n_msgs FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 30",
    "chat_first_300": "SELECT conv_id, count(*) AS n_msgs FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 300",
}
_FORWARD_SQL = f"""WITH {_long(32, "SELECT out_id AS vec_id, list(v ORDER BY pos) AS v FROM (SELECT label::BIGINT AS out_id, pos, max(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1")},
x AS (SELECT vec_id AS x_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::FLOAT AS v FROM embeddings)
SELECT x.x_id, c.vec_id AS out_id, round(sum(x.v::DOUBLE * (c.code * c.alpha)::FLOAT::DOUBLE) + any_value(c.vec_id / 8), 5) + 0.0 AS y FROM x JOIN coded c USING (pos) GROUP BY 1, 2"""
ORACLES |= {"linear_forward": _FORWARD_SQL, "linear_forward_join": _FORWARD_SQL}
_PARAMETERS_SQL = """p AS (SELECT 'p_embed' AS param_id, vec_id AS row_idx, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::FLOAT AS w FROM embeddings
  UNION ALL SELECT 'p_q0', label::BIGINT, pos, max(w) FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::FLOAT AS w FROM embeddings) GROUP BY label, pos)"""
_OWNERS_SQL = f"o AS (SELECT path, new_kind AS kind, group_size, owner_param_id AS owner FROM ({_SWAP_SQL}) WHERE new_kind LIKE 'quant%')"
_SHAPES_SQL = "s AS (SELECT param_id, max(pos)::INTEGER + 1 AS n_in, count(DISTINCT row_idx) AS n_out FROM p GROUP BY param_id)"
_WIDE_SQL = "SELECT vec_id, list_concat(embedding, list_reverse(embedding)) AS v FROM embeddings"
ORACLES |= {
    "parameter_round_trip": f"WITH {_PARAMETERS_SQL} SELECT * FROM p",
    "weight_file_round_trip": f"WITH {_PARAMETERS_SQL} SELECT * FROM p",
    "construct_modules": f"""WITH {_PARAMETERS_SQL}, {_OWNERS_SQL}, {_SHAPES_SQL},
z AS (SELECT *, greatest(max(abs(w)) OVER (PARTITION BY param_id, row_idx, pos // 64), 1e-8::FLOAT) AS alpha FROM p)
SELECT o.path, o.kind, s.n_in, s.n_out, z.row_idx, z.pos, (round_even(w::DOUBLE / alpha::DOUBLE, 0) * alpha + 0.0)::FLOAT AS q FROM o JOIN s ON s.param_id = o.owner JOIN z ON z.param_id = o.owner""",
    "describe_modules": f"WITH {_PARAMETERS_SQL}, {_OWNERS_SQL}, {_SHAPES_SQL} SELECT path, n_in || ' to ' || n_out || ', quantized' AS description FROM o JOIN s ON s.param_id = o.owner WHERE path IN ('lm_head', 'model.layers.0.q_proj')",
    "adapter_rows": f"""WITH RECURSIVE {_MODEL_SQL}, t2 AS (SELECT path, n_out FROM modules WHERE numel > 0 AND {_TARGETS_SQL}),
a AS (SELECT path, r, unnest(range(64)) AS pos FROM (SELECT path, unnest(range({ADAPTER_R})) AS r FROM t2)),
b AS (SELECT path, r, unnest(range({ADAPTER_R})) AS pos FROM (SELECT path, unnest(range(n_out)) AS r FROM t2))
SELECT path AS module_path, 'A' AS side, r AS row_idx, {ADAPTER_R}::INTEGER AS r, 8.0::DOUBLE AS alpha, pos, round(((('0x' || substr(md5(path || '|' || r || '|' || pos), 1, 8))::BIGINT / 4294967296.0 * 2 - 1) / 8)::FLOAT::DOUBLE, 6) AS w FROM a
UNION ALL SELECT path, 'B', r, {ADAPTER_R}, 8.0, pos, 0.0 FROM b""",
    "quant_default": f"WITH {_long(128, _WIDE_SQL)} SELECT vec_id, pos, (code * alpha)::FLOAT AS q FROM coded",
    "linear_forward_default": f"""WITH {_long(128, "SELECT out_id AS vec_id, list_concat(v, list_reverse(v)) AS v FROM (SELECT out_id, list(v ORDER BY pos) AS v FROM (SELECT label::BIGINT AS out_id, pos, max(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1)")},
x AS (SELECT vec_id AS x_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, unnest(v)::FLOAT AS v FROM ({_WIDE_SQL}))
SELECT x.x_id, c.vec_id AS out_id, round(sum(x.v::DOUBLE * (c.code * c.alpha)::FLOAT::DOUBLE), 5) + 0.0 AS y FROM x JOIN coded c USING (pos) GROUP BY 1, 2""",
}
_RANKS_SQL = f"""{_ADAPTER_SQL},
l AS (SELECT label::VARCHAR AS module, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings QUALIFY r < {SECOND[0]}),
a2 AS (SELECT l.module, l.r, e.pos, e.v, greatest(max(abs(e.v)) OVER (PARTITION BY l.module, l.r, e.pos // {ADAPTER_K}), 1e-8::FLOAT) AS alpha FROM l JOIN e USING (module, vec_id)),
p AS (SELECT module, r, pos, q, {ALPHA / RANK}::DOUBLE AS scale, 'x' AS name FROM aq
  UNION ALL SELECT module, r, pos, (round_even(v::DOUBLE / alpha::DOUBLE, 0) * alpha + 0.0)::FLOAT, {SECOND[1] / SECOND[0]}, 'y' FROM a2),
f AS (SELECT module, vec_id, r, v, 'x' AS name FROM b UNION ALL SELECT module, vec_id, pos - 4, v, 'y' FROM e WHERE pos BETWEEN 4 AND {3 + SECOND[0]}),
d AS (SELECT f.module, f.vec_id, p.pos, sum(f.v::DOUBLE * p.scale * p.q::DOUBLE) AS delta FROM f JOIN p USING (module, r, name) GROUP BY ALL),
m AS (SELECT e.module, e.vec_id, e.pos, (e.v::DOUBLE + d.delta)::FLOAT AS w FROM e JOIN d USING (module, vec_id, pos))"""
ORACLES |= {
    "adapter_merge_ranks": f"WITH {_RANKS_SQL} SELECT module, vec_id AS row, pos, round(w::DOUBLE, 5) AS w FROM m",
    "save_pipeline_ranks": f"""WITH {_RANKS_SQL}, z AS (SELECT *, greatest(max(abs(w)) OVER (PARTITION BY module, vec_id, pos // {ADAPTER_K}), 1e-8::FLOAT) AS alpha FROM m)
SELECT module, vec_id AS row, pos, round((round_even(w::DOUBLE / alpha::DOUBLE, 0) * alpha)::FLOAT::DOUBLE, 4) + 0.0 AS q FROM z""",
}
