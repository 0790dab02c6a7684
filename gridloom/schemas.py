"""Schemas of the relations that stand for a model's parameters, modules, adapters and chat records."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

PARAMETERS = T.StructType([T.StructField("param_id", T.StringType(), False), T.StructField("row_idx", T.LongType(), False), T.StructField("values", VECTOR, False)])

MODULES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("param_id", T.StringType(), True),
    T.StructField("owner_param_id", T.StringType(), True),
    T.StructField("bias_id", T.StringType(), True),
    T.StructField("is_quantized", T.BooleanType(), False),
    T.StructField("group_size", T.IntegerType(), True),
    T.StructField("requires_grad", T.BooleanType(), False),
    T.StructField("numel", T.LongType(), False),
])

ADAPTERS = T.StructType([
    T.StructField("module_path", T.StringType(), False),
    T.StructField("adapter_name", T.StringType(), False),
    T.StructField("side", T.StringType(), False),
    T.StructField("row_idx", T.LongType(), False),
    T.StructField("values", VECTOR, False),
])

#: Adapters that carry their own rank and alpha, as init_adapters makes them.
SCALED_ADAPTERS = T.StructType([*ADAPTERS.fields, T.StructField("r", T.IntegerType(), False), T.StructField("alpha", T.DoubleType(), False)])

CHAT = T.StructType([
    T.StructField("conv_id", T.LongType(), False),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])), False),
])
