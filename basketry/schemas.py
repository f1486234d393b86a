"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

BASKETS = T.StructType([T.StructField("tid", T.LongType()), T.StructField("item", T.IntegerType())])
PATTERNS = T.StructType([
    T.StructField("items", T.ArrayType(T.IntegerType(), False)),
    T.StructField("support", T.LongType()),
])
VBITMAP = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("words", T.BinaryType())])
LEVEL_STATS = T.StructType([
    T.StructField("level", T.IntegerType()), T.StructField("n_candidates", T.LongType()),
    T.StructField("n_nodes", T.LongType()), T.StructField("n_patterns", T.LongType()),
    T.StructField("generate_s", T.DoubleType()), T.StructField("count_s", T.DoubleType()),
    T.StructField("identify_s", T.DoubleType()),
])
