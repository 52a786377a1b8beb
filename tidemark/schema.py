"""Record types of the log. Timestamps are Unix nanoseconds; ``seq`` is arrival order."""

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("seq", T.LongType()),
    ]
)
#: A log row with the optional vector of a put.
RECORD = T.StructType([*LOG.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
#: A row of a store's run: ``batch`` is null in a run of one batch, whose number the manifest has.
STORED = T.StructType([T.StructField("batch", T.LongType()), *RECORD.fields])
VECTOR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("seq", T.LongType()),
    ]
)
HINT = T.StructType([T.StructField("target", T.StringType()), *LOG.fields])
SCHEMA_REGISTRY = T.StructType([T.StructField("version", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))])
