"""Canonical schemas. Time is epoch milliseconds (``long``) everywhere."""

from pyspark.sql import types as T

SECTIONS = ("speed", "location", "image")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

READINGS = T.StructType([
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("section", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("generate_ms", T.LongType()),
    T.StructField("scalar", T.DoubleType()),
    T.StructField("location", POINT),
    T.StructField("image", T.BinaryType()),
    T.StructField("sequence_number", T.LongType()),
])

POLICY = T.StructType([
    T.StructField("app", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("predicate", T.StringType()),
    T.StructField("pet", T.StringType()),
])

# A PET description as JSON. Parameter values stay text: the label needs the text as written.
PET = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("stateWindow", T.ArrayType(T.StructType([
        T.StructField("dataSection", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("size", T.IntegerType()),
    ]))),
    T.StructField("parameters", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    T.StructField("inputDataSection", T.ArrayType(T.StringType())),
    T.StructField("outputDataSection", T.ArrayType(T.StringType())),
])
