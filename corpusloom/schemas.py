"""Explicit schemas of the engine's tables."""

from pyspark.sql import types as T

CODE_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# One nullable struct for every kind of unit; an absent key is NULL and the
# JSON sinks leave NULLs out.
METADATA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("lines", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("has_docstring", T.BooleanType()),
    T.StructField("arg_count", T.IntegerType()),
    T.StructField("method_count", T.IntegerType()),
    T.StructField("naming_style", T.StringType()),
    T.StructField("doc_style", T.StringType()),
    T.StructField("style_focus", T.BooleanType()),
    T.StructField("priority", T.StringType()),
    T.StructField("llm_generated_prompt", T.BooleanType()),
    T.StructField("original_instruction", T.StringType()),
])

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))

TRAINING_RECORD = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("messages", MESSAGES),
])

MODULE_SPEC = T.StructType([
    T.StructField("module", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("entities", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
        ]))),
    ]))),
    T.StructField("api", T.StructType([
        T.StructField("style", T.StringType()),
        T.StructField("base_path", T.StringType()),
        T.StructField("endpoints", T.ArrayType(T.StringType())),
    ])),
    T.StructField("ui", T.StructType([
        T.StructField("framework", T.StringType()),
        T.StructField("routes", T.ArrayType(T.StringType())),
    ])),
    T.StructField("persistence", T.StructType([T.StructField("driver", T.StringType())])),
])
