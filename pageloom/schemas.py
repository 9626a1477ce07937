"""Table contracts shared by the operators.

``PAGE`` is the page key every spatial operator partitions on. A run table has
``PAGE + run_ord, text, x, y, w, h, style``; lines, blocks and regions keep the
same rectangle columns so joins and filters push down on plain doubles.
"""

from pyspark.sql import types as T

PAGE = ["doc_id", "page_index"]
RECT = ["x", "y", "w", "h"]

RGB = T.StructType([T.StructField(c, T.DoubleType()) for c in ("r", "g", "b")])

STYLE = T.StructType([
    T.StructField("font_name", T.StringType()),
    T.StructField("font_size_pt", T.DoubleType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
    T.StructField("color", RGB),
])

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
])

RUN = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("run_ord", T.LongType()),
    T.StructField("text", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in RECT],
    T.StructField("style", STYLE),
])

REGION = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("region_id", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in RECT],
])

PAINT_OP = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("op_ord", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("args", T.ArrayType(T.DoubleType())),
])

# One closed edit type; kind-specific columns are null for the other kinds.
EDIT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("page_index", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in RECT],
    T.StructField("z", T.LongType()),
    T.StructField("text", T.StringType()),
])

EDIT_EVENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("ids", T.ArrayType(T.StringType())),
    T.StructField("edits", T.ArrayType(EDIT)),
])

EDIT_KINDS = ("text", "cover", "image", "line")
