"""Elements of an array in one large JSON document, read by several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Characters that open or close something, or part elements.
MARKS = r"[{}\[\],]"


def _before(df: DataFrame, value: Column, out: str, whole: str = "sum") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before a row, in the order of (block, at); with ``last`` its last non-null value up to the row.

    Inside a block of the file by a running window, before it by one over the blocks, of which there is one short row each.
    """
    order, blocks = Window.partitionBy("block").orderBy("at"), Window.orderBy("block")
    if whole == "sum":
        inside = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total, carried = F.sum(value), F.coalesce(F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        join = F.col("inside") + F.col("carried")
    else:
        inside = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        total, carried = F.max_by(value, F.when(value.isNotNull(), F.col("at"))), F.last("total", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
        join = F.coalesce("inside", "carried")
    carry = df.groupBy("block").agg(total.alias("total")).select("block", carried.alias("carried"))
    return df.withColumn("inside", inside).join(carry, "block").withColumn(out, join).drop("inside", "carried")


def json_array(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(pos, raw): the elements of the array ``field`` of the JSON object in the file at ``path``, as JSON text, numbered from 0.

    The file is cut at quotation marks, which Spark does by byte ranges, so that a large document is read by as many tasks as it has blocks.  Whether a
    part lies inside a string follows from how many quotation marks, other than escaped ones, are before it, and its depth from the brackets outside
    strings: running sums within a block, and over blocks.  What stands between two commas of the array's own depth is an element.  No
    task holds more than a block's share of a window, or one element.

    The document must be valid JSON; an array that is missing or empty, or another value, gives no rows.  Of several arrays of that name at the top the
    elements of all are numbered on.
    """
    lines = spark.read.option("lineSep", '"').text(path)
    parts = lines.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    parts = written(parts, "json-parts")
    escaped = F.length(F.regexp_extract("text", r"(\\*)$", 1)) % 2 == 1
    parts = _before(parts, F.when(escaped, 0).otherwise(1), "quotes").withColumn("in_string", F.col("quotes") % 2 == 1)
    # a part outside strings falls into pieces that end with a mark, and what comes after the last, with which the quotation mark goes that ended the part
    marked, rest = F.regexp_extract_all("text", F.lit(rf"[^{{}}\[\],]*{MARKS}"), F.lit(0)), F.regexp_replace("text", rf"(?s)^.*{MARKS}", "")
    pieces = F.when(F.col("in_string"), F.array("text")).otherwise(F.concat(marked, F.array(rest)))
    rows = parts.select("block", "in_string", F.col("at").alias("part"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("k", "piece"))
    rows = rows.select("block", F.struct("part", "k").alias("at"), "in_string", "piece", (F.col("k") == F.col("n") - 1).alias("quoted"))
    mark = F.when(~F.col("in_string"), F.right("piece", F.lit(1)))
    step = F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
    rows = written(_before(rows.withColumns({"mark": mark, "step": step}), F.col("step"), "depth"), "json-pieces")
    # the last string at the object's own depth is the key of the array that opens there
    rows = _before(rows, F.when(F.col("in_string") & (F.col("depth") == 1), F.col("piece")), "key", "last")
    rows = _before(rows, F.when((F.col("step") == 1) & (F.col("depth") == 1), F.col("mark")), "holder", "last")
    named = F.coalesce((F.col("key") == field) & (F.col("holder") == "["), F.lit(False))
    closes = named & (F.col("depth") == 2) & (F.col("mark") == "]")
    within = named & (F.col("depth") >= 2)
    comma = within & (F.col("depth") == 2) & (F.col("mark") == ",")
    rows = _before(rows.withColumns({"within": within, "ends": F.coalesce(comma | closes, F.lit(False))}), F.col("ends").cast("int"), "element")
    text = F.when(F.col("ends"), F.regexp_replace("piece", r"[,\]]$", "")).otherwise(F.concat("piece", F.when(F.col("quoted"), '"').otherwise("")))
    own = rows.filter("within").groupBy("element").agg(F.sort_array(F.collect_list(F.struct("block", "at", text.alias("text")))).alias("texts"))
    raw = own.select("element", F.regexp_replace(F.array_join("texts.text", ""), r"^\s+|\s+$", "").alias("raw")).filter("raw != ''")
    # elements that hold something are numbered from 0; an empty array has one that holds nothing
    numbers = raw.select("element", F.floor(F.col("element") / 1_000_000).alias("block"), F.col("element").alias("at"))
    return raw.join(_before(numbers, F.lit(1), "pos").select("element", "pos"), "element").select(F.col("pos").cast("int").alias("pos"), "raw")
