"""Sources: uploads, texts, spreadsheet cells, event-stream lines, tables of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EXTENSIONS = ["pdf", "docx", "xlsx", "txt"]
MOST_BYTES = 50 * 1024 * 1024


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict a file: extension, size, leading bytes. Files above the size limit are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    unknown = F.when(~kind.isin(EXTENSIONS), "extension")
    head = F.substring("content", 1, 1024)
    bad_pdf = (kind == "pdf") & ~F.contains(head, F.lit(b"%PDF-"))
    bad_zip = kind.isin("docx", "xlsx") & ~F.startswith(head, F.lit(b"PK\x03\x04"))
    # The source takes a filter on length as a filter on files.
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "length", unknown.when(bad_pdf | bad_zip, "content").otherwise("ok").alias("verdict"))
    large = files.where(F.col("length") > MOST_BYTES).select("path", "length", unknown.otherwise("size").alias("verdict"))
    return small.unionByName(large)


def pages_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """S3: text files to pages(path, ord, page, text), at form feeds."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\f", -1)).alias("ord", "text")).withColumn("page", F.col("ord") + 1)


def sheet_pages(cells: DataFrame) -> DataFrame:
    """cells(doc_id, sheet, row, col, value) to a page a sheet: cells by bars, rows by lines."""
    filled = cells.where("value is not null and value != ''")
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    rows = filled.groupBy("doc_id", "sheet", "row").agg(F.array_join(ordered("col", "value"), " | ").alias("line"))
    return rows.groupBy("doc_id", "sheet").agg(F.array_join(ordered("row", "line"), "\n").alias("text"))


def table_to_markdown(cells: DataFrame, least: float = 0.3) -> DataFrame:
    """cells(table_id, row, col, value), row 0 the header: a Markdown table between its marks.

    Tables with fewer than ``least`` of their cells filled go; an empty header gets a name; an empty
    first cell takes the value of the row above.
    """
    value = T.strip(F.coalesce("value", F.lit("")))
    rows = cells.select("table_id", "row", "col", value.alias("value"))
    above = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when((F.col("value") != "") & (F.col("row") > 0), F.col("value")), ignorenulls=True).over(above)
    shown = F.when((F.col("row") == 0) & (F.col("value") == ""), F.concat(F.lit("Col"), (F.col("col") + 1).cast("string")))
    shown = shown.when((F.col("col") == 0) & (F.col("row") > 0), F.coalesce(carried, F.lit(""))).otherwise(F.col("value"))
    share = F.avg((F.col("value") != "").cast("int")).over(Window.partitionBy("table_id"))
    kept = rows.withColumns({"shown": shown, "share": share}).where(F.col("share") >= least)
    line = kept.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "shown"))), lambda x: x["shown"]).alias("c"))
    text = F.concat(F.lit("| "), F.array_join("c", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: F.lit("---")), " | "), F.lit(" |"))
    text = F.when(F.col("row") == 0, F.concat(text, F.lit("\n"), rule)).otherwise(text)
    lines = line.withColumn("line", text).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("l"))
    return lines.select("table_id", F.concat(F.lit("<!-- TABLE -->\n"), F.array_join("l", "\n"), F.lit("\n<!-- /TABLE -->")).alias("text"))


def point_lookup(points: DataFrame, tenant_id: str, document_id=None, point_id=None) -> DataFrame:
    """The points of a tenant's document, or one point; never another tenant's."""
    rows = points.where(F.col("tenant_id") == tenant_id)
    rows = rows if document_id is None else rows.where(F.col("document_id") == document_id)
    return rows if point_id is None else rows.where(F.col("point_id") == point_id)


def sse_parse(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """lines(stream_id, n, line): data lines up to [DONE] as variants; bad JSON and other keys go."""
    data = F.substring("line", 7, 1 << 30)
    rows = lines.where(F.col("line").startswith("data: ")).withColumn("data", data)
    w = Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    open_ = rows.withColumn("done", F.max((T.strip(F.col("data")) == "[DONE]").cast("int")).over(w)).where("done = 0")
    event = F.try_parse_json(F.col("data"))
    given = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.try_variant_get(event, f"$.{k}", "string") for k in keys)))
    return open_.where(event.isNotNull()).select("stream_id", "n", F.map_filter(given, lambda k, v: v.isNotNull()).alias("event"))
