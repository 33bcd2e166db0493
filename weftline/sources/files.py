"""Files as frames: readers by type, type detection, source trees, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ids import uuid5

# First bytes (hex) of file types.
MAGIC = [
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"),
    ("494433", "audio/mpeg"),
    ("FFFB", "audio/mpeg"),
    ("4F676753", "audio/ogg"),
    ("664C6143", "audio/flac"),
    ("50415231", "application/parquet"),
    ("D0CF11E0A1B11AE1", "application/msword"),
    ("7B5C727466", "application/rtf"),
]
EXTENSIONS = {"txt": "text", "md": "text", "html": "text", "htm": "text", "css": "text", "js": "text", "py": "text", "sql": "text", "yaml": "text", "yml": "text", "xml": "text", "log": "text", "json": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "orc": "orc", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tiff": "image", "webp": "image", "wav": "audio", "mp3": "audio", "m4a": "audio", "flac": "audio", "ogg": "audio", "pdf": "pdf", "docx": "office", "xlsx": "office", "pptx": "office"}


def file_type(content: Column) -> Column:
    """Type by the first bytes; text where they are valid UTF-8, else application/octet-stream; null for null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(content.isNull(), F.lit(None).cast("string"))
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), F.lit(kind))
    out = out.when(head.startswith("52494646") & F.substring(head, 17, 8).isin("57415645"), F.lit("audio/wav")).when(head.startswith("52494646") & F.substring(head, 17, 8).isin("57454250"), F.lit("image/webp"))
    return out.when(F.is_valid_utf8(content.cast("string")), F.lit("text/plain")).otherwise(F.lit("application/octet-stream"))


def extension_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[ext], F.lit("binary"))


def read_any(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    """A file or folder by kind: text, json, csv, parquet, orc, or binary for all that Spark does not parse."""
    r = spark.read.options(**options)
    if kind == "text":
        return r.text(path, wholetext=True)
    if kind == "csv":
        return r.option("header", options.get("header", "true")).csv(path)
    if kind in ("json", "parquet", "orc"):
        return getattr(r, kind)(path)
    return r.format("binaryFile").load(path)


def write_any(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if kind == "csv":
        w.option("header", "true").csv(path)
    else:
        getattr(w, kind)(path)


def source_tree(spark: SparkSession, root: str, patterns: str = "*.{py,md,sql,yaml}", size: int = 20_000) -> DataFrame:
    """(id, uri, ordinal, content): all files under a folder in pieces of ``size`` characters, with ids that repeat runs keep."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", patterns).text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("uri"), F.col("value"))
    some = files.where(F.length("value") > 0).withColumn("s", F.explode(F.sequence(F.lit(0), F.length("value") - 1, F.lit(size))))
    out = some.withColumn("ordinal", (F.col("s") / size).cast("long")).withColumn("content", F.expr(f"substring(value, s + 1, {size})"))
    return out.select(uuid5(F.concat_ws("-", "uri", "ordinal")).alias("id"), "uri", "ordinal", "content")


def due_syncs(configs: DataFrame, now: Column) -> DataFrame:
    """Sync configurations that are due: enabled and never run or past their time, with the next time."""
    due = configs.where(F.col("enabled") & (F.col("next_sync").isNull() | (F.col("next_sync") <= now)))
    return due.withColumn("next_sync", now + F.make_interval(hours=F.col("interval_hours")))


def changed_files(listing: DataFrame, synced: DataFrame) -> DataFrame:
    """Remote files that are new or changed since they were synced: (config_id, remote_id, modified)."""
    s = synced.select(F.col("config_id").alias("_c"), F.col("remote_id").alias("_r"), F.col("modified").alias("_m"))
    j = listing.join(s, (F.col("config_id") == F.col("_c")) & (F.col("remote_id") == F.col("_r")), "left")
    return j.where("_m is null or _m < modified").drop("_c", "_r", "_m")


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, path, depth) of (id, parent_id, name): folder paths from the roots, level by level, however deep.

    Each level is cut, so that the next does not work it out again. A folder that is its own ancestor hangs from no root and
    is not listed; folders with several parents have a path for each.
    """
    from weftline.session import cut

    level = folders.where("parent_id is null").select("id", F.col("name").alias("path"), F.lit(0).cast("long").alias("depth"))
    out = level
    child = folders.where("parent_id is not null").select(F.col("id").alias("cid"), "parent_id", "name")
    while True:
        level = cut(level.join(child, F.col("id") == F.col("parent_id")).select(F.col("cid").alias("id"), F.concat_ws("/", "path", "name").alias("path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
