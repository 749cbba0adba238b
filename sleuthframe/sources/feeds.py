"""Files of JSON records as a source, and sinks that can run twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Connector types by name.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {}


def connector(kind: str) -> Callable:
    """Register a reader of raw records (``payload, file, modified``)."""

    def put(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CONNECTORS[kind] = read
        return read

    return put


def described(options: dict[str, object]) -> dict[str, object]:
    """Options without what may be a secret."""
    return {k: v for k, v in options.items() if not any(word in k.lower() for word in ("token", "secret", "password", "key"))}


@connector("json_lines")
def json_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", after: str | None = None) -> DataFrame:
    """One record a line. ``after`` is the cursor: only files modified later are read."""
    reader = spark.read.option("pathGlobFilter", pattern)
    reader = reader.option("modifiedAfter", after) if after else reader
    lines = reader.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return lines.where(F.trim("payload") != "")


@connector("json_files")
def json_files(spark: SparkSession, path: str, pattern: str = "*.json", after: str | None = None) -> DataFrame:
    """One object or one array of objects a file; each array member is a record."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", pattern)
    reader = reader.option("modifiedAfter", after) if after else reader
    whole = reader.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    parsed = whole.withColumn("v", F.try_parse_json("value")).withColumn("kind", F.schema_of_variant("v"))
    many = F.from_json("value", "array<variant>")
    records = F.when(F.startswith("kind", F.lit("ARRAY")), F.transform(many, lambda v: F.to_json(v))).otherwise(F.array("value"))
    return parsed.select(F.explode(records).alias("payload"), "file", "modified")


def rejected(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that are JSON objects, and those that aren't."""
    kind = F.schema_of_variant(F.try_parse_json("payload"))
    good = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    return records.where(good), records.where(~good)


#: What one fetch reads at most: files, bytes, records; and bytes of a file that is read at all.
MOST_FILES, MOST_BYTES, MOST_RECORDS, FILE_BYTES = 1000, 1 << 30, 5000, 32 << 20


@dataclass
class Fetched:
    """One batch of a feed: ``records`` (``payload, file, place``), where the next one goes on, and what was cut or refused."""

    records: DataFrame
    cursor: str | None
    deferred: bool = False
    refused: list[str] = field(default_factory=list)


def fetch(spark: SparkSession, path: str, cursor: str | None = None, pattern: str = "*.json*", most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_records: int = MOST_RECORDS, file_bytes: int = FILE_BYTES) -> Fetched:
    """The next batch of a folder of JSON and JSON-lines files, oldest file first, ties by path.

    Files are never moved; the cursor is all that is remembered: modification
    time and path of the last file, and how many of its records were taken. A
    ceiling cuts between files, or within one by records, and the cursor stays
    where it cut, so that the next fetch goes on with the next record; at least
    one file is begun. ``deferred`` says that more was there. A file over
    ``file_bytes`` is refused and named, and passed by. A file of lines gives a
    record for each that isn't blank, an array one for each member, any other file
    one. Only names, times, sizes and counts of at most ``most_files`` files come
    to the driver. A file that changes comes again; ``inserted`` by content hash
    lands nothing twice.
    """
    us, taken, name = cursor.split("|", 2) if cursor else ("-1", "0", "")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = listed.select("path", F.unix_micros("modificationTime").alias("us"), "length")
    same = (F.col("us") == int(us)) & (F.col("path") == name)
    later = (F.col("us") > int(us)) | ((F.col("us") == int(us)) & (F.col("path") > name)) | (same & F.lit(int(taken) > 0))
    first = files.where(later).orderBy("us", "path").limit(most_files + 1).collect()
    chosen, size, deferred = [], 0, len(first) > most_files
    refused = [f["path"] for f in first[:most_files] if f["length"] > file_bytes]
    for f in first[:most_files]:
        if chosen and size + f["length"] > most_bytes and f["path"] not in refused:
            deferred = True
            break
        chosen.append(f)
        size += 0 if f["path"] in refused else f["length"]
    paths = [f["path"] for f in chosen if f["path"] not in refused]
    text = F.col("content").cast("string")
    if not paths:
        none = spark.createDataFrame([], "payload string, file string, place int")
        return Fetched(none, f"{chosen[-1]['us']}|0|{chosen[-1]['path']}" if chosen else cursor, deferred, refused)
    whole = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), text.alias("t"))
    lines = F.filter(F.split("t", "\r?\n"), lambda x: F.trim(x) != "")
    opens = F.substring(F.ltrim("t"), 1, 1)
    many = (F.size(lines) > 1) & (opens != "[") | F.endswith("file", F.lit(".jsonl"))
    members = F.transform(F.from_json("t", "array<variant>"), lambda v: F.to_json(v))
    records = F.when(F.trim("t") == "", F.array().cast("array<string>")).when(many, lines).when((opens == "[") & F.try_parse_json("t").isNotNull(), members).otherwise(F.array("t"))
    spread = whole.select("file", F.posexplode(records).alias("at", "payload")).select("payload", "file", (F.col("at") + 1).alias("place"))
    counts = {r["file"]: r["count"] for r in spread.groupBy("file").count().collect()}  # of ``most_files`` files at most
    spans, room, cursor_now = [], most_records, cursor
    for f in chosen:
        start = int(taken) if f["path"] == name and f["us"] == int(us) else 0
        n = 0 if f["path"] in refused else counts.get(f["path"], 0) - start
        if room == 0 and n > 0:
            deferred = True
            break
        got = min(room, max(n, 0))
        spans.append((f["path"], start, start + got))
        room -= got
        cursor_now = f"{f['us']}|{start + got if got < n else 0}|{f['path']}"
        if got < n:
            deferred = True
            break
    span = F.broadcast(spark.createDataFrame(spans, "file string, start int, stop int"))  # a row a file
    kept = spread.join(span, "file").where("place > start and place <= stop").select("payload", "file", "place")
    return Fetched(kept, cursor_now, deferred, refused)


def inserted(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` to append: one for each key that isn't there yet."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str, counter: str) -> DataFrame:
    """``existing`` with ``new`` over it: other columns replaced, ``counter`` raised by one where the key was there, 1 where not."""
    rest = [c for c in existing.columns if c not in (key, counter)]
    e, n = existing.alias("e"), new.alias("n")
    count = F.coalesce(F.col(f"e.{counter}"), F.lit(0)) + F.col("n._new").isNotNull().cast("long")
    joined = e.join(n.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    return joined.select(key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in rest], count.alias(counter))


def append(df: DataFrame, path: str, run: str) -> None:
    """Append one run's rows to a ledger; a run that is written again replaces itself."""
    df.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
