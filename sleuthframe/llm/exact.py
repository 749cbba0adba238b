"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.llm.decontam import small
from sleuthframe.plans.lineage import materialise, scratch_folder

#: Bytes from which a bucket is overfull, as long as there are no more than about MOST_BUCKETS; then it is that part of all bytes. Bytes that an entry takes beside its text.
BUCKET_BYTES, MOST_BUCKETS, ENTRY_BYTES = 4 << 20, 1 << 18, 64
#: Keys with more than one row in HOT are hot; there are fewer than HOT of them.
HOT = 1024
#: Bits of a key that the directory may tell apart.
DEEPEST = 62


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is; empty for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def leading(key: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a 64-bit key, as a number."""
    return F.when(depth > 0, F.call_function("shiftrightunsigned", key, (64 - depth).cast("int"))).otherwise(F.lit(0).cast("long"))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """``depth, slot, keys, bytes``: the buckets of an extendible-hash index of ``keys`` (``key, bytes``, each key once).

    At first there is one bucket, of depth 0. A bucket with more than ``capacity``
    bytes and more than one key is overfull and becomes two, of the keys that begin
    with one more bit; where its depth is the directory's, the directory doubles.
    As the keys are all known, the doublings are made together: keys are counted by
    their first bits up to the depth that even keys need and three more, and those
    counts by each shorter prefix. What is overfull even there (keys alike in all
    those bits) is split on bit by bit from its own keys. Empty halves are buckets too.
    """
    sums = [F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes")]
    each = keys.select("key", F.lit(1).cast("long").alias("keys"), "bytes")
    over = (F.col("bytes") > capacity) & (F.col("keys") > 1)
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth = min(DEEPEST, ceil(log2(max(1.0, total / capacity))) + 3)

    def halves(full: DataFrame, counts: DataFrame) -> DataFrame:
        born = full.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return born.join(counts, ["depth", "slot"], "left").select("depth", "slot", zero("keys"), zero("bytes"))

    cells = each.groupBy(leading(F.col("key"), F.lit(depth)).alias("cell")).agg(*sums)
    levels = cells.select("cell", "keys", "bytes", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    at = F.call_function("shiftright", F.col("cell"), depth - F.col("depth"))
    levels = materialise(levels.groupBy("depth", at.alias("slot")).agg(*sums))
    root = keys.sparkSession.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("slot"), F.lit(0).cast("long").alias("keys"), F.lit(0).cast("long").alias("bytes"))
    first = levels.where("depth = 0")
    buckets = materialise((root if first.isEmpty() else first).unionByName(halves(levels.where(over & (F.col("depth") < depth)), levels)))
    done, full = buckets.where(~over), buckets.where(over & (F.col("depth") == depth))
    while depth < DEEPEST and not full.isEmpty():
        here = each.withColumn("slot", leading(F.col("key"), F.lit(depth))).join(small(full.select("slot")), "slot", "left_semi")
        depth += 1
        counts = here.groupBy(F.lit(depth).alias("depth"), leading(F.col("key"), F.lit(depth)).alias("slot")).agg(*sums)
        born = materialise(halves(full, counts))
        done, full = done.unionByName(born.where(~over)), born.where(over)
    return materialise(done.unionByName(full))


def owners(buckets: DataFrame, tasks: int) -> DataFrame:
    """``buckets`` with ``owner``: the task, below ``tasks``, that owns them; each owns a range of keys with about equal bytes."""
    order = Window.orderBy(F.call_function("shiftleft", F.col("slot"), DEEPEST - F.col("depth")), "depth")  # one row a bucket, of which there are about MOST_BUCKETS at most
    before = F.sum(F.col("bytes") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") - 1
    whole = F.sum(F.col("bytes") + 1).over(Window.partitionBy())
    return buckets.withColumn("owner", F.floor(before * tasks / whole).cast("int"))


def build_index(docs: DataFrame, folder: str, key: Callable[[Column], Column] = F.xxhash64, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the index of ``docs`` (``doc_id, text``) below ``folder``; returns its entries and its directory, read from there.

    ``entries`` has a row for each text: ``bucket, key, body`` (the lowered text),
    ``n`` (documents that have it), ``keep_id`` (the largest of their ids) and
    ``sha256``, in a folder a bucket. Texts with one key are chained in the key's
    bucket and told apart by their bytes. ``directory`` is as above, with owners.

    Texts are shuffled once, to the owner of their key's range. A hot key's copies
    are counted where they are read and never meet before that.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", lowered(F.col("text")).alias("body")).withColumn("key", key(F.col("body")))
    counts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max(F.octet_length("body")) + ENTRY_BYTES).cast("long").alias("bytes")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    hot = F.broadcast(counts.where(F.col("n") * HOT > (total["n"] or 0)).select("key"))  # fewer than HOT keys
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = owners(directory(counts.select("key", "bytes"), capacity or max(BUCKET_BYTES, (total["bytes"] or 0) // MOST_BUCKETS)), tasks)
    found.write.parquet(f"{folder}/directory")
    found = spark.read.parquet(f"{folder}/directory")

    depths = [r["depth"] for r in found.select("depth").distinct().collect()]  # DEEPEST at most
    slots = small(found.select("depth", "slot", "owner"))
    places = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), leading(F.col("key"), F.lit(d)).alias("slot")) for d in depths]))

    def placed(few: DataFrame) -> DataFrame:
        return few.select("*", places.alias("p")).select(*few.columns, "p.*").join(slots, ["depth", "slot"])

    measures = [F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")]
    alike = ["owner", "depth", "slot", "key", "body"]
    cold = placed(rows.join(hot, "key", "left_anti")).repartitionById(tasks, "owner").groupBy(*alike).agg(*measures)
    copied = placed(rows.join(hot, "key", "left_semi").groupBy("key", "body").agg(*measures)).select(*cold.columns)
    bucket = F.concat(F.lpad(F.bin("slot"), 64, "0").substr(65 - F.greatest("depth", F.lit(1)), F.col("depth")), F.lit("-"))
    entries = cold.unionByName(copied).select(bucket.alias("bucket"), "key", "body", "n", "keep_id", F.sha2("body", 256).alias("sha256"))
    entries.write.partitionBy("bucket").parquet(f"{folder}/entries")
    schema = entries.select("key", "body", "n", "keep_id", "sha256", "bucket").schema  # so that no bucket's name is read as a number
    return spark.read.schema(schema).parquet(f"{folder}/entries"), found


def exact_groups(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int | None = None) -> DataFrame:
    """Groups of documents with the same text but for A-Z, and the one of each that stays.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row
    per row of ``docs``: ``doc_id, keep_id`` (the group's largest id), ``group_size``,
    ``kept`` and ``text_sha256`` (of the lowered text in UTF-8). Null texts count as
    empty ones. Rows that repeat an id are one document: all of those with the kept
    id are kept. A null id is kept only if no row of its group has another.

    Rows find their group's entry in the index by key alone; where different texts
    share a key, by key and text. ``key`` gives a 64-bit number for a text.
    """
    spark = docs.sparkSession
    entries, _ = build_index(docs, f"{scratch_folder(spark, 'index-')}/index-{uuid.uuid4().hex}", key, capacity)
    classes = entries.select("key", "n", "keep_id", "sha256")
    chained = materialise(classes.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    rows = docs.select("doc_id", lowered(F.col("text")).alias("body")).withColumn("key", key(F.col("body")))
    out = lambda r, c: r.select("doc_id", c["keep_id"].alias("keep_id"), c["n"].cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(c["keep_id"]).alias("kept"), c["sha256"].alias("text_sha256"))

    def by_key(some: DataFrame, of: DataFrame) -> DataFrame:
        """Rows of hot classes are joined where they are read, and spread by id in the shuffle that joins the others."""
        few = F.broadcast(of.where(F.col("n") * HOT > total).select("key", F.struct("keep_id", "n", "sha256").alias("hot")))  # fewer than HOT classes
        many = of.where(F.col("n") * HOT <= total).select(F.col("key").alias("at"), F.lit(False).alias("is_hot"), F.struct("keep_id", "n", "sha256").alias("cold"))
        here = some.select("doc_id", "key").join(few, "key", "left").withColumn("is_hot", F.col("hot").isNotNull())
        here = here.withColumn("at", F.when(F.col("is_hot"), F.xxhash64("doc_id")).otherwise(F.col("key")))
        got = here.join(many, ["at", "is_hot"], "left").select("doc_id", F.coalesce("hot", "cold").alias("c"))
        return out(got, F.col("c"))

    if chained.isEmpty():
        return by_key(rows, classes)
    chained = small(chained)
    texts = small(entries.join(chained, "key", "left_semi").select("key", "body", "n", "keep_id", "sha256"), "body")
    full = rows.join(chained, "key", "left_semi").join(texts, ["key", "body"])
    alone = lambda df: df.join(chained, "key", "left_anti")
    return by_key(alone(rows), alone(classes)).unionByName(out(full, texts))
