"""Hash chains: entries that each hold the digest of the one before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What stands before the first entry of a chain.
GENESIS = "0" * 64


def entry_body(*fields: str) -> Column:
    """An entry's fields as one text; a null field differs from an empty one, and no field can run into the next."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.replace(F.replace(F.col(f).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))), F.lit("-")) for f in fields])


def entry_hash(previous: Column, body: Column) -> Column:
    """Digest of an entry's body and of the digest before it."""
    return F.sha2(F.concat_ws("|", previous, body), 256)


def append_entries(entries: DataFrame, order: list[str], fields: list[str], log: DataFrame | None = None) -> DataFrame:
    """``entries`` (``chain``, ``fields``) as links of their chains: with ``seq, prev_hash, entry_hash``.

    New entries follow in ``order`` after the last one that ``log`` has of their
    chain, numbered on; without one a chain begins with 1 after GENESIS. Each
    digest needs the one before, so a chain is written by one task, but as a
    stream: its entries come sorted and only the last digest is held. A null
    chain is a chain.
    """
    rows = entries.withColumn("_body", entry_body(*fields))
    if log is None:
        rows = rows.withColumns({"_seq": F.lit(0).cast("long"), "_head": F.lit(GENESIS)})
    else:
        heads = log.groupBy(F.col("chain").alias("_chain")).agg(F.max(F.struct("seq", "entry_hash")).alias("_h"))
        joined = rows.join(heads, F.col("chain").eqNullSafe(F.col("_chain")), "left")
        rows = joined.select(*rows.columns, F.coalesce("_h.seq", F.lit(0)).cast("long").alias("_seq"), F.coalesce("_h.entry_hash", F.lit(GENESIS)).alias("_head"))
    schema = StructType([*entries.schema.fields, StructField("seq", LongType()), StructField("prev_hash", StringType()), StructField("entry_hash", StringType())])
    names = schema.names

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, last = object(), 0, ""
        for batch in batches:
            chains, bodies, seqs, heads = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chain", "_body", "_seq", "_head"))
            numbers, before, after = [], [], []
            for chain, body, start, head in zip(chains, bodies, seqs, heads, strict=True):
                if chain != now:
                    now, seq, last = chain, start, head
                seq += 1
                before.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                numbers.append(seq)
                after.append(last)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=names)

    return rows.repartition("chain").sortWithinPartitions("chain", *order).mapInArrow(fold, schema)


def chain_faults(log: DataFrame, fields: list[str]) -> DataFrame:
    """Entries that don't hold: ``chain, seq, fault``.

    ``content``: the digest isn't that of the entry; ``link``: the digest before
    isn't the one the entry names; ``gap``: the entry before is missing. Each entry
    is held against its neighbour alone, found by number, so no chain is walked.
    """
    before = log.select(F.col("chain").alias("_chain"), (F.col("seq") + 1).alias("_seq"), F.col("entry_hash").alias("_before"), F.lit(True).alias("_there"))
    joined = log.join(before, F.col("chain").eqNullSafe(F.col("_chain")) & (F.col("seq") == F.col("_seq")), "left")
    first = F.col("seq") == 1
    faults = F.array(
        F.when(~F.col("entry_hash").eqNullSafe(entry_hash(F.col("prev_hash"), entry_body(*fields))), "content"),
        F.when((first | F.col("_there").isNotNull()) & ~F.col("prev_hash").eqNullSafe(F.when(first, F.lit(GENESIS)).otherwise(F.col("_before"))), "link"),
        F.when(~first & F.col("_there").isNull(), "gap"),
    )
    return joined.select("chain", "seq", F.explode(F.array_compact(faults)).alias("fault"))


def chain_report(log: DataFrame, fields: list[str]) -> DataFrame:
    """By chain: ``entries, n_faults, first_seq, first_fault``; whole chains have 0 and nulls."""
    sizes = log.groupBy(F.col("chain")).agg(F.count(F.lit(1)).alias("entries"))
    found = chain_faults(log, fields).groupBy(F.col("chain").alias("_chain")).agg(F.count(F.lit(1)).alias("n_faults"), F.min(F.struct("seq", "fault")).alias("f"))
    joined = sizes.join(found, F.col("chain").eqNullSafe(F.col("_chain")), "left")
    return joined.select("chain", "entries", F.coalesce("n_faults", F.lit(0)).alias("n_faults"), F.col("f.seq").alias("first_seq"), F.col("f.fault").alias("first_fault"))
