"""Exact duplicates with a two-pass Bloom filter, in built-in expressions only.

Every text is read once: the SHA-256 of it without white space, its length and a row number are written as a small table of digests.
First pass: each digest sets HASHES cells of one block of 32,768, chosen by hash; cells are counted (map-side, so a text repeated a billion times is one
count a task), and those hit at least twice make the filter, one bitmap a block. Second pass: each digest is tested against
its block's bitmap where it is. A digest with a cell hit once is unique beyond doubt and passes straight through. Only the
others, true repeats and about one unique row in seventy, are shuffled by digest, and groups found exactly.

The filter has 16 to 32 bits a row: blocks are broadcast up to BROADCAST_BLOCKS of them (4 KB each). Beyond that, blocks with a cell hit so often that
there can't be more than BROADCAST_BLOCKS of the kind still are, and other digests meet their block by shuffle; texts never move. Likewise
groups of so many rows that there can't be more than HEAVY_GROUPS of them are joined back by broadcast, and the rest by shuffle, so
that no task gets a large group of copies.

Defined cases: a null text is the empty one; texts of white space alone equal it. Rows of null id are rows like others, last among equals; repeated
rows are members each, and exactly one row of each group is kept. Other columns are not read. No rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.llm.common import GAP, staged

BITS_A_ROW = 16
HASHES = 2
BLOCK_BITS = 32_768  # of one built-in bitmap
BROADCAST_BLOCKS = 16_384
HEAVY = 10_000
HEAVY_GROUPS = 1_000_000


def digests(documents: DataFrame) -> DataFrame:
    """row, doc_id, n (code points of the original text), digest (SHA-256 of the text without white space); written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, f"{GAP}+", ""), 256))
    return staged(documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.length(text).cast("long").alias("n"), digest.alias("digest")))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(blocks).cast("long")).cast("int")


def cells() -> list[Column]:
    """The places in its block that a digest sets; another hash than the block's."""
    h = F.xxhash64("digest", F.lit(1))
    return [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(HASHES)]


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """First pass. block, bits, times: of each block that has any, the bitmap of cells that two rows or more set, and the hits of its busiest one."""
    hit = rows.select(block_of(blocks).alias("block"), F.explode(F.array_distinct(F.array(*cells()))).alias("cell"))
    twice = hit.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("cell")).alias("bits"), F.max("times").alias("times"))


def is_set(bits: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, cell.bitwiseAND(F.lit(7))) == 1


def tested(rows: DataFrame, filter_: DataFrame, blocks: int, n: int, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """Second pass. The n rows with `maybe`: whether a row may be a repeated one. At most `most` blocks of filter_ are broadcast."""
    every = F.lit(True)
    for cell in cells():
        every = every & is_set(F.col("bits"), cell)
    columns = ["row", "doc_id", "n", "digest"]
    placed = rows.withColumn("block", block_of(blocks))
    if filter_.count() <= most:
        return placed.join(F.broadcast(filter_), "block", "left").select(*columns, F.coalesce(every, F.lit(False)).alias("maybe"))
    busy = filter_.where(F.col("times") > HASHES * n // max(1, most))  # cells have HASHES * n hits in all
    near = placed.join(F.broadcast(busy), "block", "left")
    there = near.where("bits is not null").select(*columns, every.alias("maybe"))
    rest = near.where("bits is null").select("block", *columns).join(filter_, "block", "left")
    return there.unionByName(rest.select(*columns, F.coalesce(every, F.lit(False)).alias("maybe")))


def in_groups(rows: DataFrame, n: int, heavy: int = HEAVY) -> DataFrame:
    """rows with keep_id, group_size, kept; n of them or more. The first of a group by length, longest first, then id, then row stays."""
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = staged(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).select("digest", "group_size", "first.keep_id", "first.keep_row"))
    is_heavy = F.col("group_size") > max(heavy, n // HEAVY_GROUPS)
    # A heavy group's rows find it before anything is dealt by digest.
    marked = rows.join(F.broadcast(groups.where(is_heavy)), "digest", "left")
    columns = ["row", "doc_id", "digest", "group_size", "keep_id", "keep_row"]
    rest = marked.where("group_size is null").select("row", "doc_id", "digest").join(groups.where(~is_heavy), "digest")
    found = marked.where("group_size is not null").select(*columns).unionByName(rest.select(*columns))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicated(documents: DataFrame, bits_a_row: int = BITS_A_ROW, broadcast_blocks: int = BROADCAST_BLOCKS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents (doc_id, text)."""
    rows = digests(documents)
    n, blocks = rows.count(), 1
    while blocks * BLOCK_BITS < bits_a_row * n:
        blocks *= 2
    after = staged(tested(rows, staged(repeated_cells(rows, blocks)), blocks, n, broadcast_blocks))
    alone = after.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    found = alone.unionByName(in_groups(after.where("maybe"), n, heavy))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `documents`."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as s from documents),
r as (select doc_id, s, row_number() over w as nth, first_value(doc_id) over w as keep_id, count(*) over (partition by s) as group_size
 from d window w as (partition by s order by length(t) desc, doc_id nulls last))
select doc_id, keep_id, group_size, nth = 1 as kept, sha256(s) as text_sha256 from r
"""
