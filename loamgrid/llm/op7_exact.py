"""Operator 7: exact dedup with an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z.  Each text has a 64-bit
key; a directory addressed by the key's leading bits names the bucket of each
key.  The bytes of text under each key are summed first; a bucket with more than
``bucket_bytes`` is split by doubling the directory, ``DIGIT`` bits at a time, of
which the driver sees the sums of the buckets that overflow.  The directory (no
more than a few entries a bucket) is a table in the shared checkpoint folder.

Every text is shuffled once, to the task that owns its bucket.  The owner chains
its rows by key and compares the bytes of the texts of a key, so texts whose keys
collide make chains of their own, and writes each chain (key, digest, doc_ids) to
the index files.  A key with more bytes than a bucket holds is dealt to several
owners in pieces; the pieces of a chain, without texts, are put together by key
and digest.  The result is read from the index.

Only DataFrame and SQL functions run on executors.

Null texts count as empty, and an empty table gives an empty result.  Very long
texts are rows like others; an owner holds ``bucket_bytes`` or one text, and
spills beyond its memory.  Equal rows (also with the same or a null doc_id) are
one group with each row counted; of a tie the row with the largest doc_id stays,
where several rows share that doc_id all of them are kept.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, written

#: Buckets for each shuffle partition, if their size isn't given.
BUCKETS = 4
#: Bits by which the directory grows at a time.
DIGIT = 4
#: Entries of a directory, or keys in pieces, that are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY x) AS keep_id,
       count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept,
       sha256(x) AS text_sha256
FROM t
"""


def _cell(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(chains: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """cell and bucket of every entry of the directory, its depth, and the number of buckets; chains has key and load."""
    spark = chains.sparkSession
    done: list[tuple[int, int]] = []  # leading bits and how many
    full, depth = [0] if (chains.agg(F.sum("load")).first()[0] or 0) > bucket_bytes else [], 0
    if not full:
        done.append((0, 0))
    while full:
        parents = spark.createDataFrame([(x,) for x in full], "parent long")
        here = chains.withColumn("parent", _cell(F.col("key"), depth)).join(F.broadcast(parents), "parent")
        sums = here.groupBy(_cell(F.col("key"), depth + DIGIT).alias("cell")).agg(F.sum("load").alias("load")).collect()
        loads: list[dict[int, int]] = [{} for _ in range(DIGIT)] + [{r["cell"]: r["load"] for r in sums}]
        for k in range(DIGIT - 1, -1, -1):
            for cell, load in loads[k + 1].items():
                loads[k][cell >> 1] = loads[k].get(cell >> 1, 0) + load
        for k in range(1, DIGIT + 1):  # one doubling after the other
            halves = [2 * x + b for x in full for b in (0, 1)]
            full = [x for x in halves if loads[k].get(x, 0) > bucket_bytes]
            over = set(full)
            done += [(x, depth + k) for x in halves if x not in over]
        depth += DIGIT
        if depth == 64:
            done += [(x, depth) for x in full]
            full = []
    deepest = max(k for _, k in done)
    rows = spark.createDataFrame([(x, deepest - k, i) for i, (x, k) in enumerate(sorted(done, key=lambda b: b[0] << (64 - b[1])))], "bits long, free int, bucket int")
    entries = rows.select(F.explode(F.expr("sequence(shiftleft(bits, free), shiftleft(bits + 1, free) - 1)")).alias("cell"), "bucket")
    return entries, deepest, len(done)


def exact_dedup(docs: DataFrame, bucket_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    A bucket holds ``bucket_bytes`` of text; by default each shuffle partition owns about ``BUCKETS`` buckets.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    texts = docs.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("key"))

    chains = texts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("norm") + 64).cast("long").alias("bytes"))
    chains = written(chains, f"{folder}/chains")
    if bucket_bytes is None:
        bucket_bytes = max(1, (chains.agg(F.sum("bytes")).first()[0] or 0) // (BUCKETS * parts))
    # half a bucket at most for a key, so that large ones don't split their neighbours for ever
    chains = chains.withColumn("load", F.least("bytes", F.lit(max(1, bucket_bytes // 2))))
    entries, depth, _ = directory(chains, bucket_bytes)
    entries = written(entries, f"{folder}/directory")
    large = written(chains.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).selectExpr("key", f"CAST(least(n, ceil(bytes / {bucket_bytes})) AS int) AS pieces"), f"{folder}/large")

    def small(table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= BROADCAST else table

    owned = texts.withColumn("cell", _cell(F.col("key"), depth)).join(small(entries, 1 << depth), "cell").join(small(large, large.count()), "key", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), "pieces").cast("int"), F.lit(-1)).alias("piece")
    owned = owned.select("doc_id", "norm", "key", "bucket", piece).repartition(parts, "bucket", "piece")
    # the key comes first, as sorting compares it first
    index = owned.groupBy("key", "norm", "bucket", "piece").agg(F.collect_list(F.struct("doc_id")).alias("members"), F.max("doc_id").alias("head"))
    index = written(index.select("bucket", "piece", "key", F.sha2("norm", 256).alias("digest"), "head", "members"), f"{folder}/index")

    whole = index.where("piece < 0").select("digest", "head", F.size("members").cast("long").alias("n"), "members")
    apart = index.where("piece >= 0")
    sums = apart.groupBy("key", "digest").agg(F.max("head").alias("head"), F.sum(F.size("members")).alias("n"))
    sums = written(sums, f"{folder}/sums")
    whole = whole.unionByName(apart.select("key", "digest", "members").join(sums, ["key", "digest"]).select("digest", "head", "n", "members"))
    doc_id = F.col("member.doc_id")
    return whole.select("digest", "head", "n", F.explode("members").alias("member")).select(
        doc_id.alias("doc_id"),
        F.col("head").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(doc_id == F.col("head"), F.col("head").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
