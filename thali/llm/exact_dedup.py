"""Exact dedup by skew-safe combining (native).

Texts are equal when they are identical after each run of white space is one
space; null counts as empty.  The first grouping, by digest, salt and content,
runs as a local (map-side) dedup followed by a merge of salted groups; the
second combines the salt winners.  Both group on the whole content, so a
digest collision cannot merge two texts.

Defined results: a null or empty text is a text like any other; a null
``doc_id`` loses to any id; of rows that repeat both id and text one is kept, the
same in every run;
an empty table gives an empty result; extra columns are ignored by
``exact_groups`` and carried along by ``drop_exact_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.common import GAP, lookup, nested, stored

SALTS = 16


def _sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _contents(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, content, digest) of every row."""
    content = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), GAP, " ")
    return docs.select(docs["doc_id"], content.alias("content")).withColumn("digest", digest(F.col("content")))


def _winners(contents: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size): one row a distinct content."""
    salted = (contents.groupBy("digest", "content", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` only routes rows; with any function the groups are those of
    equal contents.
    """
    contents = _contents(docs, digest)
    found = _winners(contents, salts)
    winners = stored(found.select("digest", "keep_id", "group_size"), "winners")
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    shared = winners.groupBy("digest").count().where("count > 1").select("digest")
    collide = not shared.isEmpty()

    sha = contents.withColumn("text_sha256", F.sha2("content", 256))
    slim = sha.groupBy("doc_id", "digest", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    if collide:  # two contents under one digest: these rows join on their content
        slim = slim.join(shared, "digest", "left_anti")
        by_content = (sha.join(shared, "digest", "left_semi").groupBy("doc_id", "digest", "content", "text_sha256")
                      .agg(F.count(F.lit(1)).alias("copies"))
                      .join(found.join(shared, "digest", "left_semi"), ["digest", "content"]))
        winners = winners.join(shared, "digest", "left_anti")
    placed = lookup(slim, winners, "digest", "group_size", total)
    if collide:
        placed = placed.unionByName(by_content.select(*placed.columns))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (placed.select("doc_id", "keep_id", "group_size", "text_sha256", copy.alias("copy"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows are matched
    to their group's winner by id and digest, and by content wherever two
    contents have one digest."""
    found = _winners(_contents(docs, digest), salts)
    winners = stored(found.select("digest", "keep_id"), "winners")
    shared = winners.groupBy("digest").count().where("count > 1").select(F.col("digest").alias("_of"))
    rows = nested(docs, "doc_id", "text")
    rows = rows.withColumn("_content", F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " ")).withColumn("_digest", digest(F.col("_content")))
    keep = winners.select(F.col("keep_id").alias("_keep"), F.col("digest").alias("_of"))
    same = F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_of"))
    first = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "_digest")
    if shared.isEmpty():
        joined = rows.drop("_content").join(keep, same, "left_semi")
    else:
        own = found.select(F.col("keep_id").alias("_keep"), F.col("digest").alias("_of"), F.col("content").alias("_kept"))
        joined = rows.join(own, same & (F.col("_content") == F.col("_kept")), "left_semi")
        first = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "_digest", "_content")
    return joined.withColumn("_n", F.row_number().over(first.orderBy(F.xxhash64("_row")))).where("_n = 1").select("_row.*")
