"""Exact dedup by progressive refinement, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import unused
from waymark.session import cut, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: Column) -> Column:
    """A-Z to lower case, null to empty; all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _mark(rows: DataFrame, groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a flag for those whose keys are in groups; groups must be materialised."""
    flagged = groups.select(*keys, F.lit(True).alias(name))
    return rows.join(small(flagged, 24), keys, "left")


def groups(docs: DataFrame, prefix: int = 128, all_hashes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Length first: rows alone with their length are done. Of the rest the first `prefix` characters are hashed, and only where
    length and that hash meet is the full text hashed. Texts are equal when they are after lower-casing A-Z; null counts as
    empty. Of equal texts the largest doc_id stays; of rows equal in text and id one stays. A null id is smaller than any
    other. text_sha256 is null where it was not needed, unless all_hashes. No rows give no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.octet_length(text).alias("_len"))
    again = F.col("count") > 1
    lengths = cut(rows.groupBy("_len").count().filter(again).select("_len"))
    head = F.when(F.col("_a"), F.xxhash64(normalise(F.substring("_t", 1, prefix))))
    headed = _mark(rows, lengths, ["_len"], "_a").withColumn("_head", head)
    heads = cut(headed.filter("_a").groupBy("_len", "_head").count().filter(again).select("_len", "_head"))
    full = F.sha2(normalise(F.col("_t")), 256)
    marked = _mark(headed, heads, ["_len", "_head"], "_b")
    light = marked.select(
        "doc_id", "_b", F.when(F.col("_b"), F.col("_len")).alias("_len"),
        (full if all_hashes else F.when(F.col("_b"), full)).alias("text_sha256"),
    )
    light = cut(light)
    # Equal rows are counted, not carried: a group of copies is one row for each id before it is shuffled.
    each = light.filter("_b").groupBy("_len", "text_sha256", "doc_id").agg(F.count("*").alias("_n"))
    whole = cut(each.groupBy("_len", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size")))
    joined = each.join(small(whole, 120), ["_len", "text_sha256"])
    order = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))
    found = joined.select("doc_id", "keep_id", "group_size", "text_sha256", order.alias("_i")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256"
    )
    alone = light.filter(F.col("_b").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return found.unionByName(alone)


def drop_copies(docs: DataFrame, prefix: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies, all columns kept. Rows that share an id and a text leave one, whatever their other columns hold.

    An id that stands in one row is enough to tell a copy. Only texts of rows with a repeated or null id are hashed again.
    Columns of docs may have any names. No rows give no rows.
    """
    decided = cut(groups(docs, prefix, id_col=id_col, text_col=text_col))
    each = decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    odd = cut(each.select("doc_id", (F.col("doc_id").isNull() | (F.col("n") > 1)).alias("many"), "k").filter("many OR k = 0").select("doc_id", "many"))

    def same_id(other: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(other["doc_id"])

    plain = docs[id_col].isNotNull() & (docs[id_col] == odd["doc_id"])
    if odd.filter("many").isEmpty():
        return docs.join(small(odd, 24), plain, "left_anti")
    many = cut(odd.filter("many").select("doc_id"))
    sha = unused("_sha", docs.columns)
    told = decided.join(small(many, 24).withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # Texts that nothing else equals have no hash, and nothing to be told.
    gone = cut(told.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct())
    again = cut(told.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select("doc_id", "text_sha256").distinct())
    rest = docs.join(small(many, 24), same_id(many), "left_semi").withColumn(sha, F.sha2(normalise(F.col(text_col)), 256))

    def same(other: DataFrame) -> Column:
        return rest[id_col].eqNullSafe(other["doc_id"]) & (rest[sha] == other["text_sha256"])

    left = rest.join(small(gone, 120), same(gone), "left_anti")
    once = left.join(small(again, 120), same(again), "left_semi").dropDuplicates([id_col, sha])
    return docs.join(small(odd, 24), same_id(odd), "left_anti").unionByName(
        left.join(small(again, 120), same(again), "left_anti").unionByName(once).drop(sha)
    )
