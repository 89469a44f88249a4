"""Map, shuffle and reduce: word counts, joins on extracted keys, shuffle statistics, skew and PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir

SKEW_FAN_OUT = 100


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n)."""
    return docs.select(F.explode(tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def skewed_keys(rows: DataFrame, key: str, fan_out: int = SKEW_FAN_OUT) -> DataFrame:
    """(key, n, label): keys with more than `fan_out` rows; label is `key(n)`."""
    counts = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fan_out)
    return counts.withColumn("label", F.format_string("%s(%d)", "key", "n"))


def encode_join_input(row_id: Column, join_key: Column) -> Column:
    """`row#key`, the form in which a join key travels with a row's id."""
    return F.concat(row_id.cast("string"), F.lit("#"), join_key.cast("string"))


def extract_join_key(encoded: Column) -> Column:
    """What follows the last `#`, or all of it where there is none."""
    return F.substring_index(encoded, "#", -1)


def reduce_side_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """(key, joined): per key every left value with every right value, as `left+right`.

    Both sides are shuffled on the key (merge hint); a skewed key is split at run time, and a null key joins nothing.
    """
    pair = F.concat(F.col(f"l.{left_value}").cast("string"), F.lit("+"), F.col(f"r.{right_value}").cast("string"))
    return left.alias("l").hint("merge").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}")).select(F.col(f"l.{key}").alias(key), pair.alias("joined"))


def shuffle_stats(pairs: DataFrame, key: Column, value: Column, partition: Column) -> DataFrame:
    """One row: pairs, bytes, partitions (sizes in order, as text), max_share. 0 rows give 0 and an empty list."""
    size = F.octet_length(key.cast("string")) + F.octet_length(value.cast("string"))
    parts = pairs.groupBy(partition.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))
    share = F.coalesce(F.max("rows") / F.sum("rows"), F.lit(0.0))
    sizes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rows"))), lambda p: p["rows"].cast("string")), " ")
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), sizes.alias("partitions"), share.alias("max_share"))


def split_input(rows: DataFrame, key: Column, splits: int) -> DataFrame:
    """`rows` in `splits` partitions by a hash of `key`: an even start where files are uneven."""
    return rows.repartition(splits, key)


def group_fold(rows: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """A reducer in Python over all rows of a key, for folds that no aggregate expresses (a frame in, a frame out)."""
    return rows.groupBy(key).applyInPandas(fold, schema)


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, redistribute: bool = False, checkpoint_every: int = 4) -> DataFrame:
    """(id, rank) after `rounds` rounds over edges (src, dst); an edge that is there twice counts twice.

    Nodes without edges out lose their rank unless `redistribute` spreads it. Edges are shuffled once, by source, and
    kept; lineage is cut every few rounds in the shared folder.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.where("src is not null and dst is not null")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().checkpoint()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = edges.join(out, "src").select("src", "dst", "deg").checkpoint()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        sent = weighted.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        base = F.lit((1 - damping) / n)
        if redistribute:
            lost = ranks.join(out.withColumnRenamed("src", "id"), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            base = base + damping * F.lit(lost.first()["lost"]) / n
        ranks = nodes.join(sent, "id", "left").select("id", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % checkpoint_every == 0 and i < rounds:
            ranks = ranks.checkpoint()
    return ranks
