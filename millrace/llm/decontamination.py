"""Benchmark decontamination, with DataFrame functions only.

Words are lower-cased runs of letters and digits; a window is 13 consecutive words of a benchmark item, or a shorter
item as a whole. 13 consecutive words of a text always hold one of the text's own blocks of 7 words (the text cut into
sevens from its start), so a text without a block from any benchmark window holds no window. That test runs inside the
scan: blocks are hashed and looked up in a hash set that goes along with the tasks. Only texts that pass are cut into
windows; their hashes are looked up likewise, and the words of what is found are compared in a join. A benchmark whose
hash sets exceed `most_hashes` goes through joins on the hashes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import few

WINDOW = 13
MOST_HASHES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, once A-Z are lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same while A-Z stand.
BETWEEN_CASED = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[^{BETWEEN}]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """Words in some lower case with single spaces between. Equal words stay equal and words stay apart, but further
    words may become equal, so this serves to find candidates only. (Lower-casing a capital sigma looks at its
    neighbours, hence the replacement.)"""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ")))
    return F.trim(F.regexp_replace(plain, f"[{BETWEEN}]+", " "))


def blocks_of(words: Column, size: int) -> Column:
    """Hashes of the blocks of `size` words that a spaced text is cut into; what is left at the end is no block."""
    pattern = f"(?<![^ ])(?:[^ ]++ ){{{size - 1}}}[^ ]++"
    return F.transform(F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), lambda b: F.xxhash64(b))


def runs_of(words: Column, size: Column | int) -> Column:
    """All runs of `size` consecutive words of an array, joined by spaces."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window, size (words), blocks (words of a block that each occurrence holds), items (their ids as texts)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    windows = items.select("item", "size", F.explode(runs_of(F.col("words"), F.col("size"))).alias("window"))
    return windows.groupBy("window", "size").agg(F.collect_set("item").alias("items")).withColumn("block", ((F.col("size") + 1) / 2).cast("int"))


def literal(h: int) -> str:
    """A long in SQL."""
    return f"{h}L" if h > -(2**63) else "shiftleft(1L, 63)"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row per row of `docs`: `id_col`, version (hash of the text), n_words, n_hit, spans, items, contaminated.

    A word inside any occurrence of a window is hit: n_hit counts them, spans holds the (first, last) word numbers of
    the occurrences, items the sorted texts of the ids of items that occur. contaminated: some word is hit, and hit
    words are a twentieth of all or more. Null and empty texts have no words and are clean; items without words have no
    window, and an item with a null id counts for hits only; repeated rows are judged each; other columns are left out;
    an empty benchmark leaves all clean.
    """
    windows = benchmark_windows(benchmark, item_col).persist()
    sizes = [(r["size"], r["block"]) for r in windows.select("size", "block").distinct().collect()]
    parts = windows.select("block", F.xxhash64("window").alias("whole"), F.explode(F.transform(runs_of(F.split(spaced(F.col("window")), " "), F.col("block")), lambda b: F.xxhash64(b))).alias("part")).distinct()
    found = parts.limit(most_hashes + 1).collect()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("version"))
    rows = rows.withColumn("spaced", spaced(F.col("text")))
    rows = rows.withColumn("n_words", F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "))) + 1).cast("long"))
    maybe = F.lit(False)
    if len(found) <= most_hashes:
        for block in sorted({b for _, b in sizes}):
            some = sorted({r["part"] for r in found if r["block"] == block})
            rows = rows.withColumn(f"blocks{block}", blocks_of(F.col("spaced"), block))
            maybe = maybe | F.expr(f"exists(blocks{block}, b -> b IN ({', '.join(map(literal, some))}))")
        wholes = sorted({r["whole"] for r in found})
    else:
        maybe, wholes = F.lit(bool(sizes)), None
    rows = rows.withColumn("words", F.when(maybe, words_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    hits = []
    for size in sorted({s for s, _ in sizes}):
        starts = f"if(size(words) >= {size}, sequence(1, size(words) - {size - 1}), cast(array() AS array<int>))"
        window = f"array_join(slice(words, i, {size}), ' ')"
        if wholes is not None:
            starts = f"filter({starts}, i -> xxhash64({window}) IN ({', '.join(map(literal, wholes))}))"
        hits.append(F.expr(f"transform({starts}, i -> struct(i AS first, i + {size - 1} AS last, {window} AS window))"))
    nothing = F.array().cast("array<struct<first:int,last:int,window:string>>")
    rows = rows.select("id", "version", "n_words", F.concat(nothing, *hits).alias("hits"))
    each = rows.select("id", "version", "n_words", F.posexplode_outer("hits").alias("at", "hit")).select("id", "version", "n_words", "at", "hit.*")
    met = each.join(windows.select("window", "items"), "window", "left")
    span = F.when(F.col("items").isNotNull(), F.struct("first", "last"))
    judged = met.groupBy("id", "version", "n_words").agg(
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr("aggregate(spans, struct(0 AS upto, 0L AS n), (a, s) -> struct(greatest(a.upto, s.last) AS upto, a.n + greatest(0, s.last - greatest(a.upto, s.first - 1)) AS n), a -> a.n)")
    judged = judged.withColumn("n_hit", covered)
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return judged.select(F.col("id").alias(id_col), "version", "n_words", "n_hit", "spans", "items", flag.alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def same_row(id_col: str, text_col: str) -> Column:
    return F.col(f"d.`{id_col}`").eqNullSafe(F.col("f.id")) & (F.xxhash64(F.col(f"d.`{text_col}`").cast("string")) == F.col("f.version"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns."""
    found = few(find_contamination(docs, benchmark, id_col, text_col, item_col).where("contaminated").select(F.col(id_col).alias("id"), "version").distinct())
    return docs.alias("d").join(found.alias("f"), same_row(id_col, text_col), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All rows of `docs`, with the hit words of contaminated ones cut out of `text_col` with what stands before them."""
    found = find_contamination(docs, benchmark, id_col, text_col, item_col).where("contaminated").select(F.col(id_col).alias("id"), "version", "spans").dropDuplicates(["id", "version"])
    met = docs.alias("d").join(found.alias("f"), same_row(id_col, text_col), "left")
    pieces = F.regexp_extract_all(F.col(f"d.{text_col}"), F.lit(f"[{BETWEEN_CASED}]*[^{BETWEEN_CASED}]+"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("f.spans", lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"])))
    rest = F.regexp_extract(F.col(f"d.{text_col}"), f"[{BETWEEN_CASED}]*\\z", 0)
    cut = F.when(F.col("f.spans").isNull(), F.col(f"d.{text_col}")).otherwise(F.concat(F.array_join(kept, ""), rest))
    return met.select(*[cut.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
