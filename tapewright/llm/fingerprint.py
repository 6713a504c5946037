"""Document fingerprints: threshold-scaled sketches of word shingles (FracMinHash).

A sketch retains every shingle hash below a fixed fraction of the hash range, so sketches of unequal documents stay
comparable, and the sketch of a union is the union of the sketches. The least hash is retained too, so that no text with
a word has an empty sketch; the union rule then is: unite, keep those below the threshold and the least. Column
expressions only: no Python on the path.

Defined results: a null text is an empty one; a text of fewer than five words (one at least) is one shingle; a text
without words has an empty sketch, which is like (1.0) another empty sketch and unlike (0.0) any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stash

SHINGLE = 5


def words(text: Column) -> Column:
    """The runs without ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch_of_words(w: Column, fraction: float) -> Column:
    """Sorted distinct shingle hashes below the threshold, and the least one. `w` must be a plain column: it is read often."""
    below = F.lit(int(-(1 << 63) + fraction * (1 << 64)))
    n = F.size(w)
    at = lambda i, k: F.get(w, i + k)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    one = F.array(F.xxhash64(F.concat_ws(" ", w), n))
    hashes = F.when(n >= SHINGLE, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_union(F.filter(hashes, lambda h: h < below), F.slice(F.array(F.array_min(hashes)), 1, F.when(n > 0, 1).otherwise(0))))


def add_sketch(df: DataFrame, text_col: str, out: str, fraction: float) -> DataFrame:
    """Adds a sketch column; the words are a column of their own in between, split once."""
    return df.withColumn("__w", words(F.coalesce(col(text_col), F.lit("")))).withColumn(out, sketch_of_words(F.col("__w"), fraction)).drop("__w")


def merge(a: Column, b: Column, fraction: float) -> Column:
    """The sketch of two documents together."""
    both = F.array_union(a, b)
    below = F.lit(int(-(1 << 63) + fraction * (1 << 64)))
    return F.array_sort(F.filter(both, lambda h: (h < below) | (h == F.array_min(both))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / F.greatest(total, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def as_text(sketch: Column) -> Column:
    """A sketch as a string: its hashes in 16 hex digits each, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.25, per_range: int = 2000, range_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Edited text: the last floor(n_chars/2) code points replaced by the first as many (or all) of the next document in
    descending id order (after the last: the first). Ties of ids are ordered by the text's hash; null ids come last.

    The order is cut into ranges, between ids or, within an id of many texts, between hashes: of `range_bytes` of text, or
    less as long as that keeps all tasks of a shuffle busy. Spark's range partitioning of the keys alone finds the first
    key of each; they are one broadcast row of 16 bytes a range, a four-millionth of the texts. A range also gets the
    first row of the one after it, so one shuffle of the texts, in bounded windows, does for all neighbours.
    """
    rows = docs.select(col(id_col).alias("__id"), F.coalesce(col(text_col), F.lit("")).alias("__t"))
    # ascending: ids from the greatest to the least, then the text's hash
    falling = F.bitwise_not(F.coalesce(F.col("__id").cast("long"), F.lit(-(1 << 63))))
    keyed = rows.select("*", F.struct(falling.alias("k"), F.xxhash64("__t").alias("h")).alias("__key"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()
    busy = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-size // range_bytes), min(-(-n // per_range), busy))
    keys = keyed.select("__key")
    ranged = keys.repartitionByRange(parts, F.col("__key")["k"], F.col("__key")["h"]) if parts > 1 else keys
    firsts = ranged.groupBy(F.spark_partition_id().alias("__p")).agg(F.min("__key").alias("__first"))
    starts = stash(firsts.agg(F.lit(1).alias("__one"), F.array_sort(F.collect_set("__first")).alias("__starts")))
    rows = keyed.withColumn("__one", F.lit(1)).join(F.broadcast(starts), "__one").withColumn("__b", _range_of(F.col("__starts"), F.col("__key")))
    opens = F.get("__starts", "__b") == F.col("__key")
    # the first row of a range is the guest at the end of the range before; that of the first range ends the last
    guests = rows.where(opens).groupBy("__b").agg(F.min("__t").alias("__t"), F.first(F.size("__starts")).alias("__n"))
    guests = guests.select(F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "__t", F.lit(None).cast(rows.schema["__key"].dataType).alias("__key"), F.pmod(F.col("__b") - 1, F.col("__n")).alias("__b"), F.lit(True).alias("__guest"))
    both = rows.drop("__starts", "__one").withColumn("__guest", F.lit(False)).unionByName(guests)
    # dealt by number, not by hash, so that every task gets two ranges
    tasks = max(1, parts // 2)
    dealt = both.withColumn("__task", F.pmod("__b", F.lit(tasks))).repartitionById(tasks, F.col("__task"))
    fp = add_sketch(dealt, "__t", "__fp", fraction)
    w = W.partitionBy("__task", "__b").orderBy("__guest", "__key", "__t")
    seen = fp.select("*", F.lead("__t").over(w).alias("__next"), F.lead("__fp").over(w).alias("__nfp")).where("not __guest")
    size = F.char_length("__t").cast("long")
    half = F.floor(size / 2).cast("int")
    cut = seen.withColumns({"n_chars": size, "__e": F.concat(F.substring("__t", F.lit(1), (size - half).cast("int")), F.substring("__next", F.lit(1), half))})
    out = add_sketch(cut, "__e", "__efp", fraction)
    return out.select(
        F.col("__id").alias(id_col),
        "n_chars",
        F.col("__e").alias("edited_text"),
        F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__efp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__efp")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__nfp")).alias("near_next"),
    )


def _range_of(starts: Column, key: Column) -> Column:
    """The number of the range that holds the key: of the last start that is not above it, by halving."""
    n = F.size(starts)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(starts, mid) <= key
        return F.when(acc["hi"] - acc["lo"] < 2, acc).otherwise(F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]
