"""MinHash near-duplicates with BagMinHash signatures, bands and exact verification of the multiset overlap.

1. Equal texts become one member, their least id (hashes are shuffled, not texts).
2. Members whose signatures share a band meet in a bucket. Each is held, exactly, against its bucket's leader, the member
   that meets most others.
3. Components of the links found so far; then what met a leader and is of another component is held against all that met
   that leader, unless an exact bound rules a link out. Two members that are near enough must share a token of their
   prefixes, where what the leader lacks comes first and of that the rarest: copies with edits of their own do not meet.
   And 1 - J is a metric, so |J(a, L) - J(b, L)| > 1 - threshold proves J(a, b) < threshold. Members of one component
   need no further link.
4. Components again. No candidate is capped or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bagminhash import band_keys, compare, multisets, shingles, signatures
from .common import append, col, drop, give_back, small_batches, stash, steps
from .components import connected_components


def with_bands(docs: DataFrame, text_col: str, bands: int, rows: int) -> DataFrame:
    """Adds bands (array<long>, null where a text has no word) and n_shingles."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            h, off = shingles(texts)
            sig = signatures(*multisets(h, off), len(texts), bands * rows)
            keys = band_keys(sig, bands)
            n = np.diff(off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            return [pc.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type)), pa.array(n, pa.int64())]

        return run

    return append(docs, text_col, [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.LongType())], make)


#: Keys that the rows of one band, leader or hub are dealt to where they meet a row of their own.
SALTS = 16


def salted_join(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to the one row of their key, which is copied for each salt; rows are dealt to the salts by a hash of `by`,
    so no task gets all rows of a key."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"], how).drop("__salt")


def with_text(pairs: DataFrame, texts: DataFrame, side: str, per_key: int) -> DataFrame:
    """Adds t<side>, the text of one end of each pair. The pairs of an id that has more than `per_key` are dealt to as many
    keys as that needs, with a copy of the text for each, so that no task holds all pairs of a hub."""
    hubs = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / per_key).cast("int").alias("keys")).where("keys > 1")
    other = "a" if side == "b" else "b"
    dealt = salted_join(pairs, hubs, side, other, "left").withColumn("key", F.pmod(F.xxhash64(other), F.coalesce("keys", F.lit(1)))).drop("keys")
    ends = texts.select(F.col("id").alias(side), F.col("t").alias(f"t{side}")).join(hubs, side, "left")
    ends = ends.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("keys", F.lit(1)).cast("long") - 1))).drop("keys")
    return dealt.join(ends, [side, "key"]).drop("key")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float | None = None, per_key: int = 2000) -> DataFrame:
    """(a, b) of member ids and (id, t) -> (a, b, j[, extra, common]): the exact weighted Jaccard of each pair, and with a
    threshold the tokens of a against b (see bagminhash.compare). Pairs should be stored: they are read more than once."""
    both = with_text(with_text(pairs, texts, "a", per_key), texts, "b", per_key).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            at = 0
            for left in steps(batch.column(2)):
                whole = batch.slice(at, len(left))
                at += len(left)
                done = 0
                for right in steps(whole.column(3)):
                    part = whole.slice(done, len(right))
                    done += len(right)
                    j, tokens = compare(part.column(2), part.column(3), threshold)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j), *tokens], names=["a", "b", "j", "extra", "common"][: 3 + len(tokens)])
        give_back()

    return small_batches(both).mapInArrow(run, "a long, b long, j double" + (", extra array<int>, common array<int>" if threshold else ""))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32, rows: int = 6) -> DataFrame:
    """(id, class_id): one row for each distinct non-null id; class_id is the least id of its class.

    Classes are the components of links between texts with weighted Jaccard >= threshold over five-word shingles.
    With 32 bands of 6 registers a pair at 0.8 is found with probability 0.9999. Null texts count as empty; equal texts,
    empty ones too, are one class. Rows with a null id are left out; of rows that repeat an id with different texts,
    all texts count and their classes join. An empty table gives an empty result.
    """
    base = docs.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    keyed = with_bands(base.withColumn("digest", F.md5(F.col("t").cast("binary"))), "t", bands, rows).drop("t")
    member = stash(keyed.groupBy("digest").agg(F.min("id").alias("m"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")))
    own = stash(base.select("id", F.md5(F.col("t").cast("binary")).alias("digest")).join(member.select("digest", "m"), "digest").select("id", "m").distinct())

    bucket = stash(member.where("bands is not null").select(F.explode("bands").alias("k"), "m", "n"))
    shared = bucket.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = stash(salted_join(bucket, shared, "k", "m"))
    drop(bucket)
    # the member that meets most others leads its buckets: in a family of copies that is the original, near to all
    pull = crowded.groupBy("m").agg(F.sum("size").alias("pull"))
    led = stash(crowded.join(pull, "m"))
    lead = led.groupBy("k").agg(F.max_by("m", F.struct("pull", (-F.col("m")).alias("o"))).alias("lead"))
    met = stash(salted_join(led, lead, "k", "m").select("k", "m", "n", "lead"))
    drop(crowded, led)
    pairs = stash(met.where("m <> lead").select(F.col("m").alias("a"), F.col("lead").alias("b")).distinct())
    needed = met.select(F.col("m").alias("id")).distinct()
    texts = stash(base.join(own.where("id = m").select("id"), "id", "left_semi").join(needed.hint("shuffle_hash"), "id", "left_semi"))
    links = stash(verify(pairs, texts, threshold))

    copies = own.where("id <> m").select(F.col("id").alias("u"), F.col("m").alias("v"))
    near = links.where(F.col("j") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = stash(connected_components(near))

    # members of other components than their leader's, against all that met the same leader
    part = first.select("id", "component")
    leaders = links.select("b").distinct()
    of_leader = leaders.join(part.select(F.col("id").alias("b"), F.col("component").alias("lead_c")), "b")
    placed = (
        salted_join(links.join(part.select(F.col("id").alias("a"), F.col("component").alias("c")), "a", "left"), of_leader, "b", "a", "left")
        .join(member.select(F.col("m").alias("a"), "n"), "a")
        .withColumns({"c": F.coalesce("c", "a"), "lead_c": F.coalesce("lead_c", "b")})
        .withColumn("apart", F.col("c") != F.col("lead_c"))
    )
    open_ = placed.where("apart").groupBy("b").agg(F.count(F.lit(1)).alias("others"))
    live = stash(salted_join(placed, open_.select("b"), "b", "a").select("b", F.col("a").alias("m"), "n", "j", "c", "apart", "extra", "common"))
    # the order of a leader's extra tokens: the rarest first; of each member just the prefix is kept
    extra = live.select("b", "m", "n", F.explode("extra").alias("tok"))
    often = extra.groupBy("b", "tok").agg(F.count(F.lit(1)).alias("often"))
    long_enough = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    nth = F.row_number().over(W.partitionBy("b", "m").orderBy("often", "tok"))
    rare = extra.join(often, ["b", "tok"]).withColumn("nth", nth).where(F.col("nth") <= long_enough).where("often > 1").select("b", "m", "tok", "nth")
    filled = live.select("b", "m", F.size("extra").alias("before"), F.posexplode("common").alias("at", "tok")).select("b", "m", "tok", (F.col("before") + F.col("at") + 1).alias("nth"))
    tokens = stash(rare.union(filled).join(live.drop("extra", "common"), ["b", "m"]))
    drop(live)
    slack = 1.0 - threshold + 1e-9
    x, y = tokens.where("apart").alias("x"), tokens.alias("y")
    same = (F.col("x.b") == F.col("y.b")) & (F.col("x.tok") == F.col("y.tok")) & (F.col("x.c") != F.col("y.c")) & (~F.col("y.apart") | (F.col("x.m") < F.col("y.m")))
    near_enough = (F.abs(F.col("x.j") - F.col("y.j")) <= slack) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
    # at their first shared token, what may still be shared must reach the overlap that the sizes ask for
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-6)
    reach = (F.col("x.n") - F.col("x.nth") + 1 >= overlap) & (F.col("y.n") - F.col("y.nth") + 1 >= overlap)
    rest = x.join(y, same & near_enough & reach).select(F.least("x.m", "y.m").alias("a"), F.greatest("x.m", "y.m").alias("b")).distinct()
    more = verify(stash(rest), texts).where(F.col("j") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    merged = connected_components(copies.union(first.select(F.col("id").alias("u"), F.col("component").alias("v"))).union(more))
    return (
        base.select("id").distinct().join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Drop all rows of a class but one of its least id (of rows that repeat that id, the one of least text); columns as
    they were. Rows with a null id stay.

    Only ids that go or repeat are joined to the documents, and only rows that repeat an id are shuffled by it.
    """
    found = classes(docs, id_col, text_col, **options)
    gone = found.where("id <> class_id").select(F.col("id").alias("__mark"))
    again = docs.where(col(id_col).isNotNull()).groupBy(col(id_col).cast("long").alias("__mark")).count().where("count > 1").select("__mark")
    marks = stash(gone.withColumn("__gone", F.lit(True)).union(again.withColumn("__gone", F.lit(False))).groupBy("__mark").agg(F.bool_or("__gone").alias("__gone")))
    key = col(id_col).cast("long") == F.col("__mark")
    single = docs.join(marks, key, "left_anti")
    repeated = docs.join(marks.where("not __gone"), key, "left_semi")
    first = repeated.withColumn("__n", F.row_number().over(W.partitionBy(col(id_col)).orderBy(col(text_col)))).where("__n = 1").drop("__n")
    return single.unionByName(first)
