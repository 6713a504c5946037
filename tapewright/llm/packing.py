"""Best-fit-decreasing packing of token sequences.

A document's tokens are cut only where it exceeds the sequence length. Pieces are dealt by hash into groups of bounded
size, each packed by best-fit decreasing: a segment tree over the remaining capacities tells the tightest open bin that
a piece fits, in logarithmic time. Large groups of like make-up fill their bins, so groups cost next to nothing.

Defined results: a null text is an empty one, whose document is the end token alone; repeated rows are packed as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, flat_bytes, give_back, range_hashes, small_batches, stash, steps, without

#: Distinct pieces of words that a task remembers with their ids, in flat arrays of about 60 bytes each.
MEMO_PIECES = 400_000
#: Bytes of text whose words are looked up together.
WORDS_BYTES = 1 << 20
#: Marks that are cut off a word which they end, after one of STEMS: no pre-token spans that place. Letters beyond ASCII may
#: be lower-cased to a letter and a combining mark, which the tokenizer keeps with the marks after it.
MARKS, STEMS = pa.array(list(".,!?;:")), pa.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
#: Stands between words that are tokenized in one call, as a pre-token of its own.
SEPARATOR = "\x01"


class WordTokenizer:
    """Token ids of whole texts by a tokenizer whose pre-tokens never span ASCII white space, a word at a time.

    Arrow finds the distinct words of a batch; what is not remembered of them goes to the tokenizer, many in one call.
    """

    def __init__(self, path: str, most: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        # which ids end a pre-token, and what the separator makes
        self.stops = np.zeros(max(vocabulary.values()) + 1, bool)
        self.stops[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.between = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        # known pieces in order of arrival, their ids, and their sorted hashes with their places
        self.known, self.ends, self.ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian uint32 ids of all texts, and len+1 offsets."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        each = split.flatten().dictionary_encode()
        words, which = each.dictionary, each.indices.to_numpy()
        stem, last = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
        apart = pc.and_(pc.is_in(last, MARKS.cast(last.type)), pc.is_in(pc.utf8_slice_codeunits(stem, -1), STEMS.cast(last.type)))
        pieces = pa.concat_arrays([pc.if_else(apart, stem, words), pc.if_else(apart, last, "")]).dictionary_encode()
        # stem and mark of every word that occurs, one after the other
        both = self.place(pieces.dictionary)[pieces.indices.to_numpy()].reshape(2, -1)[:, which].T.ravel()
        size = self.ends[both + 1] - self.ends[both]
        end = np.r_[0, np.cumsum(size)]
        out = self.ids[np.arange(end[-1]) + np.repeat(self.ends[both] - end[:-1], size)]
        offsets = split.offsets.to_numpy().astype(np.int64)
        if len(self.known) > self.most:
            self.forget(len(self.known) - self.most // 2)
        return out, end[2 * (offsets - offsets[0])]

    def place(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces among the known ones, where new ones are put first. Hashes find them, the pieces decide."""
        data, off = flat_bytes(pieces)
        h = range_hashes(data, off[:-1], off[1:])
        i = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        at = self.places[i] if len(self.places) else np.zeros(len(h), np.int64)
        hit = np.zeros(len(h), bool)
        if len(self.known):
            hit = (self.hashes[i] == h) & pc.equal(self.known.take(pa.array(at)), pieces).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            order = fresh[self.learn(pieces.take(pa.array(fresh)))]
            at[order] = len(self.known) - len(order) + np.arange(len(order))
            order = order[np.argsort(h[order], kind="stable")]
            into = np.searchsorted(self.hashes, h[order])
            self.hashes, self.places = np.insert(self.hashes, into, h[order]), np.insert(self.places, into, at[order])
        return at

    def learn(self, new: pa.Array) -> np.ndarray:
        """Remember new pieces; returns the order in which they are kept."""
        letters = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        alone = pc.match_substring(new, SEPARATOR).to_numpy(zero_copy_only=False) | (len(self.between) != 1)
        order, ids, sizes = [], [], []
        for kind in (letters & ~alone, ~letters & ~alone, alone):
            for at in np.array_split(np.flatnonzero(kind), max(1, -(-kind.sum() // 1024))):
                some = new.take(pa.array(at)).to_pylist()
                got, size = self.each(some) if kind is alone else self.many(some, bool(letters[at[:1]].all()))
                order.append(at)
                ids.append(got)
                sizes.append(size)
        order = np.concatenate(order)
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))]
        return order

    def many(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has. Words of letters alone need no separator where each makes one pre-token."""
        if letters:
            got = self.encode(" ".join(words))
            stop = np.flatnonzero(self.stops[got])
            if len(stop) == len(words):
                return got, np.diff(stop, prepend=-1)
        got = self.encode(f" {SEPARATOR} ".join([*words, ""]))
        stop = got == self.between[0]
        return got[~stop], np.diff(np.flatnonzero(stop), prepend=-1) - 1

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.encode(w) for w in words]
        return np.concatenate([np.zeros(0, "<u4"), *got]), np.array([len(g) for g in got], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def forget(self, n: int) -> None:
        """Drop the n pieces that were learnt first."""
        self.ids, self.known = self.ids[self.ends[n] :].copy(), pa.concat_arrays([self.known[n:]])
        self.ends = self.ends[n:] - self.ends[n]
        self.hashes, self.places = self.hashes[self.places >= n], self.places[self.places >= n] - n


def tokenize(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digest: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, piece, start, length[, ids][, ids_crc32][, more]): a row for each piece of each document's ids, end_id after the last.

    `ids` (array<int>) are the tokens themselves; `digest` adds the unsigned crc32 of their little-endian uint32 bytes.
    """
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("ids_crc32", T.LongType())] * digest
    rows = docs.select(col(id_col), col(text_col).alias("__t"), *[col(c) for c in more])
    schema = T.StructType([rows.schema[0], *fields, *rows.schema.fields[2:]])

    def run(batches):
        of = WordTokenizer(tokenizer_path)
        for batch in batches:
            at = 0
            for part in steps(batch.column(1), WORDS_BYTES):
                keys, others = batch.column(0).slice(at, len(part)), [c.slice(at, len(part)) for c in batch.columns[2:]]
                at += len(part)
                flat, offsets = of(part)
                flat = np.insert(flat, offsets[1:], end_id)
                total = np.diff(offsets) + 1
                pieces = -(-total // length)
                row = np.repeat(np.arange(len(part)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(total[row] - piece * length, length)
                ends = np.r_[0, np.cumsum(size)]
                columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(size, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("<i4"))))
                if digest:
                    columns.append(pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()))
                columns += [c.take(pa.array(row)) for c in others]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        del of
        give_back()

    return small_batches(rows).mapInArrow(run, schema)


class CapacityTree:
    """Counts of open bins by remaining capacity, in a segment tree: add, remove and the tightest fit take log steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.sums = [0] * (2 * self.leaves)
        self.bins: list[list] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, bin_: object) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.leaves
        while i:
            self.sums[i] += 1
            i >>= 1

    def take_tightest(self, size: int) -> tuple[int, object] | None:
        """Remove and return the bin of least capacity >= size."""
        i = size + self.leaves
        if not self.sums[i]:
            while i > 1 and (i & 1 or not self.sums[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.sums[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.sums[i] -= 1
            i >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size by best-fit decreasing; a size of 0 takes no place."""
    tree, bins, offsets, n = CapacityTree(capacity), [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if size > capacity or size < 0:
            raise ValueError(f"size {size} does not fit {capacity}")
        found = tree.take_tightest(size)
        left, bin_ = found if found else (capacity, n)
        n += found is None
        bins[i], offsets[i] = bin_, capacity - left
        if left > size:
            tree.add(left - size, bin_)
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), size_col: str = "length", group_rows: int = 16_000, within: str | None = None) -> DataFrame:
    """Adds sequence_id and offset: pieces of one sequence lie without gaps from 0 and fill at most `length`.

    Pieces that fill a sequence alone are placed without a shuffle. The others are dealt at random, the same way on
    every run, into groups of about `group_rows`, each packed in one task; a repeated piece is spread by its place. With
    `within`, a column of whole numbers from 0, like shards, no sequence holds pieces of two of them; they should be few
    and alike in size, since each has its own groups.
    """
    rows = without(pieces, ["sequence_id", "offset"])
    whole = rows.where(col(size_col) >= length)
    part = rows.where(col(size_col) < length)
    if within is None:
        shards, n_part = 1, part.count()
        each = max(1, -(-n_part // group_rows))
    else:
        most = part.groupBy(col(within).alias("s")).count().agg(F.coalesce(F.max("s"), F.lit(0)).alias("s"), F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()
        shards, each = int(most["s"]) + 1, max(1, -(-most["n"] // group_rows))
    groups, shard = shards * each, F.lit(0) if within is None else col(within)
    spread = part.withColumn("__g", (shard * each + F.pmod(F.xxhash64(*[col(k) for k in keys], F.monotonically_increasing_id()), F.lit(each))).cast("int"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, names = rows.columns.index(size_col), rows.columns
    key_at = [names.index(k) for k in keys]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.select(names)
        group = group.sort_by([(names[i], "ascending") for i in key_at])
        bins, offsets = best_fit(group.column(at).to_pylist(), length)
        seq = pa.array(np.array(bins, np.int64) * 2 * groups + 2 * key[0].as_py() + 1)
        return pa.table([*group.columns, seq, pa.array(offsets, pa.int64())], names=schema.names)

    # ranges of group numbers: a hash of few groups would send two of them to one task
    tasks = min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = small_batches(spread).repartitionByRange(tasks, "__g").groupBy("__g").applyInArrow(run, schema)
    # even numbers: sequences of one piece, numbered by partition and place
    return packed.unionByName(whole.withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")}))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences of packed pieces that carry their ids (tokenize(..., ids=True) through pack());
    pieces that occur twice are there twice."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", within: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, within], sequence_id, offset) of all documents; tokenized once, into the shared
    folder. `within`: a column of docs, see pack()."""
    pieces = stash(tokenize(docs, tokenizer_path, length, id_col=id_col, text_col=text_col, ids=False, digest=True, more=(within,) if within else ()))
    return pack(pieces, length, (id_col, "piece"), within=within)
