"""Benchmark decontamination by suffix arrays over the training text.

Documents go through in shards, an Arrow batch each. A shard numbers its words by the benchmark's vocabulary (a word that
no item has is 0, as is the end of a document) and sorts its suffixes by their first words, as many as fit 63 bits (and a window). Every
test suffix (each word position of each item) is binary-searched there. The ranges of the array where a test suffix falls
are sorted on, doubling the depth each time; what no test suffix shares its first words with never needs an order. Binary
searches in the finished array give the longest verbatim match of every test suffix and all places of every window.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words that lie
inside any occurrence of a window are hit. Documents are never shuffled: a pass over them takes up to PASS_WORDS words of
the benchmark as arrays; a larger benchmark takes more passes, whose hits are merged. Items beyond PIECE_WORDS words are
cut into pieces that overlap, so that no window is lost.

Words are compared by 64-bit hashes of their bytes, A-Z lower-cased.

Defined results: a null or empty text has no words and is clean; repeated rows are judged one by one; items with one id
count once, an item whose id is null is searched for but has no name to list; an empty benchmark hits nothing; columns
of the documents whose names clash with those added give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, col, flat_bytes, give_back, range_hashes, stash, steps, without, words_of

WINDOW = 10
#: Words of a piece of an item, and words of the benchmark that one pass takes to every task (8 bytes each, some 60 with
#: the arrays made from them).
PIECE_WORDS, PASS_WORDS = 1 << 16, 1 << 20

#: Bytes of words: digits, letters and all beyond ASCII; A-Z is lower-cased first.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and len+1 offsets."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in steps(texts):
        data, off = flat_bytes(part)
        data = LOWER[data]
        starts, ends, doc = words_of(data, off, APART[data])
        hashes.append(range_hashes(data, starts, ends))
        counts.append(np.bincount(doc, minlength=len(part)))
    return np.concatenate(hashes), np.r_[0, np.cumsum(np.concatenate(counts))]


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo..hi of all pairs, one after the other."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


def packed(ids: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The `width` numbers from each place on in one integer, the first the highest; beyond the end they are 0."""
    out = ids.astype(np.int64)
    for k in range(1, width):
        out <<= bits
        out[: len(ids) - k] |= ids[k:]
    return out


# ---------------------------------------------------------------- the benchmark


@dataclass(frozen=True)
class Suffixes:
    """All suffixes of a part of the benchmark, by the place where they begin; pieces end in a 0."""

    vocabulary: np.ndarray  # hashes of words, sorted; numbers count from 1
    ids: np.ndarray
    left: np.ndarray  # words from a place to its piece's end
    piece: np.ndarray
    names: list[str | None]  # of the pieces' items
    at: np.ndarray  # of the pieces in their items
    bits: int
    width: int
    keys: np.ndarray  # the first `width` numbers of each suffix
    window: np.ndarray  # a place of each distinct window
    length: np.ndarray  # its words
    group: np.ndarray  # its group in `groups`, the names of the items that hold it
    groups: list[tuple[str, ...]]


def suffixes(pieces: list[tuple[str | None, int, bool, np.ndarray]], window: int = WINDOW) -> Suffixes:
    """From (item, place in it, whether it is the item's first piece, hashes of words); later pieces overlap the one before by window - 1 words."""
    pieces = [p for p in pieces if len(p[3])]
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *[p[3] for p in pieces]])
    vocabulary, number = np.unique(flat, return_inverse=True)
    bits = max(1, int(len(vocabulary)).bit_length())
    width = max(1, min(63 // bits, window))
    ids, left, piece = (np.zeros(len(flat) + len(pieces) + width, np.int64) for _ in range(3))
    first = np.cumsum(sizes + 1) - sizes - 1
    place = ranges(first, first + sizes)
    ids[place], piece[place] = number + 1, np.repeat(np.arange(len(pieces)), sizes)
    left[place] = np.repeat(first + sizes, sizes) - place
    keys = packed(ids, bits, width)
    for k in range(1, width):  # nothing beyond the piece's end
        short = left == k
        keys[short] = keys[short] >> bits * (width - k) << bits * (width - k)

    # distinct windows, by doubling: equal numbers stand for equal words from a place on
    begins = place[(left[place] >= window) | ((left[place] == sizes[piece[place]]) & np.array([p[2] for p in pieces], bool)[piece[place]])]
    length = np.minimum(left[begins], window)
    same = np.zeros((len(begins), 1), np.int64)
    for k in range(window):
        word = np.where(k < length, ids[np.minimum(begins + k, len(ids) - 1)], 0)
        _, same = np.unique(same.ravel() * (len(vocabulary) + 1) + word, return_inverse=True)
    same = same.ravel()
    order = np.argsort(same, kind="stable")
    cut = np.flatnonzero(np.diff(same[order], prepend=-1))
    held = [tuple(sorted({n for i in some if (n := pieces[piece[begins[i]]][0]) is not None})) for some in np.split(order, cut[1:])] if len(order) else []
    groups = list(dict.fromkeys(held))
    number_of = {g: i for i, g in enumerate(groups)}
    which = order[cut]
    return Suffixes(vocabulary, ids, left, piece, [p[0] for p in pieces], np.array([p[1] for p in pieces], np.int64), bits, width, keys, begins[which], length[which], np.array([number_of[g] for g in held], np.int64), groups)


def benchmark_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, at, first, words): the hashed words of the items, in pieces of at most PIECE_WORDS."""
    rows = benchmark.select(col(id_col).cast("string").alias("item"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words, _ = hashed_words(pa.array([text.as_py()], pa.large_string()))
                starts = np.arange(0, max(1, len(words) - window + 1), PIECE_WORDS - window + 1)
                some = [words[a : a + PIECE_WORDS].view(np.int64) for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(some), pa.string()), pa.array(starts), pa.array(starts == 0), pa.array(some, pa.list_(pa.int64()))], names=["item", "at", "first", "words"])
        give_back()

    return arrow_map(rows, run, "item string, at long, first boolean, words array<long>").where("size(words) > 0")


def passes(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Suffixes]:
    """The benchmark in parts of about `most` words, dealt by hash; at least one part."""
    pieces = stash(benchmark_pieces(benchmark, id_col, text_col, window))
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        part = pieces.where(F.pmod(F.xxhash64("item", "at"), F.lit(n)) == k).toArrow().sort_by([("item", "ascending"), ("at", "ascending")])
        lists = part.column("words").combine_chunks()
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())] if len(lists) else np.zeros(1, np.int64)
        names, at, first = (part.column(c).to_pylist() for c in ("item", "at", "first"))
        yield suffixes([(names[i], at[i], first[i], flat[ends[i] : ends[i + 1]]) for i in range(len(names))], window)


# ---------------------------------------------------------------- a shard of the training text


class Shard:
    """The suffix array of some documents, sorted as deep as the test suffixes tell suffixes apart."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, tests: Suffixes):
        self.tests, self.offsets = tests, offsets
        self.first = offsets[:-1] + np.arange(len(offsets) - 1)  # places of the documents' first words
        self.ids = np.zeros(len(hashes) + len(offsets) - 1 + tests.width, np.int64)
        if len(tests.vocabulary):
            at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
            known = np.where(tests.vocabulary[at] == hashes, at + 1, 0)
            self.ids[np.arange(len(hashes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = known
        self.keys = packed(self.ids, tests.bits, tests.width)
        places = np.flatnonzero(self.ids)
        order = np.argsort(self.keys[places])
        self.array = places[order]
        self.sorted = self.keys[self.array]
        # where each test suffix falls, by its first words
        low = (np.int64(1) << tests.bits * (tests.width - np.minimum(tests.left, tests.width))) - 1
        self.lo = np.searchsorted(self.sorted, tests.keys)
        self.hi = np.where(tests.left > 0, np.searchsorted(self.sorted, tests.keys | low, "right"), self.lo)
        self.deepen()

    def deepen(self) -> None:
        """Sort on, by ranks of twice the depth each time, what shares its first words with a test suffix that goes on."""
        tests, h = self.tests, self.tests.width
        goes_on = np.flatnonzero((tests.left > h) & (self.hi - self.lo > 1))
        lo, once = np.unique(self.lo[goes_on], return_index=True)
        slots = ranges(lo, self.hi[goes_on][once])
        if not len(slots):
            return
        new = np.diff(self.sorted, prepend=-1) != 0
        rank = np.zeros(len(self.ids) + 1, np.int64)
        rank[self.array] = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) + 1
        deepest = int(tests.left.max())
        while len(slots) and h < deepest:
            a = self.array[slots]
            here, ahead = rank[a], rank[np.minimum(a + h, len(self.ids))]
            order = np.lexsort((ahead, here))
            a, here, ahead = a[order], here[order], ahead[order]
            new = (np.diff(here, prepend=-1) != 0) | (np.diff(ahead, prepend=-1) != 0)
            self.array[slots] = a
            rank[a] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
            size = np.diff(np.r_[np.flatnonzero(new), len(a)])
            slots = slots[np.repeat(size > 1, size)]
            h *= 2

    def common(self, test: np.ndarray, place: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many words, at most `upto`, the test suffixes have in common with the text at the places."""
        tests, k, live = self.tests, np.zeros(len(test), np.int64), np.arange(len(test))
        while len(live):
            x = tests.keys[test[live] + k[live]] ^ self.keys[np.minimum(place[live] + k[live], len(self.keys) - 1)]
            same = sum(((x >> tests.bits * (tests.width - j)) == 0).astype(np.int64) for j in range(1, tests.width + 1))
            k[live] += same
            live = live[(same == tests.width) & (k[live] < upto[live])]
        return np.minimum(k, upto)

    def bound(self, test: np.ndarray, upto: np.ndarray, right: bool = False) -> np.ndarray:
        """Where in the array the first `upto` words of the test suffixes go, before (or after) what begins with them."""
        lo, hi = self.lo[test].copy(), self.hi[test].copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            t, place = test[live], self.array[mid]
            k = self.common(t, place, upto[live])
            before = np.where(k < upto[live], self.ids[np.minimum(place + k, len(self.ids) - 1)] < self.tests.ids[t + k], right)
            lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, length, place): the longest match of every test suffix that shares its first words with the shard."""
        test = np.flatnonzero(self.hi > self.lo)
        upto = self.tests.left[test]
        at = self.bound(test, upto)
        near = [self.array[np.clip(x, self.lo[test], self.hi[test] - 1)] for x in (at - 1, at)]
        size = [self.common(test, p, upto) for p in near]
        before = size[0] > size[1]
        return test, np.where(before, *size), np.where(before, *near)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences of all windows."""
        test, length = self.tests.window, self.tests.length
        lo, hi = self.bound(test, length), self.bound(test, length, True)
        return self.array[ranges(lo, hi)], np.repeat(np.arange(len(test)), hi - lo)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """For every document: the spans of words that are hit, and the names of the items hit, sorted."""
        n = len(self.first)
        spans, names = [[] for _ in range(n)], [[] for _ in range(n)]
        place, window = self.windows()
        if not len(place):
            return spans, names
        depth = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(depth, place, 1)
        np.add.at(depth, place + self.tests.length[window], -1)
        hit = np.r_[False, np.cumsum(depth) > 0, False]
        start, stop = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
        doc = self.document(start)
        for d, a, b in zip(doc.tolist(), (start - self.first[doc]).tolist(), (stop - self.first[doc]).tolist(), strict=True):
            spans[d].append((a, b))
        pair = np.unique(self.document(place) * len(self.tests.groups) + self.tests.group[window])
        doc, group = pair // len(self.tests.groups), pair % len(self.tests.groups)
        united: dict[tuple[int, ...], list[str]] = {}
        for some in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(doc)) + 1):
            key = tuple(group[some].tolist())
            if key not in united:
                united[key] = sorted({x for g in key for x in self.tests.groups[g]})
            names[doc[some[0]]] = united[key]
        return spans, names


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


# ---------------------------------------------------------------- operators

ADDED = ["n_words", "hits", "items"]
HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _pass(docs: DataFrame, text_col: str, tests: Suffixes) -> DataFrame:
    """Adds n_words, hits and items; those of an earlier pass, where there are any, are merged with what is found."""
    before = "hits" in docs.columns
    names = [c for c in docs.columns if c not in ADDED]
    schema = T.StructType([*docs.select(*[col(c) for c in names]).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))])
    text_at, keep = docs.columns.index(text_col), [docs.columns.index(c) for c in names]
    old = [docs.columns.index(c) for c in ADDED[1:]] if before else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = hashed_words(batch.column(text_at))
            spans, items = Shard(hashes, offsets, tests).hits()
            if before:
                for i, (s, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in old), strict=True)):
                    spans[i] = merged(spans[i], [(x["start"], x["stop"]) for x in s]) if s else spans[i]
                    items[i] = sorted({*items[i], *n}) if n else items[i]
            found = [[{"start": a, "stop": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.diff(offsets)), pa.array(found, _SPANS), pa.array(items, pa.list_(pa.string()))], names=schema.names)
        give_back()

    return arrow_map(docs, run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Adds n_words, hits (array of start, stop: the merged spans of words inside occurrences of windows) and items (the
    sorted ids, as strings, of the items with occurring windows) to every document."""
    out = without(docs, ADDED)
    for k, tests in enumerate(passes(benchmark, item_id, item_text, window, pass_words)):
        out = _pass(stash(out) if k else out, text_col, tests)
    return out


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    plain = without(docs, ADDED)
    return find(docs, benchmark, text_col, item_id, item_text, window).where(F.size("hits") == 0).select(*[col(c) for c in plain.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """(item, item_start, length, doc, doc_start): for every test suffix its longest verbatim match of at least `least`
    words in any shard, and where it is (of several equal ones, one). A match ends with its piece (PIECE_WORDS)."""
    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("length", T.LongType()), rows.schema["doc"], T.StructField("doc_start", T.LongType())])
    out = None
    for tests in passes(benchmark, item_id, item_text, least, pass_words):

        def run(batches: Iterator[pa.RecordBatch], tests: Suffixes = tests) -> Iterator[pa.RecordBatch]:
            names = pa.array(tests.names, pa.string())
            origin = np.flatnonzero(np.diff(tests.left, prepend=0) > 0)  # where the pieces begin
            for batch in batches:
                shard = Shard(*hashed_words(batch.column(1)), tests)
                test, size, place = shard.longest()
                keep = size >= least
                test, size, place = test[keep], size[keep], place[keep]
                piece, doc = tests.piece[test], shard.document(place)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(piece)), pa.array(test - origin[piece] + tests.at[piece]), pa.array(size), batch.column(0).take(pa.array(doc)), pa.array(place - shard.first[doc])], names=schema.names)
            give_back()

        found = arrow_map(rows, run, schema)
        out = found if out is None else out.union(found)
    best = F.min_by(F.struct("length", "doc", "doc_start"), F.struct((-F.col("length")).alias("l"), "doc", "doc_start")).alias("m")
    return out.groupBy("item", "item_start").agg(best).select("item", "item_start", "m.length", "m.doc", "m.doc_start")
