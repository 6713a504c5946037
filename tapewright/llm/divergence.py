"""Source divergence audit: how far the words of each source of a language are from those of the others.

Terms are counted by language and source; a language keeps the terms of at least `least` of its documents. Its matrix of
sources by kept terms is cut into blocks of columns and, where it has many sources, tiles of rows. Each block is a
K-squared quadtree: a node stands for a quadrant, which is empty or has K x K children. Pairs of sources are traversed
jointly from the root: where the quadrants of both are all zero, the pair's part there is known without looking, the
columns times the price of a term that neither has; only leaves that one of the two has are priced one by one.

With c a term's count in a source (or in the whole language), N the sum of them over kept terms and V their number,
p = 1 + floor(10^9 (c + 1) / (N + V)); the divergence of p from q is floor((p - q)^2 / q). All arithmetic is exact.

Defined results: a null text, language or source is ''; a source without terms is a source like any other; a language
without kept terms has divergence 0 everywhere; repeated rows are documents of their own; an empty table gives an empty
result. Of the columns of the documents only these three are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, col, drop, flat_bytes, give_back, small_batches, stash, steps, words_of

UNIT = 1_000_000_000
#: Children of a quadtree's node are K x K; terms of a block, sources of a tile; nodes that one step of a traversal takes.
K, BLOCK, TILE, STEP = 4, 4096, 64, 1 << 15
#: Distinct (source, term) that a task gathers before it hands them on.
HELD = 1_500_000

#: Bytes of terms: letters and all beyond ASCII; A-Z is lower-cased first.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
APART = np.ones(256, bool)
APART[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# ---------------------------------------------------------------- counts


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term, text, count): how often which text has which of them."""
    data, off = flat_bytes(texts)
    data = LOWER[data]
    apart = APART[data]
    starts, ends, text = words_of(data, off, apart)
    letters = data[~apart]
    offsets = np.r_[0, np.cumsum(ends - starts)]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    pair, n = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + text, return_counts=True)
    return words.dictionary, pair // max(len(texts), 1), pair % max(len(texts), 1), n


def _sums(term: np.ndarray, group: np.ndarray, groups: int, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(term, group, n, docs) summed up by term and group."""
    key = term * groups + group
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    if not len(first):
        return key, key, n, docs
    return key[order][first] // groups, key[order][first] % groups, np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


class _Counter:
    """Counts of (lang, source, term) of what a task has read so far."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, lang: pa.Array, source: pa.Array, texts: pa.Array) -> None:
        of = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        terms, term, text, n = terms_of(texts)
        term, group, n, docs = _sums(term, of[text], len(self.groups), n, np.ones(len(n), np.int64))
        self.parts.append((terms, term, group, n, docs))
        self.held += len(n)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            words = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
            shift = np.cumsum([0, *(len(p[0]) for p in self.parts)])
            term = np.concatenate([words.indices.to_numpy()[p[1] + s] for p, s in zip(self.parts, shift[:-1], strict=True)]).astype(np.int64)
            group, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
            self.parts = [(words.dictionary, *_sums(term, group, len(self.groups), n, docs))]
            self.held = len(self.parts[0][3])

    def take(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is then forgotten."""
        self.merge()
        for terms, term, group, n, docs in self.parts:
            langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            for a in range(0, len(n), 100_000):
                at = slice(a, a + 100_000)
                g = pa.array(group[at])
                yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(pa.array(term[at])).cast(pa.string()), pa.array(n[at]), pa.array(docs[at])], names=["lang", "source", "term", "n", "docs"])
        self.parts, self.groups, self.held = [], {}, 0


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as each task counts them, of documents (lang, source, text); not yet summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            at = 0
            for part in steps(batch.column(2), 4 << 20):
                counter.add(batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), part)
                at += len(part)
            if counter.held > HELD:
                yield from counter.take()
        yield from counter.take()
        give_back()

    return arrow_map(docs, run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, once): a row for each source that has a kept term; once marks one row of each term.

    One shuffle, by language and term: a term has at most a row for each source there.
    """
    of_term = W.partitionBy("lang", "term")
    summed = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = summed.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "once": F.min("source").over(of_term) == F.col("source")})
    return wide.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "once")


# ---------------------------------------------------------------- prices


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)) by long division, three digits at a time: exact to totals of 9e15."""
    over = np.asarray(total, np.int64) + terms
    rest, out = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return 1 + out


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# ---------------------------------------------------------------- the quadtree


class Quadtree:
    """Which quadrants of a sources x terms matrix hold a count, level by level; level 0 is the whole, a square of side
    K**depth, the last level single cells. Nodes outside the matrix do not exist."""

    def __init__(self, filled: np.ndarray, depth: int):
        self.levels = [filled]
        for _ in range(depth):
            f = self.levels[0]
            rows, cols = -(-f.shape[0] // K), -(-f.shape[1] // K)
            wide = np.zeros((rows * K, cols * K), bool)
            wide[: f.shape[0], : f.shape[1]] = f
            self.levels.insert(0, wide.reshape(rows, K, cols, K).any(axis=(1, 3)))


def depth_of(*sizes: int) -> int:
    depth = 0
    while K**depth < max(sizes):
        depth += 1
    return depth


def traverse(a: Quadtree, b: Quadtree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, column) of all leaves that a or b has; quadrants that both lack are left out. Where a is b,
    each pair of rows is met once, the lower first. Depth first, in pieces of STEP nodes."""
    last = len(a.levels) - 1
    root = np.zeros(1, np.int64)
    # a tree of one cell has no level at which a row could be told from itself: it holds no pair
    stack = [(0, root, root, root)] if (a.levels[0].any() or b.levels[0].any()) and not (a is b and last == 0) else []
    ka, kb, kc = (x.ravel() for x in np.meshgrid(*[np.arange(K)] * 3, indexing="ij"))
    while stack:
        level, i, j, c = stack.pop()
        if len(i) > STEP:
            stack += [(level, i[s : s + STEP], j[s : s + STEP], c[s : s + STEP]) for s in range(0, len(i), STEP)]
            continue
        if level == last:
            yield i, j, c
            continue
        level += 1
        la, lb = a.levels[level], b.levels[level]
        i, j, c = ((x[:, None] * K + k).ravel() for x, k in ((i, ka), (j, kb), (c, kc)))
        inside = (i < la.shape[0]) & (j < lb.shape[0]) & (c < la.shape[1])
        if a is b:
            inside &= i < j if level == last else i <= j
        i, j, c = i[inside], j[inside], c[inside]
        some = la[i, c] | lb[j, c]
        stack.append((level, i[some], j[some], c[some]))


def block_prices(counts_a: np.ndarray, counts_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, terms: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of a against rows of b: the prices of the leaves that one of the two has, summed up, with a's p (ab) and
    with b's (ba), and the number of those leaves. same: a is b, and only pairs i < j are filled in."""
    pa_, pb = share(counts_a, n_a[:, None], terms), share(counts_b, n_b[:, None], terms)
    depth = depth_of(*counts_a.shape, len(counts_b))
    tree = Quadtree(counts_a > 0, depth)
    other = tree if same else Quadtree(counts_b > 0, depth)
    shape = (len(counts_a), len(counts_b))
    ab, ba, leaves = (np.zeros(shape, np.int64) for _ in range(3))
    for i, j, c in traverse(tree, other):
        p, q, at = pa_[i, c], pb[j, c], i * shape[1] + j
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        cell = at[order][first]
        square = (p - q) * (p - q)
        ab.ravel()[cell] += np.add.reduceat((square // q)[order], first)
        ba.ravel()[cell] += np.add.reduceat((square // p)[order], first)
        leaves.ravel()[cell] += np.diff(np.r_[first, len(at)])
    return ab, ba, leaves


# ---------------------------------------------------------------- the audit

_OUT = "lang string, source string, item string, f long, leaves long, terms long, zero long"


def _tile(source: Column, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(source), tiles).cast("int")


def _pairs(tile: Column, tiles: Column) -> Column:
    """The pairs of tiles that a tile is part of."""
    return F.transform(F.sequence(F.lit(0).cast("int"), tiles - 1), lambda t: F.struct(F.least(tile, t).alias("a"), F.greatest(tile, t).alias("b")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part `pair`: every other source of the language with the divergence from it, summed over all kept terms. part
    `term`: the `top` terms of a source that it uses more than its language does, by divergence from the language.
    """
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = stash(kept_terms(rows, least))
    of_lang = kept.groupBy("lang").agg(F.count_if("once").alias("terms"), F.sum("n").alias("lang_total"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = rows.select("lang", "source").distinct()
    # one row for each source, with the numbers of its language, the blocks of its columns and the tiles of its rows
    per_lang = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(of_lang, "lang", "left").fillna({"terms": 0, "lang_total": 0})
    per_lang = stash(per_lang.withColumns({"blocks": F.greatest(F.ceil(F.col("terms") / block), F.lit(1)).cast("int"), "tiles": F.ceil(F.col("sources") / tile).cast("int")}))
    heads = sources.join(of_source, ["lang", "source"], "left").fillna({"total": 0}).join(per_lang, "lang").withColumn("ta", _tile(F.col("source"), F.col("tiles")))
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "lang_n": F.lit(0).cast("long")})
    cells = kept.join(per_lang, "lang").withColumns({"ta": _tile(F.col("source"), F.col("tiles")), "block": F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"), "total": F.lit(0).cast("long")})
    names = ["lang", "block", "source", "ta", "term", "n", "lang_n", "total", "terms", "lang_total"]
    both = heads.select(*names, "tiles").unionByName(cells.select(*names, "tiles")).withColumn("__p", F.explode(_pairs(F.col("ta"), F.col("tiles"))))

    def run(group: pa.Table) -> pa.Table:
        lang, terms, lang_total, block_number = (group.column(c)[0].as_py() for c in ("lang", "terms", "lang_total", "block"))
        tile_a, tile_b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        of, head = group.column("ta").to_numpy(), group.column("term").is_null().to_numpy()
        # sources of both tiles, terms of the block in order
        names_of, source = _numbered(group.column("source"))
        tile_of, total = np.zeros(len(names_of), np.int64), np.zeros(len(names_of), np.int64)
        tile_of[source[head]], total[source[head]] = of[head], group.column("total").to_numpy()[head]
        words, word = _numbered(group.column("term").filter(pa.array(~head)))
        n, lang_n = group.column("n").to_numpy()[~head], np.zeros(len(words), np.int64)
        lang_n[word] = group.column("lang_n").to_numpy()[~head]
        matrix = np.zeros((len(names_of), len(words)), np.int64)
        matrix[source[~head], word] = n
        out: list[list] = [[] for _ in range(7)]

        def put(s: np.ndarray, item: pa.Array, f: np.ndarray, leaves: np.ndarray, zero: np.ndarray) -> None:
            for k, x in enumerate((pa.array([lang] * len(s), pa.string()), names_of.take(pa.array(s)), item, pa.array(f), pa.array(leaves, pa.int64()), pa.array([terms] * len(s), pa.int64()), pa.array(zero, pa.int64()))):
                out[k].append(x)

        a, b = np.flatnonzero(tile_of == tile_a), np.flatnonzero(tile_of == tile_b)
        same = tile_a == tile_b
        if terms and len(a) and len(b):
            ab, ba, leaves = block_prices(matrix[a], matrix[b], total[a], total[b], terms, same)
            zero = share(0, total, terms)
        else:
            ab, ba, leaves = (np.zeros((len(a), len(b)), np.int64) for _ in range(3))
            zero = np.ones(len(names_of), np.int64)
        i, j = np.nonzero(np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool))
        if block_number:  # the first block names every pair; the others what they add
            keep = leaves[i, j] > 0
            i, j = i[keep], j[keep]
        for s, t, f in ((a[i], b[j], ab[i, j]), (b[j], a[i], ba[i, j])):
            put(s, names_of.take(pa.array(t)), f, leaves[i, j], price(zero[s], zero[t]))
        if same and len(words):
            row, c = np.nonzero(matrix)
            p, q = share(matrix[row, c], total[row], terms), share(lang_n[c], lang_total, terms)
            more = p > q
            row, c, f = row[more], c[more], price(p[more], q[more])
            order = np.lexsort((c, -f, row))
            row, c, f = row[order], c[order], f[order]
            place = np.arange(len(row)) - np.maximum.accumulate(np.where(np.diff(row, prepend=-1) != 0, np.arange(len(row)), 0))
            best = place < top
            put(row[best], words.take(pa.array(c[best])), f[best], np.full(best.sum(), -1), np.zeros(best.sum(), np.int64))
        return pa.table([pa.chunked_array(x) for x in out], names=["lang", "source", "item", "f", "leaves", "terms", "zero"])

    keyed = both.select(*names, F.col("__p")["a"].alias("a"), F.col("__p")["b"].alias("b"))
    found = stash(small_batches(keyed).groupBy("lang", "block", "a", "b").applyInArrow(run, _OUT))
    drop(kept, per_lang)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    # what neither of a pair has, in quadrants that were passed over, costs the same a term
    pair = found.where("leaves >= 0").groupBy("lang", "source", "item").agg((F.sum("f") + (F.max("terms") - F.sum("leaves")) * F.max("zero")).alias("value"))
    term = found.where("leaves < 0").select("lang", "source", "item", F.col("f").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    out = pair.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in UTF-8 order, and each row's number among them."""
    coded = pa.concat_arrays([pa.array([], pa.string()), *column.chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), number[coded.indices.to_numpy()]
