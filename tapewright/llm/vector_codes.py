"""Vector compression by product codes: a codebook for each part of the vectors, trained by member-resident Lloyd.

Vectors become integers and are cut into equal parts. A member is a distinct part at its position, with the number of
vectors that have it: tasks merge equal parts before anything moves. Members live with the owner of their (position,
entry, salt), where the salt is a hash of the part: an entry, however large, has many owners, and equal parts have one.
A round is

1. owners sum up their resident members; the sums of an entry's owners give its new components (their floor mean),
2. owners hold their members against the position's new entries, where they are, and write them with what they chose,
3. members that stay are read by the tasks that have them; only those that change entry are shuffled, to the new owner.

Codes come from the vectors themselves, held against the last codebooks, without a shuffle.

All arithmetic is exact: in double precision where every distance stays below 2**53, else in Python's integers.

Defined results: vectors that are null or empty, or hold a null or non-finite component, take no part; so do those whose
length is not that of the first vector of the initial codebook. Ties of distance go to the lower entry; among equal ids,
the initial entries take the smaller vector first, null ids come last. Fewer vectors than entries make as many entries;
no vectors give an empty result. Where the parts do not divide a vector evenly, the first ones are longer by one; equal
rows are coded one by one. An error beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, col, drop, give_back, stash, without

PARTS, ENTRIES, ROUNDS, SCALE, SALTS = 16, 64, 2, 256, 32
#: Distances that one step holds at a time.
STEP = 1 << 21
#: Integers up to this have exact distances in double precision (parts of up to 2**10 components).
EXACT = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries, an integer matrix [entries, components]."""

    entries: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def edges(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    size, more = divmod(width, parts)
    return [i * size + min(i, more) for i in range(parts + 1)]


def scaled(lists: pa.ListArray, width: int | None, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the usable vectors of the given width (any, where None) as rows, and which rows they are."""
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten()
    x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * float(scale))  # null becomes NaN
    row = np.repeat(np.arange(len(lists)), size)
    ok = size > 0
    ok[row[~np.isfinite(x)]] = False
    if width is None:
        width = int(size[ok][0]) if ok.any() else 0
    ok &= size == width
    x = x[ok[row]].reshape(-1, width) if width else np.zeros((0, 0))
    whole = x.astype(np.int64) if np.abs(x).max(initial=0) < 2.0**62 else np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return whole, np.flatnonzero(ok)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest entry; ties go to the lower one."""
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) < EXACT and x.shape[1] <= 1 << 10
    which, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if small else object)
    if not len(x):
        return which, best
    kind = np.float64 if small else object
    e = entries.astype(kind)
    norm = (e * e).sum(axis=1)
    for a in range(0, len(x), max(1, STEP // len(e))):
        part = x[a : a + max(1, STEP // len(e))].astype(kind)
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ e.T) + norm[None, :]
        at = far.argmin(axis=1)
        which[a : a + len(part)], best[a : a + len(part)] = at, far[np.arange(len(part)), at]
    return which, best


# ---------------------------------------------------------------- training


def initial(vectors: DataFrame, id_col: str, vector_col: str, entries: int, parts: int, scale: int) -> Codebooks:
    """The parts of the usable vectors of the smallest ids; the first of them says how long a vector is."""
    x = col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(col(id_col).alias("id"), x.cast("array<double>").alias("x"))
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).limit(1).toArrow()
    width = len(first.column("x")[0]) if first.num_rows else 0
    some = rows.where(F.size("x") == width).orderBy(*order).limit(entries).toArrow()
    whole, _ = scaled(some.column("x").combine_chunks(), width, scale) if some.num_rows else (np.zeros((0, 0), np.int64), None)
    cut = edges(width, parts)
    return Codebooks([whole[:, a:b].copy() for a, b in zip(cut, cut[1:], strict=False)])


_MEMBER = "position int, entry int, salt int, part array<long>, n long"


def members(vectors: DataFrame, vector_col: str, books: Codebooks, scale: int, salts: int) -> DataFrame:
    """(position, entry, salt, part, n): the distinct parts of all vectors, each with its owner; merged in their tasks,
    then by their owners."""
    cut = edges(books.width, len(books.entries))
    rows = vectors.select(col(vector_col).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, _ = scaled(batch.column(0), books.width, scale)
            for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                part, n = distinct(whole[:, a:b])
                if len(part):
                    yield _members(np.full(len(part), p), nearest(part, books.entries[p])[0], salt_of(part, salts), part, n)
        give_back()

    found = arrow_map(rows, run, _MEMBER)
    return found.repartition("position", "entry", "salt").groupBy("position", "entry", "salt", "part").agg(F.sum("n").alias("n"))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often they occur."""
    if x.dtype == object or not x.size:
        seen: dict[tuple, int] = {}
        for r in map(tuple, x.tolist()):
            seen[r] = seen.get(r, 0) + 1
        return np.array(list(seen), x.dtype).reshape(len(seen), x.shape[1]), np.array(list(seen.values()), np.int64)
    order = np.lexsort(x.T[::-1])
    first = np.r_[True, (np.diff(x[order], axis=0) != 0).any(axis=1)]
    at = np.flatnonzero(first)
    return x[order[at]], np.diff(np.r_[at, len(x)])


def salt_of(x: np.ndarray, salts: int) -> np.ndarray:
    h = np.zeros(len(x), np.uint64)
    for c in range(x.shape[1]):
        h = (h ^ (x[:, c] % (1 << 32)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(salts)).astype(np.int64)


def _members(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, part: np.ndarray, n: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, part.size + 1, part.shape[1]) if part.shape[1] else np.zeros(len(part) + 1, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(part.ravel(), pa.int64()))
    columns = [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), lists, pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int32()) for v in more.values())], names=["position", "entry", "salt", "part", "n", *more])


def sums(residents: DataFrame) -> DataFrame:
    """(position, entry, place, sum, n): each task sums up the resident members it has, then the sums of an entry meet; a
    row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, at, part in _positions(batch):
                entry, n = batch.column(1).to_numpy()[at], batch.column(4).to_numpy()[at]
                if int(np.abs(part).max(initial=0)) * int(n.sum()) >= 1 << 62:
                    part, n = part.astype(object), n.astype(object)
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                for e, s, k in zip(entry[order][first].tolist(), np.add.reduceat(part[order] * n[order][:, None], first, axis=0).tolist(), np.add.reduceat(n[order], first).tolist(), strict=True):
                    was = total.setdefault((p, e), [[0] * len(s), 0])
                    total[p, e] = [[x + y for x, y in zip(was[0], s, strict=True)], was[1] + k]
        rows = [(p, e, i, str(x), n) for (p, e), (s, n) in total.items() for i, x in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["position", "entry", "place", "sum", "n"])
        give_back()

    found = arrow_map(residents, run, "position int, entry int, place int, sum string, n long")
    return found.groupBy("position", "entry", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))


def _positions(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, its rows, their parts as a matrix) of a batch of members."""
    position, lists = batch.column(0).to_numpy(), batch.column(3)
    sizes, flat = np.asarray(lists.value_lengths(), np.int64), lists.flatten().to_numpy()
    start = np.cumsum(sizes) - sizes
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        yield p, at, flat[start[at][:, None] + np.arange(sizes[at[0]])]


def updated(books: Codebooks, residents: DataFrame) -> Codebooks:
    """Each entry the componentwise floor mean of its members; an entry without members stays. The driver gets a row for
    each component of the codebooks."""
    new = [e.copy() for e in books.entries]
    for r in sums(residents).collect():
        new[r["position"]][r["entry"], r["place"]] = int(r["sum"]) // r["n"]
    return Codebooks(new)


def reassigned(residents: DataFrame, books: Codebooks) -> DataFrame:
    """Adds `to`, the nearest entry, to the members where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, at, part in _positions(batch):
                position, entry, salt, n = (batch.column(k).to_numpy()[at] for k in (0, 1, 2, 4))
                yield _members(position, entry, salt, part, n, to=nearest(part, books.entries[p])[0])
        give_back()

    return arrow_map(residents, run, f"{_MEMBER}, to int")


def migrated(chosen: DataFrame) -> DataFrame:
    """The members with their new owners: what stays is read in place, what changes entry is shuffled."""
    stay = chosen.where("to = entry").select("position", "entry", "salt", "part", "n")
    move = chosen.where("to <> entry").select("position", F.col("to").alias("entry"), "salt", "part", "n")
    return stay.unionAll(move.repartition("position", "entry", "salt"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, salts: int = SALTS) -> Codebooks:
    """Codebooks after `rounds` of assignment and update, from the vectors of the smallest ids."""
    books = initial(vectors, id_col, vector_col, entries, parts, scale)
    if not books.width or not rounds:
        return books
    residents = stash(members(vectors, vector_col, books, scale, salts))
    books = updated(books, residents)
    for left in range(rounds - 2, -1, -1):
        chosen = stash(reassigned(residents, books))
        drop(residents)
        residents = stash(migrated(chosen)) if left else migrated(chosen)
        books = updated(books, residents)
        drop(chosen)
    if rounds == 1:
        drop(residents)
    return books


# ---------------------------------------------------------------- codes


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The usable vectors' rows, the vector given up for its code (entries in part order, two hex digits
    each or as many as the entries ask for) and for error, the squared distances summed over the parts."""
    kept = without(vectors, ["code", "error", vector_col])
    schema = T.StructType([*kept.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    at, keep = vectors.columns.index(vector_col), [vectors.columns.index(c) for c in kept.columns]
    cut = edges(books.width, len(books.entries))
    digits = max(2, len(f"{max((len(e) for e in books.entries), default=1) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(max((len(e) for e in books.entries), default=0))])
        for batch in batches:
            whole, rows = scaled(batch.column(at), books.width, scale) if books.width else (None, np.zeros(0, np.int64))
            error, codes = np.zeros(len(rows), object if whole is None or whole.dtype == object else np.int64), []
            for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if len(rows):
                    which, far = nearest(whole[:, a:b], books.entries[p])
                    error, codes = error + far, [*codes, names[which]]
            text = ["".join(c) for c in zip(*codes, strict=True)] if len(rows) else []
            errors = pa.array([int(e) if e < 2**63 else None for e in error.tolist()], pa.int64())
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keep), pa.array(text, pa.string()), errors], names=schema.names)
        give_back()

    return arrow_map(vectors, run, schema)


def with_group_total(coded: DataFrame, by: Column, name: str = "label_error", value: str = "error", salts: int = SALTS) -> DataFrame:
    """Adds the sum of a column over all rows of the same key, nulls together. Sums are made before anything moves; each
    goes to as many shares as its key's rows are dealt to, so no task holds a key."""
    rows = coded.withColumns({"__k": F.struct(by.alias("k")), "__s": F.floor(F.rand(7) * salts).cast("int")})
    totals = coded.select(F.struct(by.alias("k")).alias("__k"), col(value).alias("__v")).groupBy("__k").agg(F.sum("__v").alias(name))
    shares = totals.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(shares, ["__k", "__s"]).drop("__k", "__s")
