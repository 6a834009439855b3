"""Vector code compression by memoised grid cells.

Vectors are cut into consecutive parts, and each part becomes the index of its nearest
codebook entry. Codebooks start as the parts of the smallest ids and are moved to the
means of their parts in a fixed number of rounds.

Finding the nearest entry goes by cells. A part's components, halved SHIFT times, name the
box of the grid that it lies in. For a box that is new, the least and greatest distance of
every entry to it are added up from tables per component; an entry whose least distance
exceeds another's greatest is dominated: no point of the box is nearest to it. The others
are remembered under the cell's name, and only they are compared exactly. A worker
remembers MEMO cells per part position and then starts anew, so its memory is bounded;
what it remembers never changes a result, as dominated entries cannot be nearest, nor tied.

Components become integers, floor(SCALE * x), and all distances are exact. Each round
shuffles one row per task, part and used entry (sum and count), never a vector; the driver
holds the codebooks only, which are as large for any number of vectors.

Edge cases: a vector that is null, or holds a null or a number that is not finite, is left
out. Integers beyond LIMIT are set to it, so that squared distances of up to 127 components a
part fit a long. An id on
several rows starts one entry, with the least of its vectors; null ids start none, but are
coded. With fewer ids than ENTRIES the codebooks are smaller; without any, codes and errors
are null. A vector of another length than that of the smallest id has a null code and error.
A length that four does not divide gives parts whose lengths differ by one. Null labels are
one label. Empty tables give no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 27
#: Boxes are 2^SHIFT wide in every component.
SHIFT = 5
#: Cells remembered per part position.
MEMO = 20_000
#: New cells bounded at once, and pairs of a part and an entry compared at once.
STEP, PAIRS = 1_024, 100_000


def kept(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: the whole vectors, with integer components."""
    x = F.col("embedding")
    # A null component makes the test null, which is not true either.
    finite = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(
        x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    )
    return embeddings.where(finite).select("vec_id", "label", whole.alias("vector"))


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [i * width // parts for i in range(parts + 1)]


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Per part position the parts of the smallest ids: at most ``entries`` vectors reach the driver."""
    named = vectors.where("vec_id is not null")
    least = named.agg(F.min(F.struct("vec_id", F.size("vector").alias("width")))).first()[0]
    if least is None:
        return []
    same = named.where(F.size("vector") == least.width)
    ids = F.broadcast(same.select("vec_id").distinct().orderBy("vec_id").limit(entries))
    rows = same.join(ids, "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    table = np.array([r.vector for r in rows], np.int64).reshape(len(rows), least.width)
    at = cuts(least.width, parts)
    return [np.ascontiguousarray(table[:, a:b]) for a, b in zip(at, at[1:])]


class Cells:
    """The nearest entry of one codebook, by cells whose undominated entries are remembered."""

    def __init__(self, book: np.ndarray, shift: int = SHIFT, memo: int = MEMO):
        self.book, self.shift, self.most = book, shift, memo
        self.memo: dict[bytes, np.ndarray] = {}
        self.compared = self.found = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; of several the first."""
        parts, book = self._narrow(parts)
        coarse = parts >> self.shift
        first, member = _distinct(coarse)
        names = [row.tobytes() for row in coarse[first].astype(np.int32)]
        if len(self.memo) + len(names) > self.most:
            self.memo = {}
        new = [i for i, name in enumerate(names) if name not in self.memo]
        self.found += len(names) - len(new)
        for i in range(0, len(new), STEP):
            some = new[i : i + STEP]
            for j, entries in zip(some, self._undominated(coarse[first[some]], book)):
                self.memo[names[j]] = entries
        lists = [self.memo[name] for name in names]
        sizes = np.array([len(entries) for entries in lists])[member]
        code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(parts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            chosen = np.concatenate([lists[m] for m in member[start:stop]]).astype(np.intp)
            of = np.repeat(np.arange(start, stop), sizes[start:stop])
            away = parts[of] - book[chosen]
            far = np.einsum("ij,ij->i", away, away)
            at = np.concatenate([[0], np.cumsum(sizes[start:stop])[:-1]])
            best = np.minimum.reduceat(far, at)
            # Entries are in order, so the first that is as near as the best has the lowest index.
            ties = np.where(far == best[of - start], chosen, len(book))
            code[start:stop], error[start:stop] = np.minimum.reduceat(ties, at), best
            self.compared += len(chosen)
            start = stop
        return code, error

    def _narrow(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts and entries in 32 bits where no squared distance can leave them, else in 64."""
        largest = max((int(np.abs(a).max()) for a in (parts, self.book) if a.size), default=0)
        fits = (2 * largest + (2 << self.shift)) ** 2 * max(1, self.book.shape[1]) < 1 << 31
        kind = np.int32 if fits else np.int64
        return parts.astype(kind), self.book.astype(kind)

    def _undominated(self, cells: np.ndarray, book: np.ndarray) -> list[np.ndarray]:
        """Of each box the entries that some point of it may be nearest to, in order."""
        least = np.zeros((len(cells), len(book)), book.dtype)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            values, at = np.unique(cells[:, d], return_inverse=True)
            low = (values << self.shift)[:, None]
            below, above = low - book[:, d], book[:, d] - (low + (1 << self.shift) - 1)
            outside = np.maximum(np.maximum(below, above), 0)
            across = np.maximum(np.abs(below), np.abs(above))
            least += (outside * outside)[at]
            most += (across * across)[at]
        may = least <= most.min(1, keepdims=True)
        entry = np.nonzero(may)[1].astype(np.int16)
        ends = np.cumsum(may.sum(1)).tolist()
        return [entry[a:b] for a, b in zip([0, *ends], ends)]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each kind, and which kind every row is, by a hash that is verified."""
    mixed = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for d in range(rows.shape[1]):
        mixed = (mixed ^ rows[:, d].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    _, first, member = np.unique(mixed, return_index=True, return_inverse=True)
    if (rows[first[member]] != rows).any():  # two kinds share a hash
        _, first, member = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, member.ravel()


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the codebooks' length, and these as rows."""
    fits = np.asarray(pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == width)
    flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, flat.astype(np.int64).reshape(int(fits.sum()), width)


def moved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every used entry at the mean of its parts."""
    at = cuts(sum(b.shape[1] for b in books), len(books))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, rows = _matrix(batch.column(0), at[-1])
            for p, (a, b) in enumerate(zip(at, at[1:])):
                parts = np.ascontiguousarray(rows[:, a:b])
                code, _ = cells[p].nearest(parts)
                np.add.at(sums[p], code, parts)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, (total, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(len(used), p), pa.int32()),
                    "entry": pa.array(used, pa.int32()),
                    "n": pa.array(n[used], pa.int64()),
                    "sums": pa.array(list(total[used]), pa.list_(pa.int64())),
                }
            )

    partial = vectors.select("vector").mapInArrow(sums_of, "part int, entry int, n long, sums array<long>")
    widest = max(b.shape[1] for b in books)
    totals = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums")
    )
    out = [b.copy() for b in books]
    for r in totals.collect():  # at most a row per entry
        width = books[r.part].shape[1]
        out[r.part][r.entry] = [s // r.n for s in r.sums[:width]]
    return out


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part, and the distances' sum."""
    at = cuts(sum(b.shape[1] for b in books), len(books))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        for batch in batches:
            fits, rows = _matrix(batch.column(2), at[-1])
            codes, errors = np.empty((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, (a, b) in enumerate(zip(at, at[1:])):
                codes[:, p], error = cells[p].nearest(np.ascontiguousarray(rows[:, a:b]))
                errors += error
            shown = np.full(len(fits), None, object)
            shown[fits] = [row.tobytes().hex() for row in codes]
            sums = np.zeros(len(fits), np.int64)
            sums[fits] = errors
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(sums, pa.int64(), mask=~fits)],
                ["vec_id", "label", "code", "error"],
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
    return rows.mapInArrow(of, "vec_id long, label long, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every whole vector."""
    vectors = settle(kept(embeddings), "vectors")
    books = first_codebooks(vectors)
    for _ in range(rounds if books else 0):
        books = moved(vectors, books)
    if books:
        rows = settle(coded(vectors, books), "codes")
    else:
        nothing = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
        rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), *nothing)
    # Summed before the shuffle; the sums come back by label, or to all tasks if they are few.
    of_label = settle(
        rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors"
    )
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def sql(table: str = "embeddings", rounds: int = ROUNDS) -> str:
    """``compress`` for DuckDB, comparing every part with every entry; ids are taken as unique."""
    steps = [
        f"kept as materialized (select row_number() over () rid, vec_id, label, list_transform(embedding, "
        f"lambda x: floor({SCALE} * x)::bigint) v from {table} where embedding is not null and "
        "len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"shape as (select max(len(v)) // {PARTS} w from kept)",
        "x as materialized (select rid, (i - 1) // w part, (i - 1) % w pos, v[i] val from (select rid, v, w, "
        "unnest(generate_series(1, len(v))) i from kept, shape))",
        f"b0 as materialized (select part, entry, pos, val from (select rid, row_number() over (order by vec_id) - 1 entry "
        f"from kept where vec_id is not null order by vec_id limit {ENTRIES}) join x using (rid))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"n{k} as materialized (select rid, part, arg_min(entry, (dist, entry)) entry, min(dist) dist from (select rid, "
            f"x.part, b.entry, sum((x.val - b.val) * (x.val - b.val))::bigint dist from x join b{k} b on x.part = b.part "
            "and x.pos = b.pos group by all) group by rid, part)"
        )
        if k < rounds:
            steps.append(
                f"b{k + 1} as materialized (select b.part, b.entry, b.pos, coalesce((s - ((s % c) + c) % c) // c, b.val) val "
                f"from b{k} b left join (select part, entry, pos, sum(val)::bigint s, count(*) c from x join n{k} "
                "using (rid, part) group by all) m on b.part = m.part and b.entry = m.entry and b.pos = m.pos)"
            )
    steps.append(
        f"done as (select rid, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) code, "
        f"sum(dist)::bigint error from n{rounds} group by rid)"
    )
    return (
        f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, "
        f"(select sha256(string_agg(val::varchar, ',' order by part, entry, pos)) from b{rounds}) codebooks_sha256 "
        "from kept join done using (rid)"
    )
