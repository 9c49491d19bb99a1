"""From buckets of candidates to connected classes, without pairing what is connected already."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, dropped, kept, released, scratch, stored, trimmed
from .components import components
from .textnum import U, mix

#: Parts of the universe in a sketch; 256, as a part is eight bits of a hash.
CELLS = 256
#: Classes that have an element, up to which they are compared by it.
RARE = 8
#: Classes whose counts a task holds.
OWN = 1_000_000
#: Pairs of a signature and a class that a task packs at once, and those of a part.
PACKED, PART_PAIRS = 300_000, 700_000
#: Buckets of a class that are listed, to compare a pair in one of its buckets only.
FIRST = 8


class Packs:
    """Pairs sig, class of a task, handed on in packs: for each part of the signatures' range a row part, data.

    data: the numbers of pairs and classes; differences of the sorted signatures, byte by byte; the classes; the places of the
    pairs' classes among them; compressed."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, [], 0

    def add(self, sig: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((sig.astype(U), cls.astype(np.int64)))
        self.n += len(sig)
        if self.n >= PACKED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            sig, cls = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.n = [], 0
            order = np.argsort(sig)
            sig = sig[order]
            table, place = np.unique(cls, return_inverse=True)
            place = place.astype(np.uint32)[order]
            part = ((sig >> U(32)) * U(self.parts) >> U(32)).astype(np.int32)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            data = [_packed(sig[a:b], place[a:b], table) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(data, pa.binary())], ["part", "data"])


def _packed(sig: np.ndarray, place: np.ndarray, table: np.ndarray) -> bytes:
    step = np.diff(sig, prepend=U(0)).astype("<u8")
    few, at = np.unique(place, return_inverse=True)
    at = at.astype("<u4")
    raw = struct.pack("<II", len(sig), len(few)) + step.view(np.uint8).reshape(-1, 8).T.tobytes() + table[few].astype("<i8").tobytes() + at.view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[4:], struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True), np.uint8)
    n, m = raw[:8].view("<u4").tolist()
    step = np.ascontiguousarray(raw[8 : 8 + 8 * n].reshape(8, n).T).view("<u8").ravel()
    table = raw[8 + 8 * n : 8 + 8 * (n + m)].copy().view("<i8")
    at = np.ascontiguousarray(raw[8 + 8 * (n + m) :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(step, dtype=U).astype(np.int64), table[at]


def _of_part(packs: list[bytes], most: int) -> pa.RecordBatch:
    """Rows sig, a, b: for a bucket of `most` classes or fewer its pairs a < b (sig null; each once), for a larger one its classes as a (b null)."""
    s, c = (np.concatenate(x) for x in zip(*map(_unpacked, packs), strict=True))
    order = np.argsort(s, kind="stable")  # packs are in order, so this merges them
    s = s[order]
    same = s[1:] == s[:-1]
    some = np.zeros(len(s), bool)
    some[1:] = same
    some[:-1] |= same
    s, c = s[some], c[order[some]]
    order = np.lexsort((c, s))
    s, c = s[order], c[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    s, c = s[new], c[new]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(s)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[(size > 1) & (size <= most)]).tolist():
        at = begin[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                left.append(c[at + i])
                right.append(c[at + j])
    x, y = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y = x[new], y[new]
    large = np.repeat(size > most, size)
    sig = pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(s[large])])
    return pa.RecordBatch.from_arrays([sig, pa.array(np.concatenate([x, c[large]])), pa.concat_arrays([pa.array(y), pa.nulls(int(large.sum()), pa.int64())])], ["sig", "a", "b"])


def _buckets(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of packs in order of their parts, what _of_part() has of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield _of_part(held, most)
                    held = []
                    trimmed()
                now = part
                held.append(data.as_py())
        if held:
            yield _of_part(held, most)
        trimmed()

    return run


def parts_for(spark: SparkSession, pairs: int) -> int:
    """Parts of the signatures' range for about so many pairs: as many as shuffle partitions, and PART_PAIRS in one at most, on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PART_PAIRS), 1)


def shared_buckets(packs: DataFrame, parts: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs in Packs those whose sig several classes have: pairs a, b of classes in buckets of `most` or fewer (at most most / 2 for each of
    their rows), and rows sig, class of larger buckets, once each.

    A task holds the pairs of one part at a time, 16 bytes each and as much again to sort them."""
    found = stored(packs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_buckets(most), "sig long, a long, b long"), "buckets")
    return stored(found.where("sig is null").select("a", "b").distinct(), "near"), found.where("sig is not null").select("sig", F.col("a").alias("class"))


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """How many elements of each set (hashes h of their rows, distinct in a row) fall into each of CELLS parts of the universe."""
    cell = (mix(h ^ U(0xA24BAED4963EE407)) >> U(56)).astype(np.int64)
    count = np.bincount(row * CELLS + cell, minlength=rows * CELLS).reshape(-1, CELLS)
    return [x.tobytes() for x in np.minimum(count, 0xFF).astype(np.uint8)]


def _possible_task(percent: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, m = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), np.uint8).reshape(-1, CELLS).astype(np.int32) for c in (4, 5))
        differ = np.abs(x - y).sum(1)
        ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ * (100 + percent) <= (100 - percent) * (n + m))
        yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sets (class, n, sketch) may reach the threshold, by exact bounds: the sizes, and the differences in each part of the
    universe, which sum to no more than the sets differ. They drop nearly all pairs that have only a bucket in common."""
    few = sets.select("class", "n", "sketch")
    both = pairs.join(few.toDF("a", "na", "sa"), "a").join(few.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return arrow_map(both, partial(_possible_task, percent), "a long, b long")


def element_rows(h: np.ndarray, at: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """Rows element, class of sets: hashes h between the bounds at, distinct in a set, of the classes cls."""
    return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.repeat(cls, np.diff(at)))], ["element", "class"])


def _rare(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in order of element and class, those whose element n classes have, 2 to `most`: element, class, n, own 0; and for each class, with a null
    element and n 0, how many elements only it has (own; a class may have several such rows, to be summed).

    Of an element most + 1 rows are held at most, and counts of OWN classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = c = np.zeros(0, np.int64)
        own = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(own[0]), pa.int64()), pa.array(own[0]), pa.array(np.zeros(len(own[0]), np.int64)), pa.array(own[1])], ["element", "class", "n", "own"])

        held: list[np.ndarray] = []
        for batch in chain(batches, (None,)):
            if batch is not None:
                e, c = np.concatenate([e, np.asarray(batch.column(0))]), np.concatenate([c, np.asarray(batch.column(1))])
            if len(e):
                begin = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                whole = begin[-1] if batch is not None else len(e)
                n = np.diff(begin) if batch is not None else np.diff(np.append(begin, len(e)))
                n_of = np.repeat(n, n)
                few = (n_of > 1) & (n_of <= most)
                if few.any():
                    yield pa.RecordBatch.from_arrays([pa.array(e[:whole][few]), pa.array(c[:whole][few]), pa.array(n_of[few]), pa.array(np.zeros(int(few.sum()), np.int64))], ["element", "class", "n", "own"])
                held.append(c[:whole][n_of == 1])
                e, c = e[whole : whole + most + 1], c[whole : whole + most + 1]
            if batch is None or sum(map(len, held)) >= OWN:
                cls, back = np.unique(np.concatenate([own[0], *held]), return_inverse=True)
                own = cls, np.bincount(back, np.concatenate([own[1], *(np.ones(len(x), np.int64) for x in held)]), minlength=len(cls)).astype(np.int64)
                held = []
                if len(cls) >= OWN:
                    yield counts()
                    own = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield counts()
        trimmed()

    return run


#: n of rows that tell, as own, a class's size and how many large buckets it has.
_SIZE, _CENTRAL = -1, -2


def _prefixes(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of _rare() and those of sizes, in order of class, n and element: rows element, class, size, top, central, of reachable(). An element is null in
    the row of a class that stays in large buckets. Of a class all rows are held, as many as it has elements at most."""

    def of_runs(e: pa.Array, c: np.ndarray, n: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(c))))
        size, central, alone = (np.add.reduceat(np.where(n == k, own, 0), begin) for k in (_SIZE, _CENTRAL, 0))
        shared = n > 0
        rare = np.add.reduceat(shared.astype(np.int64), begin)
        first = np.full(len(begin), len(c))
        np.minimum.at(first, run[shared], np.flatnonzero(shared))
        # Elements in order of how many classes have them: a linked pair has its first common one among the first `prefix` of both.
        prefix = size - -(-size * percent // 100) + 1

        def most(held: np.ndarray) -> np.ndarray:
            """The greatest size of a partner, when so many elements can be in an intersection; 0 if there is none."""
            return np.where(held * 100 >= size * percent, held * (100 + percent) // percent - size, 0)

        by_all, by_common = most(size - alone), most(size - alone - rare)
        keep = shared & (by_all[run] > 0) & ((np.arange(len(c)) - first[run] < (prefix - alone)[run]) | (by_common[run] > 0))
        at = np.flatnonzero(keep)
        stay = np.flatnonzero(by_common > 0)
        whose = np.concatenate([run[at], stay])
        top = np.concatenate([by_all[run[at]], by_common[stay]])
        return pa.RecordBatch.from_arrays([pa.concat_arrays([e.take(pa.array(at)), pa.nulls(len(stay), pa.int64())]), pa.array(c[begin][whose]), pa.array(size[whose]), pa.array(top), pa.array(central[whose])], ["element", "class", "size", "top", "central"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not now:
                continue
            held = now[0]
            c = np.asarray(held.column(1))
            cut = int(np.searchsorted(c, c[-1]))
            if cut:
                part = held.slice(0, cut)
                yield of_runs(part.column(0), c[:cut], *(np.asarray(part.column(i)) for i in (2, 3)))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield of_runs(held.column(0), *(np.asarray(held.column(i)) for i in (1, 2, 3)))

    return run


def reachable(large: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int, rare: int = RARE) -> DataFrame:
    """Rows sig, class, size, top, central that take the place of large buckets: every linked pair of these meets here too.

    Let elements be in the order of how many classes of large buckets have them, those of one class first. A linked pair's first common element is
    among the first of both (prefix filtering). If at most `rare` classes have it, the pair meets in the small bucket of this element. If not, all
    that the two have in common are such common elements: then their numbers must reach the threshold against both sizes, so in large buckets only
    classes with enough of them stay, and top is the greatest size of a partner that is possible by that count. central: how many large buckets the class has."""
    central = stored(large.groupBy("class").agg(F.count(F.lit(1)).alias("central")), "central")
    rows = elements(sets.join(central, "class", "left_semi")).repartition("element").sortWithinPartitions("element", "class").mapInArrow(_rare(rare), "element long, class long, n long, own long")
    none = F.lit(None).cast("long").alias("element")
    rows = rows.unionAll(central.select(none, "class", F.lit(_CENTRAL).cast("long"), "central")).unionAll(sets.join(central, "class", "left_semi").select(none, "class", F.lit(_SIZE).cast("long"), "n"))
    rated = stored(rows.repartition("class").sortWithinPartitions("class", "n", "element").mapInArrow(_prefixes(percent), "element long, class long, size long, top long, central long"), "rated")
    columns = ("sig", "class", "size", "top", "central")
    common = large.join(rated.where("element is null").drop("element"), "class").select(*columns)
    return common.unionAll(rated.where("element is not null").withColumn("sig", F.xxhash64("element")).select(*columns))


def connected(near: DataFrame, large: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], percent: int, rare: int = RARE) -> DataFrame:
    """class, component for all classes with a verified link to another.

    near, large: of shared_buckets(). sets: class, n, and what elements() needs to give element_rows() of each. First the pairs in small buckets
    are compared, and each class of large ones with one other: the most central of most of its buckets (that with the most large
    buckets: the text which the others are copies of, if it is there). What these links
    connect is joined. Then, in buckets that hold several components, one of each is compared with the
    bucket's most central; and at last pairs of different components that share a bucket are compared. In large buckets classes
    and pairs are left out that cannot reach the threshold, by reachable(). So every two
    classes that share a bucket and are linked end in one component, but a group of n near copies costs about n
    comparisons, not n * n."""
    with scratch():
        return kept(_connected(near, large, sets, elements, verified, percent, rare)).toDF("class", "component")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _connected(near: DataFrame, large: DataFrame, sets: DataFrame, elements: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], percent: int, rare: int) -> DataFrame:
    spark = near.sparkSession
    released(spark)
    rows = stored(reachable(large, sets, elements, percent, rare), "rows")
    released(spark)
    # Of equally central classes the smallest: the greatest complement.
    most = rows.groupBy("sig").agg(F.max(F.struct("central", F.bitwise_not("class").alias("less"))).alias("most"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    buckets = stored(rows.drop("central").join(most.select("sig", F.bitwise_not("most.less").alias("first")), "sig"), "buckets")
    dropped(rows)
    often = buckets.where("first != class").groupBy("class", "first").count()
    often = often.groupBy("class").agg(F.max_by("first", F.struct("count", F.bitwise_not("first"))).alias("first"))
    tried = stored(_ordered(near.unionAll(often.select("first", "class"))), "pairs")
    links = stored(verified(tried), "found")
    reached = stored(components(links), "reached")
    for heads_only in (True, False):
        marked = buckets.join(reached.toDF("class", "component"), "class", "left").withColumn("mark", F.coalesce("component", "class")).drop("component")
        mixed = marked.groupBy("sig").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.max(F.when(F.col("class") == F.col("first"), F.col("mark"))).alias("its")).where("low != high").select("sig", "its")
        open_ = stored(marked.join(mixed, "sig"), "open")
        if heads_only:
            heads = open_.where("mark != its").groupBy("sig", "mark").agg(F.min(F.struct("class", "first")).alias("x"))
            rest = heads.select(F.col("x.first").alias("a"), F.col("x.class").alias("b"))
        else:
            # A pair is left out where the lists of both classes' first buckets show an earlier one that they share.
            lists_ = open_.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST).alias("early"))
            listed = open_.join(lists_, "class")
            p, q = listed.alias("p"), listed.alias("q")
            fits = (F.col("p.class") < F.col("q.class")) & (F.col("p.mark") != F.col("q.mark")) & (F.col("p.size") <= F.col("q.top")) & (F.col("q.size") <= F.col("p.top"))
            here = F.coalesce(F.array_min(F.array_intersect("p.early", "q.early")) >= F.col("p.sig"), F.lit(True))
            rest = p.join(q, (F.col("p.sig") == F.col("q.sig")) & fits & here).select(F.col("p.class").alias("a"), F.col("q.class").alias("b"))
        released(spark)
        rest = stored(_ordered(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
        dropped(open_)
        more = stored(verified(rest), "found")
        tried = tried.unionAll(rest)
        if more.limit(1).count():
            links = links.unionAll(more)
            reached = stored(components(links), "reached")
    return reached
