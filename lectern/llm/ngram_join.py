"""N-gram Jaccard join (operator 3): universe-partition pigeonhole with one-deletion neighbourhoods.

A document is its set of k-word shingles. Sets are banded by size, so that a set's partners are in its own
band or a neighbouring one; a group is a band with the next. Two sets of a group that reach the
threshold differ in at most H elements. A hash deals the universe into m segments, the same for all sets
of a group. If a set may leave out t_i + 1 differences in segment i (t_i = 0: the segment is equal;
t_i = 1: equal up to one deletion or insertion, for which one-deletion neighbourhoods are indexed; -1: the
segment is not used) and these sum to H + 1, then some segment agrees within its t_i. Which segments get
t_i = 1 is chosen for each group by cost (allocation()). Segments that are empty are skipped by sets that
have enough others; a set that has not emits all, so the guarantee holds for every pair.

Sets that agree in a signature are candidates. Equal sets are one class before that, so copies are
never paired. Groups of near copies share many signatures; linking.connected() compares each with one
other first, and all pairs of components that are then still apart. So no link between different texts is lost,
but links within what is connected already are not looked for again. Every link is verified on whole
sets. Elements are 64-bit hashes of shingles: the chance that any of 10**9 shingles of one comparison
collide is under 0.03, that a set of 10**4 has a collision under 10**-11."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept, released, rows_in, scratch, stored
from .linking import Packs, connected, element_rows, parts_for, possible, shared_buckets, sketches
from .rows import mark_of
from .textnum import U, Words, buffers, distinct_sorted, mix, shingles, slices, sums_by

#: Chance that a shingle of one set is also in an unrelated set of its group, for the allocation of segments.
SHARED = 0.02
#: Cost of comparing a candidate (by bounds, which drop nearly all) against writing a signature, for the same.
COMPARE = 0.5
SEEN = 1_000_000
#: Segments beyond those needed, in a hundred; and sets that share a signature before it is left out where that is possible.
SPARE = 15
HOT = 16


def band_bounds(longest: int, percent: int) -> list[int]:
    """Least sizes of the bands; a set's partners are at most one band away."""
    at = [1, 2]
    while at[-1] <= longest:
        at.append(max(at[-1] + 1, (at[-1] - 1) * 100 // percent + 1))
    return at


def most_differences(largest: int, percent: int) -> int:
    """Most elements in one of two sets only, when the smaller has at most `largest` and they reach the threshold."""
    return (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)


def allocation(differences: int, least: int, sets: int) -> tuple[int, int]:
    """Segments of a group, and how many of them get one-deletion neighbourhoods: the cheapest that keep the guarantee.

    Cost for a set: signatures it emits, and comparisons expected from segments that agree by chance, of which
    a segment with n elements has sets * SHARED**n, and one with a deletion (1 + n) * sets * SHARED**(n - 1);
    and those between sets with so many empty segments that they emit them all. Spare segments make these rare."""
    best, least_cost = (differences + 1, 0), float("inf")
    near = np.arange(differences // 2 + 2)
    needed = np.maximum(differences + 1 - 2 * near, 0) + near
    for spare in range(0, 12):
        m = needed + spare + -(-needed * SPARE // 100)
        empty = m * (1 - 1 / m) ** least
        term = np.exp(-empty)
        rest = 1 - term
        for j in range(1, int((m - needed).max()) + 1):
            term = term * empty / j
            rest = rest - np.where(j <= m - needed, term, 0)
        n, chance = least / m, sets * COMPARE
        cost = (m - near) * (1 + chance * SHARED**n) + near * (1 + n) * (1 + chance * SHARED ** np.maximum(n - 1, 0)) + m * chance * np.maximum(rest, 0) ** 2
        i = int(np.argmin(cost))
        if cost[i] < least_cost:
            best, least_cost = (int(m[i]), int(near[i])), float(cost[i])
    return best


def group_plan(bounds: list[int], held: dict, percent: int) -> dict[int, tuple[int, int, int]]:
    """By group: segments, with deletions, H + 1. held: by band n (about how many classes, for the cost alone), low and high (the least and the greatest).

    A group is left out only if its first band is empty (the next group has the rest) or it is a single class."""
    plan = {}
    for g in range(len(bounds) - 1):
        h = most_differences(bounds[g + 1] - 1, percent)
        own = [held[b] for b in (g, g + 1) if b in held]
        if h and g in held and min(x.low for x in own) < max(x.high for x in own):
            plan[g] = (*allocation(h, bounds[g], max(2, sum(x.n for x in own))), h + 1)
    return plan


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offs = buffers(batch.column(1))
    for lo, hi in slices(offs):
        h, row = shingles(Words(data, offs, lo, hi, "spaced"), k)
        yield lo, hi, *distinct_sorted(h, row, hi - lo)


def _classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at).astype(U)
    return mix(mix(sums_by(mix(h + U(0x9E6C63D0876A9A47)), at)) + sums_by(mix(h ^ U(0x5851F42D4C957F2D)), at) + n).astype(np.int64)


def _members_task(k: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, h, _, at in _sets(batch, k):
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(n.astype(np.int64)), pa.array(_classes(h, at), mask=n == 0)], ["doc_id", "mark", "n_shingles", "class"])

    return run


def signatures(h: np.ndarray, row: np.ndarray, at: np.ndarray, which: np.ndarray, group: np.ndarray, m: np.ndarray, near: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets `which` within their groups; and bounds of each set's part."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    pick = np.arange(total) + np.repeat(at[which] - ends + size, size)
    own = np.repeat(np.arange(len(which)), size)
    x = h[pick]
    base = np.concatenate([[0], np.cumsum(m)])
    segment = (mix(x + U(0x2545F4914F6CDD1D)) >> U(32)) * m[own].astype(U) >> U(32)
    flat = base[own] + segment.astype(np.int64)
    z = mix(x ^ U(0xD1342543DE82EF95))
    sums = np.zeros(int(base[-1]), U)
    np.add.at(sums, flat, z)
    count = np.bincount(flat, minlength=len(sums))
    of = np.repeat(np.arange(len(which)), m)
    number = np.arange(len(sums)) - base[of]
    salt = mix((group[of].astype(U) << U(32)) + number.astype(U))
    twice = number < near[of]
    room = np.bincount(of, (count > 0) + (twice & (count > 1)), minlength=len(which))
    scarce = room < need
    full = (count > 0) | scarce[of]
    # The lowest bit is the group's parity: a set is in two groups that follow one another.
    parity = (group & 1).astype(U)
    sig, set_of = (mix(sums + salt) & ~U(1) | parity[of])[full], of[full]
    less = np.flatnonzero(twice[flat] & ((count[flat] > 1) | scarce[own]))
    if len(less):
        sig = np.concatenate([sig, mix(sums[flat[less]] - z[less] + salt[flat[less]]) & ~U(1) | parity[own[less]]])
        set_of = np.concatenate([set_of, own[less]])
        order = np.argsort(set_of, kind="stable")
        sig, set_of = sig[order], set_of[order]
    return sig, np.searchsorted(set_of, np.arange(len(which) + 1))


def _signature_task(k: int, bounds: list[int], plan: dict[int, tuple[int, int, int]], parts: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    bands = np.array(bounds)
    table = np.zeros((len(bounds) + 1, 3), np.int64)  # by group + 1: segments, with deletions, H + 1
    for g, x in plan.items():
        table[g + 1] = x
    seen: set[int] = set()
    packs = Packs(parts)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, h, row, at in _sets(batch, k):
            size, cls = np.diff(at), _classes(h, at)
            new = []
            for i in np.flatnonzero(size).tolist():
                c = int(cls[i])
                if c not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    new.append(i)
            which = np.array(new, np.int64)
            band = np.searchsorted(bands, size[which], "right") - 1
            for group in (band, band - 1):
                ok = table[group + 1, 0] > 0
                if ok.any():
                    m, near, need = table[group[ok] + 1].T
                    sig, to = signatures(h, row, at, which[ok], group[ok], m, near, need)
                    yield from packs.add(sig, np.repeat(cls[which[ok]], np.diff(to)))
        yield from packs.flush()

    return run


def _spare_task(k: int, percent: int, bounds: list[int], plan: dict[int, tuple[int, int, int]]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Of packed texts, for each of their groups: its parity, and how many signatures a set may leave out: it has so many segments beyond those in which it may differ from
    a partner (at its own size, from the largest partner that the group pairs it with), and one."""
    bands = np.array(bounds)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = pa.array([zlib.decompress(x.as_py()) for x in part.column(1)], pa.binary()).cast(pa.string())
            rows: tuple[list, list, list] = ([], [], [])
            for a, _, h, _, at in _sets(pa.RecordBatch.from_arrays([texts, texts], ["", "text"]), k):
                size = np.diff(at)
                band = np.searchsorted(bands, size, "right") - 1
                for i in range(len(size)):
                    for g in (int(band[i]), int(band[i]) - 1):
                        if g in plan:
                            (m, near, _), n = plan[g], int(size[i])
                            partner = min(bounds[g + 2] - 1 if g == band[i] and g + 2 < len(bounds) else bounds[g + 1] - 1 if g != band[i] else n * 100 // percent, n * 100 // percent)
                            need = (100 - percent) * (n + partner) // (100 + percent) + 1
                            count = np.bincount(((mix(h[at[i] : at[i + 1]] + U(0x2545F4914F6CDD1D)) >> U(32)) * U(m) >> U(32)).astype(np.int64), minlength=m)
                            # A segment with deletions counts twice; a signature that is left out takes both away.
                            room = int((count > 0).sum() + (count[:near] > 1).sum())
                            rows[0].append(part.column(0)[a + i].as_py())
                            rows[1].append(g & 1)
                            rows[2].append((room - need) // (2 if near else 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["class", "parity", "spare"])

    return run


def _texts_task(k: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    seen: set[int] = set()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        for lo, _, h, _, at in _sets(batch, k):
            cls, texts, n = _classes(h, at), [], np.diff(at)
            new = []
            for i in np.flatnonzero(n).tolist():
                if (c := int(cls[i])) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    new.append(i)
                    texts.append(zlib.compress(data[offs[lo + i] : offs[lo + i + 1]].tobytes(), 1))
            sketch = sketches(h, np.repeat(np.arange(len(n)), n), len(n))
            yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array(n[new].astype(np.int64)), pa.array([sketch[i] for i in new], pa.binary()), pa.array(texts, pa.binary())], ["class", "n", "sketch", "packed"])

    return run


def _elements_task(k: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            cls = np.asarray(part.column(0))
            texts = pa.array([zlib.decompress(x.as_py()) for x in part.column(1)], pa.binary()).cast(pa.large_binary()).cast(pa.large_string())
            for a, b, h, _, at in _sets(pa.RecordBatch.from_arrays([texts, texts], ["", "text"]), k):
                yield element_rows(h, at, cls[a:b])

    return run


def _elements(k: int, sets: DataFrame) -> DataFrame:
    return arrow_map(sets.select("class", "packed"), partial(_elements_task, k), "element long, class long")


def _verify_task(k: int, percent: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            a, b = np.asarray(part.column(0)), np.asarray(part.column(1))
            packed = dict(zip(a.tolist(), part.column(2), strict=True)) | dict(zip(b.tolist(), part.column(3), strict=True))
            place = {c: i for i, c in enumerate(packed)}
            texts = pa.array([zlib.decompress(x.as_py()) for x in packed.values()], pa.binary()).cast(pa.string())
            sets: list[np.ndarray] = []
            for _, _, h, _, at in _sets(pa.RecordBatch.from_arrays([texts, texts], ["", "text"]), k):
                sets += np.split(h, at[1:-1])
            keep = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                s, t = sets[place[x]], sets[place[y]]
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs a, b those that reach the threshold: by bounds first, then by the whole sets, made again from the texts.

    Texts travel compressed, a fraction of their sets."""
    sized = possible(pairs, texts, percent)
    x, y = texts.select(F.col("class").alias("a"), F.col("packed").alias("x")), texts.select(F.col("class").alias("b"), F.col("packed").alias("y"))
    return arrow_map(sized.join(x, "a").join(y, "b").select("a", "b", "x", "y"), partial(_verify_task, k, percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer than k words
    is one shingle, one without words (or null) has none and is linked with nothing: its component_id is
    its own doc_id. Two rows are linked when 100 * intersection >= percent * union of their shingle sets.
    component_id: the smallest doc_id that links reach (null ids count as none, unless a component has no
    other). Repeated rows are repeated in the result. Columns besides key and text are ignored. An empty
    table gives an empty result. Working tables are in the shared folder."""
    return jaccard_members(docs, k, percent, text, key).select("doc_id", "n_shingles", "component_id")


def jaccard_members(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """jaccard_components() with what tells rows and components apart where ids repeat or are null: mark (of rows.mark_of()), and component (a number; null without words)."""
    with scratch():
        return kept(stored(_members(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), k, percent), "linked"))


def _members(rows: DataFrame, k: int, percent: int) -> DataFrame:
    members = stored(arrow_map(rows.withColumn("mark", mark_of()), partial(_members_task, k), "doc_id long, mark long, n_shingles long, class long"), "members")
    sizes = members.groupBy("n_shingles").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("class").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    longest = members.agg(F.max("n_shingles")).first()[0] or 0
    bounds = band_bounds(longest, percent)
    # One number for each band; bands are as many as the logarithm of the longest text.
    band = F.lit(len(bounds) - 1)
    for i in reversed(range(1, len(bounds))):
        band = F.when(F.col("n_shingles") < bounds[i], i - 1).otherwise(band)
    held = {r.band: r for r in sizes.where("n_shingles > 0").groupBy(band.alias("band")).agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    plan = group_plan(bounds, held, percent)
    parts = parts_for(rows.sparkSession, sum(x.rows * sum(plan[g][0] for g in (b, b - 1) if g in plan) for b, x in held.items()))
    packs = arrow_map(rows, partial(_signature_task, k, bounds, plan, parts), "part int, data binary")
    near, large = shared_buckets(packs, parts, HOT)
    released(rows.sparkSession)
    in_buckets = stored(near.select(F.explode(F.array("a", "b")).alias("class")).unionAll(large.select("class")).distinct(), "classes")
    speakers = members.join(in_buckets, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    # No id finds a class that only rows without id have: all of these are read.
    speaking = rows_in(rows, speakers, "doc_id").select("doc_id", "text").unionAll(rows.where("doc_id is null"))
    texts = arrow_map(speaking, partial(_texts_task, k), "class long, n long, sketch binary, packed binary")
    texts = stored(texts.join(in_buckets, "class", "left_semi").dropDuplicates(["class"]), "texts")
    released(rows.sparkSession)
    # A signature that many sets have costs most and is left out by sets that have enough others: if one of two partners has, after that,
    # as many segments as the guarantee needs, they meet in one of these. Sets that have not stay, and meet in the popular ones.
    hot = large.withColumn("parity", F.col("sig").bitwiseAND(F.lit(1)))
    hot_of = hot.groupBy("class", "parity").agg(F.count(F.lit(1)).alias("hot"))
    spare = arrow_map(texts.join(hot_of.select("class").distinct(), "class", "left_semi").select("class", "packed"), partial(_spare_task, k, percent, bounds, plan), "class long, parity long, spare long")
    rich = hot_of.join(spare, ["class", "parity"]).where("hot <= spare").select("class", "parity")
    poor = stored(hot.join(rich, ["class", "parity"], "left_anti").select("sig", "class"), "poor")
    reached = connected(near, poor, texts, partial(_elements, k), lambda pairs: _verified(pairs, texts, k, percent), percent)

    of_class = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"))
    of_class = of_class.join(reached, "class", "left").select("class", "low", F.coalesce("component", "class").alias("component"))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = of_class.join(lowest, "component").select("class", "component", "component_id")
    return members.join(of_class, "class", "left").select("doc_id", "mark", "n_shingles", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
