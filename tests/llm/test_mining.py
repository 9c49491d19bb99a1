"""Hard negatives, spelling variants and license scans against plain versions; odd rows and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, license_scan, spelling

CLASH = ("row", "block", "part", "pivot", "far", "word", "n", "near", "words", "have", "places", "label_", "score")


def with_clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- hard negatives


def plain_negatives(rows, every=100, positives=5, negatives=10):
    v = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, l, e in rows if i is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, la, q in (x for x in v if x[0] % every == 0):
        s = sorted((-sum(x * y for x, y in zip(q, e)), i, l) for i, l, e in v if i != a)
        for ps, p, _ in [x for x in s if x[2] == la][:positives]:
            ok = [x for x in s if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(ok, 1)]
    return sorted(out)


def vectors(kind, n, rng):
    centre = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(5)]
    for i in range(n):
        if kind == "same":
            yield [0.25, -0.5, 0.125, 0.0, 0.5, 0.25]
        elif kind == "copies":
            yield centre[i % 5]
        else:
            yield [x + rng.gauss(0, 0.05) for x in centre[i % 5]]


@pytest.mark.parametrize("kind", ["clusters", "copies", "same"])
def test_negatives_equal_all_pairs(spark, kind):
    rng = random.Random(kind)
    rows = [(i - 20, rng.randrange(10), v) for i, v in enumerate(vectors(kind, 420, rng))]
    rows += [(1000, 1, None), (1100, None, [0.1] * 6), (1200, 2, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (1300, 3, [float("nan")] * 6), (1400, 3, [float("inf")] * 6), (None, 3, [0.1] * 6), (1500, 2, []), (1600, 4, [0.3, 0.2])]
    df = with_clash(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    want = plain_negatives(rows)
    for size in (16_384, 64):  # one block, and several
        got = hard_negatives.negatives_digest(df, block_rows=size, anchor_rows=3, pivots=4)
        assert sorted(map(tuple, got.collect())) == want and want
    assert hard_negatives.negatives_digest(df.limit(0)).count() == 0


def test_search_reads_intervals_only():
    """Rows in well-parted clusters: an anchor reads its own cluster, and an annulus leaves out what lies inside."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (8, 16))
    v = np.rint(np.repeat(centres, 400, 0) + rng.normal(0, 2, (3200, 16))).astype(np.int64)
    square = float((v * v).sum(1).max())
    sphere = hard_negatives.Sphere(16, square, np.zeros((0, 17)))
    x = v.astype(float)
    sphere = hard_negatives.Sphere(16, square, hard_negatives.chosen_pivots(np.column_stack([x, sphere.extra(x)]), 8))
    far = sphere.distances(x, sphere.extra(x))
    table = pa.table({"vec_id": np.arange(3200), "row": np.arange(3200), "label": np.zeros(3200, np.int64), "pivot": far.argmin(1).astype(np.int32), "far": far.min(1), "v": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 16).cast(pa.list_(pa.int64()))})
    block = hard_negatives.Block(sphere, table)
    q = x[5]
    scores = x @ q
    scores[5] = -np.inf
    got = block.search(q, 5, 0, True, [(-hard_negatives.FAR, hard_negatives.FAR, -hard_negatives.FAR)], 5)[0]
    assert block.id[got].tolist() == np.lexsort((np.arange(3200), -scores))[:5].tolist()
    assert block.reads < 3200
    high = int(np.sort(scores)[-1000])
    got = block.search(q, 5, 1, False, [(-hard_negatives.FAR, high, -hard_negatives.FAR)], 3)[0]
    ok = np.flatnonzero(scores <= high)
    assert block.id[got].tolist() == ok[np.lexsort((ok, -scores[ok]))][:3].tolist()


# --- spelling variants


def plain_variants(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    v = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: sorted((x for x in v if near(w, x)), key=lambda x: (-v[x], x)) for w in v}
    form = {w: x[0] if x and v[x[0]] >= 2 * v[w] else None for w, x in by.items()}
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(by[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def test_variants_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["river", "rivver", "rver", "riverr", "rivers", "riverï", "Straße", "Étoile", "étoile", "aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 301, "abcde", "abcdf", "abcdg"]
    docs = [(i, " ".join(rng.choices(words, weights=[1.5 ** (k % 9) for k in range(len(words))], k=60)) + ("-Tail7" * 3)) for i in range(60)]
    docs += [(None, None), (None, "river River RIVER"), (7, ""), (7, "river; rivers"), (7, "river; rivers"), (8, "y" * 20_000)] + [(9, "z" * 5_000 + " " + "z" * 4_999)] * 3
    df = with_clash(spark.createDataFrame(docs, "doc_id long, text string"))
    got = spelling.spelling_digest(df)
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: x[0]) == plain_variants(docs)
    assert spelling.spelling_digest(df.limit(0)).count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_neighbours_are_all_distinct_edits(monkeypatch):
    alphabet = np.frombuffer(b"abc", np.uint8)
    for held in (1 << 20, 7):
        monkeypatch.setattr(spelling, "HELD", held)
        for w in ("a", "aa", "abba", "aabbc", "cabcabc"):
            got = [s for _, s in spelling.neighbours(spelling._codes([w]), alphabet, lambda h: np.ones(h.shape, bool))]
            want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}
            assert sorted(got) == sorted(want - {w})


def test_hashes_of_neighbours_follow_from_sums():
    alphabet = np.frombuffer(b"abcd", np.uint8)
    seen = []
    list(spelling.neighbours(spelling._codes(["abcab"]), alphabet, lambda h: (seen.append(h.ravel()), np.zeros(h.shape, bool))[1]))
    have = set(np.concatenate(seen).tolist())
    for s in ("bcab", "abxab".replace("x", "d"), "abcabd", "dabcab", "abcdab"):
        assert int(spelling._sums(spelling._codes([s]))[0, -1]) in have


def test_roots_of_long_chains(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("v", "w005")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert set(got.values()) == {"w037"} and len(got) == 38


# --- license scans


def plain_scan(text):
    w = license_scan.plain_words(text or "")
    at = lambda i, p: w[i : i + len(p)] == p
    base = [(i, label) for i in range(len(w)) for p, label in license_scan.BASE.items() if at(i, p.split())]
    found = {}
    for label, template, phrases in license_scan.TEMPLATES:
        t = license_scan.plain_words(template)
        for s in range(-len(t), len(w)):
            keys = all(0 <= s + next(i for i in range(len(t)) if t[i : i + len(p)] == p) and at(s + next(i for i in range(len(t)) if t[i : i + len(p)] == p), p) for p in map(license_scan.plain_words, phrases))
            share = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t)) / len(t)
            if keys and share >= license_scan.LEAST:
                found[label] = max(found.get(label, 0), share)
    labels = {x for _, x in base}
    score = 1.0 if base else max(found.values(), default=0.0)
    return len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(labels)), ",".join(sorted({*labels, *found})), score


def test_scan_equals_all_placements(spark):
    rng = random.Random(6)
    texts = [None, "", "no words of it", "CC BY", "cc-by", "cc. BY cc by", "ccby", "All rights reserved. all RIGHTS reserved", "the MIT License", "Mit freundlichem License", "MIT License", "Été cc by", "licensed under " * 5 + "cc by nc", "by cc " * 20_000]
    for _, t, _ in license_scan.TEMPLATES:
        w = t.split()
        texts += [t, "Before. " + t + " After.", " ".join(w[1:]), " ".join(w[:-1])]
        for _ in range(4):
            x = list(w)
            x[rng.randrange(len(x))] = "changed"
            texts.append(" ".join(rng.choices(["and", "the", "license"], k=5) + x))
    rows = [(i % 40 if i % 9 else None, t) for i, t in enumerate(texts)]
    df = with_clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = license_scan.scanned(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain_scan(t))) for i, t in rows)
    assert license_scan.scanned(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
