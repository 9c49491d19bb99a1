import random
import re
import time
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, html_text, line_dedup, linking, mixing, ngram_join, quality, textnum, token_counts, token_files, topk_search, toxicity
from lectern.llm.components import components

from . import brute

D = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, lang string, n_hit string, size string, class string"  # with names that clash with working columns


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["idiot", "the", "of"]
    out = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 8, 40, 200])))) for i in range(40)]
    base = rng.choices(vocab, k=120)
    for i in range(40, 70):  # a chain of near copies, and exact ones
        base = base[:]
        base[rng.randrange(len(base))] = rng.choice(vocab)
        out.append((i, " ".join(base)))
    out += [(70, out[3][1]), (71, out[3][1].upper()), (72, ""), (73, None), (74, " \n\t "), (75, "é ü\nß ñ 日本 " * 30), (75, "é ü\nß ñ 日本 " * 30), (76, "word " * 30_000), (77, "x" * 50_000)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i is not None and i % 5 == 0 else f"s{(i or 0) % 4}", "en", "a", "b", "c") for i, t in rows], DOCS)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(spark, k, percent):
    rows = texts()
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()))
    assert got == brute.ngram_join(rows, k, percent)


def test_ngram_join_with_deletions(spark, monkeypatch):
    """The guarantee also holds where all segments get one-deletion neighbourhoods."""
    monkeypatch.setattr(ngram_join, "allocation", lambda h, least, sets: (h // 2 + 1, h // 2 + 1))
    rows = texts()
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()))
    assert got == brute.ngram_join(rows, 4, 85)


def test_ngram_join_with_popular_signatures(spark, monkeypatch):
    """Sets that leave popular signatures out still meet their partners."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = texts() + [(300 + i, " ".join([f"q{rng.randrange(900)}" for _ in range(rng.choice([5, 60, 120]))] + passage)) for i in range(40)]
    rows += [(400 + i, rows[-1 - i][1] + " tail") for i in range(20)]
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()))
    assert got == brute.ngram_join(rows, 4, 85)


@pytest.mark.parametrize(("hot", "rare"), [(2, 2), (1, 1), (3, 8)])
def test_ngram_join_of_copies_around_a_text(spark, monkeypatch, hot, rare):
    """Copies of one text with 0 to 30 words changed, some changes shared, and without the text itself; buckets and elements count as large or common early."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "connected", partial(linking.connected, rare=rare))
    monkeypatch.setattr(linking, "FIRST", hot)
    rng = random.Random(hot)
    rows = []
    for base in range(3):
        text = [f"b{base}w{i}" for i in range(rng.choice([90, 150]))]
        for _ in range(45):
            copy = text[:]
            for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 6, 30])):
                at = rng.randrange(len(copy))
                copy[at] = f"x{at % 7}" if rng.random() < 0.6 else f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: rng.choice([len(copy), len(copy), len(copy) - 8])])))
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()))
    assert got == brute.ngram_join(rows, 4, 85)


def test_rare_elements_in_batches(monkeypatch):
    """Runs that go over batches of any size are counted as wholes."""
    rng = np.random.default_rng(3)
    e = np.sort(rng.integers(0, 400, 3000) ** 2 // 300)
    c = np.arange(3000)
    counts = dict(zip(*np.unique(e, return_counts=True), strict=True))
    assert [r for b in linking._rare(8)(iter([])) for r in b.to_pylist()] == []
    for size in (1, 2, 7, 1000, 3000):
        batches = [pa.RecordBatch.from_arrays([pa.array(e[i : i + size]), pa.array(c[i : i + size])], ["a", "b"]) for i in range(0, 3000, size)]
        for most in (10**6, 5):
            monkeypatch.setattr(linking, "OWN", most)
            got = [tuple(r.values()) for b in linking._rare(linking.RARE)(iter(batches)) for r in b.to_pylist()]
            assert [x for x in got if x[0] is not None] == [(x, y, counts[x], 0) for x, y in zip(e.tolist(), c.tolist(), strict=True) if 1 < counts[x] <= linking.RARE]
            assert sorted(x[1:] for x in got if x[0] is None) == [(y, 0, 1) for x, y in zip(e.tolist(), c.tolist(), strict=True) if counts[x] == 1]


@pytest.mark.parametrize(("packed", "parts"), [(1, 1), (7, 3), (500, 40), (10**6, 5)])
def test_packs_of_signatures(monkeypatch, packed, parts):
    """Pairs come together again, once each, at any sizes of packs and numbers of parts."""
    monkeypatch.setattr(linking, "PACKED", packed)
    rng = np.random.default_rng(packed)
    sig, cls = rng.integers(-50, 50, 800) ** 3, rng.integers(-9, 9, 800)
    packs = linking.Packs(parts)
    rows = [r for i in range(0, 800, 100) for b in packs.add(sig[i : i + 100].astype(np.uint64), cls[i : i + 100]) for r in b.to_pylist()] + [r for b in packs.flush() for r in b.to_pylist()]
    rows.sort(key=lambda r: r["part"])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 3], schema=pa.schema([("part", pa.int32()), ("data", pa.binary())])) for i in range(0, len(rows), 3)]
    of = {}
    for x, y in sorted(set(zip(sig.tolist(), cls.tolist(), strict=True))):
        of.setdefault(x, []).append(y)
    for most in (1, 3, 7, 50):
        got = [tuple(r.values()) for b in linking._buckets(most)(iter(batches)) for r in b.to_pylist()]
        assert {(a, b) for s, a, b in got if s is None} == {(a, b) for ys in of.values() if len(ys) <= most for a in ys for b in ys if a < b}
        assert sorted((s, a) for s, a, _ in got if s is not None) == [(x, y) for x, ys in sorted(of.items()) if len(ys) > most for y in ys]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_prefixes_of_rare_elements(monkeypatch, size):
    """Each linked pair has a kept element in common, or both stay in large buckets and fit by their counts of common elements."""
    rng = random.Random(size)
    sets = []
    for base in range(6):
        text = [1000 * base + i for i in range(30)]
        sets += [frozenset(text[: rng.choice([30, 30, 27])]) - {rng.choice(text)} | {10**6 + rng.randrange(40) for _ in range(rng.choice([0, 1, 3, 9]))} for _ in range(rng.choice([2, 5, 12]))]
    sets = list(dict.fromkeys(sets))
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    rows = []
    for c, s in enumerate(sets):
        rows += [(None, c, linking._SIZE, len(s)), (None, c, linking._CENTRAL, 5), (None, c, 0, sum(count[x] == 1 for x in s))] + [(x, c, count[x], 0) for x in s if 1 < count[x] <= 3]
    rows.sort(key=lambda r: (r[1], r[2], r[0] or 0))
    schema = pa.schema([("element", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("own", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema=schema) for i in range(0, len(rows), size)]
    got = [r for b in linking._prefixes(80)(iter(batches)) for r in b.to_pylist()]
    assert all(r["central"] == 5 and r["size"] == len(sets[r["class"]]) for r in got)
    of = [({r["element"]: r["top"] for r in got if r["class"] == c and r["element"] is not None}, next((r["top"] for r in got if r["class"] == c and r["element"] is None), 0)) for c in range(len(sets))]
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                linked += 1
                fits = lambda x, y: len(a) <= y and len(b) <= x
                assert any(fits(of[i][0][e], of[j][0][e]) for e in of[i][0].keys() & of[j][0].keys()) or fits(of[i][1], of[j][1])
    assert linked > 20 and len(got) < sum(map(len, sets))


def test_allocation_keeps_the_guarantee():
    for h in range(1, 300):
        for sets in (2, 1000, 10**9):
            m, near = ngram_join.allocation(h, 6 * h, sets)
            assert m + near >= h + 1 and near <= m
    assert ngram_join.allocation(10, 60, 1000)[1] == 0 and ngram_join.allocation(10, 60, 10**9)[1] > 0  # cost moves it to deletions


def test_null_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, None)]
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.n_shingles) == [(False, 4), (True, 4)]


def test_near_copies_with_null_ids(spark):
    """Texts that only rows without id have are linked as others."""
    rng = random.Random(9)
    a, b = ([f"w{rng.randrange(500)}" for _ in range(120)] for _ in "ab")
    near_a, near_b = [*a[:-1], "other"], [*b[:-1], "other"]
    rows = [(4, a), (None, near_a), (None, b), (None, near_b), (6, ["alone"] * 9), (None, ["apart"] * 9)]
    got = ngram_join.jaccard_components(frame(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles > 9, r.component_id or 0) for r in got) == [(0, False, 0), (0, True, 0), (0, True, 0), (0, True, 4), (4, True, 4), (6, False, 6)]


def test_ngram_join_where_counts_are_too_low(spark, monkeypatch):
    """An approximate count of one class skips no group: it is for the cost alone."""
    monkeypatch.setattr(ngram_join.F, "approx_count_distinct", lambda c: F.count_distinct(c) * 0 + 1)
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "a b c d e f g h"), (4, "a b c d e f g x")]
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()))
    assert got == brute.ngram_join(rows, 4, 85) and got[1][2] == 1


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 5), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    for share in (1_000_000, 20):  # in one task, and in shares that rounds join
        got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), local_links=share).collect()))
        assert got == {x: root(x) for x in up}


def test_decontamination(spark):
    items = [(1, "w1 w2 w3"), (2, " ".join(f"w{i}" for i in range(30))), (3, None), (4, ""), (5, "The"), (None, "w7"), (2, "w300 w301")]
    rows = [*texts(), (90, "x, " + " ".join(f"W{i}" for i in range(4, 20)) + "! w1-w2.w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontamination(rows, [x for x in items if x[0] is not None])
    for chunk in (1 << 20, 20, 60):
        got = map(tuple, decontamination.contamination_digest(frame(spark, rows), bench, chunk_bytes=chunk).collect())
        assert brute.counted(got) == brute.counted(want)
    assert decontamination.contamination_digest(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_mixing(spark):
    rows = texts()
    df = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") < 8, F.lit("only empty")).otherwise(F.col("source"))).withColumn("text", F.when(F.col("doc_id") < 8, F.lit("")).otherwise(F.col("text")))
    plan = mixing.mix_plan(df).collect()
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert brute.counted(plan) == brute.counted(again) and len(plan) == df.count()
    sizes = {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute.targets(sizes)
    for s in sizes:
        own = [r for r in plan if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max([r.size for r in own], default=0) / 2 + 1e-6
        assert all(r.taken <= 2 * r.size for r in own)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in plan)


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=16) / 4]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (450, [0.0] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search_digest(df, block_rows=64, query_rows=4).collect())
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got == brute.top_k(exact)
    again = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.9, 0.9]), (0, [1.0, 1.0]), (0, [-1.0, 0.0]), (2, [])], "vec_id long, embedding array<float>").withColumn("row", F.lit("clash"))
    every = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search_digest(again, k=3).orderBy("rank").collect()]
    assert every[:2] == [(0, 1, 1, 2 * 230 * 256), (0, 2, 1, 2 * 128 * 256)] and len(every) == 3
    assert topk_search.search_digest(df.limit(0)).count() == 0
    assert topk_search.search_digest(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    v = rng.integers(-20, 20, (5000, 8)).astype(float)
    v[7] = 200
    block = topk_search.Block(np.arange(5000), v)
    ids, scores = block.best(np.ones(8), -1, 1)
    assert ids.tolist() == [7] and scores[0] == 1600 and block.reads < 1000


def test_html():
    page = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><a href="/">home</a></nav><div class="cookie-notice">We bake</div>
    <article><h1>Rivers &amp; boats</h1><p><b>First  part<br><p>Second&nbsp;part with <a href="/x">one link</a> in it.</p><aside>Read also</aside><form>Search</form><p>End.</p></article>
    <section class="comments"><p>Nice</p></section><footer>&copy; Net</footer></body></html>"""
    assert html_text.main_text(page) == "Rivers & boats\n\nFirst part\n\nSecond part with one link in it.\n\nEnd."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a href='/'>x</a></nav>") == ""
    assert html_text.main_text("<article><p>" + "long " * 50_000 + "</p></article>").count("long") == 50_000


def test_html_of_hidden_elements_left_open():
    """Elements that are never closed hide their own text only; closed ones hide all of it."""
    for tag in ("button", "select", "textarea", "noscript", "video", "object"):
        page = f"<article><h1>Rivers rise in spring</h1><p>The village moved its boats up the hill.</p><{tag}>hidden words<p>They stayed until the water fell again.</p></article><div><{tag}>x</{tag}></div>"
        assert html_text.main_text(page) == "Rivers rise in spring\n\nThe village moved its boats up the hill.\n\nThey stayed until the water fell again.", tag
        closed = page.replace("hidden words", f"hidden <div>words</div></{tag}>")
        assert html_text.main_text(closed) == html_text.main_text(page)
    assert html_text.main_text("<article><p>A long first line of the text here.</p><script>var a = '<p>no</p>'") == "A long first line of the text here."
    began = time.perf_counter()
    html_text.main_text("<article>" + "<button>a<select>b" * 20_000)
    assert time.perf_counter() - began < 5


def test_html_without_containers(spark):
    """Where no container tells, words and link density of blocks and neighbours decide; without these the tree finds next to nothing."""
    counts = {"all": [0, 0, 0], "bare": [0, 0, 0]}
    for page in [r.html for r in spark.read.parquet(f"{D}/pages.parquet").collect() if r.html]:
        plain = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", page)
        plain = re.sub(r'\s(class|id|role)="[^"]*"', "", plain)
        a, b = html_text.Cut(page), html_text.Cut(plain)
        assert a.texts == b.texts
        want, x = html_text.tree().of(a.features()) >= 0.5, b.features()
        bare = x.copy()
        bare[:, :6] = 0
        for name, z in (("all", x), ("bare", bare)):
            got = html_text.tree().of(z) >= 0.5
            counts[name] = [n + int(k.sum()) for n, k in zip(counts[name], (want & got, want & ~got, got & ~want), strict=True)]
    hit, lost, more = counts["all"]
    assert hit / (hit + lost) > 0.98 and hit / (hit + more) > 0.8
    assert counts["bare"][0] / (hit + lost) < 0.3


def test_html_of_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "<p>x", "t"), (1, "u", "", "t"), (2, "u", "<article><p>One.<br>Two words here.</p></article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()), key=repr)
    assert len(got) == 4 and (1, None, "", 0) in got and (2, "u", "One.\n\nTwo words here.", 21) in got
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_of_pages(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").withColumn("text", F.lit("clash"))
    got = html_text.extracted(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)


ODD = ["", "a", " a", "  a", "a  b \n c\n\nd", "x<|endoftext|>y <|endoftext|>", " ", "\n", "it's don't we'll", "日本語 テキスト\n\n ok\r\nend\n", "\x1c \x1d a", "a \n", "12 345a6 ½", "é è  x　 　y", "a" * 3000, "\t\ta\tb", "“q” — r\n“s”"]


def test_token_counts_and_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = [*texts(), *((200 + i, t) for i, t in enumerate(ODD)), (None, "no id"), (None, None)]
    n = token_counts.token_counts(frame(spark, rows), PATH).collect()
    want = [(i, len((t or "").encode()), k := len(tok.encode(t or "", add_special_tokens=False).ids), k > 512) for i, t in rows]
    assert brute.counted(map(tuple, n)) == brute.counted(want)
    got = token_files.token_digest(frame(spark, rows), PATH).collect()
    assert sorted(map(tuple, got), key=repr) == brute.token_digest(rows, tok)
    assert token_files.token_digest(frame(spark, rows).limit(0), PATH).count() == 0


def test_heap_merges_are_those_of_a_rescan():
    pairs = token_counts.BytePairs(PATH)
    import json

    letters = {c: b for b, c in enumerate(token_counts.byte_letters())}
    raw = lambda s: bytes(letters[c] for c in s)
    merges = json.load(open(PATH))["model"]["merges"]
    ranks = {tuple(map(raw, m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(merges)}
    for w in ("hello", " thereabouts", "aaaaaaaaaaaaaaaaaaaaa", "日本語", " ", "xyzzyxyzzy", "ssssssssss"):
        assert pairs.merged(w.encode()) == brute.merges(w.encode(), ranks)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 70_000])
def test_blocks_of_tokens(n):
    rng = np.random.default_rng(n)
    ids = np.concatenate([rng.integers(0, 50_000, n), np.arange(n)]).astype(np.uint32)
    back, lengths, keys, null = token_files.unpack(token_files.pack(ids, np.array([n, n]), np.array([5, -1]), np.array([False, True])))
    assert np.array_equal(back, ids) and lengths.tolist() == [n, n] and keys.tolist() == [5, -1] and null.tolist() == [False, True]
    with pytest.raises(ValueError):
        token_files.unpack(b"LTB1" + bytes(30))


def test_line_dedup(spark):
    rng = random.Random(2)
    long_ = " ".join(rng.choices([f"river{i}" for i in range(50)], k=40))
    rows = [(0, f"{long_}\nshort\n\nunique one"), (1, f"{long_[:-8]} changed\n  \nshort"), (2, f"x\n{long_}"), (3, None), (4, ""), (5, "a" * 40_000), (6, "a" * 40_000), (7, "ñandú " * 30), (8, "ñandú " * 31)]
    got = line_dedup.deduped_lines(frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute.lines_kept(rows)
    assert line_dedup.line_digest(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_joins_no_lines_to_what_stays(spark):
    """The plan of the texts joins components and, once, texts; lines do not meet their components' first lines."""
    rows = [(1, "a line that is here twice\n\nanother line, of its own"), (2, "a line that is here twice\n \nthe last one"), (3, None), (4, ""), (2, "a line that is here twice\n \nthe last one")]
    out = line_dedup.deduped_lines(frame(spark, rows))

    def joins(plan):
        return (plan.nodeName() == "Join") + sum(joins(plan.children().apply(i)) for i in range(plan.children().size()))

    assert joins(out._jdf.queryExecution().optimizedPlan()) == 2
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect()), key=lambda r: r[0])
    assert got == [(1, rows[0][1], 2, 2), (2, " \nthe last one", 2, 1), (2, " \nthe last one", 2, 1), (3, None, 0, 0), (4, "", 0, 0)]


def test_scales_of_lines_are_exact_where_they_decide():
    """Counts from a line's beginning lead to the same signatures as counts of the whole line."""
    rng = np.random.default_rng(5)
    runs = [rng.integers(0, most, n).astype(np.uint64) * np.uint64(step) for n in (0, 1, 95, 96, 127, 128, 160, 161, 162, 400, 3000) for most in (3, 100, 130, 1 << 40) for step in (1, 4)]
    runs += [np.concatenate([np.full(200, 7, np.uint64), rng.integers(0, 1 << 40, 300).astype(np.uint64)]), np.arange(1, 4001, 4, dtype=np.uint64), np.concatenate([np.arange(1, 1001, 4), np.arange(0, 400, 4)]).astype(np.uint64)]
    n, parts = line_dedup._scales(np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])]))
    for a, b, x in zip(n.tolist(), parts.tolist(), runs, strict=True):
        own = set(x.tolist())
        quarter = sum(k % 4 == 0 for k in own)
        if len(x) < 96:
            assert a == len(x)
        else:
            assert (a < 96, a < 128, b > 0, b < line_dedup.SMALL) == (len(own) < 96, len(own) < 128, quarter > 0, quarter < line_dedup.SMALL)


def test_lines_are_cut_from_the_bytes_of_all():
    texts = pa.array(["ä\n\n  \nb c\U0001f600\n", None, "", "\nz", "one"])
    data, offs = textnum.buffers(texts)
    x = line_dedup.Lines(data, offs, 0, 5)
    assert line_dedup._line_texts(x, np.array([3, 0, 1, 2])).to_pylist() == ["one", "ä", "b c\U0001f600", "z"]
    x = line_dedup.Lines(np.frombuffer(b"a\xff\nb", np.uint8), np.array([0, 4]), 0, 1)
    assert line_dedup._line_texts(x, np.array([0, 1])).to_pylist() == ["a\ufffd", "b"]


def test_line_dedup_with_repetitive_lines(spark):
    """Lines with the same few shingles are found at any lengths: rulers, and phrases repeated."""
    rng = random.Random(8)
    pool = [c * n for c in "-=_*~#+.ox" for n in (20, 100, 130, 200, 900)]
    for i in range(12):
        phrase = "".join(rng.choices("abcdefghij ", k=rng.choice([3, 15, 40]))) + str(i)
        pool += [(phrase * 100)[:n] for n in (90, 120, 180, 600)]
    pool += ["".join(rng.choices("klmnop", k=n)) + "z" * n for n in (95, 103, 127, 140)]
    pool += [x[:-3] for x in pool[-4:]]
    rows = [(i, f"head {i} of it\n{x}") for i, x in enumerate(pool)]
    got = line_dedup.deduped_lines(frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute.lines_kept(rows)


def test_quality_and_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for digest, label, least in ((quality.quality_digest, "quality", 0.93), (toxicity.toxicity_digest, "toxic", 0.85)):
        got = digest(docs, labels)
        assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted != CAST(score >= 0.5 AS INT)").count() == 0
        held = got.where("held_out").join(labels, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_classifiers_without_labels(spark):
    docs = frame(spark, texts())
    none = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for digest in (quality.quality_digest, toxicity.toxicity_digest):
        rows = digest(docs, none).collect()
        assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}
        one = digest(docs, spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")).collect()
        assert all(r.score > 0.5 for r in one)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in quality.quality_digest(docs, x).collect()}
    assert score(labels) == score(turned)


def test_bounds_of_labelled_samples(spark, monkeypatch):
    """At most so many rows and bytes teach, also where ids repeat; a text that doesn't fit is passed over, the others stay."""
    rows = [(1, "é" * 30), (2, "b" * 20), (2, "c" * 20), (2, "c" * 20), (3, "d" * 30), (4, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, label int")
    taught = []
    monkeypatch.setattr(toxicity, "trained", lambda texts, y: taught.append((sorted(texts), len(y))))
    for most, most_bytes in ((10, 1000), (10, 75), (3, 1000)):
        toxicity.fitted(frame(spark, rows), labels, most, most_bytes)
    assert taught[0] == (sorted(["é" * 30, "b" * 20, "c" * 20, "d" * 30, ""]), 5)
    assert sum(len(t.encode()) for t in taught[1][0]) in (70, 60) and taught[2][1] <= 3
    many = frame(spark, [(7, f"word {i} here") for i in range(50)] + [(8, "other words")])
    quality.fitted(many, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int"), most=10)
    seen = []
    real = quality.pooled
    monkeypatch.setattr(quality, "pooled", lambda s, y: (seen.append(len(y)), real(s, y))[1])
    quality.fitted(many, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int"), most=60)
    assert seen == [51]


def test_toxicity_learns_through_the_network(spark):
    """On held-out rows the network is no worse than the best single word by its label odds with the best cut in hindsight, and better than always answering clean."""
    import zlib
    from collections import Counter

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, int(r.toxic)) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r.doc_id in docs and r.toxic is not None]
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    fit = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    net = toxicity.trained([docs[i] for i, _ in fit], [y for _, y in fit])
    data, offs = textnum.buffers(pa.array([docs[i] for i, _ in held]))
    score = np.concatenate([net.score(toxicity.Inputs(textnum.Words(data, offs, lo, hi, "alnum"))) for lo, hi in textnum.slices(offs)])
    y = np.array([v for _, v in held])
    accuracy = ((score >= 0.5) == y).mean()
    words = {i: set(re.findall(r"\w+", docs[i].lower())) for i, _ in labels}
    hits = (Counter(), Counter())
    for i, v in fit:
        hits[v].update(words[i])
    odds = {w: np.log((n + 0.5) / (sum(v for _, v in fit) + 1)) - np.log((hits[0][w] + 0.5) / (len(fit) + 1)) - 2 * np.sqrt(1 / (n + 0.5) + 1 / (hits[0][w] + 0.5)) for w, n in hits[1].items()}
    best = np.array([max((odds.get(w, -9.0) for w in words[i]), default=-9.0) for i, _ in held])
    lookup = max(((best >= cut) == y).mean() for cut in np.unique(best))  # with the cut that is best on these very rows
    assert accuracy >= lookup and accuracy > 0.97 > 1 - y.mean(), (accuracy, lookup, 1 - y.mean())


def test_gradients_of_the_network():
    texts_ = ["good calm river", "you idiot clown go", ""]
    data, offs = textnum.buffers(pa.array(texts_))
    x = toxicity.Inputs(textnum.Words(data, offs, 0, 3, "alnum"))
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.ones(toxicity.CELLS, bool), np.ones(toxicity.CELLS, bool))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["attend"] = rng.normal(size=net.p["attend"].shape)
    start, size, _ = toxicity.windows(x.count, x.first)
    index, mask = toxicity._places(x, start, size, len(x.hash))
    y, w = np.array([0.0, 1.0, 0.0]), np.full(3, 1 / 3)

    def loss():
        z = net.run(net.inputs(x), index, mask)[0].astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(x, index, mask, y, w)
    for k in ("uf", "wb", "cf", "attend", "out", "bias", "word", "gram"):
        flat = net.p[k].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - np.asarray(grads[k]).reshape(-1)[i]) < 2e-3


def test_hash_index():
    rng = np.random.default_rng(0)
    index, known = textnum.HashIndex(4), {}
    for _ in range(20):
        keys = np.unique(rng.integers(0, 5000, 300).astype(np.uint64) * np.uint64(1 << 33))
        found = index.find(keys)
        assert all(known.get(int(k), -1) == f for k, f in zip(keys, found, strict=True))
        new = keys[found < 0]
        known |= {int(k): index.n + i for i, k in enumerate(new)}
        data = b"".join(b"%d" % k for k in new)
        ends = np.cumsum([len(b"%d" % k) for k in new])
        start = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(new) else ends.astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        index.add(new, raw, start, ends.astype(np.int64))
        if len(new):
            number = index.find(new)
            assert index.same(number, raw, start, ends).all()
            other = raw.copy()
            other[start[0]] ^= 1
            assert index.same(number, other, start, ends).tolist() == [False] + [True] * (len(new) - 1)


def thue_morse(n, a="a", b="b"):
    x = y = ""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_hashes_are_no_polynomials():
    for n in (3, 10, 14):
        for a, b in ((("a", "b")), ("ab", "cd"), ("word1xyz", "word2xyz")):
            x, y = thue_morse(n, a, b)
            raw = np.frombuffer((x + y).encode(), np.uint8)
            h = textnum.span_hashes(raw, np.array([0, len(x)]), np.array([len(x), len(x + y)]))
            assert h[0] != h[1]


def test_texts_whose_sums_of_powers_agree(spark):
    """Thue-Morse words and their complements, as words, pieces, lines and whole texts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = [(2 * i + j, t) for i, n in enumerate((10, 11, 6)) for j, t in enumerate(thue_morse(n))]
    rows += [(20 + j, f"one two three {t} five six") for j, t in enumerate(thue_morse(10))] + [(30 + j, t) for j, t in enumerate(thue_morse(10, "x y ", "z w "))]
    df = frame(spark, rows).coalesce(1)
    n = token_counts.token_counts(df, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in n} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert sorted(map(tuple, token_files.token_digest(df, PATH).collect()), key=repr) == brute.token_digest(rows, tok)
    assert sorted(map(tuple, ngram_join.jaccard_components(df, 4, 85).collect())) == brute.ngram_join(rows, 4, 85)
    got = line_dedup.deduped_lines(df).collect()
    assert {r.doc_id: r.text for r in got} == brute.lines_kept(rows)


def test_pieces_with_the_key_of_another(spark, monkeypatch):
    """Where keys are equal and pieces differ, texts are tokenized whole."""
    from lectern.llm import pieces
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    monkeypatch.setattr(pieces, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) + np.uint64(7))
    rows = [t for _, t in texts() if t][:30] + ODD
    data, offs = textnum.buffers(pa.array(rows))
    encoder, counter = token_files.Encoder(PATH), token_counts._Counter(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in rows]
    for _ in range(2):
        flat, count = encoder.slice(data, offs, 0, len(rows))
        assert count.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
        assert counter.slice(data, offs, 0, len(rows)).tolist() == list(map(len, want))


def test_words_of_slices():
    rows = ["A b  C", "", "é x", "tail"]
    data, offs = textnum.buffers(pa.array(rows))
    w = textnum.Words(data, offs, 0, 4, "spaced")
    assert w.count.tolist() == [3, 0, 2, 1]
    one = textnum.Words(*textnum.buffers(pa.array(["é x"])), 0, 1, "spaced")
    assert np.array_equal(w.hashes()[3:5], one.hashes())
