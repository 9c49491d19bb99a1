"""Empty tables, null and repeated ids, clashing columns, for every operator and stage; recall of the line candidates."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, html_text, line_dedup, mixing, ngram_join, quality, token_counts, token_files, topk_search, toxicity
from lectern.llm.queries import vocabulary

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: Columns with the names that operators use while they work.
CLASH = ("class", "mark", "component", "sig", "size", "h", "part", "line", "row", "n", "_lectern_of", "_lectern_k", "_key", "_text", "label", "block", "score")
ROWS = [(None, None), (None, ""), (None, "one two three four five six"), (1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of the same id here"), (2, "a b c d e f g h"), (3, "x" * 100_000), (4, " \n\t\n "), (5, "a line that repeats itself\n" * 40)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None else f"s{i % 2}") for i, t in rows], "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in CLASH})


def operators(spark):
    bench = spark.createDataFrame([(7, "a b c d e f g"), (None, "x"), (8, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    return {
        "op3": lambda d: ngram_join.jaccard_components(d), "op4": lambda d: quality.quality_digest(d, labels), "op5": lambda d: mixing.mix_digest(d), "op6": lambda d: decontamination.contamination_digest(d, bench),
        "op7": lambda d: toxicity.toxicity_digest(d, labels), "op8": lambda d: token_counts.token_counts(d, vocabulary()), "op9": lambda d: token_files.token_digest(d, vocabulary()), "op10": lambda d: line_dedup.line_digest(d),
    }


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows_and_no_rows(spark, name):
    run = operators(spark)[name]
    got = run(table(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    empty = run(table(spark, ROWS).limit(0))
    assert empty.count() == 0 and empty.columns == run(table(spark, ROWS)).columns


def test_components_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, ROWS)).collect()), key=repr)
    assert [r for r in got if r[0] == 1] == [(1, 4, 1), (1, 4, 1), (1, 4, 1)] and (2, 5, 2) in got and (None, 0, None) in got


def test_pages_and_vectors_without_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, row string")
    assert html_text.extracted(pages).count() == 0 and topk_search.search_digest(vectors).count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    docs = table(spark, ROWS)
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, "an item of ten words that no document has in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert (out.columns == rows.columns) == (name != "tokens")
            n = out.count()
            assert n == 0 if rows is not docs else n > 0, name


def test_recall_of_line_candidates(spark):
    """Of pairs of lines by their similarity, the share that is linked; at 0.8 and above 0.9 at least, below 0.8 none."""
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(600):
        words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(1000)}" for _ in range(rng.choice([8, 14, 25, 60]))]
        other = words[:]
        for _ in range(rng.choice([1, 1, 2, 3])):
            other[rng.randrange(len(other))] = f"new{rng.randrange(10**6)}"
        a, b = f"{i} " + " ".join(words), f"{i} " + " ".join(other)
        s, t = (frozenset(x[j : j + 8] for j in range(len(x) - 7)) for x in (a, b))
        pairs.append((2 * i, len(s & t) / len(s | t)))
        rows += [(2 * i, a), (2 * i + 1, b)]
    gone = {r.doc_id for r in line_dedup.deduped_lines(table(spark, rows)).where("n_kept = 0").collect()}
    near = [i + 1 in gone for i, s in pairs if 0.8 <= s < 0.87]
    same = [i + 1 in gone for i, s in pairs if s >= 0.87]
    assert not any(i + 1 in gone for i, s in pairs if s < 0.8)
    assert len(near) > 60 and sum(near) / len(near) >= 0.9 and len(same) > 60 and sum(same) / len(same) >= 0.98
    assert brute.near(80)(frozenset("ab"), frozenset("ab"))


def test_new_pieces_are_joined_without_a_string_for_each():
    """op9_token_files: pieces that begin with a blank reach the library as joined bytes; ids are those of whole texts."""
    import pyarrow as pa
    import public_tokenizers
    from lectern.llm import textnum, token_files

    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the river runs\nTwo  blanks é 中文 x", "", " ", "a b\tc", "the river again 😀 é\n", "  x y"]
    data, offs = textnum.buffers(pa.array(texts))
    asked = []
    made = token_files._Strings.__getitem__
    token_files._Strings.__getitem__ = lambda self, i: asked.append(made(self, i)) or asked[-1]
    try:
        flat, count = e.slice(data, offs, 0, len(texts))
    finally:
        token_files._Strings.__getitem__ = made
    assert [flat[b - n : b].tolist() for b, n in zip(count.cumsum().tolist(), count.tolist(), strict=True)] == [e.ids(t).tolist() for t in texts]
    assert asked and not any(len(p) > 1 and p[0] == " " for p in asked)
