import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lectern.llm import quality  # noqa: E402

from . import brute  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()] if name != "quality" else [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, D)
        if name != "tokens":
            assert out.columns == docs.columns
        seen[name] = (before, out.collect())
        docs = out
    before, after = seen["quality"]
    predicted = {r.doc_id: r.predicted for r in quality.quality_digest(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, _ in before if predicted[i])
    before, after = seen["near_copies"]
    joined = brute.ngram_join([(i, t) for i, t, _ in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in joined if i == c)
    before, after = seen["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(t))] for i in range(len(w) - 9)}
    clean = [i for i, t, _ in before for w in [brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(t))] if not any(tuple(w[j : j + 10]) in grams for j in range(len(w) - 9))]
    assert sorted(r.doc_id for r in after) == sorted(clean)
    before, after = seen["mix"]
    size = {i: len(brute.words(t)) for i, t, _ in before}
    of = {i: s for i, _, s in before}
    totals = {}
    for i, s in of.items():
        totals[s] = totals.get(s, 0) + size[i]
    want, got = brute.targets(totals), dict.fromkeys(totals, 0)
    for r in after:
        got[of[r.doc_id]] += size[r.doc_id]
    assert all(abs(got[s] - want[s]) <= max(size[i] for i in of if of[i] == s) for s in totals)
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = seen["tokens"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, after), key=repr) == brute.token_digest([(i, t) for i, t, _ in before], tok)


def test_one_row_of_each_component(spark):
    """Also where ids repeat or are null; rows without words stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    near = a + " other"
    rows = [(3, a), (7, near), (7, b), (8, c), (8, c + " other"), (8, c), (None, a + " more"), (None, "x y z"), (None, "x y z"), (None, "p q r s t u"), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, D).collect()]
    assert sum(i == 8 for i, _ in got) == 1 and {t for i, t in got if i == 8} <= {c, c + " other"}
    want = [(3, a), (7, b), (None, "x y z"), (None, "p q r s t u"), (9, ""), (9, None)]
    assert sorted((x for x in got if x[0] != 8), key=repr) == sorted(want, key=repr)


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert out.agg(F.sum("n_tokens")).first()[0] == max(r.start + r.n_tokens for r in out.collect())
    assert zlib.crc32(b"") == 0
