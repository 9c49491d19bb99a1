"""Several special strings in a vocabulary; held-out labels of toxicity."""

import json

from pyspark.sql import functions as F

from lectern.llm import token_counts, toxicity
from lectern.llm.queries import vocabulary


def test_several_special_strings(spark, tmp_path):
    """Each is one token, the longer of two that begin alike, as the library has it."""
    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary(), encoding="utf-8"))
    first = spec["added_tokens"][0]
    for i, text in enumerate(("<|pad|>", "<|pad|>>", "[SEP]")):
        spec["added_tokens"].append(first | {"id": 60_000 + i, "content": text})
    path = str(tmp_path / "several.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    tok = Tokenizer.from_file(path)
    rows = [(1, "a <|pad|> b"), (2, "x<|pad|>>y[SEP]<|endoftext|>z"), (3, "[SEP][SEP]"), (4, None), (5, ""), (6, "é [SEP" + " word" * 1000 + "]")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_labels_of_held_out_rows_teach_no_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labels.where(out).count() > 0
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity_digest(docs, x).collect()}
    assert score(labels) == score(turned)
