"""Arrow UDFs take a batch in slices."""

import pyarrow as pa
from pyspark.sql import types as T

from lectern.functions import arrow, text
from lectern.operators import lines


def test_a_batch_of_whole_texts_is_never_python_values_at_once():
    texts = pa.array(["é" * 1_000_000] * 40)
    sizes = [len(part[0]) for part in arrow.slices((texts, texts))]
    assert sum(sizes) == 40 and max(sizes) == 1
    assert [len(p[0]) for p in arrow.slices((pa.array(["a", None, "b"]),))] == [3]
    assert list(arrow.slices((pa.array([], pa.string()),))) == []


def test_slices_come_together_again(monkeypatch):
    monkeypatch.setattr(arrow.slices, "__defaults__", (8,))
    for udf, given, want in (
        (text.nfkc, [["ﬁn", None, "", "½"] * 5], ["fin", None, "", "1⁄2"] * 5),
        (text.unaccented, [["Ána", None, "abc"] * 5], ["Ana", None, "abc"] * 5),
        (lines.lcs_length, [[["a", "b"], None, []] * 5, [["b"], ["b"], ["c"]] * 5], [1, 0, 0] * 5),
    ):
        assert udf.func(*map(pa.array, given)).to_pylist() == want
        assert udf.func(*(pa.array(x).slice(0, 0) for x in given)).to_pylist() == []
    assert text.nfkc.returnType == T.StringType()
