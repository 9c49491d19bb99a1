"""Groups of spelling variants (operator 12) by full neighbourhoods.

Words are counted over all texts. Every word of the vocabulary then emits all distinct strings that one deletion, replacement or insertion over
the observed alphabet makes of it; a string that is a word itself is a near word, found by a hash join on the whole string, so that no
distance is ever computed. Nearly all of these strings are no words: their hashes follow from prefix sums of the word's own, and those
that a bitmap of the vocabulary's hashes does not have are dropped where they are made. The bitmap has a bounded size; what it lets pass
wrongly finds no partner in the join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, dropped, kept, scratch, stored
from .textnum import U, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Bits of the bitmap for each word, and the least and most bits (as powers of 2) that it has: 64 MB at most.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 20, 29
#: Strings whose hashes are held at once.
HELD = 1 << 20
#: Each character's number in a word's hash, the base and its inverse.
_VALUE = mix(np.arange(1, 257).astype(U))
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SECOND = U(0xD6E8FEB86659FD93)


def _counted(slip: int, least: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            begun = zlib.crc32(f"{'null' if (i := doc_id.as_py()) is None else i}:".encode())
            for word, k in Counter(RUN.findall(text.as_py() or "")).items():
                word = word.lower() if word.isascii() else word.translate(_LOWER)
                h = zlib.crc32(word.encode(), begun)
                if h % slip == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= least:
                    n[word] += k
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, slip: int = 97, least_length: int = 5, least: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: letter runs of all whole texts, A-Z in lower case, with n occurrences overall.

    A run whose crc32 with its document's id is divisible by slip loses a letter first. A null text has no runs, a null id
    is written null; rows that repeat count again."""
    found = arrow_map(docs.select(key, text), lambda: _counted(slip, least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of character codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base^place: the last is the word's hash."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), U)
    np.cumsum(_VALUE[codes] * _powers(codes.shape[1]), axis=1, out=out[:, 1:])
    return out


def _bits(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(h) >> U(64 - power), mix(h ^ _SECOND) >> U(64 - power)


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and codes of the words of each length."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    for length, places in at.items():
        step = max(1, HELD // (length + 1))
        for lo in range(0, len(places), step):
            yield places[lo : lo + step], _codes([words[i] for i in places[lo : lo + step]])


def neighbours(codes: np.ndarray, alphabet: np.ndarray, is_word: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, str]]:
    """Of words of one length, as rows of codes: row and string of every neighbour for whose hash is_word holds, each string once.

    Of equal letters in a row the first is deleted, and before the first an equal one is inserted."""
    n, length = codes.shape
    sums, power = _sums(codes), _powers(length + 1)
    whole, values = sums[:, -1:], _VALUE[alphabet]
    again = np.zeros((n, length + 1), bool)  # the letter stands there before, too
    again[:, 1:length] = codes[:, 1:] == codes[:, :-1]
    rows = max(1, HELD // ((length + 1) * max(1, len(alphabet))))
    places = max(1, HELD // max(1, len(alphabet)))
    for lo in range(0, n, rows):
        r = slice(lo, lo + rows)
        p = sums[r]
        gone = is_word(p[:, :-1] + (whole[r] - p[:, 1:]) * _INVERSE) & ~again[r, :length]
        for i, j in np.argwhere(gone).tolist():
            w = codes[lo + i]
            yield lo + i, bytes(np.delete(w, j)).decode("latin-1")
        for a in range(0, length + 1, places):
            s = slice(a, min(a + places, length + 1))
            more = p[:, s, None] + values * power[s, None] + (whole[r] - p[:, s])[..., None] * _BASE
            ok = is_word(more)
            if a:
                ok &= alphabet != codes[r, a - 1 : s.stop - 1, None]
            else:
                ok[:, 1:] &= alphabet != codes[r, : s.stop - 1, None]
            for i, j, c in np.argwhere(ok).tolist():
                yield lo + i, bytes(np.insert(codes[lo + i], a + j, alphabet[c])).decode("latin-1")
            s = slice(a, min(a + places, length))
            if s.start < s.stop:
                own = codes[r, s]
                other = whole[r][..., None] + (values - _VALUE[own][..., None]) * power[s, None]
                ok = is_word(other) & (alphabet != own[..., None])
                for i, j, c in np.argwhere(ok).tolist():
                    w = codes[lo + i].copy()
                    w[a + j] = alphabet[c]
                    yield lo + i, bytes(w).decode("latin-1")


def _bits_task(power: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, codes in by_length(batch.column("word").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(_sums(codes)[:, -1], power)).astype(np.int64) + 1)], ["bit"])

    return run


def bitmap(words: DataFrame, power: int) -> np.ndarray:
    """Two bits of 2^power for each word, as bytes."""
    bits = arrow_map(words.select("word"), lambda: _bits_task(power), "bit long")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    out = np.zeros(max(4096, (1 << power) // 8), np.uint8)
    for bucket, data in zip(parts["bucket"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(data, np.uint8)
    return out


def candidates(words: DataFrame, size: int) -> DataFrame:
    """word, n, near: the neighbours of every word that may be words. words: word, n (size of them)."""
    spark: SparkSession = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct()  # at most those of RUN
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint8)
    power = min(MOST_BITS, max(LEAST_BITS, (size * BITS_A_WORD).bit_length()))
    shared = spark.sparkContext.broadcast(bitmap(words, power))

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        have = shared.value

        def is_word(h: np.ndarray) -> np.ndarray:
            bit = mix(h) >> U(64 - power)
            ok = (have[bit >> U(3)] >> (bit & U(7)).astype(np.uint8) & 1).astype(bool)
            more = np.nonzero(ok)
            bit = mix(h[more] ^ _SECOND) >> U(64 - power)
            ok[more] = have[bit >> U(3)] >> (bit & U(7)).astype(np.uint8) & 1
            return ok

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words_, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for places, codes in by_length(words_):
                at, near = [], []
                for i, s in neighbours(codes, alphabet, is_word):
                    at.append(places[i])
                    near.append(s)
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([words_[i] for i in at]), pa.array(n[at]), pa.array(near)], ["word", "n", "near"])

        return run

    return arrow_map(words, make, "word string, n long, near string")


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end. Each round doubles the steps taken; forms are at least twice as frequent as
    their words, so a chain has at most the logarithm of the largest count."""
    now = stored(links.select("word", F.col("form").alias("root")), "links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        dropped(now)
        moved = then.where("moved").limit(1).count()
        now = then
        if not moved:
            return now.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n).

    form: of the near words (one inserted, deleted or replaced code point) that of largest n, ties to the smallest in code-point
    order, if it is at least times as frequent (form_n its n), else null; root: where following forms ends. Words must be
    of code points below 256 and distinct; no words give no rows."""
    with scratch():
        words = stored(words, "vocabulary")
        size = words.count()
        tried = candidates(words.repartition(F.col("word")), size)
        pairs = tried.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
        near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
        form_n = -F.col("best.less")
        chosen = form_n >= times * F.col("n")
        forms = words.join(near, "word", "left").select(
            "word", "n", F.when(chosen, F.col("best.form")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, form_n).alias("form_n")
        )
        forms = stored(forms, "forms")
        ends = roots(forms.where("form is not null"))
        out = forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return kept(stored(out, "variants"))


def spelling_digest(docs: DataFrame) -> DataFrame:
    """variants() of the vocabulary of all texts: words of at least 5 code points that occur at least 3 times."""
    return variants(vocabulary(docs))
