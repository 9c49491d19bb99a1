"""Text that must be copied from a source: strings of a JSON text, copy tests of whole values, a constraint for text models."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrow import by_row

#: Fields whose values are copied word for word; titles may change case.
VERBATIM = ("title", "sectionContent", "caption")
ANY_CASE = ("title",)
# Quotes and dashes that count as one.
_SAME = str.maketrans({**dict.fromkeys("‘’‚‛“”„‟«»′″´`\"", "'"), **dict.fromkeys("‐‑‒–—―−", "-")})
_PIECE = re.compile(r'"(?P<s>(?:[^"\\]|\\.)*)(?P<end>"?)|(?P<p>[{}\[\]:,])', re.S)


def plain(text: str) -> str:
    """Without accents, quotes and dashes unified, white space collapsed."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", bare.translate(_SAME))


def source_of(raw: str) -> str:
    return plain(re.sub(r"(?m)^[ \t]*#{1,6}[ \t]+", "", raw)).strip()


def strings(text: str | None) -> list[tuple[str | None, str, bool]]:
    """(key, value, closed) of the string values in a JSON text, which may end anywhere. An incomplete escape at the end is left out."""
    out: list[tuple[str | None, str, bool]] = []
    nest: list[list] = []  # of each open container: kind, last key, whether a value is next
    held = None
    for m in _PIECE.finditer(text or ""):
        mark = m["p"]
        if mark is None:
            body = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", m["s"])
            try:
                value = json.loads(f'"{body}"', strict=False)
            except ValueError:
                value = body
            if nest and nest[-1][0] == "{" and not nest[-1][2]:
                held = value
            else:
                key = next((n[1] for n in reversed(nest) if n[0] == "{"), None)
                out.append((key, value, bool(m["end"])))
        elif mark in "{[":
            nest.append([mark, None, False])
        elif mark in "}]":
            if nest:
                nest.pop()
        elif mark == ":" and nest:
            nest[-1][1:] = [held, True]
        elif mark == "," and nest and nest[-1][0] == "{":
            nest[-1][2] = False
    return out


class Copy:
    """Whether pieces of one string go on copying a source, and do not copy more than `most` characters that it has copied before."""

    def __init__(self, source: str, any_case: bool = False, most: int = 80):
        self.text = source.lower() if any_case else source
        self.any_case, self.most = any_case, most
        self.at, self.run, self.taken = -1, 0, bytearray(len(self.text))

    def _place(self, piece: str) -> int:
        """Where the piece stands in the source: right after the last one, or at a word's start; -1 if nowhere."""
        if self.at >= 0 and self.text.startswith(piece, self.at):
            return self.at
        word = piece.lstrip(" ") if self.at < 0 or piece.startswith(" ") else None
        if not word:
            return -1
        i = self.text.find(word)
        while i > 0 and self.text[i - 1] != " ":
            i = self.text.find(word, i + 1)
        return i

    def take(self, piece: str) -> bool:
        """Takes the piece if it is allowed."""
        piece = piece.lower() if self.any_case else piece
        i = self._place(piece)
        if i < 0:
            return False
        n = len(piece) if self.at >= 0 and i == self.at else len(piece.lstrip(" "))
        again = self.run + n if n and all(self.taken[i : i + n]) else 0
        if again > self.most:
            return False
        self.at, self.run = i + n, again
        self.taken[i : i + n] = b"\1" * n
        return True


def allowed(source: str, value: str, any_case: bool = False) -> int:
    """Characters at the start of value that are copied from the source, in words."""
    state, done = Copy(source_of(source), any_case), 0
    for m in re.finditer(r"\s*\S+", value):
        if not state.take(plain(m[0])):
            break
        done = m.end()
    return done


def constraint(source: str, candidates: Callable[[str], list[str]], so_far: str, key: str) -> str | None:
    """The first candidate that goes on copying the source after so_far; None if none does, so that a model is never stuck."""
    state = Copy(source_of(source), key in ANY_CASE)
    for m in re.finditer(r"\s*\S+", so_far):
        state.take(plain(m[0]))
    return next((c for c in candidates(so_far) if state.take(plain(c))), None)


_STRINGS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("closed", T.BooleanType())]))


@by_row(_STRINGS)
def json_strings(s: str | None) -> list[dict]:
    return [{"key": k, "value": v, "closed": c} for k, v, c in strings(s)]


@by_row(T.DoubleType())
def copied_share(source: str | None, key: str | None, value: str | None) -> float:
    """Share of a value that is copied from the source before the first word that is not."""
    return allowed(source or "", value, key in ANY_CASE) / len(value) if value else 1.0


def invented(responses: DataFrame, text: str = "text", response: str = "response") -> DataFrame:
    """doc_id, pos, key, share of each verbatim string of a response."""
    rows = responses.select("doc_id", text, F.posexplode(json_strings(response)).alias("pos", "s")).where(F.col("s.key").isin(*VERBATIM))
    return rows.select("doc_id", "pos", F.col("s.key").alias("key"), copied_share(F.col(text), F.col("s.key"), F.col("s.value")).alias("share"))


def whole_copy(source: Column, value: Column) -> Column:
    """The value stands in the source as it is."""
    return F.contains(source, value)
