"""How well extracted records capture a text: words, numbers, fields, ROUGE-L."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text

from .lines import lcs_length


def word_capture(reference: Column, extracted: Column) -> Column:
    """Share of the reference's distinct tokens that are in the extracted text."""
    return text.containment(text.tokens(reference), text.tokens(extracted))


def number_capture(reference: Column, extracted: Column) -> Column:
    """Share of the reference's numbers that are in the extracted text; 1 without numbers."""
    want = text.numerals(reference)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, text.numerals(extracted))) / F.size(want))


def field_proportion(reference: Column, extracted: Column) -> Column:
    return F.when(F.length(reference) > 0, F.length(extracted) / F.length(reference)).otherwise(F.lit(0.0))


def rouge_l(reference: Column, extracted: Column) -> Column:
    """F1 of the longest common subsequence of tokens."""
    a, b = text.tokens(reference), text.tokens(extracted)
    both = lcs_length(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def passed(words: Column, rouge: Column, numbers: Column, fields: Column) -> Column:
    return (words >= 0.75) & (rouge >= 0.75) & (numbers >= 0.75) & fields.between(0.5, 1.5)
