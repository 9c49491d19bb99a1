"""Predicates and scalar functions over text, as Columns of built-in functions; Arrow UDFs where Unicode forms are needed."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .arrow import by_row


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


# --- characters -------------------------------------------------------------------------------


@by_row(T.StringType())
def nfkc(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFKC", s)


@by_row(T.StringType())
def unaccented(s: str | None) -> str | None:
    """Without combining marks, after compatibility decomposition."""
    if s is None or s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@by_row(T.StringType())
def casefolded(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFKC", s).casefold()


def spaced(c: Column | str) -> Column:
    """Runs of white space become one blank; trimmed."""
    # A blank that stands alone is left as it is.
    return F.btrim(F.regexp_replace(col(c), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def unified(c: Column | str) -> Column:
    """Exotic blanks, quotes and dashes become plain ones. Comma and blank stay as they are."""
    was = fixed.EXOTIC_BLANKS + fixed.SINGLE_QUOTES + fixed.DOUBLE_QUOTES + fixed.DASHES
    now = " " * len(fixed.EXOTIC_BLANKS) + "'" * len(fixed.SINGLE_QUOTES) + '"' * len(fixed.DOUBLE_QUOTES) + "-" * len(fixed.DASHES)
    return F.translate(col(c), was, now)


def normalized(c: Column | str) -> Column:
    return nfkc(unified(c))


def cleaned(c: Column | str) -> Column:
    """Without direction marks and other invisible characters, composed, single blanks, trimmed."""
    c = nfkc(F.translate(col(c), fixed.INVISIBLE, ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "[  -     　]", " "), " {2,}", " "))


def for_model(c: Column | str) -> Column:
    """Decomposed without marks, curly quotes straight: the form that a text model reads."""
    return F.translate(unaccented(col(c)), fixed.SINGLE_QUOTES + fixed.DOUBLE_QUOTES, "'" * len(fixed.SINGLE_QUOTES) + '"' * len(fixed.DOUBLE_QUOTES))


def valid_utf8(c: Column | str) -> Column:
    """Lone surrogates cannot occur in Spark strings; invalid bytes become the replacement character."""
    return F.make_valid_utf8(col(c))


def right_to_left_marked(c: Column | str) -> Column:
    """Runs of Hebrew or Arabic words between embedding marks."""
    return F.regexp_replace(col(c), r"([\p{InHebrew}\p{InArabic}]+(?:\s+[\p{InHebrew}\p{InArabic}]+)*)", "‫$1‬")


def alphanumeric(c: Column | str) -> Column:
    """ASCII letters and digits and single blanks, lower-cased."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(col(c), r"[^a-zA-Z0-9\s]", ""), r"\s+", " ")))


def without_markdown(c: Column | str) -> Column:
    c = F.regexp_replace(F.regexp_replace(col(c), r"\*\*([^*]+)\*\*", "$1"), "__([^_]+)__", "$1")
    return F.btrim(F.regexp_replace(c, r"(?m)^\s{0,3}#{1,6}\s+", ""), F.lit(" \n\t\r"))


# --- tokens -----------------------------------------------------------------------------------


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def ascii_tokens(c: Column | str) -> Column:
    """Lower-case ASCII runs after accents are taken off."""
    return F.regexp_extract_all(F.lower(unaccented(F.coalesce(col(c), F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))


def letter_words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"\p{L}{2,}"), F.lit(0))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def counted(c: Column, pattern: str) -> Column:
    """How often the pattern is met."""
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def n_words(c: Column | str) -> Column:
    """size(words(c)), without an array of words that a lambda goes through."""
    return counted(col(c), r"(?U)\S+")


def core_size(c: Column, around: str) -> Column:
    """Characters of c without those of `around` at both ends: whether it can be one of a list of short values is told by this before a pattern reads all of it."""
    return F.length(F.btrim(c, F.lit(around)))


def gram_keys(toks: Column, n: int) -> Column:
    """A 64-bit key of each n-gram of tokens, in order and with repeats; none if there are fewer tokens. For comparisons within a document,
    where two n-grams share a key with a chance of 1e-9 even at 200,000 words."""
    # The array of one element binds the tokens, so that they are made once and not for each n-gram.
    one = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(toks), one))


def numerals(c: Column | str) -> Column:
    """Distinct numbers, with the integer part of those that have a point."""
    found = F.regexp_extract_all(col(c), F.lit(r"\d+\.?\d*"), F.lit(0))
    return F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: F.contains(x, F.lit("."))), lambda x: F.split_part(x, F.lit("."), F.lit(1)))))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of a that are in b."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.lit(0.0))


# --- predicates -------------------------------------------------------------------------------


def is_placeholder(c: Column | str) -> Column:
    v = F.btrim(F.regexp_replace(F.lower(F.btrim(col(c))), "[.…]+$", ""))
    short = (core_size(col(c), " .…") <= max(map(len, fixed.PLACEHOLDERS))) | (F.lower(F.substring(F.btrim(col(c)), 1, 7)) == "keyword")
    # What AND joins may be computed ahead where it occurs twice; what WHEN guards is not.
    return F.coalesce(F.when(short, one_of(v, fixed.PLACEHOLDERS) | v.rlike(r"^keyword\s*\d*$")), F.lit(False))


def is_placeholder_person(name: Column, given: Column, family: Column) -> Column:
    """All name fields that are present are template names, and some is present."""
    keys = F.transform(F.filter(F.array(name, given, family), lambda x: x.isNotNull() & (F.btrim(x) != "")), lambda x: F.regexp_replace(F.lower(x), "[^a-z,]", ""))
    return (F.size(keys) > 0) & F.forall(keys, lambda k: one_of(k, fixed.PLACEHOLDER_NAMES))


def without_placeholder_affiliations(names: Column) -> Column:
    return F.filter(names, lambda a: ~is_placeholder(a))


def is_section_label(c: Column | str) -> Column:
    """Nothing but section words, 45 characters at most."""
    t = F.lower(F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[#*•:/\\-–—]", " ")))
    toks = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    short = core_size(F.coalesce(col(c), F.lit("")), " #*•:/-–—") <= 45  # lower case is never shorter
    return F.when(short, (F.length(t) <= 45) & (F.size(toks) > 0) & F.forall(toks, lambda w: one_of(w, fixed.SECTION_LABELS))).otherwise(F.lit(False))


def is_section_keyword(c: Column | str) -> Column:
    short = core_size(col(c), " :.\t\n\x0b\f\r") <= max(map(len, fixed.SECTION_KEYWORDS))
    return short & one_of(F.lower(F.btrim(F.regexp_replace(F.btrim(col(c)), r"[:.\s]+$", ""))), fixed.SECTION_KEYWORDS)


def is_bare_label(c: Column | str) -> Column:
    t = F.btrim(col(c), F.lit(" \n\t\r"))
    return (F.length(t) <= 60) & t.rlike(r"^[A-Za-z][A-Za-z0-9&,'()/\- ]{0,58}:$")


def looks_like_header(c: Column | str) -> Column:
    """One to eight words, 60 characters at most, begins with a capital or digit, no sentence, no caption."""
    t = col(c)
    n = n_words(t)
    return (F.length(t) <= 60) & (n >= 1) & (n <= 8) & t.rlike(r"^[\p{Lu}\p{Nd}]") & ~t.rlike(r"[.,;]$") & ~t.rlike(r"(?i)^(?:fig(?:ure)?|table|tab)\.?\s*\d")


def looks_like_sentence(c: Column | str, least: int = 6) -> Column:
    t = col(c)
    size = F.greatest(F.length(F.replace(t, F.lit(" "), F.lit(""))), F.lit(1))
    # The array of one element binds the words, so that they are found once.
    enough = F.exists(F.array(letter_words(t)), lambda a: (F.size(a) >= max(least - 1, 2)) & (F.length(F.array_join(a, "")) / size >= 0.6))
    # A word of a-z tells it nearly always; without one, single words are looked at where some letter has a capital.
    lower = t.rlike(r"(?<!\p{L})[a-z]{2,}(?!\p{L})") | ((t != F.upper(t)) & F.exists(letter_words(t), lambda w: (w == F.lower(w)) & (w != F.upper(w))))
    address = (F.contains(t, F.lit("@")) | F.contains(t, F.lit("://")) | F.contains(t, F.lit("www."))) & t.rlike(r"@\S+\.\S+|https?://|www\.")
    return (n_words(t) >= least) & lower & ~address & enough


def is_author_line(c: Column | str) -> Column:
    """Heavy in digits, commas, initials or capitalised names."""
    t = col(c)
    # Each pattern begins where a word begins, so a line is read once for each, not word by word, and only where there are enough of its signs.
    word = lambda p: rf"(?U)(?<!\S)(?:{p})"
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    signs, digits = counted(t, r"[0123456789*†‡§¶,]+"), counted(t, word(r"[^\s0-9]*+[0-9]|[*†‡§¶,]++(?!\S)"))
    seps, initials = counted(t, word(r"(?:[,&;]|and)(?!\S)")), counted(t, word(r"(?:[A-Z]\.)++,?(?!\S)"))
    names = ~t.rlike(word(r"(?!and(?!\S))[\p{L}&&[^\p{Lu}]]"))

    def rules(n: Column) -> Column:
        listed = ((commas >= 3) & (commas / n > 0.3)) | ((commas >= 2) & (commas / n >= 0.15) & names)
        return F.when(n == 0, True).otherwise(listed | ((signs / n > 0.25) & (digits / n > 0.25)) | (t.rlike(r"[A-Z]\.") & (initials >= 2) & ((initials + seps) / n >= 0.3)))

    # The array of one element binds the number of words, so that they are counted once.
    return F.exists(F.array(n_words(t)), rules)


def is_rights_junk(c: Column | str) -> Column:
    t = F.btrim(F.coalesce(col(c), F.lit("")))
    begins, within = ("|".join(f"(?:{p})" for p in fixed.RIGHTS_JUNK if p.startswith("^") == at) for at in (True, False))
    low = F.lower(t)
    marked = reduce(Column.__or__, (F.contains(low, F.lit(m)) for m in fixed.JUNK_MARKS))
    return (t == "") | (F.length(t) > 200) | t.rlike(f"(?i)^(?:{begins})") | (marked & t.rlike(f"(?i){within}"))


def ran_into_body(c: Column | str) -> Column:
    """An affiliation that goes on as running text: over 180 characters, or five words of one case in a row."""
    return (F.length(col(c)) > 180) | col(c).rlike(r"(?<![\p{L}\p{N}_])[a-zà-ÿ]{2,}(?:\s+[a-zà-ÿ]{2,}){4,}(?![\p{L}\p{N}_])") | col(c).rlike(r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?:\s+[A-Z]{2,}){4,}(?![\p{L}\p{N}_])")


def affiliation_like(c: Column | str) -> Column:
    """No bullet or quote, 24 words at most, no words of a sentence."""
    t = col(c)
    return ~t.rlike("^[•▪●\\-–*\"“]") & (n_words(t) <= 24) & ~t.rlike(r"(?i)\b(?:we|our|this|these|was|were|is|are|have|has|that|which)\b")


def is_rotated(upright: Column, matrix: Column) -> Column:
    return ~F.coalesce(upright, F.lit(True)) | (F.abs(F.coalesce(matrix[1], F.lit(0.0))) > F.abs(F.coalesce(matrix[0], F.lit(1.0))))


def is_numeric_token(c: Column | str) -> Column:
    letters = F.length(F.regexp_replace(col(c), r"\P{L}", ""))
    return col(c).rlike(r"\d") & (letters <= F.greatest(F.lit(1), F.floor(F.length(col(c)) / 3)))


def is_bold(font: Column | str) -> Column:
    return F.coalesce(F.lower(col(font)).rlike("bold|black|heavy|-[^-]*(?:bd|demi)[^-]*$"), F.lit(False))


def is_italic(font: Column | str) -> Column:
    return F.coalesce(F.lower(col(font)).rlike("italic|oblique|-[^-]*it[^-]*$"), F.lit(False))


# --- labels of captions -----------------------------------------------------------------------

LABEL = r"(?i)^[^\p{L}\p{N}_]*(fig(?:ure)?s?|tab(?:le)?s?)\.?\s*(?:(S?\d+[A-Za-z]?|[IVX]{1,4})\b(\s*[.:|–—-])?|(\s*[.:|]))"


def caption_label(c: Column | str) -> Column:
    """kind, num, has_sep and end (characters of the label) of a leading "Figure 2." or "Table 1 |"; null without one."""
    t = F.coalesce(col(c), F.lit(""))
    word = F.lower(F.regexp_extract(t, LABEL, 1))
    got = F.struct(F.when(word.startswith("tab"), "table").otherwise("figure").alias("kind"), F.nullif(F.regexp_extract(t, LABEL, 2), F.lit("")).alias("num"), ((F.regexp_extract(t, LABEL, 3) != "") | (F.regexp_extract(t, LABEL, 4) != "")).alias("has_sep"), F.length(F.regexp_extract(t, LABEL, 0)).alias("end"))
    return F.when(word != "", got)


def without_label(c: Column | str) -> Column:
    lab = caption_label(c)
    return F.btrim(F.when(F.coalesce(lab["has_sep"], F.lit(False)), F.substr(col(c), lab["end"] + 1)).otherwise(col(c)))


# --- keys -------------------------------------------------------------------------------------


def alnum_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def letters_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z]", "")


def integers_key(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def query_key(c: Column | str) -> Column:
    return F.lower(spaced(nfkc(col(c))))


def match_key(c: Column | str) -> Column:
    return F.lower(spaced(unaccented(col(c))))


def subject_value(c: Column | str) -> Column:
    return spaced(nfkc(col(c)))


def award_number(c: Column | str) -> Column:
    """Without punctuation around it, upper case; null if nothing is left."""
    return F.nullif(F.upper(F.btrim(spaced(nfkc(col(c))), F.lit(" .,;:()[]{}\"'"))), F.lit(""))


def without_country(c: Column | str) -> Column:
    """Without the part after the last comma if that has one to three words and no digit; else null."""
    tail = F.btrim(F.element_at(F.split(col(c), ","), -1))
    base = F.btrim(F.regexp_replace(col(c), ",[^,]*$", ""))
    ok = F.contains(col(c), F.lit(",")) & (tail != "") & (base != "") & (F.size(words(tail)) <= 3) & ~tail.rlike(r"\d")
    return F.when(ok, base)


def address_tail(c: Column | str) -> Column:
    """Empty, or at most four parts of at most 30 characters without a word of an institution."""
    parts = F.filter(F.transform(F.split(col(c), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return (col(c) == "") | (~col(c).rlike(fixed.INSTITUTION) & (F.size(parts) <= 4) & F.forall(parts, lambda x: F.length(x) <= 30))


def title_case_like(candidate: Column, model: Column) -> Column:
    """An all-capitals candidate takes the word forms of the model's title, else capitalised words."""
    strip = lambda w: F.btrim(F.lower(w), F.lit(".,:;()"))
    known = words(model)
    form = lambda w: F.coalesce(F.try_element_at(F.filter(known, lambda k: strip(k) == strip(w)), F.lit(-1)), F.when(F.length(w) > 1, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(w))
    capitals = candidate.rlike(r"\p{L}") & ~candidate.rlike(r"\p{Ll}")
    return F.when(capitals, F.array_join(F.transform(words(candidate), lambda w: form(w)), " ")).otherwise(candidate)


def markers(c: Column | str) -> Column:
    """"1-3,6" to ["1","2","3","6"]; a range is expanded if it ascends by at most 15, else both ends stand."""
    part = lambda p: F.when(p.rlike(r"^\d+-\d+$"), F.when((F.split_part(p, F.lit("-"), F.lit(2)).cast("int") - F.split_part(p, F.lit("-"), F.lit(1)).cast("int")).between(0, 15), F.transform(F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.greatest(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.least(F.split_part(p, F.lit("-"), F.lit(2)).cast("int"), F.split_part(p, F.lit("-"), F.lit(1)).cast("int") + 15))), lambda i: i.cast("string"))).otherwise(F.split(p, "-"))).otherwise(F.array(p))
    plain = F.translate(col(c), "⁰¹²³⁴⁵⁶⁷⁸⁹–", "0123456789-")
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(plain, r"[,;\s]+"), lambda p: p != ""), part)))
