"""T1, T6-T8 text helpers as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# - tokens: runs of 2+ letters, digits or underscore, lower-cased (the public
#   default token pattern of the TF-IDF vectorizer the reference uses)
# - white space removed by str.strip(): Unicode separators (Z*), \t \n \x0b \x0c
#   \r, \x1c-\x1f and \x85
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
OPEN_TAG = "<explanation>"
CLOSE_TAG = "</explanation>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def tokens(c) -> Column:
    """Lower-cased word tokens (array<string>)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def ngrams_1_2(tok) -> Column:
    """Unigrams followed by bigrams of adjacent tokens.

    Bigrams come from zipping two shifted slices, so the token array is
    referenced a fixed number of times (never inside a per-element lambda,
    which would re-evaluate the tokenizer for every element)."""
    t = _c(tok)
    n = F.size(t) - 1
    bi = F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) > 1, F.concat(t, bi)).otherwise(t)


def tag_extract(c) -> Column:
    """Text between the explanation tags, stripped. No opening tag -> the
    whole text; no closing tag -> to the end; a closing tag before the
    opening one -> empty."""
    t = _c(c)
    s = F.instr(t, OPEN_TAG)
    start = s + F.lit(len(OPEN_TAG))
    e = F.instr(t, CLOSE_TAG)
    end = F.when(e > 0, e).otherwise(F.length(t) + 1)
    inner = F.when(end > start, t.substr(start, end - start)).otherwise(F.lit(""))
    return py_strip(F.when(s > 0, inner).otherwise(t))


def pattern_position(arr, left, mid, right) -> Column:
    """First 0-based interior position p with arr[p-1]=left, arr[p]=mid,
    arr[p+1]=right; null when absent. Built from three shifted slices joined
    with a control character, so no per-element lambda re-reads ``arr``."""
    a = F.transform(_c(arr), lambda x: x.cast("string"))
    n = F.size(a) - 2
    sep = F.lit("\u0001")
    tri = F.zip_with(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: F.concat(x, sep, y)),
                     F.slice(a, 3, n), lambda xy, z: F.concat(xy, sep, z))
    key = F.concat(F.lit(str(left)) if not isinstance(left, Column) else left.cast("string"), sep,
                   F.lit(str(mid)) if not isinstance(mid, Column) else mid.cast("string"), sep,
                   F.lit(str(right)) if not isinstance(right, Column) else right.cast("string"))
    pos = F.array_position(tri, key).cast("int")
    return F.when((F.size(a) >= 3) & (pos > 0), pos)
