"""Text standardization as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.columns import as_column

# Put between a separator and the letter or digit after it, so that initcap sees
# the start of a word, and removed again afterwards. The mark's own character is
# always followed by a second one, so an input that holds the mark survives.
_MARK = "\u0001 "
_SEPARATOR = r"[^\p{L}\p{N} ]"
_BEFORE_WORD = rf"(\u0001|{_SEPARATOR}(?=[\p{{L}}\p{{N}}]))"

# A dotted I or a last sigma is lowered like any other letter, one to one.
_LOWER_FIRST = (("İ", "i"), ("Σ", "σ"))
# Fixed value: the letters that stand for two and have a title form between small and capital.
_TWO_LETTERS = "\u01c4\u01c5\u01c6\u01c7\u01c8\u01c9\u01ca\u01cb\u01cc\u01f1\u01f2\u01f3"


def _swap(c: Column, old: str, new: str) -> Column:
    # A byte search; translate() would look up every character.
    return F.replace(c, F.lit(old), F.lit(new))


def _prepared(c: Column) -> Column:
    for old, new in _LOWER_FIRST:
        c = _swap(c, old, new)
    return c


def _capital(letter: Column) -> Column:
    """The capital of one character; the character itself where that takes several."""
    return F.when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(letter)


def clean_lower(c: Column | str) -> Column:
    """Lower case without leading and trailing spaces; tabs and newlines stay."""
    return F.lower(_prepared(F.trim(as_column(c))))


def clean_upper(c: Column | str) -> Column:
    """Upper case without leading and trailing spaces; tabs and newlines stay.

    Each character becomes one character. Capitals are never fewer characters than
    the text, so equal lengths mean that none became several.
    """
    text = F.trim(as_column(c))
    upper = F.upper(text)
    one_by_one = F.array_join(F.transform(F.split(text, ""), _capital), "")
    return F.when(F.length(upper) == F.length(text), upper).when(text.isNotNull(), one_by_one)


def initcap_words(c: Column | str) -> Column:
    """Capitalize each run of letters and digits: ``d'ávila`` becomes ``D'Ávila``.

    The built-in initcap starts words at spaces only, so a mark is put after each other
    separator, and a mark is taken out again. Where a word
    begins with a character whose capital is several, or that is a capital or title
    form which initcap would change, the words are taken one by one.
    """
    c = as_column(c)
    marked = F.regexp_replace(_prepared(c), _BEFORE_WORD, f"$1{_MARK}")
    capitalized = F.initcap(marked)
    special = F.length(capitalized) != F.length(marked)
    for letter in ("İ", *_TWO_LETTERS):
        special = special | c.contains(letter)
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    one_by_one = F.array_join(
        F.transform(
            words, lambda w: F.concat(_capital(F.left(w, F.lit(1))), F.lower(_prepared(F.substring(w, 2, 2**31 - 1))))
        ),
        "",
    )
    # One of the two parts is empty. What is computed in a branch only is not shared with the test for the branch, so
    # the usual way is no branch, and only the rare one is.
    usual = F.substring(_swap(capitalized, _MARK, ""), F.lit(1), F.when(special, 0).otherwise(2**31 - 1))
    return F.concat(usual, F.when(special, one_by_one).otherwise(F.lit("")))


def full_name(first: Column | str, last: Column | str) -> Column:
    """``first last``; null when either part is null."""
    return F.concat(as_column(first), F.lit(" "), as_column(last))
