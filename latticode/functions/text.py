"""Text columns of the papers table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_LENGTH = 150
SNIPPET_LENGTH = 280
TITLE_MARK = "Title: "
ABSTRACT_MARK = " | Abstract: "
LINK_PREFIX = "https://arxiv.org/abs/"
# Unicode white space: controls 9-13 and 28-31, next line, space separators,
# line and paragraph separators.
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
         "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def is_long_enough(text: Column, minimum: int = MIN_LENGTH) -> Column:
    """More than `minimum` characters; false or null drops the row."""
    return F.length(text) > minimum


def content(title: Column, abstract: Column) -> Column:
    """Text given to the encoder; null if either part is null."""
    return F.concat(F.lit(TITLE_MARK), title, F.lit(ABSTRACT_MARK), abstract)


def strip(text: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE))


def content_title(col: Column) -> Column:
    """Title part of a content text, trimmed, with its mark."""
    return strip(F.substring_index(col, ABSTRACT_MARK, 1))


def content_abstract(col: Column) -> Column:
    """What follows the first abstract mark, later bars included; null without one."""
    rest = F.locate(ABSTRACT_MARK, col) + len(ABSTRACT_MARK)
    return F.when(F.locate(ABSTRACT_MARK, col) > 0, strip(F.substring(col, rest, F.length(col))))


def one_line(text: Column, replacement: str = " ") -> Column:
    """Trimmed, newlines replaced."""
    return F.replace(strip(text), F.lit("\n"), F.lit(replacement))


def snippet(text: Column, length: int = SNIPPET_LENGTH) -> Column:
    """One line of at most `length` characters, cut at a word end with an ellipsis."""
    stripped = strip(F.coalesce(text, F.lit("")))
    head = F.replace(F.substring(stripped, 1, length), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(head, r" [^ ]*\z", "")
    return F.when(F.length(stripped) > length, F.concat(cut, F.lit("…"))).otherwise(head)


def link(id_col: Column) -> Column:
    return F.concat(F.lit(LINK_PREFIX), id_col.cast("string"))
