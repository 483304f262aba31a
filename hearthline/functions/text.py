"""Labels, templates and text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is split into words.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(c: Column) -> Column:
    """Without white space at both ends; text that starts and ends with plain characters is taken as it is."""
    plain = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(SPACES)))


def label(c: Column) -> Column:
    """Trimmed upper case, `-` and `/` as spaces, double spaces halved in one pass."""
    spaced = F.upper(stripped(c))
    for mark in ("-", "/"):
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    return F.replace(spaced, F.lit("  "), F.lit(" "))


def feature_name(labelled: Column, prefix: str = "flat_type_") -> Column:
    return F.concat(F.lit(prefix), F.replace(labelled, F.lit(" "), F.lit("_")))


def label_of_feature(name: Column, prefix: str = "flat_type_") -> Column:
    return F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit("_"), F.lit(" "))


def loose_key(c: Column) -> Column:
    """Upper case without spaces, underscores and hyphens: equal keys mean the same label."""
    return F.regexp_replace(F.upper(c), "[ _-]", "")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def mentions(text: Column, word: Column) -> Column:
    """Case-blind substring test; neither a pattern nor bound to words."""
    return F.contains(F.lower(text), F.lower(word))


def share_mentioned(text: Column, words: Column) -> Column:
    """Which part of `words` the text mentions; 1 for an empty list.

    The one-element array lowers the text once instead of once per word.
    """

    def share(lowered: Column) -> Column:
        found = F.filter(words, lambda w: F.contains(lowered, F.lower(w)))
        return F.size(found).cast("double") / F.nullif(F.size(words), F.lit(0)).cast("double")

    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.transform(F.array(F.lower(text)), share)[0])


def word_count(text: Column) -> Column:
    """Words between white space; (?U) plus the four separators makes \\s the characters of SPACES."""
    return F.regexp_count(text, F.lit("(?U)[^\\s\\x1c-\\x1f]+"))


def quoted(c: Column) -> Column:
    """A string as Python shows it inside a list."""
    plain = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    only_single = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(only_single, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def shown_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def table_cell(c: Column, keep_lines: bool = False) -> Column:
    """Safe inside a pipe table."""
    flat = c if keep_lines else F.replace(c, F.lit("\n"), F.lit(" "))
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def file_key(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))
