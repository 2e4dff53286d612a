"""Text primitives as Column expressions.

Everything here stays inside the JVM. Two rules hold throughout: white space
means the Unicode White_Space property (so a line holding only a no-break space
is blank), and a line ends at ``\\n`` with at most one ``\\r`` before it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set, and the Unicode word characters, as Java character classes. They
# are spelled out because the (?U) flag would also switch case folding to rules
# that let dotless and dotted capital i match a plain i.
_SPACE_RANGES = r"\s\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = f"[{_SPACE_RANGES}]"
NON_SPACE = f"[^{_SPACE_RANGES}]"
WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\u200C\u200D]"


def utrim(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def utrim_end(text: Column) -> Column:
    """Strip Unicode white space from the end."""
    return F.rtrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return utrim(text) == ""


def present(text: Column) -> Column:
    """The trimmed text, or null when nothing is left of it."""
    return F.nullif(utrim(text), F.lit(""))


def split_lines(content: Column) -> Column:
    """Lines of a text; the line break that ends the text opens no further line."""
    length = F.char_length(content)
    body = (
        F.when(content.endswith("\r\n"), F.left(content, length - 2))
        .when(content.endswith("\n"), F.left(content, length - 1))
        .otherwise(content)
    )
    return (
        F.when(content == "", F.array().cast("array<string>"))
        .when(F.contains(content, F.lit("\r")), F.split(body, r"\r?\n", -1))
        .otherwise(F.split(body, "\n", -1))  # a single character is split without a pattern
    )


def tokens(text: Column) -> Column:
    """Runs of characters between white space."""
    return F.regexp_extract_all(text, F.lit(f"({NON_SPACE}+)"), 1)


def java_regex(pattern: str) -> str:
    """An ASCII case-insensitive Java pattern in which ``.`` stops only at ``\\n``.

    Apply it to text that went through :func:`fold_case_variants`.
    """
    return "(?id)" + pattern.replace(r"\s", SPACE).replace(r"\w", WORD)


def fold_case_variants(text: Column) -> Column:
    """Replace the two non-ASCII characters whose case folding is an ASCII letter."""
    long_s_folded = F.replace(text, F.lit("\u017f"), F.lit("s"))
    return F.replace(long_s_folded, F.lit("\u212a"), F.lit("k"))


def four_decimals(value: Column) -> Column:
    """Fixed four-decimal text, exact binary ties to the even digit.

    A double sits exactly between two four-decimal numbers only when it is an odd
    multiple of 1/32. Other values print as Java prints them.
    """
    tie = F.pmod(value * 32, F.lit(2.0)) == 1.0
    even = F.bround(value * 10000, 0) / 10000
    return F.format_string("%.4f", F.when(tie, even).otherwise(value))
