"""Text functions: keyword coding, regex extract/replace, case, keys, periods."""

from __future__ import annotations

import re

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recode import ColumnOrName, _c


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Keywords joined into one regex alternation (matching is done on lower-cased text)."""
    return "|".join(keywords)


_REGEX_META = set(".^$*+?()[]{}|\\")


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Does ``text`` contain any keyword? Literal keywords become an OR of
    substring tests (a byte search on UTF-8, exact for literals); a keyword
    with regex syntax keeps the regex alternation."""
    if all(not (set(k) & _REGEX_META) for k in keywords):
        cond = None
        for k in keywords:
            c = text.contains(k)
            cond = c if cond is None else (cond | c)
        return cond
    return text.rlike(keyword_pattern(keywords))


def code_text(c: ColumnOrName, keywords: Sequence[str]) -> Column:
    """0/1 code: does the lower-cased text contain any keyword (C11, X2)?

    A missing text is 0 (R ``grepl`` on NA is FALSE, N10). The whole text is
    scanned JVM-side inside the generated code; ``lower(text)`` is shared
    by all categories through subexpression elimination.
    """
    return F.coalesce(any_keyword(F.lower(_c(c)), keywords), F.lit(False)).cast("int")


def code_text_columns(c: ColumnOrName, categories: Mapping[str, Sequence[str]], suffix: str) -> dict[str, Column]:
    """All categories of one dictionary as ``{f"{category}_{suffix}": code}`` for one projection."""
    return {f"{name}_{suffix}": code_text(c, kws) for name, kws in categories.items()}


def extract_first(c: ColumnOrName, pattern: str) -> Column:
    """``str_extract``: first match or NULL."""
    return F.regexp_substr(_c(c), F.lit(pattern))


def remove_all(c: ColumnOrName, pattern: str) -> Column:
    return F.regexp_replace(_c(c), pattern, "")


def replace_first(c: ColumnOrName, pattern: str, replacement: str) -> Column:
    """``str_replace``: only the first match is replaced (Spark replaces all, so anchor it).

    ``replacement`` uses Java ``$n`` group syntax for groups of ``pattern``.
    """
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups
    shifted = replacement
    for i in range(groups, 0, -1):
        shifted = shifted.replace(f"${i}", f"${i + 1}")
    return F.regexp_replace(_c(c), f"(?s)^(.*?)(?-s:{pattern})", f"$1{shifted}")


def period_from_label(c: ColumnOrName) -> Column:
    """"Generación 3 (2019 - 2020)" -> "2019-2020" (C13).

    Text after the first "(" keeps its digits; a dash follows the first four.
    A parenthesis without digits gives "Otro"; no parenthesis (or NULL) gives NULL.
    """
    digits = F.regexp_replace(extract_first(c, r"\(.*"), r"\D", "")
    dashed = F.regexp_replace(digits, r"^(\d{4})", "$1-")
    return F.when(dashed == F.lit(""), F.lit("Otro")).otherwise(dashed)


def sentence_case(c: ColumnOrName) -> Column:
    """First character upper-case, rest lower-case (C14)."""
    col = _c(c)
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(col.substr(F.lit(2), F.length(col))))


def title_case(c: ColumnOrName) -> Column:
    return F.initcap(_c(c))


def paste0(*parts: ColumnOrName) -> Column:
    """R ``paste0``: a missing part prints as the literal "NA" (N11)."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("NA")) for p in parts])


def link_key(id_col: ColumnOrName, name_col: ColumnOrName, n: int = 3) -> Column:
    """id + lower-cased first ``n`` letters of the name."""
    return paste0(id_col, F.lower(F.substring(_c(name_col), 1, n)))


def keep_matching(df: DataFrame, c: str, pattern: str) -> DataFrame:
    """``filter(str_detect(c, pattern))``: rows whose text holds a match; a missing text has none."""
    return df.where(F.col(f"`{c}`").rlike(pattern))


def repair_mentor_key(c: ColumnOrName) -> Column:
    """Drop everything from the first space, then fix one known code typo."""
    return replace_first(F.regexp_replace(_c(c), " .*", ""), "5CU", "5CH")
