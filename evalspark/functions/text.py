"""Text normalization.

NFKC and case folding do not exist in Spark SQL. For text made of ASCII and the
Latin-1 letters the result equals ``lower`` with sharp s spelled out, so those rows
stay in the JVM; only the remaining rows go through an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python counts as white space: Unicode's white space and four separators.
_SPACE = r"\s\x1C-\x1F"
SPACE_RUN = rf"(?U)[{_SPACE}]+"
WORD_RUN = rf"(?U)[^{_SPACE}]+"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# ASCII plus the Latin-1 letters whose NFKC form is the character itself.
_PLAIN_TEXT = r"^[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*$"


@F.pandas_udf(T.StringType())
def _nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def _fold(text: Column, udf) -> Column:
    plain = text.rlike(_PLAIN_TEXT)
    in_jvm = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    # Plain rows reach the UDF as nulls, so their text is never shipped to Python.
    return F.when(plain, in_jvm).otherwise(udf(F.when(~plain, text)))


def nfkc_casefold(text: Column) -> Column:
    return _fold(text, _nfkc_casefold)


def casefold(text: Column) -> Column:
    return _fold(text, _casefold)


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at either end."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def strip(text: Column) -> Column:
    """Without white space at either end; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def normalize_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc_casefold(text), r"[^\p{L}\p{N}]+", " "))


def normalize_sql(text: Column) -> Column:
    return collapse_spaces(nfkc_casefold(text))


def normalize_sql_exact_match(text: Column) -> Column:
    """The exact-match key: as ``normalize_sql`` but without NFKC."""
    return casefold(collapse_spaces(text))
