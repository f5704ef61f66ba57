"""De-obfuscation of text: NFKC, invisible characters, confusables, white space, case."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Zero-width and filler characters, then the bidirectional controls.
INVISIBLE = "\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u3164\uffa0" + "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
#: Cyrillic and Greek letters and the Latin letters they look like.
CONFUSABLE = "аеорсухіјѕԁһАВЕКМНОРСТУХοαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aeopcyxijsdhABEKMHOPCTYXoaeiknptuxABEZHIKMNOPTYX"
#: What Python calls white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters and punctuation that NFKC leaves alone; a text of others goes through the UDF.
_STABLE = r"\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ac}\x{ae}\x{b0}-\x{b1}\x{b6}-\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2013}\x{2014}\x{2018}-\x{201d}"


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def fold_confusables(c: Column) -> Column:
    """Only in words that mix Latin with Cyrillic or Greek letters; words of one script stay as they are. Words are set off by any white space."""
    mixed = lambda w: w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & w.rlike("[A-Za-z]")
    folded = lambda w: F.when(mixed(w), F.translate(w, CONFUSABLE, LATIN)).otherwise(w)

    def finer(piece: Column) -> Column:
        blanks = F.regexp_extract_all(piece, F.lit(f"[{SPACE}]"), F.lit(0))
        return F.array_join(F.zip_with(F.split(piece, f"[{SPACE}]", -1), blanks, lambda w, s: F.concat(folded(w), F.coalesce(s, F.lit("")))), "")

    # nearly all white space is blanks: only pieces between them that mix scripts are looked at closely
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(mixed(w), finer(w)).otherwise(w)), " ")


def collapse_space(c: Column) -> Column:
    # a single blank is passed over: nearly all of a text's white space stays as it is
    return F.trim(F.regexp_replace(c, f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+", " "))


def plain_normalized(c: Column) -> Column:
    """All steps but NFKC. Texts of plain letters hold neither invisible characters nor confusables."""
    return F.lower(collapse_space(F.when(may_change(c), fold_confusables(strip_invisible(c))).otherwise(c)))


def may_change(c: Column) -> Column:
    """Whether a text has a character beyond the plain letters and punctuation; ASCII texts show in their length."""
    return (F.octet_length(c) != F.length(c)) & c.rlike(rf"[^\x00-\x7f](?<![{_STABLE}])")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(df: DataFrame, column: str = "text") -> DataFrame:
    """``column`` in NFKC. A UDF sees every row of a projection, so texts that it cannot change are nulls to it."""
    return df.withColumn(column, F.coalesce(_nfkc(F.when(may_change(F.col(column)), F.col(column))), F.col(column)))


def normalized(df: DataFrame, column: str = "text", into: str = "norm_text") -> DataFrame:
    return nfkc(df.withColumn(into, F.col(column)), into).withColumn(into, plain_normalized(F.col(into)))
