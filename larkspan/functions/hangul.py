"""Korean syllables: integer arithmetic on code points, particles, lyrics to syllables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col

# Fixed values of Unicode: the first syllable, and how many medials and finals follow each initial and medial.
FIRST, LAST, MEDIALS, FINALS = 0xAC00, 0xD7A3, 21, 28


def is_syllable(ch: Column | str) -> Column:
    code = F.ascii(col(ch))
    return (code >= FIRST) & (code <= LAST)


def decompose(ch: Column | str) -> Column:
    """Struct of the indices of initial, medial and final (0: none); NULL for other characters."""
    n = F.ascii(col(ch)) - FIRST
    part = F.struct(F.floor(n / (MEDIALS * FINALS)).cast("int").alias("initial"), F.floor(n % (MEDIALS * FINALS) / FINALS).cast("int").alias("medial"), (n % FINALS).cast("int").alias("final"))
    return F.when(is_syllable(ch), part)


def has_final(word: Column | str) -> Column:
    return F.coalesce(decompose(F.right(col(word), F.lit(1)))["final"] > 0, F.lit(False))


def with_particle(word: Column | str, after_final: str, after_vowel: str) -> Column:
    """The word and the form of a particle that its last sound asks for."""
    return F.concat(col(word), F.when(has_final(word), after_final).otherwise(after_vowel))


def nfc(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(col(text))


def syllables(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, syllable, word_initial: the Korean syllables of a text; everything else only parts words at blanks."""
    chars = F.filter(F.split(nfc(text), ""), lambda c: c != "")
    rows = df.select(*keys, F.posexplode(chars).alias("_at", "ch"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("_at")
    blank = F.trim("ch") == ""
    rows = rows.withColumn("_word", F.sum(blank.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(is_syllable("ch"))
    first = F.row_number().over(Window.partitionBy(*keys, "_word").orderBy("_at")) == 1
    return rows.select(*keys, (F.row_number().over(w) - 1).alias("pos"), F.col("ch").alias("syllable"), first.alias("word_initial"))
