"""Term weights as column functions: SMART tf, df and length codes, BM25."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a scheme, a letter each for tf, df and norm. Byte-size norm raises the length to this power.
TF_CODES, DF_CODES, NORM_CODES = "nlabL", "ntp", "ncub"
BYTE_POWER = 0.75
K1, B = 1.5, 0.75


def check_scheme(scheme: str) -> str:
    """Schemes are three letters; all are validated before anything is built."""
    if len(scheme) != 3 or scheme[0] not in TF_CODES or scheme[1] not in DF_CODES or scheme[2] not in NORM_CODES:
        raise ValueError(f"unknown scheme {scheme!r}: one of {TF_CODES}, one of {DF_CODES}, one of {NORM_CODES}")
    return scheme


def norm_name(tf: str, df: str) -> str:
    """The column that holds a document's cosine norm under these codes (names of columns know no case)."""
    return f"norm_{'log_over_mean' if tf == 'L' else tf}_{df}"


def tf_weight(code: str, tf: Column, max_tf: Column, avg_tf: Column) -> Column:
    tf = tf.cast("double")
    log = F.lit(1.0) + F.log10(tf)
    some = {
        "n": tf,
        "l": log,
        "a": F.lit(0.5) + F.lit(0.5) * tf / F.greatest(max_tf.cast("double"), F.lit(1.0)),
        "b": F.lit(1.0),
        "L": log / (F.lit(1.0) + F.log10(avg_tf)),
    }[code]
    return F.when(tf > 0, some).otherwise(0.0)


def df_weight(code: str, df: Column, n: Column) -> Column:
    """0 for terms that aren't in the collection, and where the odds against a term aren't above 1."""
    n, df = n.cast("double"), df.cast("double")
    if code == "n":
        return F.lit(1.0)
    if code == "t":
        return F.when(df > 0, F.log10(n / df)).otherwise(0.0)
    return F.when((df > 0) & (n - df > df), F.log10((n - df) / df)).otherwise(0.0)


def bm25_idf(df: Column, n: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a document's tf and length make of the idf."""
    tf, dl = tf.cast("double"), dl.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    return bm25_idf(df, n) * bm25_saturation(tf, dl, avgdl)
