"""Digests, keyed digests and ciphers."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(x, kind: str) -> Column:
    x = _c(x).cast("binary")
    kind = kind.lower()
    if kind == "md5":
        return F.md5(x)
    if kind == "sha1":
        return F.sha1(x)
    return F.sha2(x, int(kind.removeprefix("sha")))


@F.pandas_udf(K.StringType())
def hmac(x: pd.Series, key: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or k is None else _hmac.new(k.encode(), a.encode(), getattr(hashlib, t)).hexdigest() for a, k, t in zip(x, key, kind)], dtype=object)


def encrypt(x, key, mode: str = "GCM") -> Column:
    return F.aes_encrypt(_c(x).cast("binary"), _c(key), F.lit(mode))


def decrypt(x, key, mode: str = "GCM") -> Column:
    return F.aes_decrypt(_c(x), _c(key), F.lit(mode)).cast("string")


@F.pandas_udf(K.StringType())
def crypt(password: pd.Series, salt: pd.Series) -> pd.Series:
    """A slow salted hash: PBKDF2 with 100,000 rounds."""
    make = lambda p, s: hashlib.pbkdf2_hmac("sha256", p.encode(), s.encode(), 100_000).hex()
    return pd.Series([None if p is None or s is None else make(p, s) for p, s in zip(password, salt)], dtype=object)

