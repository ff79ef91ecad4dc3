"""Values that Spark has no function for, Arrow batches at a time; null stays null."""

from __future__ import annotations

import difflib
import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapped(run):
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(run, na_action="ignore")

    return apply


def normalised(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form: NFC, NFD, NFKC or NFKD."""
    return _mapped(lambda s: unicodedata.normalize(form, s))(text)


def canonical_json(text: Column, ascii_only: bool = False) -> Column:
    """JSON text with sorted keys and no white space; text that is no JSON gives null."""

    def run(s: str) -> str | None:
        try:
            return json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
        except ValueError:
            return None

    return _mapped(run)(text)


def blake2b(text: Column, size: int = 8) -> Column:
    """BLAKE2b of the UTF-8 bytes, ``size`` bytes as lowercase hex."""
    return _mapped(lambda s: hashlib.blake2b(s.encode(), digest_size=size).hexdigest())(text)


def commitment(salt_hex: Column, text: Column) -> Column:
    """``sha256:`` and the digest of salt and text: shows later that the text was known, and nothing before."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.unhex(salt_hex), F.encode(text, "UTF-8")), 256))


def token(payload: Column, secret: Column) -> Column:
    """The payload in URL-safe base64 without padding, a point, and a digest over payload and secret."""
    return F.concat_ws(".", F.rtrim(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/=\r\n", "-_")), F.sha2(F.concat_ws("\n", secret, payload), 256))


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, matches by longest common blocks (junk heuristics off): 1 for equal texts. Quadratic in the lengths: for sentences and lines."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(p) or pd.isna(q) else difflib.SequenceMatcher(None, p, q, False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return apply(a, b)
