"""Ids and hashes that can be worked out again elsewhere."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def short_hash(length: int, *parts: Column, separator: str = " ") -> Column:
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, length)


def lead_id(source: Column, external_id: Column) -> Column:
    return short_hash(16, source, external_id)


def notice_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), short_hash(length, *parts))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def value_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.to_json(c), 256), 1, 16)


def bundle_hash(schema: str, receipts: Column) -> Column:
    """Of an array of JSON strings in order: schema, count and every receipt, each on its line."""
    lines = F.concat(F.lit(schema), F.lit("\n"), F.size(receipts).cast("string"), F.lit("\n"), F.array_join(receipts, "\n"), F.lit("\n"))
    return F.sha2(lines, 256)


def signature_holds(secret: str):
    """Pandas UDF (body, header): whether the header is sha256=HMAC of the body. Spark has no keyed hash."""

    @F.pandas_udf(T.BooleanType())
    def check(body: pd.Series, header: pd.Series) -> pd.Series:
        good = [hmac.compare_digest("sha256=" + hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest(), h or "") for b, h in zip(body, header, strict=True)]
        return pd.Series(good)

    return check
