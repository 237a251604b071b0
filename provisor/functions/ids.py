"""Deterministic identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

URL_NAMESPACE_HEX = uuid.NAMESPACE_URL.hex


def name_uuid(prefix: str, kind: str, *parts: Column) -> Column:
    """Version-5 UUID in the URL namespace of ``prefix/kind/part/part...``."""
    path = F.concat(
        F.lit(f"{prefix}/{kind}/"),
        F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]),
    )
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(path, "UTF-8")))
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1)
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
