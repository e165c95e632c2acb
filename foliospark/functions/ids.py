"""Identifiers and digests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of stable ids; a parameter, so that other catalogues get other ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/folio-catalogue")


def stable_id(kind: str, key: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """UUIDv5 of ``kind:key``; null for a null key. Built from SHA-1, Spark having no function for it."""
    name = F.concat(F.lit(f"{kind}:"), key)
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by a bar; a null part counts as an empty one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def blob_sha1(content: Column) -> Column:
    """SHA-1 of a binary as version control stores it: behind a header with its length."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8"), F.lit(b"\x00"), content))


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys, on the driver, for reports; NaN is an error."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()
