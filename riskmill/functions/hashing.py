"""Digests, keyed digests and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_BLOCK = 64


def content_hash(content: Column, fallback: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the content, or of the id when there is none."""
    return F.substring(F.sha2(F.coalesce(content, fallback), 256), 1, 16)


def hmac_sha256(body: Column, key: str | bytes) -> Column:
    """RFC 2104 keyed digest from two native SHA-256 calls.

    The key is a constant, so both pads are literals; only the body is data.
    """
    inner, outer = (F.lit(bytearray(pad)) for pad in hmac_pads(key))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hmac_pads(key: str | bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key."""
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def checkout_signature(order_id: Column, payment_id: Column, key: str) -> Column:
    return hmac_sha256(F.concat(order_id, F.lit("|"), payment_id), key)


@pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Any JSON text with sorted keys, no spaces and ASCII escapes; null for a text that is no JSON.

    Needed only for metadata of free shape; a known struct should be stored canonical at write.
    """

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return raw.map(one)


# Short escapes of JSON, by UTF-16 code unit.
_SHORT_ESCAPES = {
    "0022": '\\"',
    "005C": "\\\\",
    "0008": "\\b",
    "0009": "\\t",
    "000A": "\\n",
    "000C": "\\f",
    "000D": "\\r",
}


def json_string(value: Column) -> Column:
    """JSON string literal with ASCII escapes, or ``null``; plain text takes the short way."""

    def unit(code: Column) -> Column:
        out = F.when(
            code.between("0020", "007E"), F.char(F.conv(code, 16, 10).cast("long"))
        ).otherwise(F.concat(F.lit("\\u"), F.lower(code)))
        for name, text in _SHORT_ESCAPES.items():
            out = F.when(code == name, F.lit(text)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(value, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    escaped = F.array_join(F.transform(units, unit), "")
    body = F.when(value.rlike(r"^[ !#-\[\]-~]*$"), value).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def audit_payload(
    actor: Column, event: Column, object_type: Column, object_id: Column, metadata: Column
) -> Column:
    """Canonical JSON of an audit row; ``metadata`` is canonical JSON already."""
    return F.concat(
        F.lit('{"actor":'),
        json_string(actor),
        F.lit(',"event":'),
        json_string(event),
        F.lit(',"metadata":'),
        F.coalesce(metadata, F.lit("{}")),
        F.lit(',"object_id":'),
        json_string(object_id),
        F.lit(',"object_type":'),
        json_string(object_type),
        F.lit("}"),
    )


def request_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
