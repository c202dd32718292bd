"""Names, masks, keyed hashes, derived ids and buckets as Column expressions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, functions as F

#: Bytes of a SHA-256 block.
BLOCK = 64
#: Names under which ids are derived; each namespace is the version-5 UUID of its name under the OID namespace.
NAMESPACES = {kind: str(uuid.uuid5(uuid.NAMESPACE_OID, f"galleria:{kind}")) for kind in ("person", "identity", "photo", "sample", "process")}


def split_name(full: Column) -> Column:
    """first and last name: the last token is the last name, unless it is the only one."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(full, r"\s+", " ")), " "), lambda p: p != "")
    n = F.size(parts)
    first = F.when(n > 1, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), " ")).otherwise(F.array_join(parts, " "))
    last = F.when(n > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    return F.struct(first.alias("first_name"), last.alias("last_name"))


def full_name(first: Column, last: Column) -> Column:
    """Both names with a space between; nulls are left out."""
    return F.trim(F.concat_ws(" ", first, last))


def mask_tail(raw: Column, shown: int = 4) -> Column:
    """Stars but for the last characters; short values are stars only."""
    n = F.length(raw)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - shown), F.right(raw, F.lit(shown))))


def mask_hmac(digest: Column) -> Column:
    """At most 24 stars and the last eight characters."""
    return F.concat(F.repeat(F.lit("*"), F.least(F.lit(24), F.length(digest) - 8)), F.right(digest, F.lit(8)))


def hmac_sha256(message: Column, key: str) -> Column:
    """Keyed hash (hex) of a text. The padded key is constant, so only the two digests are computed for a row."""
    raw = key.encode()
    if not raw:
        raise ValueError("the key is empty")
    if len(raw) > BLOCK:
        raw = hashlib.sha256(raw).digest()
    pad = raw.ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def uuid5(name: Column, namespace: str) -> Column:
    """Version-5 UUID of a text under a namespace."""
    d = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(d, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))


def derived_id(kind: str, name: Column) -> Column:
    """The id of a person, identity, photo, sample or process by what names it."""
    return uuid5(name, NAMESPACES[kind])


def _unsigned(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def bucket_sha(person_id: Column, n: int) -> Column:
    """Bucket by the first 64 bits of the id's SHA-256."""
    if n <= 0:
        raise ValueError("the number of buckets must be positive")
    return (_unsigned(F.substring(F.sha2(person_id.cast("binary"), 256), 1, 16)) % F.lit(n)).cast("int")


def bucket_uuid(person_id: Column, n: int) -> Column:
    """Bucket by the UUID as a 128-bit number, from its two halves."""
    if n <= 0:
        raise ValueError("the number of buckets must be positive")
    digits = F.replace(person_id, F.lit("-"), F.lit(""))
    high, low = (_unsigned(F.substring(digits, i, 16)) % F.lit(n) for i in (1, 17))
    return ((high * F.lit(2**64 % n) + low) % F.lit(n)).cast("int")


def uuid7_like(now_ms: Column) -> Column:
    """Time-ordered random id: 48 bits of milliseconds, then random ones. Not deterministic."""
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    t = F.lpad(F.lower(F.hex(now_ms.cast("long"))), 12, "0")
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(r, 14, 3), F.lit("-"), F.substring(r, 17, 4), F.lit("-"), F.substring(r, 21, 12))


def display_folder(name: Column) -> Column:
    """A folder's name as shown."""
    return F.replace(F.trim(name), F.lit("_"), F.lit(" "))


def sanitize_message(message: Column) -> Column:
    """A message without paths, at most 500 characters."""
    return F.left(F.regexp_replace(message, r"[/\\][^\s]{4,}", "<path>"), F.lit(500))
