"""Digests and values derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


DIGESTS = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
}


def digest(value, algorithm: str = "sha256") -> Column:
    """Hex digest of a string (as UTF-8) or of bytes."""
    return DIGESTS[algorithm](_col(value))


def digests(value, algorithms=("md5", "sha1", "sha256")) -> dict[str, Column]:
    """Several digests of one column; the column is read once."""
    return {name: digest(value, name) for name in algorithms}


def same_digest(left, right) -> Column:
    return F.lower(_col(left)) == F.lower(_col(right))


def digest_kind(value) -> Column:
    """md5, sha1 or sha256 by length, else unknown."""
    size = F.length(_col(value))
    return (F.when(size == 32, "md5").when(size == 40, "sha1")
            .when(size == 64, "sha256").otherwise("unknown"))


def sha256_field(value) -> Column:
    """SHA256 of a 'K=V,K=V' text; text without the marker passes through."""
    value = _col(value)
    return F.when(value.contains("SHA256="), F.regexp_extract(value, r"SHA256=([0-9a-fA-F]{64})", 1)) \
            .otherwise(value)


def url_key(url) -> Column:
    """base64url of the URL without padding."""
    plain = F.base64(F.encode(_col(url), "UTF-8"))
    return F.rtrim(F.translate(F.regexp_replace(plain, r"[\r\n]", ""), "+/", "-_"), F.lit("="))


def stable_id(prefix: str, *cols, length: int = 8) -> Column:
    """Repeatable id from the row's own key, instead of a random one."""
    joined = F.concat_ws("\x1f", *[_col(c).cast("string") for c in cols])
    return F.concat(F.lit(prefix), F.upper(F.left(F.sha2(joined, 256), F.lit(length))))
