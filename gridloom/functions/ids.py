"""Deterministic and scoped ids (ID-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import text

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def det_uuid(c) -> Column:
    """UUID of the first 16 bytes of the SHA-256, with version 5 and the usual variant set."""
    h = F.sha2(text(c).cast("binary"), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def is_uuid(c) -> Column:
    return F.coalesce(F.regexp_like(text(c), F.lit(UUID)), F.lit(False))


def encode_serial(package, resource, serial, package_scope: bool = False) -> Column:
    """package/resource/serial (or package/serial), the serial percent-encoded; null where a part is not valid."""
    serial = F.trim(text(serial).cast("string"))
    coded = F.regexp_replace(F.url_encode(serial), r"\+", "%20")
    good = is_uuid(package) & (F.coalesce(serial, F.lit("")) != "")
    parts = [F.lower(text(package)), coded]
    if not package_scope:
        good = good & is_uuid(resource)
        parts.insert(1, F.lower(text(resource)))
    return F.when(good, F.concat_ws("/", *parts))


def decode_serial(c) -> Column:
    """struct<serial_scope, package_uuid, resource_uuid, serial>; null for what is no scoped id."""
    p = F.split(text(c), "/")
    three = (F.size(p) == 3) & is_uuid(F.get(p, F.lit(0))) & is_uuid(F.get(p, F.lit(1)))
    two = (F.size(p) == 2) & is_uuid(F.get(p, F.lit(0)))

    def found(scope: str, resource: Column, serial: Column) -> Column:
        return F.struct(
            F.lit(scope).alias("serial_scope"), F.get(p, F.lit(0)).alias("package_uuid"), resource.alias("resource_uuid"),
            F.try_url_decode(serial).alias("serial"),
        )

    return F.when(three, found("RESOURCE", F.get(p, F.lit(1)), F.get(p, F.lit(2)))).when(
        two, found("PACKAGE", F.lit(None).cast("string"), F.get(p, F.lit(1)))
    )
