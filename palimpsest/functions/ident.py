"""Identity of source fragments: file ids, ranges, entities and versions, as strings and as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How a range is written, by encoding: fields in order (fixed values).
RANGES = {"LC": ["sl", "sc", "el", "ec"], "O": ["so", "eo"], "LO": ["sl", "so", "el", "eo"], "LCO": ["sl", "sc", "so", "el", "ec", "eo"]}
VERSION_KINDS = ["REL", "SVNREV", "GITREV", "VARIANT", "UNKNOWN"]


def encode_range(kind: str, fields: dict[str, Column]) -> Column:
    return F.concat_ws("-", *(fields[f].cast("string") for f in RANGES[kind]))


def decode_range(kind: str, text: Column) -> Column:
    parts = F.split(text, "-")
    return F.struct(*(F.get(parts, F.lit(i)).cast("int").alias(f) for i, f in enumerate(RANGES[kind])))


def file_id(kind: str, *parts: Column) -> Column:
    """``D`` and a digest with its algorithm; or ``PVF``: project, version and path, each in hex."""
    if kind == "D":
        algorithm, value = parts
        return F.concat_ws("_", algorithm, value)
    return F.concat_ws("_", *(F.lower(F.hex(F.encode(p, "UTF-8"))) for p in parts))


def entity(encoding: str, fid: Column, range_text: Column) -> Column:
    return F.concat_ws("-", F.lit(encoding), fid, range_text)


def decode_entity(text: Column) -> Column:
    """(encoding, fid, range) of an entity's string."""
    parts = F.split(text, "-", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("encoding"), F.get(parts, F.lit(1)).alias("fid"), F.get(parts, F.lit(2)).alias("range"))


def version_key(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def contains(so: Column, eo: Column, so2: Column, eo2: Column) -> Column:
    """Whether [so, eo] holds [so2, eo2]."""
    return (so <= so2) & (eo2 <= eo)


def contains_lc(sl: Column, sc: Column, el: Column, ec: Column, sl2: Column, sc2: Column, el2: Column, ec2: Column) -> Column:
    """The same by lines and columns; columns are compared even where lines differ."""
    return (sl <= sl2) & (sc <= sc2) & (el2 <= el) & (ec2 <= ec)


def overlaps(so: Column, eo: Column, so2: Column, eo2: Column) -> Column:
    return (so <= eo2) & (so2 <= eo)


def meet(so: Column, eo: Column, so2: Column, eo2: Column) -> Column:
    """(so, eo) of what two ranges share; null if nothing."""
    a, b = F.greatest(so, so2), F.least(eo, eo2)
    return F.when(a <= b, F.struct(a.alias("so"), b.alias("eo")))
