"""String functions with the semantics of graph queries, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def before(c: Column | str, mark: str) -> Column:
    """What is in front of the first ``mark``; empty if there is none."""
    c = _c(c)
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).when(c.isNotNull(), "")


def after(c: Column | str, mark: str) -> Column:
    """What is behind the first ``mark``; empty if there is none."""
    c = _c(c)
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).when(c.isNotNull(), "")


def cut_ends(c: Column | str) -> Column:
    """A substring from place 0 that is one shorter than the text: place 0 lies before it, so two characters go."""
    c = _c(c)
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - 2, F.lit(0)))


def escape_literal(c: Column | str) -> Column:
    """Escapes of a literal in a line-based triple file."""
    out = F.replace(_c(c), F.lit("\\"), F.lit("\\\\"))
    for raw, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


#: A code point outside of all texts (private use).
_STAND_IN = "\ue000"


def unescape_literal(c: Column | str) -> Column:
    """The opposite; the stand-in takes the backslash's place meanwhile."""
    out = F.replace(_c(c), F.lit("\\\\"), F.lit(_STAND_IN))
    for raw, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(name), F.lit(raw))
    return F.replace(out, F.lit(_STAND_IN), F.lit("\\"))


def escape_xml(c: Column | str) -> Column:
    out = _c(c)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def local_name(c: Column | str) -> Column:
    """The last part of an ``http://`` name, behind ``#`` or ``/``; other names stay."""
    c = _c(c)
    return F.when(c.startswith("http://"), F.regexp_extract(c, r"([^/#]*)$", 1)).otherwise(c)


def prefixed(c: Column | str, prefixes: dict[str, str]) -> Column:
    """``prefix:rest`` for names in a known space."""
    c = _c(c)
    out = c
    for prefix, space in prefixes.items():
        out = F.when(c.startswith(space), F.concat(F.lit(f"{prefix}:"), F.substring(c, F.lit(len(space) + 1), F.length(c)))).otherwise(out)
    return out


def name_space(c: Column | str) -> Column:
    """A name up to and with its last ``#`` or ``/``."""
    return F.regexp_extract(_c(c), r"^(.*[/#])[^/#]*$", 1)


def hexed(c: Column | str) -> Column:
    """Two lower-case hex digits a byte."""
    return F.lower(F.hex(F.encode(_c(c), "UTF-8")))


def unhexed(c: Column | str) -> Column:
    return F.decode(F.unhex(_c(c)), "UTF-8")


def digest(c: Column | str, how: str) -> Column:
    """Digest of a content by name: MD5, SHA1, SHA224, SHA256, SHA384, SHA512, or GIT (of a blob)."""
    c = _c(c)
    if how == "MD5":
        return F.md5(c.cast("binary"))
    if how == "SHA1":
        return F.sha1(c.cast("binary"))
    if how == "GIT":
        size = F.octet_length(c).cast("string")
        return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), size), "UTF-8"), F.unhex(F.lit("00")), c.cast("binary")))
    if how.startswith("SHA"):
        return F.sha2(c.cast("binary"), int(how[3:]))
    raise ValueError(f"no digest {how}")


def title(c: Column | str) -> Column:
    """A file name as a title: underscores and dashes become blanks, words get capitals."""
    return F.initcap(F.translate(_c(c), "_-", "  "))


def local_time(seconds: Column | str, offset_minutes: Column | str) -> Column:
    """Seconds since 1970 and an offset to the text of the local time."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")  # no session time zone takes part
    return F.date_format(F.timestamp_add("SECOND", _c(seconds) + _c(offset_minutes) * 60, start), "yyyy-MM-dd HH:mm:ss")


def group_key(c: Column | str) -> Column:
    """Parts of ``a/b;c`` in one order: split at ``/`` and ``;``, sorted, joined by ``;``."""
    return F.array_join(F.array_sort(F.split(_c(c), "[/;]")), ";")


def path_parts(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), "/"), lambda x: x != "")


def path_parent(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^(.*)/[^/]*$", 1)


def is_path_prefix(a: Column | str, b: Column | str) -> Column:
    """Whether path a is b or lies above it."""
    a, b = _c(a), _c(b)
    return (a == b) | b.startswith(F.concat(a, F.lit("/")))


def path_key(c: Column | str) -> Column:
    """Paths that differ in case, or in ``-`` and ``/``, are the same."""
    return F.replace(F.lower(_c(c)), F.lit("-"), F.lit("/"))
