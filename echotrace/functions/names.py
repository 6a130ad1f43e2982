"""File names, local paths and other small parsers of message parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotrace.functions.text import positive_int, strip

#: fixed value: names beyond this length are replaced by their hash
LONGEST_NAME = 512
_SCHEME = r"(?i)\A[a-z][a-z0-9+.-]*:"


def unquoted(text: Column) -> Column:
    """Percent escapes undone (a plus stays a plus); text with broken escapes as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def file_name(value: Column) -> Column:
    """The lower-case file name of a path, URI or file reference, without query and escapes; empty for inline data."""
    text = strip(F.coalesce(value, F.lit("")))
    no_scheme = F.regexp_replace(text, _SCHEME, "")
    path = F.when(text.rlike(_SCHEME), F.regexp_extract(no_scheme, r"(?s)\A(?://[^/?#]*)?([^?#]*)", 1)).otherwise(F.substring_index(text, "?", 1))
    name = F.lower(strip(F.regexp_extract(unquoted(path), r"(?s)([^\\/]*)\z", 1)))
    name = F.when(F.length(name) > LONGEST_NAME, F.concat(F.lit("sha256-"), F.sha2(name, 256))).otherwise(name)
    return F.when(text.rlike(r"\A(?:base64://|data:)"), "").otherwise(name)


def local_path(source: Column) -> Column:
    """The path of a local file: absolute paths, file URIs, and anything without a scheme; else null."""
    parts = lambda k: F.regexp_extract(source, r"(?is)\Afile:(?://([^/?#]*))?([^?#]*)", k)
    by_uri = F.concat(F.when(parts(1) != "", F.concat(F.lit("//"), parts(1))).otherwise(""), unquoted(parts(2)))
    out = F.when(source.startswith("/"), source).when(source.rlike(r"(?i)\Afile:"), by_uri).when(~source.rlike(_SCHEME), source)
    return F.when(F.coalesce(source, F.lit("")) != "", out)


def metadata_hash(name: Column, size: Column) -> Column:
    """A hash of a file's name and size; null without either."""
    return F.when((F.coalesce(name, F.lit("")) != "") & (size > 0), F.sha2(F.concat(name, F.lit("\n"), size.cast("string")), 256))


def declared_size(*sizes: Column) -> Column:
    """The first given size, as a whole number above 0; null otherwise.  Sizes may come as text."""
    given = [F.when(~F.coalesce(s.cast("string"), F.lit("")).isin("", "0"), s.cast("string")) for s in sizes]
    return positive_int(F.coalesce(*given))


def cached_at(file: Column) -> Column:
    """When a cached image was stored, from its name ``YYYYmmdd_HHMMSS_...``; else null."""
    stamp = F.regexp_extract(F.regexp_extract(file, r"([^/\\]*)\z", 1), r"\A(\d{8}_\d{6})_", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def expired_files(files: Column, now: Column, days: int) -> Column:
    """Whether a cached file is older than ``days`` days; files without a time in their names stay."""
    return F.coalesce(cached_at(files) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
