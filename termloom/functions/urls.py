"""URL functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Extensions of generated pages.
SCRIPTS = ("asp", "aspx", "cgi", "do", "jsp", "jspx", "php", "pl")
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def normal_url(url: Column) -> Column:
    """Trimmed, without fragment."""
    return F.regexp_replace(F.trim(url), "(?s)#.*$", "")


def physical_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != ""))


def domain(url: Column) -> Column:
    """Authority in lower case without one leading www.; port and user stay."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 1)), r"^www\.", "")


def is_valid(url: Column) -> Column:
    """The host has two labels or more, none empty."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", ""), ":.*$", "")
    return host.rlike(r"^[^.]+(\.[^.]+)+$")


def kind(url: Column) -> Column:
    """dynamic with a query or a script's extension, else static."""
    script = F.lower(F.regexp_extract(url, PATH, 1)).rlike(rf"[^/.][^/]*\.({'|'.join(SCRIPTS)})$")
    return F.when((F.regexp_extract(url, QUERY, 1) != "") | script, "dynamic").otherwise("static")


@F.pandas_udf(StringType())
def _urljoin(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(base, ref):
        try:
            return urljoin(base, ref)
        except ValueError:
            return None

    for bases, refs in parts:
        yield pd.Series([None if b is None or r is None else one(b, r) for b, r in zip(bases, refs)], dtype=object)


def resolve(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of any reference, by Arrow batches."""
    return _urljoin(base, ref)


def resolve_rooted(base: Column, ref: Column) -> Column:
    """The same in the JVM, for absolute and root-relative references; others give null."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    absolute, rooted = ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref.startswith("/")
    return F.when(absolute, ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(rooted, F.concat(scheme, F.lit("//"), F.regexp_extract(base, AUTHORITY, 1), ref))


def is_plain(base: Column, ref: Column) -> Column:
    """Whether resolve_rooted gives what RFC 3986 does: an absolute or root-relative reference without dot segments, to an http base."""
    with_scheme, rooted = ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), ref.rlike(r"^/[^/]|^/$")
    return F.coalesce((with_scheme | rooted & base.rlike("^https?://[^/?#]")) & ~ref.rlike(r"(^|/)\.{1,2}(/|$|\?|#)|//.*//|[\[\]\s;]"), F.lit(False))
