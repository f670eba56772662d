"""URL functions as column expressions; only resolving against a base needs Python."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path, parameters and query without the fragment (RFC 3986, appendix B).
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Links that are no pages, by scheme.
SKIPPED_SCHEMES = ["mailto", "tel", "javascript", "data", "about"]


def scheme_of(url: Column) -> Column:
    """Lower-cased scheme, "" if there is none."""
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def domain_of(url: Column) -> Column:
    """Lower-cased authority with port and user, "" if there is none."""
    return F.lower(F.regexp_extract(url, SPLIT, 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 4)


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority, "/" for an empty path, no fragment, no bare "?"."""
    scheme, query = scheme_of(url), query_of(url)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    host = domain_of(url)
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when((host == "") & (scheme == ""), "").otherwise(F.concat(F.lit("//"), host)),
        path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def is_page_url(url: Column) -> Column:
    """http or https with an authority."""
    return url.rlike(r"^(?i:https?)://[^/?#]+")


def href_scheme(href: Column) -> Column:
    """What stands before the first colon, lower-cased; "" without a colon."""
    return F.when(href.contains(":"), F.lower(F.split_part(href, F.lit(":"), F.lit(1)))).otherwise("")


def is_followable(href: Column) -> Column:
    """A non-empty href that is neither an anchor nor of a skipped scheme."""
    bare = collapse_ends(href)
    return (bare != "") & ~bare.startswith("#") & ~href_scheme(bare).isin(SKIPPED_SCHEMES)


def collapse_ends(text: Column) -> Column:
    """``text`` without white space at its ends (all Unicode white space)."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", "")


def collapse_spaces(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", " "))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def join_root_relative(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base`` where it is absolute or starts with one "/"; null otherwise."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.when(is_page_url(href), without_fragment(href)).when(href.rlike("^/(?!/)"), F.concat(root, without_fragment(href)))


def resolve(base: str, href: str) -> str | None:
    """RFC 3986 resolution without the fragment; None where the href cannot be parsed."""
    try:
        return urldefrag(urljoin(base, href))[0]
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """General resolution of a href (relative paths, "..", "//host") for whole Arrow batches."""
    return pd.Series([None if b is None or h is None else resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def robots_regex(pattern: Column) -> Column:
    """A robots.txt path pattern as a regular expression: "*" is anything, a last "$" the end."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|/-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))
