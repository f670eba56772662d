"""Formatting, JSON and progress arithmetic as column expressions; byte decoding as Arrow functions."""

from __future__ import annotations

import html
import itertools
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json_text(value: Column) -> Column:
    """JSON that keeps null fields and non-ASCII letters."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def format_int(n: Column) -> Column:
    """Thousands apart by a blank."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def format_seconds(s: Column) -> Column:
    """Tenths of a second up to a minute, then minutes and seconds, then hours and minutes."""
    n = F.round(s).cast("long")
    minutes = F.format_string("%d min %02d s", F.floor(n / 60), n % 60)
    hours = F.format_string("%d h %02d min", F.floor(n / 3600), F.floor(n / 60) % 60)
    return F.when(s < 60, F.format_string("%.1f s", s.cast("double"))).when(n < 3600, minutes).otherwise(hours)


def nice_step(x: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten at or over ``x``, 1 at least."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(x, F.lit(1.0)))))
    lead = x / power
    step = F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10) * power
    return F.greatest(step, F.lit(1.0)).cast("long")


def format_duration(s: Column) -> Column:
    """m:ss, from an hour on h:mm:ss, "?" if unknown."""
    n = F.floor(s).cast("long")
    h, m, sec = F.floor(n / 3600).cast("long"), (F.floor(n / 60) % 60).cast("long"), (n % 60).cast("long")
    return F.when(s.isNull() | (s < 0), "?").when(n >= 3600, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


def estimate(done: Column, queued: Column, in_progress: Column, elapsed: Column, max_pages: Column) -> Column:
    """struct(total, percent, speed, eta) of a run."""
    total = F.greatest(F.least(max_pages, done + queued + in_progress), done, F.lit(1))
    speed = F.when(elapsed > 0, done / elapsed).otherwise(0.0)
    eta = F.when(speed > 0, (total - done) / speed)
    return F.struct(total.alias("total"), (100.0 * done / total).alias("percent"), speed.cast("double").alias("speed"), eta.cast("double").alias("eta"))


def progress_line(done: Column, total: Column, speed: Column, eta: Column, width: int = 30) -> Column:
    filled = F.floor(width * done / total).cast("int")
    return F.concat(
        F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("] "),
        F.format_string("%d/%d %.0f%% %.1f/s ", done, total, (100.0 * done / total).cast("double"), speed.cast("double")), format_duration(eta),
    )


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unzipped(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """A body in pieces; gzip, known by its first bytes, is undone on the way. A broken one raises."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[k : k + piece]) for k in range(0, len(view), piece))
        return
    rest = bytes(view)
    while rest:  # gzip files may follow each other
        member, fed = zlib.decompressobj(31), rest
        while not member.eof:
            out = member.decompress(fed, piece)
            fed = member.unconsumed_tail
            if out:
                yield out
            elif not fed and not member.eof:
                raise EOFError("gzip ends early")
        rest = member.unused_data.lstrip(b"\0")


def sitemap_locations(data: bytes | None) -> tuple[str, list[str], str | None]:
    """(kind, locations, error) of a sitemap or a sitemap index; namespaces do not matter.

    The file is read in pieces and entries are forgotten when they end, so neither the
    whole text nor a tree is ever in memory. A file that breaks anywhere is an error and
    has no locations.
    """
    if not data:
        return "urlset", [], "empty or broken body"
    bare = lambda tag: tag.rsplit("}", 1)[-1].lower()
    parser, depth, root, found = ET.XMLPullParser(("start", "end")), 0, None, []
    try:
        for part in itertools.chain(unzipped(data), [None]):
            parser.feed(part) if part is not None else parser.close()
            for event, node in parser.read_events():
                if event == "start":
                    depth += 1
                    root = node if root is None else root
                    continue
                if depth == 3 and bare(node.tag) == "loc" and node.text and node.text.strip():
                    found.append(node.text.strip())
                if depth == 2:
                    root.clear()
                depth -= 1
    except (OSError, EOFError, zlib.error):
        return "urlset", [], "empty or broken body"
    except ET.ParseError as e:
        return "urlset", [], f"ParseError: {e}"
    kind = bare(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        return "urlset", [], f"ParseError: unknown root element <{kind}>"
    return kind, found, None


@F.pandas_udf(T.StructType().add("kind", "string").add("locations", T.ArrayType(T.StringType())).add("error", "string"))
def parse_sitemap(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sitemap_locations(b) for b in body], columns=["kind", "locations", "error"])


def escape(text: str) -> str:
    return html.escape(text, quote=True)
