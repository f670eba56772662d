"""A self-contained HTML report of the statistics of a run; drawn by the driver from small results."""

from __future__ import annotations

import math
from pathlib import Path

from harrow.functions.text import escape


def fmt_int(n: float) -> str:
    return f"{n:,.0f}".replace(",", " ")


def fmt_seconds(s: float) -> str:
    n = round(s)
    return f"{s:.1f} s" if s < 60 else f"{n // 60} min {n % 60:02d} s" if n < 3600 else f"{n // 3600} h {n // 60 % 60:02d} min"


def nice_step(x: float) -> int:
    power = 10 ** math.floor(math.log10(max(x, 1)))
    return max(1, int(power * next(k for k in (1, 2, 5, 10) if k * power >= x)))


def tile(label: str, value: str) -> str:
    return f'<div class="tile"><b>{escape(value)}</b><span>{escape(label)}</span></div>'


def grid(head: list[str], rows: list[list]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{escape('' if c is None else str(c))}</td>" for c in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{cells}</table>"


def bars(items: list[tuple[str, int]]) -> str:
    most = max([1, *(n for _, n in items)])
    return "".join(f'<div class="bar"><span>{escape(str(k))}</span><i style="width:{100 * n / most:.1f}%"></i><em>{fmt_int(n)}</em></div>' for k, n in items)


def timeline_svg(pages: list[int], failed: list[int], width: int = 720, height: int = 160) -> str:
    top = max([1, *pages])
    step = nice_step(top / 4)
    w = width / max(1, len(pages))
    y = lambda n: height - height * n / (step * math.ceil(top / step))
    lines = "".join(f'<line x1="0" x2="{width}" y1="{y(v):.1f}" y2="{y(v):.1f}" class="g"/><text x="2" y="{y(v) - 2:.1f}">{v}</text>' for v in range(step, top + step, step) if y(v) >= 0)
    rects = "".join(f'<rect x="{k * w:.1f}" y="{y(n):.1f}" width="{max(1, w - 1):.1f}" height="{height - y(n):.1f}"/>' + (f'<rect class="f" x="{k * w:.1f}" y="{y(f):.1f}" width="{max(1, w - 1):.1f}" height="{height - y(f):.1f}"/>' if f else "") for k, (n, f) in enumerate(zip(pages, failed, strict=True)))
    return f'<svg viewBox="0 0 {width} {height}" role="img">{lines}{rects}</svg>'


STYLE = "body{font:15px sans-serif;margin:2em;max-width:60em}.tile{display:inline-block;padding:1em;margin:.3em;background:#eef}.tile span{display:block}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em}.bar span{display:inline-block;width:16em}.bar i{display:inline-block;height:.8em;background:#47a;max-width:50%}rect{fill:#47a}.f{fill:#c33}.g{stroke:#ddd}"


def html(stats: dict, title: str = "Crawl report") -> str:
    """stats: what ``CrawlEngine.get_stats`` returns."""
    t = stats["totals"]
    parts = [
        f"<h1>{escape(title)}</h1>",
        tile("pages", fmt_int(t["total"])), tile("successful", fmt_int(t["successful"])), tile("failed", fmt_int(t["failed"])),
        tile("success", f"{t['success_rate']:.1f} %"), tile("pages a second", f"{t['pages_per_second']:.2f}"), tile("duration", fmt_seconds(t["duration"] or 0)),
        "<h2>Over time</h2>", timeline_svg([r["pages"] for r in stats["timeline"]], [r["failed"] for r in stats["timeline"]]),
        "<h2>Status</h2>", bars([(r["status"], r["pages"]) for r in stats["status"]]),
        "<h2>Domains</h2>", bars([(r["domain"], r["pages"]) for r in stats["top_domains"]]),
        "<h2>Depth</h2>", bars([(str(r["depth"]), r["pages"]) for r in stats["depth"]]),
        "<h2>Errors</h2>", grid(["type", "pages"], [[r["error"], r["pages"]] for r in stats["errors"]]),
    ]
    if bad := stats["failures"]:
        note = f"<p>{len(bad)} of {bad[0]['of']}</p>" if len(bad) < bad[0]["of"] else ""
        parts += ["<h2>Failures</h2>", note, grid(["url", "status", "error"], [[r["url"], r["status"], r["error"]] for r in bad])]
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style><body>{"".join(parts)}</body></html>'


def write(stats: dict, path: str, title: str = "Crawl report") -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(html(stats, title), encoding="utf-8")
