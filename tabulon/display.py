"""Tables as text, Markdown and HTML, from the few rows that were fetched."""

from __future__ import annotations

import datetime as dt
import html as markup
import shutil
import unicodedata
from decimal import Decimal

from .schema import RelationSchema

COLORS = {"null": "90", "bool": "35", "number": "36", "text": "33", "time": "32", "bytes": "90", "head": "1"}


def span(v: dt.timedelta) -> str:
    """Days, hours, minutes and seconds of an interval."""
    minutes, seconds = divmod(v.seconds + v.microseconds / 1e6, 60)
    hours, minutes = divmod(int(minutes), 60)
    years, days = divmod(v.days, 365) if v.days >= 0 else (0, v.days)
    parts = [f"{n}{u}" for n, u in ((years, "y"), (days, "d"), (hours, "h"), (minutes, "m")) if n] + ([f"{seconds:.2f}s"] if seconds else [])
    return " ".join(parts) or "0s"


def text_of(v: object) -> tuple[str, str]:
    """A value's text and kind."""
    if v is None or v != v:
        return "null", "null"
    if isinstance(v, bool):
        return str(v), "bool"
    if isinstance(v, (int, float, Decimal)):
        return str(v), "number"
    if isinstance(v, dt.timedelta):
        return span(v), "time"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S"), "time"
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat(), "time"
    if isinstance(v, (bytes, bytearray)):
        return v.decode("utf-8", "replace"), "bytes"
    return str(v), "text"


def wide(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in s)


def fitted(s: str, width: int, right: bool = False) -> str:
    """A text padded or cut to a display width."""
    s = s.replace("\n", " ").replace("\t", " ")
    if wide(s) > width:
        while s and wide(s) > width - 1:
            s = s[:-1]
        s += "…"
    pad = " " * (width - wide(s))
    return pad + s if right else s + pad


def table(schema: RelationSchema, rows: list[tuple], limit: int = 5, display_width: bool | int = True, max_column_width: int = 30, colorize: bool = False, show_types: bool = True) -> str:
    """A box; rows are numbered on, and those after the first `limit` are the last ones. The footer counts what is shown."""
    total = shutil.get_terminal_size((80, 20))[0] if display_width is True else display_width or 5_000
    cells = [[text_of(v) for v in r] for r in rows]
    names, kinds = schema.column_names, [str(c.type) for c in schema]
    widths = [max(4, min(max_column_width, max([wide(names[i]), wide(kinds[i]) if show_types else 0, *(wide(r[i][0]) for r in cells)]))) for i in range(len(names))]
    number = len(str(max(len(rows), 1))) + 2
    shown, used = 0, number + 2
    for w in widths:
        if used + w + 3 > total and shown:
            break
        used, shown = used + w + 3, shown + 1
    widths = widths[:shown]
    paint = (lambda s, k: f"\033[{COLORS[k]}m{s}\033[0m") if colorize else (lambda s, k: s)
    bar = lambda a, b, c: a + "─" * number + b + b.join("─" * (w + 2) for w in widths) + c
    line = lambda first, parts: "│" + first + "│" + "│".join(f" {p} " for p in parts) + "│"
    out = [bar("┌", "┬", "┐"), line(" " * number, [paint(fitted(n, w), "head") for n, w in zip(names, widths)])]
    if show_types:
        out.append(line(" " * number, [fitted(k, w) for k, w in zip(kinds, widths)]))
    out.append(bar("╞", "╪", "╡").replace("─", "═"))
    for i, r in enumerate(cells):
        if i == limit and len(cells) == 2 * limit:
            out.append(line(fitted("…", number), [fitted("…", w) for w in widths]))
        out.append(line(str(i + 1).rjust(number - 1) + " ", [paint(fitted(t, w, k == "number"), k) for (t, k), w in zip(r, widths)]))
    return "\n".join([*out, bar("└", "┴", "┘"), f"[ {len(rows)} rows x {len(names)} columns ]"])


def markdown(schema: RelationSchema, rows: list[tuple], max_column_width: int = 30) -> str:
    names = schema.column_names
    cells = [[text_of(v)[0].replace("|", "\\|") for v in r] for r in rows]
    widths = [max(4, min(max_column_width, max([wide(n), *(wide(r[i]) for r in cells)]))) for i, n in enumerate(names)]
    line = lambda parts: "| " + " | ".join(fitted(p, w) for p, w in zip(parts, widths)) + " |"
    return "\n".join([line(names), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells)])


def html(schema: RelationSchema, rows: list[tuple]) -> str:
    cell = lambda tag, s: f"<{tag}>{markup.escape(s)}</{tag}>"
    head = "".join(cell("th", n) for n in schema.column_names)
    body = "".join("<tr>" + "".join(cell("td", text_of(v)[0]) for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><p>{len(rows)} rows x {len(schema.columns)} columns</p>"
