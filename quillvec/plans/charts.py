"""Line charts of result tables as SVG files."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import writer

WIDTH, HEIGHT, EDGE = 640, 400, 60
#: Points of a chart, at most: a chart is for figures, not for data.
POINTS = 10_000
#: Colours that are told apart by most eyes, and dash patterns besides.
_STYLES = [("#0072b2", ""), ("#d55e00", "6 3"), ("#009e73", "2 3"), ("#cc79a7", "8 3 2 3"), ("#e69f00", "1 4"), ("#000000", "12 4")]


def line_chart(rows: DataFrame, path: str, x: str, y: str, *, series: str | None = None, title: str = "") -> int:
    """Writes column y over column x, a line for each value of `series`; gives the number of points.  Null figures are left out."""
    held = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(series).cast("string") if series else F.lit("")).alias("s")).where("x is not null and y is not null")
    points = sorted((r["s"] or "", r["x"], r["y"]) for r in held.limit(POINTS + 1).collect())
    if len(points) > POINTS:
        raise ValueError(f"more than {POINTS} points")
    xs, ys = [p[1] for p in points] or [0.0], [0.0, *(p[2] for p in points)]
    scale = lambda v, low, high, a, b: a + (b - a) * ((v - low) / (high - low) if high > low else 0.5)
    at = lambda p: (scale(p[1], min(xs), max(xs), EDGE, WIDTH - EDGE), scale(p[2], min(ys), max(ys), HEIGHT - EDGE, EDGE))
    text = lambda a, b, t, anchor="middle": f'<text x="{a:.1f}" y="{b:.1f}" text-anchor="{anchor}" font-size="12">{escape(t)}</text>'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif"><rect width="100%" height="100%" fill="white"/>']
    out.append(f'<path d="M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}" fill="none" stroke="black"/>')
    for k in range(5):
        a, b = min(xs) + (max(xs) - min(xs)) * k / 4, min(ys) + (max(ys) - min(ys)) * k / 4
        out += [text(scale(k, 0, 4, EDGE, WIDTH - EDGE), HEIGHT - EDGE + 16, f"{a:.4g}"), text(EDGE - 6, scale(k, 0, 4, HEIGHT - EDGE, EDGE) + 4, f"{b:.4g}", "end")]
    out += [text(WIDTH / 2, 20, title), text(WIDTH / 2, HEIGHT - 12, x), text(EDGE, EDGE - 10, y)]
    for k, name in enumerate(sorted({p[0] for p in points})):
        colour, dash = _STYLES[k % len(_STYLES)]
        own = [at(p) for p in points if p[0] == name]
        out.append(f'<polyline points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in own)}" fill="none" stroke="{colour}" stroke-width="2" stroke-dasharray="{dash}"/>')
        out += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3" fill="{colour}"/>' for a, b in own]
        if series:
            out.append(text(WIDTH - EDGE + 4, EDGE + 16 * k, name, "start"))
    with writer(path) as f:
        f.write("".join([*out, "</svg>"]).encode())
    return len(points)
