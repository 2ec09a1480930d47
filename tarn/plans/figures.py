"""The four figures as SVG, drawn from the figure data. All of these are small: bins, quartiles, cells of a grid, days, and twenty users."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, Row

WIDTH, HEIGHT, LEFT, TOP, RIGHT, BOTTOM = 640, 360, 70, 40, 20, 50
INK, FILL, ACCENT = "#333333", "#5b8db8", "#c44e52"
SLICES = ("#5b8db8", "#dd8452", "#55a868", "#c44e52", "#8172b3")


def shade(share: float) -> str:
    """A colour between yellow (0) and red (1)."""
    share = min(1.0, max(0.0, share))
    return f"rgb({round(255 - 40 * share)},{round(240 - 200 * share)},{round(180 - 140 * share)})"


class Panel:
    """One chart with its axes; the data's ranges are mapped to the inner box. Values that are missing are not drawn."""

    def __init__(self, title: str, x: tuple[float, float], y: tuple[float, float]):
        (self.x0, self.x1), (self.y0, self.y1) = (r if r[1] > r[0] else (r[0] - 0.5, r[0] + 0.5) for r in (x, y))
        self.parts = [f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" font-size="15">{escape(title)}</text>']

    def px(self, x: float) -> float:
        return round(LEFT + (x - self.x0) / (self.x1 - self.x0) * (WIDTH - LEFT - RIGHT), 1)

    def py(self, y: float) -> float:
        return round(HEIGHT - BOTTOM - (y - self.y0) / (self.y1 - self.y0) * (HEIGHT - TOP - BOTTOM), 1)

    def box(self, x0: float, y0: float, x1: float, y1: float, fill: str, line: str = "none") -> None:
        a, b, c, d = self.px(x0), self.py(y1), self.px(x1), self.py(y0)
        self.parts.append(f'<rect x="{a}" y="{b}" width="{round(c - a, 1)}" height="{round(d - b, 1)}" fill="{fill}" stroke="{line}"/>')

    def line(self, points: list[tuple[float, float | None]], colour: str = INK, dash: str = "") -> None:
        """A line with a gap wherever a value is missing."""
        run: list[str] = []
        for x, y in [*points, (0, None)]:
            if y is not None:
                run.append(f"{self.px(x)},{self.py(y)}")
            elif run:
                self.parts.append(f'<polyline points="{" ".join(run)}" fill="none" stroke="{colour}" stroke-dasharray="{dash}"/>')
                run = []

    def text(self, x: float, y: float, words: str, anchor: str = "middle", dy: float = 0, size: int = 11) -> None:
        self.parts.append(f'<text x="{self.px(x)}" y="{self.py(y) + dy}" text-anchor="{anchor}" font-size="{size}">{escape(words)}</text>')

    def axes(self, below: str, left: str, ticks: list[tuple[float, str]] | None = None, steps: int = 5) -> None:
        self.line([(self.x0, self.y1), (self.x0, self.y0), (self.x1, self.y0)])
        for x, words in ticks or [(self.x0 + k * (self.x1 - self.x0) / steps, f"{self.x0 + k * (self.x1 - self.x0) / steps:.3g}") for k in range(steps + 1)]:
            self.text(x, self.y0, words, dy=16)
        for k in range(steps + 1):
            y = self.y0 + k * (self.y1 - self.y0) / steps
            self.text(self.x0, y, f"{y:.3g}", "end", 4)
        self.text((self.x0 + self.x1) / 2, self.y0, below, dy=36, size=12)
        self.parts.append(f'<text transform="translate(14,{HEIGHT / 2}) rotate(-90)" text-anchor="middle" font-size="12">{escape(left)}</text>')


def page(panels: list[Panel], across: int = 2) -> str:
    """Panels side by side, row by row."""
    rows = -(-len(panels) // across)
    drawn = "".join(f'<g transform="translate({k % across * WIDTH},{k // across * HEIGHT})">{"".join(p.parts)}</g>' for k, p in enumerate(panels))
    size = f'width="{min(across, len(panels)) * WIDTH}" height="{rows * HEIGHT}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif" fill="{INK}"><rect width="100%" height="100%" fill="white"/>{drawn}</svg>'


def distribution(bins: list[Row], curve: list[Row], marks: list[Row], mean: float | None) -> Panel:
    """Histogram, density on the histogram's scale, and marks at the percentiles and the mean."""
    step = bins[1].low_edge - bins[0].low_edge if len(bins) > 1 else 0.0
    total, last = sum(b["count"] for b in bins), (bins[-1].low_edge + step if bins else 1.0)
    shown = [(r.x, r.density * total * step) for r in curve if r.density is not None and r.x is not None]
    p = Panel("Composite waste", (bins[0].low_edge if bins else 0.0, last), (0, max([1, *(b["count"] for b in bins), *(y for _, y in shown)])))
    for b in bins:
        p.box(b.low_edge, 0, b.low_edge + step, b["count"], FILL, "white")
    p.line(shown, ACCENT)
    for value, words in [*((m.value, f"p{m.percentile}") for m in marks), (mean, "mean")]:
        if value is not None:
            p.line([(value, 0), (value, p.y1)], INK, "4 3")
            p.text(value, p.y1, words, dy=-2, size=9)
    p.axes("composite waste", "jobs")
    return p


def shares(counts: list[Row]) -> Panel:
    """One bar of the categories' shares, most frequent first; the colours go by rank."""
    p, at = Panel("Jobs by waste", (0, 100), (0, 1)), 0.0
    for k, r in enumerate(counts):
        width = r.pct or 0.0
        p.box(at, 0.35, at + width, 0.75, SLICES[k % len(SLICES)], "white")
        p.text(0, 0.25 - 0.07 * k, f"{r.waste_category}: {r['count']:,} ({width:.1f}%)", "start")
        at += width
    return p


def boxes(rows: list[Row], key: str, title: str) -> Panel:
    """Quartiles and whiskers, side by side in the order of the rows."""
    p = Panel(title, (0, max(1, len(rows))), (0, 1))
    for k, r in enumerate(rows):
        if r.q1 is not None:
            p.line([(k + 0.5, r.whisker_low), (k + 0.5, r.whisker_high)])
            p.box(k + 0.25, r.q1, k + 0.75, r.q3, FILL, INK)
            p.line([(k + 0.25, r.median), (k + 0.75, r.median)], ACCENT)
    p.axes("", "composite waste", [(k + 0.5, str(r[key])) for k, r in enumerate(rows)] or [(0, "")])
    return p


def scatter(cells: list[Row], correlation: float | None, per_side: int = 100) -> Panel:
    """Cells of CPU and memory waste, coloured by their composite waste, with the diagonal."""
    said = "" if correlation is None else f" (r = {correlation:.3f})"
    p = Panel(f"CPU and memory waste{said}", (0, 1), (0, 1))
    for c in cells:
        if c.x is not None and c.y is not None:
            p.box(c.x / per_side, c.y / per_side, (c.x + 1) / per_side, (c.y + 1) / per_side, shade(c.composite_waste or 0.0))
    p.line([(0, 0), (1, 1)], INK, "4 3")
    p.axes("CPU waste", "memory waste")
    return p


def days(rows: list[Row]) -> list[Panel]:
    """Daily means with the rolling mean and its band, and wasted core-hours."""
    last, ticks = max(1, len(rows) - 1), [(k, str(rows[k].date)) for k in sorted({round(i * (len(rows) - 1) / 5) for i in range(6)})] if rows else [(0, "")]
    mean = Panel("Composite waste by day", (0, last), (0, 1))
    for column, colour, dash in (("mean", "#bbbbbb", ""), ("band_low", FILL, "3 3"), ("band_high", FILL, "3 3"), ("rolling_mean", ACCENT, "")):
        mean.line([(k, r[column]) for k, r in enumerate(rows)], colour, dash)
    hours = Panel("Wasted core-hours by day", (0, last), (0, max([1.0, *(r.cpu_hours_wasted or 0.0 for r in rows)])))
    hours.line([(k, r.cpu_hours_wasted) for k, r in enumerate(rows)], FILL)
    for panel, left in ((mean, "composite waste"), (hours, "core-hours")):
        panel.axes("day", left, ticks)
    return [mean, hours]


def users(rows: list[Row]) -> Panel:
    """Users by duration of their jobs; each cell shows its mean."""
    names = ("short", "medium", "long", "very_long")
    p = Panel("Mean composite waste of the users with the most wasted core-hours", (0, len(names)), (0, max(1, len(rows))))
    for k, r in enumerate(rows):
        low = len(rows) - k - 1
        p.text(0, low + 0.5, str(r.job_username), "end", 4, 9)
        for c, name in enumerate(names):
            if r[name] is not None:
                p.box(c, low, c + 1, low + 1, shade(r[name]), "white")
                p.text(c + 0.5, low + 0.5, f"{r[name]:.2f}", dy=4, size=9)
    for c, name in enumerate(names):
        p.text(c + 0.5, 0, name.replace("_", " "), dy=16)
    return p


def draw(frames: dict[str, DataFrame], stats: dict) -> dict[str, str]:
    """The figures by name; `frames` are the figure data of a run, `stats` its statistics."""
    got: Callable[[str], list[Row]] = lambda name: frames[name].collect()
    by_kind = [boxes(got(f"box_{n}"), key, f"Composite waste by {words}") for n, key, words in (("exitcode", "job_exitcode", "exit code"), ("duration", "duration_category", "duration"), ("size", "size_category", "size"))]
    return {
        "waste_distributions": page([distribution(got("histogram"), got("density"), got("percentiles"), stats["overall"]["composite_waste_mean"]), shares(got("category_counts"))]),
        "waste_by_characteristics": page([*by_kind, scatter(got("scatter_cells"), stats["waste_correlations"]["cpu_mem_correlation"])]),
        "waste_time_series": page(days(got("time_series")), 1),
        "user_waste_heatmap": page([users(got("user_heatmap"))]),
    }
