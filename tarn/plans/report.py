"""Key findings: a table of figures, and one way to print it."""

from __future__ import annotations

Figure = tuple[str, float, str]
MEASURES = {"cpu_waste_mean": "mean CPU waste", "mem_waste_mean": "mean memory waste", "composite_waste_mean": "mean composite waste"}


def findings(stats: dict) -> list[Figure]:
    """(name, value, unit) of what a run found; shares in percent."""
    figures: list[Figure] = [("files", stats["files_processed"], ""), ("jobs", stats["overall"]["total_jobs"], "")]
    figures += [(name, 100 * stats["overall"][key], "%") for key, name in MEASURES.items()]
    figures += [(f"jobs wasting {row['threshold']}", row["composite_waste_pct"], "%") for row in stats["waste_thresholds"]]
    return [*figures, ("wasted core-hours", stats["total_waste"]["total_cpu_hours_wasted"], "h")]


def printed(title: str, figures: list[Figure]) -> str:
    """Names to the left, values to the right, in one width."""
    shown = [(name, f"{value:,.1f} {unit}" if unit == "%" else f"{value:,.0f} {unit}".rstrip()) for name, value, unit in figures]
    left, right = (max((len(row[k]) for row in shown), default=0) for k in (0, 1))
    return "\n".join([title, *(f"  {name:<{left}}  {value:>{right}}" for name, value in shown)])


def key_findings(stats: dict) -> str:
    return printed(f"Waste on {stats['hpc_system']}", findings(stats))


def comparison(rows: list[dict]) -> str:
    """A block for each system."""
    blocks = []
    for row in rows:
        figures: list[Figure] = [("files", row["files_processed"], ""), ("jobs", row["total_jobs"], "")]
        figures += [(name, 100 * row[key], "%") for key, name in MEASURES.items()]
        blocks.append(printed(row["system"], [*figures, ("wasted core-hours", row["total_cpu_hours_wasted"], "h")]))
    return "\n".join(blocks)
