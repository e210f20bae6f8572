"""Write reports to files, one folder per segment."""

from __future__ import annotations

from collections.abc import Collection

from wagerlens.model import Tables
from wagerlens.plans.catalog import REPORTS, SEGMENTS
from wagerlens.sources.text import export_result


def export_reports(t: Tables, out_dir: str, names: Collection[str] = (), fmt: str = "csv") -> list[str]:
    """Run the named reports (all, by default) and write each to ``out_dir/<segment>/<report>``."""
    unknown = set(names) - set(REPORTS)
    if unknown:
        raise ValueError(f"no such report: {', '.join(sorted(unknown))}")
    written = []
    for segment, reports in SEGMENTS.items():
        for name, report in reports.items():
            if not names or name in names:
                path = f"{out_dir}/{segment}/{name}"
                export_result(report(t), path, fmt)
                written.append(path)
    return written
