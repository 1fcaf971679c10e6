"""Presentation of small results on the driver: charts, markdown digests, indexes within byte budgets."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Sequence

FORMATS = {
    "table": "Answer with one Markdown table and nothing else.",
    "bullets": "Answer with a short Markdown bullet list.",
    "oneline": "Answer in one sentence.",
    "paragraph": "Answer in plain paragraphs without lists or tables.",
    "numbered": "Answer with a numbered Markdown list.",
    "json": "Answer with valid JSON only.",
}


def number(x: float | None) -> str:
    if x is None:
        return "—"
    return f"{x:,.0f}" if abs(x) >= 1000 else f"{x:.2f}".rstrip("0").rstrip(".")


def money(x: float | None) -> str:
    if x is None:
        return "—"
    return f"${x / 1e6:.2f}M" if abs(x) >= 1e6 else f"${x / 1e3:.1f}K" if abs(x) >= 1e3 else f"${x:.2f}"


def chart(kind: str, labels: Sequence[str], series: dict[str, Sequence[float]], total: int | None = None) -> dict:
    """Chart data of all points given, with its CSV and, for one series of up to twelve values that aren't negative, a
    mermaid drawing. ``total`` tells how many points there are where not all are given."""
    labels = [str(x) for x in labels]
    series = {k: list(v) for k, v in series.items()}
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["label", *series])
    writer.writerows(zip(labels, *series.values(), strict=True))
    data = {"type": kind, "labels": labels, "series": series, "csv": out.getvalue(), "mermaid": None, "total": len(labels) if total is None else total}
    values = next(iter(series.values()), [])
    if len(series) == 1 and 0 < len(labels) <= 12 and all(v is not None and v >= 0 for v in values):
        names = ", ".join('"' + x.replace('"', "'") + '"' for x in labels)
        data["mermaid"] = f"xychart-beta\n  x-axis [{names}]\n  {'line' if kind == 'line' else 'bar'} [{', '.join(f'{v:g}' for v in values)}]"
    return data


def markdown_table(rows: list[dict], most: int = 50) -> str:
    if not rows:
        return "_no rows_"
    names = list(rows[0])
    cell = lambda v: number(v) if isinstance(v, float) else "—" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"_{len(rows) - most} more rows_")
    return "\n".join(lines)


def within_budget(levels: Sequence[Callable[[], str]], limit: int) -> str:
    """The first rendering, from the most detailed to the barest, of at most ``limit`` UTF-8 bytes; the last is cut at
    a line end."""
    text = ""
    for level in levels:
        text = level()
        if len(text.encode()) <= limit:
            return text
    return text.encode()[:limit].decode("utf-8", "ignore").rpartition("\n")[0] + "\n"


def front_matter(values: dict) -> str:
    line = lambda v: "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list | tuple) else str(v)
    return "---\n" + "".join(f"{k}: {line(v)}\n" for k, v in values.items() if v not in (None, "", [], ())) + "---\n"


def table_digest(name: str, card, totals: list[dict], breakdowns: dict[str, list[dict]], keywords: list[str], limit: int = 10_000) -> str:
    """A table's digest: front matter, totals, breakdowns, columns; fewer breakdown rows as the budget shrinks."""
    head = front_matter({"path": name, "type": "table", "rows": card.total_rows, "columns": len(card.columns), "period": card.time_range, "grain": card.grain, "keywords": keywords})

    def body(rows: int, schema: bool) -> str:
        out = [head, f"# {name}\n"]
        out += [f"- **{t['metric']}**: {number(t['total'])} over {t['n_values']} values" for t in totals]
        for dimension, groups in breakdowns.items() if rows else ():
            out.append(f"\n## By {dimension}\n")
            out += [f"- {g['key']}: {number(g['value'])}" for g in groups[:rows]]
        if schema:
            out.append("\n## Columns\n")
            out += [f"- {c.name} ({c.kind})" + (f", {c.null_rate:.0%} missing" if c.null_rate >= 0.2 else "") for c in card.columns]
        return "\n".join(out) + "\n"

    return within_budget([lambda r=r, s=s: body(r, s) for r, s in ((8, True), (5, True), (3, True), (0, True), (0, False))], limit)


def document_digest(path: str, sections: list[dict], keywords: list[str], limit: int = 6_000) -> str:
    head = front_matter({"path": path, "type": "document", "sections": len(sections), "keywords": keywords})

    def body(most: int, leads: bool) -> str:
        out = [head, f"# {path}\n"]
        for s in sections[:most]:
            out.append("  " * (min(3, s["level"] or 1) - 1) + f"- {s['heading']}" + (f": {s['lead']}" if leads and s.get("lead") else ""))
        return "\n".join(out) + "\n"

    return within_budget([lambda m=m, x=x: body(m, x) for m, x in ((200, True), (60, True), (60, False), (20, False), (5, False))], limit)


#: Lines that an index page can have at most; its byte budget is spent before.
INDEX_FILES = 1_000


def index_page(domain: str, files: list[dict], total: int | None = None, limit: int = 3_000) -> str:
    """A domain's index: the number of its files and a line per file, with fewer keywords as the budget shrinks."""
    total = len(files) if total is None else total

    def body(n: int) -> str:
        return f"# {domain}\n\n{total} files\n\n" + "".join(f"- {f['path']} ({f.get('type', '')})" + (f": {', '.join(f['keywords'][:n])}" if n and f.get("keywords") else "") + "\n" for f in files)

    return within_budget([lambda n=n: body(n) for n in (8, 4, 2, 0)], limit)


def manifest(stats: list[dict], limit: int = 8_000) -> str:
    def body(n: int) -> str:
        return "# Domains\n\n" + "".join(f"- {s['domain']}: {s['n_files']} files" + (f", {', '.join(s['keywords'][:n])}" if n and s.get("keywords") else "") + "\n" for s in stats)

    return within_budget([lambda n=n: body(n) for n in (8, 4, 0)], limit)


def readme_stub(domain: str, description: str, types: dict[str, int]) -> str:
    """A first README for a domain that has none."""
    counts = ", ".join(f"{n} {t}" for t, n in sorted(types.items(), key=lambda x: (-x[1], x[0])))
    return f"# {domain}\n\n{description.strip() or 'No description yet.'}\n\nFiles: {counts or 'none'}.\n"
