"""Document digests, rendered in the tasks that hold their sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from . import render


def page(path: str, sha: str, status: str, sections: list[dict], leads: list[str], keywords: list[str]) -> str:
    """Headings with their first paragraphs, or first paragraphs alone; a file that couldn't be read says so."""
    if status != "ok":
        return render.front_matter({"sha": sha, "path": path, "extraction": "empty", "reason": status}) + f"# {path}\n\nNothing could be read from this file.\n"
    known = sections or [{"level": 1, "heading": x, "lead": None} for x in leads]
    text = render.document_digest(path, known, keywords)
    return text.replace("---\n", f"---\nsha: {sha}\nextraction: ok\n", 1)


def rendered(rows: DataFrame) -> DataFrame:
    """``path, text`` from ``(path, hash, status, leads, sections, keywords)``."""
    ship(rows.sparkSession)
    listed = lambda v: [] if v is None else list(v)

    def run(batches):
        for b in batches:
            out = [
                (r.path, page(r.path, r.hash, r.status, [dict(s) for s in listed(r.sections)], listed(r.leads), listed(r.keywords)))
                for r in b.itertuples(index=False)
            ]
            yield pd.DataFrame(out, columns=["path", "text"])

    return rows.select("path", "hash", "status", "leads", "sections", "keywords").mapInPandas(run, "path string, text string")
