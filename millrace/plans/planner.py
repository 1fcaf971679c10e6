"""From a question in words to a plan: period, columns, ranking size, and what to ask back."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..operators.analyst import Period
from ..operators.profile import DataCard

# Words by which a question chooses its operation, tried in this order.
OPERATIONS = {
    "attrition": ("attrition", "churn", "at risk", "lost", "did not renew", "didn't renew"),
    "compare": ("compare", "versus", " vs "),
    "outliers": ("outlier", "anomal", "unusual"),
    "concentration": ("gini", "concentration", "80/20", "pareto"),
    "growth": ("growing fastest", "fastest", "grew most"),
    "trend": ("trend", "over time", "by year", "by quarter", "year over year", "growth"),
    "top": ("top", "biggest", "largest", "highest", "ranking", "rank"),
    "total": ("total", "sum", "how much", "overall", "aggregate"),
    "breakdown": ("breakdown", "by ", "split", "group", "per ", "each"),
    "summary": ("summary", "overview", "describe", "what is this", "quality"),
}
EVERYTHING = re.compile(r"\b(all|all time|ever|everything|entire|any)\b", re.I)
PERIOD_WORD = re.compile(r"\b(q[1-4]|fy\s*20\d\d|(?:19|20)\d\d|h[12]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", re.I)


@dataclass(frozen=True)
class Plan:
    operation: str
    metric: str | None = None
    group: str | None = None
    time: str | None = None
    period: Period = Period()
    entity: tuple[str, str] | None = None
    top_n: int = 10


def parse_period(text: str | None) -> Period:
    """Years and quarters named in a text; none means all."""
    t = (text or "").lower()
    years = tuple(dict.fromkeys(int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d\d)(?!\d)", t)))
    quarters = tuple(dict.fromkeys(int(q) for q in re.findall(r"\bq([1-4])", t)))
    return Period(years, quarters, text or "all")


def _named(question: str, columns: list[str]) -> str | None:
    q = re.sub(r"[_\W]+", " ", question.lower())
    spaced = sorted(((re.sub(r"[_\W]+", " ", c.lower()).strip(), c) for c in columns), key=lambda x: -len(x[0]))
    return next((c for s, c in spaced if s and re.search(rf"\b{re.escape(s)}s?\b", q)), None)


def _choose(question: str, columns: list[str], wanted: str | None) -> str | None:
    return wanted if wanted in columns else _named(question, columns) or (columns[0] if columns else None)


def operation(question: str) -> str:
    q = f" {question.lower()} "
    return next((name for name, words in OPERATIONS.items() if any(w in q for w in words)), "total")


def plan(question: str, card: DataCard, params: dict | None = None) -> Plan:
    """The operation a question asks for and the columns it runs on; ``params`` override: metric, group, time,
    time_range, top_n, entity (column, value)."""
    params = params or {}
    metrics, entities, times = card.of_kind("metric"), card.of_kind("entity", "categorical"), card.of_kind("time")
    n = params.get("top_n") or next((int(m) for m in re.findall(r"\b(?:top|first|largest|biggest)\s+(\d{1,3})\b", question.lower())), 10)
    what = operation(question)
    time = _choose(question, times, params.get("time"))
    group = _choose(question, entities, params.get("group"))
    if what == "breakdown" and not _named(question, entities) and _named(question, times):
        group = _named(question, times)
    return Plan(what, _choose(question, metrics, params.get("metric")), group, time, parse_period(params.get("time_range") or question), params.get("entity"), int(n))


def clarifications(question: str, card: DataCard, params: dict | None = None) -> list[dict]:
    """What must be asked first: which of several metrics, and for which period."""
    params, out = params or {}, []
    metrics = card.of_kind("metric")
    if len(metrics) > 1 and not params.get("metric") and not _named(question, metrics):
        out.append({"id": "metric", "kind": "choice", "text": "Which metric?", "choices": metrics})
    known = params.get("time_range") or EVERYTHING.search(question) or PERIOD_WORD.search(question)
    if card.of_kind("time") and not known and operation(question) not in ("trend", "attrition", "growth", "summary", "compare"):
        out.append({"id": "time_range", "kind": "text", "text": "Which period? For example FY2025, Q1 2026 or all."})
    return out


def refine(params: dict, feedback: str, pending: list[dict]) -> dict:
    """Parameters after a free-text answer: a choice, a period, 'all', a number of results, or 'only X' for an entity."""
    new, text = dict(params), feedback.strip()
    for p in pending:
        hit = next((c for c in p.get("choices", ()) if c.lower() in text.lower()), None)
        if hit:
            new[p["id"]] = hit
    period = parse_period(text)
    if period.years or period.quarters:
        new["time_range"] = text
    elif EVERYTHING.search(text):
        new["time_range"] = "all"
    if m := re.search(r"\b(?:top|first|show)\s+(\d{1,3})\b|^\s*(\d{1,3})\s*(?:results|rows)?\s*$|\b(\d{1,3})\s+results\b", text, re.I):
        new["top_n"] = int(next(g for g in m.groups() if g))
    if m := re.search(r"\bonly (?:the )?([\w .&-]+?)(?: (?:region|segment|customer|market))?\s*$", text, re.I):
        new["only"] = m[1].strip()
    return new


def questions(card: DataCard, most: int = 12) -> list[dict]:
    """Questions a table can answer, by theme, without repeats."""
    m, e, t = (next(iter(card.of_kind(*k)), None) for k in (("metric",), ("entity", "categorical"), ("time",)))
    out = [("summary", f"What is in {card.name}?"), ("summary", f"Are there data quality issues in {card.name}?")]
    if m:
        out.append(("revenue", f"What is the total {m}?"))
    if m and e:
        out += [("revenue", f"What are the top 10 {e} by {m}?"), ("revenue", f"Show the breakdown of {m} by {e}."), ("concentration", f"How concentrated is {m} across {e}?"), ("anomaly", f"Which {e} are outliers in {m}?")]
    if m and t:
        out.append(("growth", f"What is the trend of {m} over {t}?"))
    if m and e and t:
        out += [("attrition", f"Which {e} were lost in the latest {t}?"), ("growth", f"Which {e} are growing fastest in {m}?")]
    seen: dict[str, tuple[str, str]] = {}
    for theme, q in out:
        seen.setdefault(q.strip().lower(), (theme, q))
    return [{"theme": theme, "question": q} for theme, q in list(seen.values())[:most]]


def with_operation(p: Plan, name: str) -> Plan:
    return replace(p, operation=name)
