"""A question from start to end: domains, tiers of context, writers, merged answers, warnings, sources, memory, log.

Context comes in tiers. A question about a domain as a whole is answered from its README; a question for figures goes to
the analyst over the domain's tables; else the best files are retrieved. A registered writer turns context into an
answer; without one the context itself is passed through, as Markdown that the client's own model reads.
"""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates, routing, summaries
from ..sources import config, tables
from . import api, plugins, render
from .contextstore import ContextStore
from .knowledge import KnowledgeBase

README_LEAST = 200
ANALYST_CHARS = 3000
#: Tables that may answer a question for figures, best first.
TABLES_TRIED = 3
TABULAR = ("csv", "tsv", "xlsx", "xlsm", "json", "jsonl")

# Markers of generated parts of a README, and of a passed-through context.
INDEX_START, INDEX_END = "<!-- AUTO-INDEX START -->", "<!-- AUTO-INDEX END -->"
PASS_START, PASS_END = "[[CONTEXT]]", "[[/CONTEXT]]"


@dataclass
class Found:
    """A domain's share of an answer."""

    domain: str
    tier: str
    text: str
    sources: list[dict] = field(default_factory=list)
    withheld: int = 0
    passed: bool = False
    error: str | None = None


def readme_body(text: str) -> str:
    """A README without its generated index."""
    return re.sub(f"{re.escape(INDEX_START)}.*?{re.escape(INDEX_END)}", "", text, flags=re.S).strip()


def wrap(question: str, context: str, domain: str) -> str:
    """Context as a block that a client's model answers from."""
    return f"{PASS_START}\ndomain: {domain}\nquestion: {question}\n\n{context}\n{PASS_END}"


def unwrap(text: str) -> str:
    """Passed-through blocks as Markdown sections; other text stays as it is."""
    pattern = re.compile(rf"{re.escape(PASS_START)}\ndomain: (?P<d>[^\n]*)\nquestion: [^\n]*\n\n(?P<c>.*?)\n{re.escape(PASS_END)}", re.S)
    return pattern.sub(lambda m: f"# {m['d']}\n\n{m['c'].strip()}", text)


def sources_block(found: list[Found]) -> list[dict]:
    """Each file once with its best score, best first."""
    best: dict[str, float] = {}
    for f in found:
        for s in f.sources:
            best[s["path"]] = max(best.get(s["path"], 0.0), s["score"] or 0.0)
    return [{"path": p, "score": s} for p, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))]


def trimmed(text: str, most: int) -> str:
    """Whole lines up to ``most`` characters, with a mark where some are left out."""
    if len(text) <= most:
        return text
    return (text[:most].rpartition("\n")[0] or text[:most]).rstrip() + "\n\n_cut_"


def shown_rows(rows: list[dict]) -> str:
    """As many rows as fit into ``ANALYST_CHARS``, and how many don't."""
    shown = len(rows)
    while shown > 1 and len(text := render.markdown_table(rows[:shown])) > ANALYST_CHARS:
        shown = max(1, min(shown - 1, shown * ANALYST_CHARS // len(text)))
    left = f"\n\n_{len(rows) - shown} more rows_" if shown < len(rows) else ""
    return render.markdown_table(rows[:shown]) + left


class Assistant:
    def __init__(self, kb: KnowledgeBase, engine: api.Engine | None = None, context: ContextStore | None = None):
        self.kb, self.spark, self.digests = kb, kb.spark, context
        self.engine = engine or api.Engine(kb.spark)

    def list_domains(self) -> list[dict]:
        """Indexed domains and those with rules: name, description, number of files."""
        counted = {r["domain"]: r["n_files"] for r in self.kb.store.domains().collect()}
        return [{"domain": d, "description": self._rules(d).description, "n_files": counted.get(d, 0)} for d in sorted({*counted, *self.kb.domains})]

    def ask(self, question: str, session: str = "default", now: float | None = None, acknowledged: bool = False) -> dict:
        """``text``, ``domains``, ``sources``, ``confidence``, ``warnings``, ``withheld``; the turn is remembered and
        logged. A domain that fails is a warning, and the others answer."""
        began, now = time.monotonic(), time.time() if now is None else now
        history = self.kb.store.history(session, now, self.kb.settings.session_hours)
        domains = plugins.classify(question, history, sorted(self.kb.domains), self.kb.route(question))
        rules = [self._rules(d) for d in domains]
        n = summaries.answer_budget(len(domains), max((r.top_n for r in rules), default=1), max((r.max_chars for r in rules), default=1))
        weights = self.kb.store.file_weights(now, self.kb.settings.feedback_days).withColumnRenamed("file", "path").select("path", "weight")
        weights = weights if self.kb.store.versions("feedback") else None

        def one(name: str) -> Found:
            try:
                return self.domain_answer(name, question, history, n, acknowledged, weights)
            except (ValueError, PySparkException, Py4JJavaError) as e:
                return Found(name, "failed", "", error=api.first_line(e))

        with ThreadPoolExecutor(max(1, min(4, len(domains)))) as pool:
            found = list(pool.map(one, domains))
        sources = sources_block(found)
        warnings = [f"{f.domain}: {f.error}" for f in found if f.error] + self.warnings([f.domain for f in found], now)
        text = self.merged(question, [f for f in found if not f.error], warnings)
        label = self.spark.range(1).select(S.confidence(F.lit(len(sources)), F.lit(max((s["score"] for s in sources), default=0.0)))).first()[0]
        out = {"text": text, "domains": domains, "sources": sources, "confidence": label, "warnings": warnings, "withheld": sum(f.withheld for f in found)}
        self.kb.store.remember(session, question, text, now, self.kb.settings.max_turns)
        self.kb.store.log_turn(now, session, question, text, domains, [s["path"] for s in sources], not sources and out["withheld"] > 0, 1000 * (time.monotonic() - began))
        return out

    # ---- tiers

    def domain_answer(self, name: str, question: str, history: list[dict], n: int, acknowledged: bool = False, weights=None) -> Found:
        """The first tier that answers: README, analyst, digests where there is a store of them, retrieved files. A question for figures passes the README by,
        one that is complex reads all of it, others its introduction and index."""
        rules = self._rules(name)
        asks = self.spark.range(1).select(S.is_data(F.lit(question)).alias("data"), S.is_complex(F.lit(question)).alias("complex")).first()
        matches = lambda patterns: any(re.search(p, question, re.I) for p in patterns)
        figures = asks["data"] or matches(rules.data_patterns)
        if not figures and (readme := self.readme(name)):
            text = readme["text"] if asks["complex"] or matches(rules.complex_patterns) else readme["short"]
            return self.written(Found(name, "readme", trimmed(text, rules.max_chars), [{"path": readme["path"], "score": 1.0}]), question, history)
        if figures and (answered := self.analyst(name, question, acknowledged)):
            return answered
        if self.digests and (answered := self.digest(name, question, n, acknowledged)):
            return self.written(answered, question, history)
        got = self.kb.domain_context(name, question, n, acknowledged, weights)
        text = "\n\n".join(f"## {s['path']}\n\n{s['text']}" for s in got["sources"])
        return self.written(Found(name, "files", text, [{"path": s["path"], "score": s["score"]} for s in got["sources"]], got["withheld"]), question, history)

    def readme(self, name: str) -> dict | None:
        """The domain's README with the shortest path, if what it says beyond its generated index is long enough."""
        listed = self.kb.readmes().where(F.col("domain") == name).orderBy(F.length("path"), "path").limit(1).collect()
        if not listed:
            return None
        text = bytes(listed[0]["content"]).decode("utf-8", "replace")
        short = text.partition(INDEX_END)[0] if INDEX_START in text and INDEX_END in text else text
        return {"path": listed[0]["path"], "text": text, "short": short} if len(readme_body(text)) >= README_LEAST else None

    def analyst(self, name: str, question: str, acknowledged: bool) -> Found | None:
        """A figure from the domain's table that fits the question best, by the names, columns and values that share terms
        with it; where none does, from the first by name."""
        fit = self.kb.values.route(question, TABLES_TRIED, F.substring_index("path", "/", 1) == name)
        if not fit:
            rows = self.kb.store.files().where((F.col("domain") == name) & F.lower(F.substring_index("path", ".", -1)).isin(*TABULAR))
            fit = [r["path"] for r in rows.orderBy("path").limit(1).collect()]
        for path in fit:
            confidential = self.kb.store.read("chunks").where(F.col("path") == path).select(S.confidential_reason(F.col("path"), F.col("text")).alias("r")).where("r is not null")
            if not acknowledged and not confidential.isEmpty():
                return Found(name, "analyst", "", [], 1)
            out = self.engine.query_data(f"{self.kb.settings.root.rstrip('/')}/{path}", question, {"time_range": question})
            if out["status"] == "answered" and out["rows"]:
                return Found(name, "analyst", f"{out['answer']}\n\n{shown_rows(out['rows'])}", [{"path": path, "score": 1.0}])
        return None

    def digest(self, name: str, question: str, n: int, acknowledged: bool) -> Found | None:
        """The digests that fit the question, without those of confidential files unless acknowledged; a domain whose
        digests say nothing of it goes on to its files."""
        found = self.digests.fitting(name, question, n, self._rules(name).max_chars)
        if not found:
            return None
        rows = self.spark.createDataFrame([(r["path"], r["text"]) for r in found], "path string, text string")
        hidden = set() if acknowledged else {r["path"] for r in gates.confidential(self.kb.store.read("chunks").join(F.broadcast(rows.select("path")), "path", "left_semi")).select("path").distinct().collect()}
        shown = [r for r in found if r["path"] not in hidden]
        if not shown:
            return None
        text = trimmed("\n\n".join(f"## {r['path']}\n\n{r['text']}" for r in shown), self._rules(name).max_chars)
        return Found(name, "digest", text, [{"path": r["path"], "score": r["score"]} for r in shown], len(hidden))

    def written(self, found: Found, question: str, history: list[dict]) -> Found:
        """By the registered writer, else passed through."""
        writer = plugins.find("writer")
        if writer is None or not found.text:
            found.passed, found.text = True, wrap(question, found.text, found.domain) if found.text else ""
            return found
        form = self.spark.range(1).select(S.format_key(F.lit(question))).first()[0]
        lines = [f"{m['role']}: {m['text']}" for m in history] + [question] + ([render.FORMATS[form]] if form in render.FORMATS else [])
        found.text = writer("\n".join(lines), found.text)
        return found

    # ---- one answer from several

    def merged(self, question: str, found: list[Found], warnings: list[str]) -> str:
        """One domain's text alone, or sections with what they disagree on and what each adds."""
        told = [f for f in found if f.text]
        if not told:
            return "Nothing was found." if not sum(f.withheld for f in found) else "What was found is confidential and was not acknowledged."
        if all(f.passed for f in told):
            return unwrap("\n\n".join(f.text for f in told))
        if len(told) == 1:
            return told[0].text
        notes = []
        written = [(f.domain, f.text) for f in told if not f.passed]
        if len(written) > 1:
            answers = self.spark.createDataFrame(written, "domain string, answer string")
            notes += [f"- {r['subject']}: {r['values'].replace('|', ' or ')}" for r in routing.conflicts(answers).orderBy("subject").collect()]
            notes = ["## Differing figures\n\n" + "\n".join(notes)] if notes else []
            only = routing.complementary(answers).orderBy("domain").collect()
            notes += ["## Only in one domain\n\n" + "\n".join(f"- {r['domain']}: {r['sentence']}" for r in only)] if only else []
        return "\n\n".join([*(f"## {f.domain}\n\n{unwrap(f.text)}" for f in told), *notes])

    def warnings(self, domains: list[str], now: float) -> list[str]:
        """Domains of the answer whose index is out of step, and how many of their files are old."""
        out = [f"{d}: the index is out of step" for d in self.kb.out_of_step() if d in domains] if domains else []
        old = self.kb.stale_files(now).groupBy(F.substring_index("path", "/", 1).alias("domain")).agg(F.count("*").alias("n"))
        return out + [f"{r['domain']}: {r['n']} files are older than {self.kb.settings.stale_days} days" for r in old.where(F.col("domain").isin(*domains)).orderBy("domain").collect()] if domains else out

    def _rules(self, name: str) -> config.Domain:
        return self.kb.domains.get(name, config.Domain(name))
