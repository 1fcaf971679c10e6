"""What a client calls: profile a file, ask about it, refine, compare, search the documents, read the logs.

Results are dictionaries for tools; every figure in them comes from a DataFrame operator. Rows reach the driver only
as final answers of a stated size.
"""

from __future__ import annotations

import hmac
import secrets
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyst, digest, gates, profile, routing, search
from ..sources import tables
from . import planner, render

SHOWN = 50


@dataclass
class Dialogue:
    """A question that may still need answers."""

    id: str
    path: str
    question: str
    params: dict = field(default_factory=dict)
    pending: list[dict] = field(default_factory=list)
    other: str | None = None


class Engine:
    """Entry points over one session; dialogues live in memory."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.dialogues: dict[str, Dialogue] = {}
        self.cards: dict[str, profile.DataCard] = {}
        self.tokens: dict[str, str] = {}
        self.acknowledged: set[str] = set()

    def card(self, path: str) -> profile.DataCard:
        if path not in self.cards:
            self.cards[path] = profile.card(tables.load(self.spark, path), path.rstrip("/").rpartition("/")[2])
        return self.cards[path]

    def analyze_file(self, path: str) -> dict:
        return self.card(path).to_dict()

    def suggest_questions(self, path: str) -> list[dict]:
        return planner.questions(self.card(path))

    def query_data(self, path: str, question: str, params: dict | None = None) -> dict:
        """An answer, or what must be clarified first with the id of a dialogue to continue."""
        talk = Dialogue(uuid.uuid4().hex[:8], path, question, dict(params or {}))
        self.dialogues[talk.id] = talk
        return self._step(talk)

    def refine_query(self, dialogue: str, feedback: str) -> dict:
        talk = self.dialogues.get(dialogue)
        if talk is None:
            return {"status": "error", "error": "unknown dialogue"}
        talk.params = planner.refine(talk.params, feedback, talk.pending)
        return self._compare(talk) if talk.other else self._step(talk)

    def _step(self, talk: Dialogue) -> dict:
        """Asks back or answers; whatever a file or its columns make impossible is an error in the result."""
        try:
            card = self.card(talk.path)
            talk.pending = planner.clarifications(talk.question, card, talk.params)
            if talk.pending:
                return {"status": "clarifying", "session": talk.id, "clarifications": talk.pending}
            plan = planner.plan(talk.question, card, talk.params)
            df = tables.load(self.spark, talk.path)
            if only := talk.params.get("only"):
                hits = [c for c in card.of_kind("entity", "categorical") if df.where(F.lower(F.trim(F.col(f"`{c}`").cast("string"))) == only.lower()).limit(1).count()]
                if hits:
                    df = analyst.restrict(df, entity_col=hits[0], entity=only)
            return {"session": talk.id, "status": "answered", "plan": plan.operation} | answer(df, plan, card)
        except (ValueError, PySparkException, Py4JJavaError) as e:
            return {"status": "error", "error": first_line(e), "session": talk.id}

    def compare_data(self, path_a: str, path_b: str, metric: str | None = None, time: str | None = None) -> dict:
        """Two files by period. What is asked back is answered by ``refine_query`` with the session's id."""
        talk = Dialogue(uuid.uuid4().hex[:8], path_a, "compare", {"metric": metric, "time": time}, other=path_b)
        self.dialogues[talk.id] = talk
        return self._compare(talk)

    def _compare(self, talk: Dialogue) -> dict:
        try:
            a, b = self.card(talk.path), self.card(talk.other)
            metrics = [m for m in a.of_kind("metric") if m in b.of_kind("metric")]
            metric = talk.params.get("metric") or (metrics[0] if len(metrics) == 1 else None)
            time = talk.params.get("time") or next((t for t in a.of_kind("time") if t in b.of_kind("time")), None)
            if not (metrics or metric) or not time:
                return {"status": "error", "error": "the files share no metric and period columns", "session": talk.id}
            if not metric:
                talk.pending = [{"id": "metric", "kind": "choice", "text": "Which metric?", "choices": metrics}]
                return {"status": "clarifying", "session": talk.id, "clarifications": talk.pending}
            rows = analyst.compare(tables.load(self.spark, talk.path), tables.load(self.spark, talk.other), metric, time)
            found = shown(rows.orderBy("period"))
        except (ValueError, PySparkException, Py4JJavaError) as e:
            return {"status": "error", "error": first_line(e), "session": talk.id}
        names = {"value_a": a.name, "value_b": b.name}
        labels = [r["period"] for r in found["rows"]]
        return {"status": "answered", "session": talk.id, "chart": render.chart("bar", labels, {n: [r[c] for r in found["rows"]] for c, n in names.items()})} | found

    def search(self, docs: DataFrame, question: str, n: int = 10) -> list[dict]:
        """BM25 over ``docs (doc_id, name, text)``, else the keyword fallback."""
        t = docs.select("doc_id", F.concat_ws(" ", "name", "text").alias("t"))
        return collected(search.bm25_texts(t, question, "doc_id", F.col("t"), n), n) or collected(search.keyword_fallback(docs, question, "doc_id", F.col("text"), n), n)

    def ask(self, docs: DataFrame, keywords: DataFrame, question: str, n: int = 5, session: str = "default") -> dict:
        """Routes a question to domains, retrieves from each, withholds confidential documents until acknowledged."""
        asked = self.spark.createDataFrame([(0, question)], "question_id int, question string")
        routes = routing.dominance(routing.keyword_hits(asked, keywords)).collect()
        domains = [r["domain"] for r in routes if r["confident"]]
        pool = docs.where(F.col("domain").isin(domains)) if domains else docs
        hits = self.search(pool, question, n)
        kind = pool.schema["doc_id"].dataType.simpleString()
        found = self.spark.createDataFrame([(h["doc_id"], float(h["score"])) for h in hits], f"doc_id {kind}, score double")
        rows = pool.join(F.broadcast(found), "doc_id")
        flagged = gates.confidential(rows)
        kept = gates.withhold(rows, flagged.select("path"), session in self.acknowledged)
        return {"domains": domains, "sources": collected(kept.select("doc_id", "path", "score", "marked").orderBy(F.desc("score"), "doc_id"), n), "withheld": len(hits) - kept.count()}

    def check_confidential(self, docs: DataFrame, session: str = "default") -> dict:
        """The first flagged files by path, and the ``total`` that the token opens."""
        flagged = gates.confidential(docs).select("path", "reason")
        found = collected(flagged.orderBy("path"))
        total = flagged.count() if len(found) == SHOWN else len(found)
        self.tokens[session] = secrets.token_hex(4)
        return {"files": found, "total": total, "token": self.tokens[session]}

    def acknowledge_gate(self, session: str, token: str) -> bool:
        if hmac.compare_digest(self.tokens.get(session, ""), token) and token:
            self.acknowledged.add(session)
        return session in self.acknowledged


def collected(df: DataFrame, most: int = SHOWN) -> list[dict]:
    """The first rows, for tables that have no more, or for reports whose size is asked for."""
    return [r.asDict() for r in df.limit(most).collect()]


def shown(df: DataFrame, most: int = SHOWN) -> dict:
    """The first ``most`` rows, how many there are, and whether that is more than is shown."""
    rows = collected(df, most + 1)
    total = df.count() if len(rows) > most else len(rows)
    return {"rows": rows[:most], "total": total, "truncated": total > most}


def first_line(e: Exception) -> str:
    return str(e).strip().partition("\n")[0][:300]


def answer(df: DataFrame, plan: planner.Plan, card: profile.DataCard) -> dict:
    """Runs a plan: rows with their number, a sentence, chart data and follow-up questions.

    The entity that was asked for restricts every operation; the period all but those that compare periods with each
    other. Figures in the sentence are counted over all rows, also where only some are shown.
    """
    every = analyst.restrict(df, None, None, *(plan.entity or (None, None)))
    rows = analyst.restrict(every, plan.time, plan.period) if plan.time else every
    follow = [q["question"] for q in planner.questions(card)[2:5]]
    m, g, t = plan.metric, plan.group, plan.time
    out: dict = {"followups": follow, "warnings": list(card.warnings), "chart": None}
    if plan.operation == "summary" or not m:
        return out | {"rows": [], "total": 0, "truncated": False, "answer": f"{card.name}: {card.total_rows} rows, {len(card.columns)} columns, {card.time_range}."}
    if plan.operation == "attrition" and g and t:
        found = shown(analyst.attrition(every, g, t, m).orderBy(F.desc("lost_value"), "entity"))
        return out | found | {"answer": f"{found['total']} {g} are missing from the latest {t}."}
    if plan.operation in ("trend", "compare") and t:
        found = shown(analyst.trend(rows, m, t).orderBy("nth"), 400)
        return out | found | {"answer": f"{m} over {found['total']} periods.", "chart": chart_of("line", found, "period", "value", m)}
    if plan.operation == "top" and g:
        found = shown(analyst.top(rows, m, g, plan.top_n).orderBy("rank"), plan.top_n)
        return out | found | {"answer": f"Top {found['total']} {g} by {m}.", "chart": chart_of("bar_horizontal", found, "key", "value", m)}
    if plan.operation == "breakdown" and g:
        found = shown(analyst.breakdown(rows, m, g).orderBy(F.desc("value"), "key"))
        total = found["rows"][0]["n_groups"] if found["rows"] else 0
        found |= {"total": total, "truncated": total > len(found["rows"])}
        return out | found | {"answer": f"{m} by {g}: {total} groups.", "chart": chart_of("bar", found, "key", "value", m)}
    if plan.operation == "outliers" and g:
        found = shown(analyst.outliers(rows, m, g).orderBy("key"))
        return out | found | {"answer": f"{found['total']} {g} with unusual {m}."}
    if plan.operation == "concentration" and g:
        return out | shown(analyst.gini(rows, m, g)) | {"answer": f"Concentration of {m} across {g}."}
    if plan.operation == "growth" and g and t:
        return out | shown(analyst.fastest_growth(every, m, g, t, plan.top_n).orderBy(F.desc("change"), "key"), plan.top_n) | {"answer": f"{g} that grow fastest."}
    found = shown(analyst.total(rows, m))
    return out | found | {"answer": f"Total {m}: {render.money(found['rows'][0]['total'])} over {found['rows'][0]['n_rows']} rows."}


def chart_of(kind: str, found: dict, label: str, value: str, name: str) -> dict:
    return render.chart(kind, [r[label] for r in found["rows"]], {name: [r[value] for r in found["rows"]]}, found["total"])


#: Groups that a digest shows of a metric in a dimension.
GROUPS = 8


def digest_of(df: DataFrame, name: str) -> str:
    """A table's digest in Markdown."""
    card = profile.card(df, name)
    metrics = card.of_kind("metric")
    dimensions = digest.pick_dimensions(card)
    totals = collected(digest.metric_summary(df, metrics).orderBy("metric"), len(metrics)) if metrics else []
    groups: dict[str, list[dict]] = {}
    if metrics and dimensions:
        place = {m: i for i, m in enumerate(metrics)}
        known = list(dict.fromkeys(dimensions.values()))
        found = digest.breakdowns(df, metrics, known, GROUPS).orderBy("metric", "dimension", F.desc("value"), "key")
        # the first metric's groups go by the dimension's name, those of the others say whose they are
        for r in sorted(collected(found, GROUPS * len(metrics) * len(known)), key=lambda r: place[r["metric"]]):
            groups.setdefault(r["dimension"] if r["metric"] == metrics[0] else f"{r['dimension']}, {r['metric']}", []).append(r)
    named = [c for c in card.of_kind("entity", "categorical")]
    values = [F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(named)]
    words = collected(digest.keywords(df.select(F.explode(F.array(*values)).alias("v")).select("v.*")), 25) if values else []
    return render.table_digest(name, card, totals, groups, [r["keyword"] for r in words])
