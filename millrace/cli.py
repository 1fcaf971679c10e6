"""Command line: ``python -m millrace.cli status|diff|doctor|reindex|stale|sessions|manifest|context|domains|profile|ask|query …``."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from .plans import api, planner
from .plans.assistant import Assistant
from .plans.contextstore import ContextStore
from .plans.knowledge import KnowledgeBase
from .session import session
from .sources import config


def rules(folder: str) -> dict[str, config.Domain]:
    """Domain rules from ``<folder>/*.yaml``."""
    found = sorted(Path(folder).glob("*.yaml")) if Path(folder).is_dir() else []
    return {p.stem: config.domain(p.read_text(encoding="utf-8"), p.stem) for p in found}


def ago(seconds: float) -> str:
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        if seconds >= size:
            return f"{int(seconds // size)}{unit} ago"
    return "just now"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("command", choices=["status", "diff", "doctor", "reindex", "stale", "sessions", "manifest", "profile", "ask", "query", "context", "domains"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--env", default=".env")
    parser.add_argument("--rules", default="rules")
    parser.add_argument("--master")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    spark = session(args.master)
    kb = KnowledgeBase(spark, config.Settings.load(config.dotenv(args.env)), rules(args.rules))
    now = time.time()

    def show(rows):
        """A JSON list of all rows, an object a line, fetched a partition at a time."""
        print("[", end="")
        for i, r in enumerate(rows.toLocalIterator()):
            print(",\n " if i else "", json.dumps(r.asDict(), default=str, ensure_ascii=False), sep="", end="")
        print("]")

    if args.command == "status":
        show(kb.domain_status().orderBy("domain"))
    elif args.command == "diff":
        show(kb.status().where("state != 'ok'").orderBy("path"))
    elif args.command == "doctor":
        found = kb.doctor()
        print(json.dumps(found, indent=1))
        return int(bool(found))
    elif args.command == "reindex":
        print(json.dumps(kb.reindex(now, args.force)))
    elif args.command == "stale":
        show(kb.stale_files(now).orderBy("path"))
    elif args.command == "sessions":
        for r in kb.store.sessions(now).orderBy("session_id").collect():
            print(f"{r.session_id}\t{r.turns} turns\t{ago(now - r.last_active)}{' (expired)' if r.expired else ''}")
    elif args.command == "manifest":
        print(kb.manifest())
    elif args.command == "ask":
        out = Assistant(kb).ask(" ".join(args.words), now=now)
        print(out["text"])
        print("\n".join(["", f"Confidence: {out['confidence']}", *(f"- {s['path']} ({s['score']:.2f})" for s in out["sources"]), *(f"! {w}" for w in out["warnings"])]))
    elif args.command == "context":
        print(json.dumps(ContextStore(kb).sync()))
    elif args.command == "domains":
        print(json.dumps(Assistant(kb).list_domains(), ensure_ascii=False, indent=1))
    else:
        engine = api.Engine(spark)
        path, *question = args.words
        asked = " ".join(question)
        # nobody can be asked back here: without a period in the question all of them count
        known = {} if planner.PERIOD_WORD.search(asked) else {"time_range": "all"}
        out = engine.query_data(path, asked, known) if args.command == "query" else engine.analyze_file(path)
        print(json.dumps(out, default=str, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
