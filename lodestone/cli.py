"""Command line: index a folder, search and ask it, list symbols, evaluate, grade and compare answer runs.

Flags beat the environment, that the defaults. Ends with 0, also where nothing was found, and with 1 for errors
that the caller can mend.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from pathlib import Path

from .operators import evaluation as measures
from .service import SearchSettings, Service
from .session import build_session
from .sources import review
from .sources.repository import SKIPPED, read_repository
from .sources.store import IndexMismatch, IndexStore

FOLDER = ".lodestone"


def setting(flag, name: str, default, kind=str):
    """A flag, else the environment's LODESTONE_<name>, else the default."""
    told = os.environ.get(f"LODESTONE_{name}")
    return flag if flag is not None else kind(told) if told not in (None, "") else default


def _plugged(path: str | None):
    """What ``module:name`` names, called."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--index")
    p.add_argument("--embedder", help="module:name of an embedder")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--rebuild", action="store_true")
    search, ask = sub.add_parser("search"), sub.add_parser("ask")
    for a in (index, search, ask, symbols := sub.add_parser("symbols"), ev := sub.add_parser("eval")):
        a.add_argument("path")
    for a, text in ((search, "query"), (ask, "question")):
        a.add_argument(text)
        a.add_argument("-k", type=int)
        a.add_argument("--mode")
        a.add_argument("--graph", action=argparse.BooleanOptionalAction, default=True)
        a.add_argument("--hops", type=int)
        a.add_argument("--weight", type=float)
        a.add_argument("--json", action="store_true")
    ask.add_argument("--generator", help="module:name of a generator")
    ask.add_argument("--budget", type=int, default=12_000)
    ask.add_argument("--quoting", action="store_true")
    symbols.add_argument("--prefix", default="")
    symbols.add_argument("--kind")
    symbols.add_argument("--limit", type=int, default=200)
    ev.add_argument("questions")
    ev.add_argument("--split", choices=review.SPLITS)
    grids = ev.add_mutually_exclusive_group()
    grids.add_argument("--sweep", action="store_true")
    grids.add_argument("--graph-sweep", action="store_true")
    grids.add_argument("--candidates")
    grade = sub.add_parser("grade")
    grade.add_argument("review")
    grade.add_argument("grades")
    grade.add_argument("--results", default="")
    grade.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    compare = sub.add_parser("compare-answers")
    compare.add_argument("base")
    compare.add_argument("new")
    compare.add_argument("criteria")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return {"grade": _grade, "compare-answers": _compare}.get(args.command, _indexed)(args)
    except (ValueError, LookupError, IndexMismatch, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _session():
    return build_session(master=None if os.environ.get("SPARK_MASTER") else "local[*]")


def _grade(args) -> int:
    grades, ungraded, problems = review.read_review(Path(args.review).read_text(encoding="utf-8"))
    if problems:
        raise ValueError("; ".join(problems))
    if bad := [m for m in args.meta if "=" not in m]:
        raise ValueError(f"not KEY=VALUE: {bad}")
    review.write_grades(args.grades, args.results or args.review, {q: g for q, (g, _) in grades.items()}, dict(m.split("=", 1) for m in args.meta))
    print(f"{len(grades)} graded, {len(ungraded)} open")
    return 0


RUN = "qid string, negative boolean, status string, grade string, cited_relevant boolean, context array<string>"


def _compare(args) -> int:
    from .evaluation import compare_runs

    spark = _session()
    base, new = (review.load_results(spark, p, RUN) for p in (args.base, args.new))
    judged, decision, lost = compare_runs(base, new, review.load_criteria(args.criteria))
    print(measures.table([r.asDict() for r in judged.orderBy("criterion").collect()], ["criterion", "numerator", "denominator", "op", "limit", "over", "verdict"]))
    for r in lost.orderBy("qid").collect():
        print(f"{r.qid}: {r.state}")
    print(decision.head()["decision"])
    return 0


def _indexed(args) -> int:
    spark = _session()
    root = Path(args.path).resolve()
    store = IndexStore(spark, setting(args.index, "INDEX", root / FOLDER), _plugged(setting(args.embedder, "EMBEDDER", None)))
    if args.command == "index":
        stats = store.build(read_repository(spark, root, skip=SKIPPED | {FOLDER}), str(root), args.rebuild)
        print(json.dumps(vars(stats)))
        return 0
    service = Service(store)
    if args.command == "symbols":
        print(json.dumps(service.list_symbols(args.prefix, args.kind, args.limit), indent=1))
        return 0
    if args.command == "eval":
        return _evaluate(service, args)
    hops = setting(args.hops, "HOPS", 2, int) if args.graph else 0
    settings = SearchSettings(setting(args.mode, "MODE", "dense"), hops, setting(args.weight, "WEIGHT", 2.0, float))
    text = args.query if args.command == "search" else args.question
    asked = spark.createDataFrame([(1, text)], "qid long, query string")
    if args.command == "search":
        hits = [r.asDict(recursive=True) for r in service.search(asked, setting(args.k, "K", 10, int), settings).orderBy("hit_rank").collect()]
        print(json.dumps({"settings": settings.describe(), "hits": hits}) if args.json else "\n".join(f"{h['hit_rank']:3d} {h['score']:.6f} {h['chunk_id']}:{h['first_line']}-{h['last_line']}" for h in hits))
        return 0
    generator = _plugged(setting(args.generator, "GENERATOR", None))
    if generator is None:
        raise ValueError("ask needs a generator (module:name)")
    answer = service.ask(asked, generator, setting(args.k, "K", 8, int), settings, args.budget, args.quoting).head().asDict(recursive=True)
    if args.json:
        print(json.dumps(answer))
    else:
        print({"abstained": "NOT FOUND", "mixed": "PARTLY FOUND"}.get(answer["status"], "ANSWER"), answer["text"], sep="\n")
        print("cited: " + (", ".join(answer["citations"]) or "none") + ("; unknown: " + ", ".join(answer["unknown_tags"]) if answer["unknown_tags"] else ""))
    return 0


def _evaluate(service: Service, args) -> int:
    from . import evaluation

    questions = evaluation.numbered(review.load_questions(service.store.spark, args.questions))
    questions = questions.where(questions["split"] == args.split) if args.split else questions
    evaluation.check_relevant(service, questions)
    configs, rules = (measures.fusion_grid(), []) if args.sweep else (measures.graph_grid(), []) if args.graph_sweep else ([measures.BASES[n] for n in ("bm25-only", "dense-only", "default")], [])
    if args.candidates:
        configs, rules = review.load_configs(args.candidates)
    print(evaluation.report(evaluation.retrieval(service, questions, configs), questions, configs, rules))
    return 0


if __name__ == "__main__":
    sys.exit(main())
