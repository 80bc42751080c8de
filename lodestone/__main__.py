"""Command line: ``python -m lodestone <command>``.

queries                         names of the registered queries
run NAME SF_DIR [OUT]           a query's rows, printed or written as Parquet
parse PATH OUT                  chunks of all files below a path, as Parquet
check ITEMS RELATIONS VOCABULARY   findings of a store (Parquet tables, a vocabulary file); exit 1 with errors
publish PLAN ITEMS RELATIONS OUT   the sections of a plan file as Markdown and HTML
"""

from __future__ import annotations

import sys

from lodestone.operators import checks
from lodestone.plans import files, render, sections
from lodestone.queries import QUERIES
from lodestone.session import session
from lodestone.sources import readers


def vocabulary(path: str) -> checks.Vocabulary:
    data = dict(files.load(path))  # type: ignore[call-overload]
    return checks.Vocabulary(item_types=data.get("item_types", []), attributes=[checks.Attribute(**a) for a in data.get("attributes", [])], relations=[checks.Relation(**r) for r in data.get("relations", [])], warn_if_no_upstream=data.get("warn_if_no_upstream", {}))


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("", [])
    if command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    needs = {"run": 2, "parse": 2, "check": 3, "publish": 4}
    if command not in needs or len(rest) < needs[command]:
        print(__doc__)
        return 2
    spark = session("lodestone")
    if command == "run":
        out = QUERIES[rest[0]](spark, rest[1])
        out.write.mode("overwrite").parquet(rest[2]) if len(rest) > 2 else out.show(100, truncate=False)
        return 0
    if command == "parse":
        readers.read_files(spark, rest[0]).write.mode("overwrite").parquet(rest[1])
        return 0
    items, relations = (spark.read.parquet(p) for p in (rest[1:3] if command == "publish" else rest[:2]))
    if command == "check":
        found = checks.in_report_order(checks.validate(items, relations, vocabulary(rest[2]))).collect()
        for r in found:
            print(f"{r['level']} {r['code']} {r['target']}: {r['message']}")
        return int(any(r["level"] == "error" for r in found))
    plan = dict(files.load(rest[0]))  # type: ignore[call-overload]
    parts = []
    for s in plan.get("sections", []):
        table = sections.compile_section({k: v for k, v in s.items() if k != "heading"}, items, relations)
        parts.append({"title": s.get("heading", s["kind"]), "table": table, "order": table.columns[:1]})
    render.publish([{"name": plan.get("name", "report"), "phase": plan.get("phase", "reports"), "sections": parts}], rest[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
