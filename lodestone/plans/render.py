"""Reports for people: Markdown and HTML of compiled sections, by phase folder with an index."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a printed section; the store has the rest, and the table says so.
ROWS = 5000

_SCRIPT = """<script>
document.querySelectorAll("table").forEach(t=>{const q=document.createElement("input");q.placeholder="filter";t.before(q);
q.oninput=()=>t.querySelectorAll("tbody tr").forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(q.value.toLowerCase()));
t.querySelectorAll("th").forEach((h,i)=>h.onclick=()=>{const b=t.tBodies[0],s=h.dataset.s=h.dataset.s==="1"?"-1":"1";
[...b.rows].sort((x,y)=>s*x.cells[i].textContent.localeCompare(y.cells[i].textContent,undefined,{numeric:true})).forEach(r=>b.append(r))})});
</script>"""


def cells(table: DataFrame, order: Sequence[str], limit: int = ROWS) -> tuple[list[list[str]], int]:
    """The first rows in order as texts, and how many there are."""
    shown = table.orderBy(*order).limit(limit).select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in table.columns)).collect()
    total = len(shown) if len(shown) < limit else table.count()
    return [list(r) for r in shown], total


def markdown(title: str, columns: Sequence[str], rows: Sequence[Sequence[str]], total: int) -> str:
    mask = lambda x: x.replace("|", "\\|").replace("\n", "<br>") or "―"
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(mask, r)) + " |" for r in rows)]
    return "\n".join([*lines, *(["", f"{total - len(rows)} more rows"] if total > len(rows) else []), ""])


def page(title: str, columns: Sequence[str], rows: Sequence[Sequence[str]], total: int) -> str:
    """A section as HTML; its rows can be filtered and sorted."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(x) or '―'}</td>" for x in r) + "</tr>" for r in rows)
    more = f"<p>{total - len(rows)} more rows</p>" if total > len(rows) else ""
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}</section>"


def publish(reports: Sequence[Mapping], folder: str) -> list[str]:
    """Write ``name.md`` and ``name.html`` of each report (name, phase, sections: title, table, order)
    into its phase's folder, and an index. Sections without rows are left out, with a line that says so."""
    index = []
    for report in reports:
        out, web = [f"# {report['name']}", ""], []
        for s in report["sections"]:
            rows, total = cells(s["table"], s["order"])
            if not rows:
                out.append(f"{s['title']}: no rows\n")
                continue
            out.append(markdown(s["title"], s["table"].columns, rows, total))
            web.append(page(s["title"], s["table"].columns, rows, total))
        place = Path(folder) / str(report["phase"])
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{report['name']}.md").write_text("\n".join(out), encoding="utf-8")
        (place / f"{report['name']}.html").write_text(f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(report['name'])}</title>{''.join(web)}{_SCRIPT}", encoding="utf-8")
        index.append(f"{report['phase']}/{report['name']}")
    Path(folder, "index.md").write_text("\n".join(["# Reports", "", *(f"- [{x}]({x}.md)" for x in sorted(index)), ""]), encoding="utf-8")
    return sorted(index)
