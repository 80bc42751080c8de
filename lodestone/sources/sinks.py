"""Writers: stores by type, findings, invoices, retention."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_store(items: DataFrame, path: str) -> None:
    """Only the types present are rewritten (dynamic partition overwrite)."""
    items.sortWithinPartitions("type", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(path)


def findings_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("level", "code", "target", "message")).alias("value"))


def sarif(findings: DataFrame, limit: int = 10_000) -> str:
    """A SARIF log of at most ``limit`` findings, a report for people."""
    rows = findings.orderBy(F.col("level") != "error", "code", "target").limit(limit).collect()
    results = [{"ruleId": r["code"], "level": "error" if r["level"] == "error" else "warning", "message": {"text": f"{r['target']}: {r['message']}"}} for r in rows]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "lodestone"}}, "results": results}]}, ensure_ascii=False)


def invoice_csv(lines: DataFrame) -> bytes:
    """One invoice as CSV: fixed columns, unit price with four decimals, CRLF, values quoted where
    they must be, cp932; unencodable text raises."""
    columns = ["tenant", "kind", "quantity", "unit_price", "amount"]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    for r in lines.orderBy("tenant", "kind").select(*columns).collect():
        writer.writerow([r["tenant"], r["kind"], r["quantity"], f"{r['unit_price']:.4f}", r["amount"]])
    return out.getvalue().encode("cp932")


def write_each(tables: dict[str, DataFrame], folder: str) -> list[tuple[str, str, str, str]]:
    """Write each table below ``folder``; one that fails gives a finding (P011) and the rest go on."""
    told = []
    for name, table in tables.items():
        try:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        except Exception as e:  # one bad table must not stop the rest
            told.append(("error", "P011", name, str(e).split("\n")[0]))
    return told


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """A manifest of captures after a new one: new rows (path, digest, captured) replace old ones."""
    both = old.unionByName(new)
    columns = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "captured").alias("r")).select(key, "r.*")


def mermaid(edges: DataFrame, limit: int = 2000) -> str:
    """A flow chart of at most ``limit`` edges (from, to, label), a figure for people."""
    rows = edges.orderBy("from", "to", "label").limit(limit).collect()
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["from"], r["to"])}))}
    said = lambda x: str(x).replace('"', "'")
    lines = [f'  {i}["{said(n)}"]' for n, i in names.items()] + [f"  {names[r['from']]} -->{f'|{said(r["label"])}|' if r['label'] else ''} {names[r['to']]}" for r in rows]
    return "\n".join(["flowchart LR", *lines])


def retain(df: DataFrame, ts: str, years: int, today: str) -> DataFrame:
    """Rows younger than ``years`` before ``today``."""
    return df.where(F.col(ts) >= F.add_months(F.lit(today).cast("date"), -12 * years))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
