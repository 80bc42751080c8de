"""Stores and printed reports read back: JSON (and YAML) files of items and relations, Markdown tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.files import yaml

SCHEMA = "file string, line long, kind string, id string, type string, status string, `from` string, `to` string, ord int, attrs map<string,string>, lists map<string,array<string>>, code string"
RESERVED = ("id", "type", "status", "from", "to", "order")


def _parsed(path: str, text: str) -> object:
    if path.endswith((".yml", ".yaml")):
        if yaml is None:
            raise ValueError("no YAML reader")
        return yaml.safe_load(text)
    return json.loads(text)


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def records(path: str, text: str) -> Iterator[tuple]:
    """Rows of SCHEMA of one file: an array of mappings, each an item or, with from and to, a relation.
    What is neither is a row with the code E000."""
    bad = lambda k: (path, k, "error", None, None, None, None, None, None, None, None, "E000")
    try:
        data = _parsed(path, text)
    except ValueError:
        yield bad(0)
        return
    except Exception as e:  # the YAML reader's own errors
        if yaml is not None and isinstance(e, yaml.YAMLError):
            yield bad(0)
            return
        raise
    if data is None:
        return
    if not isinstance(data, list):
        yield bad(0)
        return
    for k, x in enumerate(data, 1):
        if not isinstance(x, Mapping):
            yield bad(k)
            continue
        own = {str(n): v for n, v in x.items() if n not in RESERVED and v is not None}
        lists = {n: [_text(i) for i in v] for n, v in own.items() if isinstance(v, list)}
        attrs = {n: _text(v) for n, v in own.items() if not isinstance(v, (list, Mapping))}
        named = [None if x.get(n) is None else str(x[n]) for n in RESERVED[:5]]
        order = x.get("order")
        yield (path, k, "relation" if "from" in x or "to" in x else "item", *named, order if isinstance(order, int) else None, attrs, lists, None)


def load_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, relations and findings (level, code, target, message) of all store files below a folder.
    A file that cannot be read is a finding; the others are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(r"\.(json|ya?ml)$")).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "line", "kind", "id", "type", "status", "from", "to", "ord", "attrs", "lists", "code"]
        for pdf in frames:
            rows = [r for path, content in zip(pdf["path"], pdf["content"], strict=True) for r in records(path, bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32"})

    rows = files.mapInPandas(run, SCHEMA)
    items = rows.where("kind = 'item'").select("id", "type", "status", "attrs", "lists", "file")
    relations = rows.where("kind = 'relation'").select("type", "from", "to", "ord", "status", "attrs", "file")
    findings = rows.where("code is not null").select(F.lit("error").alias("level"), "code", F.concat_ws("#", "file", F.col("line").cast("string")).alias("target"), F.lit("no mapping").alias("message"))
    return items, relations, findings


def markdown_tables(text: str) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(heading, columns, rows) of the tables of a printed report; escaped bars and line breaks are
    turned back, cells that stand for nothing are empty. Lines in code fences are no tables."""
    heading, held, fence = "", [], False

    def cells(line: str) -> list[str]:
        parts = re.split(r"(?<!\\)\|", line.strip().strip("|") if not line.rstrip().endswith("\\|") else line.strip()[1:])
        return ["" if (c := p.strip().replace("\\|", "|").replace("<br>", "\n")) == "―" else c for p in parts]

    for line in [*text.split("\n"), ""]:
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        if not fence and line.startswith("|"):
            held.append(line)
            continue
        if len(held) > 1 and re.fullmatch(r"\|(\s*:?-+:?\s*\|)+\s*", held[1]):
            yield heading, cells(held[0]), [cells(x) for x in held[2:]]
        held = []
        m = re.match(r"#{1,6}\s+(.+?)\s*$", line) if not fence else None
        if m:
            heading = m[1]
