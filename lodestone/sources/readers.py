"""Readers of source files into anchored chunks: csv, markdown, html, DDL, Python, Java, Office.

Files are read with the binaryFile source and parsed one file a row inside mapInPandas; a file that
cannot be read gives an error row (code P010), not a failed job."""

from __future__ import annotations

import ast
import csv
import html
import io
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import BLOCK_TAGS, DROPPED_TAGS
from lodestone.sources import office

SCHEMA = "file string, anchor string, at string, heading string, kind string, rows array<array<string>>, text string, code string"
#: Files of a Python batch, and bytes of files after which what was found in them is given out.
BATCH_ROWS, GIVEN_BYTES = 512, 1 << 22
SKIPPED = r"(^|/)(~\$|\.|node_modules/|__pycache__/)"
Chunk = tuple[str, str, str, list[list[str]] | None, str | None]  # at, heading, kind, rows, text


def decode(content: bytes) -> str:
    """BOM, then UTF-8, then cp932."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(bom):
            return content.decode(name)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp932")


def garbled(text: str) -> bool:
    """Whether three tenths of the characters beyond ASCII are such as wrong decoding gives: half-width
    kana, replacement marks, controls and private ones."""
    wide = [c for c in text if c > "\x7f"]
    odd = [c for c in wide if "\uff61" <= c <= "\uff9f" or c == "\ufffd" or "\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff"]
    return bool(wide) and len(odd) >= 0.3 * len(wide)


def html_text(text: str) -> str:
    """Visible text of html: headings as # lines, blocks as lines, all entities decoded."""
    t = re.sub(rf"(?is)<({'|'.join(DROPPED_TAGS)})\b.*?</\1>", "", text)
    t = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: f"\n\n{'#' * int(m[1])} {re.sub('<[^>]+>', '', m[2]).strip()}\n\n", t)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = re.sub(rf"(?i)</(?:{BLOCK_TAGS})>", "\n", t)
    t = html.unescape(re.sub(r"<[^>]+>", "", t))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in t.split("\n"))).strip()


def read_html(text: str) -> Iterator[Chunk]:
    yield from read_markdown(html_text(text))


def delimiter_of(text: str) -> str | None:
    """The one delimiter under which at least 0.8 of the rows have the modal number (over one) of
    columns; None for none or a tie."""
    best: list[tuple[float, int, str]] = []
    for d in ",\t;|":
        sizes = Counter(len(r) for r in csv.reader(io.StringIO(text), delimiter=d) if r)
        if sizes:
            n, c = sizes.most_common(1)[0]
            share = c / sum(sizes.values())
            if n > 1 and share >= 0.8:
                best.append((share, n, d))
    best.sort(reverse=True)
    if not best or (len(best) > 1 and best[0][:2] == best[1][:2]):
        return None
    return best[0][2]


def read_csv(text: str, tab: bool = False) -> Iterator[Chunk]:
    d = "\t" if tab else delimiter_of(text)
    if d is None:
        yield "1", "", "undecided", None, text, "P018"
        return
    if garbled(text):
        yield "1", "", "finding", None, "the encoding is a guess", "P018"
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=d) if any(x.strip() for x in r)]
    width = max(map(len, rows), default=0)
    ragged = any(len(r) != width for r in rows)
    yield "1", "ragged" if ragged else "", "rows", [r + [""] * (width - len(r)) for r in rows], None


def read_markdown(text: str) -> Iterator[Chunk]:
    """Sections at headings outside code fences; what comes before the first is kept."""
    fence, heading, start, body = "", "", 1, []
    for i, line in enumerate(text.splitlines(), 1):
        mark = re.match(r"^\s*(```+|~~~+)", line)
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1]
        h = None if fence or mark else re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)
        if h:
            if "".join(body).strip():
                yield str(start), heading, "text", None, "\n".join(body).strip()
            heading, start, body = h[2], i, []
        else:
            body.append(line)
    if heading or "".join(body).strip():
        yield str(start), heading, "text", None, "\n".join(body).strip()


def split_sql(text: str) -> list[str]:
    """Statements at semicolons outside quotes and comments; comments are dropped."""
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|;|[^;'\"`/-]+|.", re.S)
    out, now = [], []
    for m in token.finditer(text):
        s = m.group()
        if s == ";":
            out.append("".join(now).strip())
            now = []
        elif not s.startswith(("--", "/*")):
            now.append(s)
    return [s for s in [*out, "".join(now).strip()] if s]


def _top_level(body: str) -> list[str]:
    depth, parts, now, quote = 0, [], [], ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if c == "," and not depth and not quote:
            parts.append("".join(now).strip())
            now = []
        else:
            now.append(c)
    return [p for p in [*parts, "".join(now).strip()] if p]


def unquote(name: str) -> str:
    return ".".join(p.strip().strip('`"[]') for p in name.split("."))


_COLUMN = re.compile(r"^(\S+)\s+([A-Za-z]\w*(?:\s+(?:varying|precision))?(?:\s*\([^)]*\))?(?:\s+with(?:out)?\s+time\s+zone)?)\s*(.*)$", re.I | re.S)


def read_ddl(text: str) -> Iterator[Chunk]:
    """Tables (columns with vendor types as written), constraints, indexes, comments; other
    statements are counted."""
    other = 0
    for k, s in enumerate(split_sql(text), 1):
        t = re.match(r"create\s+(?:\w+\s+)*?table\s+(?:if\s+not\s+exists\s+)?([^\s(]+)\s*\((.*)\)[^)]*$", s, re.I | re.S)
        i = re.match(r"create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(\S+)\s+on\s+([^\s(]+)[^(]*\((.*?)\)(.*)$", s, re.I | re.S)
        c = re.match(r"comment\s+on\s+(table|column)\s+(\S+)\s+is\s+'((?:[^']|'')*)'", s, re.I)
        if t:
            rows = [["name", "type", "rest"]]
            for part in _top_level(t[2]):
                if re.match(r"(constraint|primary\s+key|foreign\s+key|unique|check|index|key)\b", part, re.I):
                    rows.append(["", "", part])
                elif m := _COLUMN.match(part):
                    rows.append([unquote(m[1]), m[2], m[3].strip()])
                else:
                    rows.append([unquote(part), "", ""])
            yield str(k), unquote(t[1]), "table", rows, None
        elif i:
            yield str(k), unquote(i[2]), "index", [["table", "columns", "unique", "rest"], [unquote(i[3]), i[4].strip(), "○" if i[1] else "", i[5].strip()]], None
        elif c:
            yield str(k), unquote(c[2]), "comment", None, c[3].replace("''", "'")
        else:
            other += 1
    if other:
        yield "0", "", "other", None, str(other)


def read_python(text: str) -> Iterator[Chunk]:
    """Imports, constants, functions, classes with methods, what is raised, arguments of argparse."""
    tree = ast.parse(text)
    imports = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    imports += [f"{'.' * n.level}{n.module or ''}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names]
    if imports:
        yield "1", "imports", "rows", [[x] for x in imports], None

    def row(f: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
        raised = sorted({ast.unparse(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for n in ast.walk(f) if isinstance(n, ast.Raise) and n.exc})
        return [f.name, ast.unparse(f.args), ast.unparse(f.returns) if f.returns else "", ", ".join(raised), ", ".join(map(ast.unparse, f.decorator_list)), (ast.get_docstring(f) or "").split("\n")[0]]

    head = ["name", "arguments", "returns", "raises", "decorators", "summary"]
    values = [[t.id, ast.unparse(n.value)] for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper()]
    if values:
        yield "1", "constants", "rows", [["name", "value"], *values], None
    functions = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if functions:
        yield str(functions[0].lineno), "functions", "rows", [head, *map(row, functions)], None
    for c in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        methods = [row(n) for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        fields = [[n.target.id, ast.unparse(n.annotation)] for n in c.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
        yield str(c.lineno), c.name, "class", [head, *methods, *([["field", "type"], *fields] if fields else [])], ast.get_docstring(c)
    args = [[ast.unparse(a) for a in n.args] for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "add_argument"]
    if args:
        yield "1", "arguments", "rows", args, None


_JAVA_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def read_java(text: str) -> Iterator[Chunk]:
    """Package, imports, and the declarations of each brace level with their annotations."""
    clean = _JAVA_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group()[0] == "/" else m.group()[0] + re.sub(r"[^\n]", "_", m.group()[1:-1]) + m.group()[-1], text)
    if p := re.search(r"^\s*package\s+([\w.]+)\s*;", clean, re.M):
        yield "1", p[1], "package", None, None
    imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", clean, re.M)
    if imports:
        yield "1", "imports", "rows", [[x] for x in imports], None
    owner: list[tuple[int, str]] = []
    depth, start, rows = 0, 0, {}
    for m in re.finditer(r"[{};]", clean):
        at, head = m.start(), " ".join(clean[start : m.start()].split())
        start = m.end()
        if m.group() == "}":
            depth -= 1
            while owner and owner[-1][0] > depth:
                owner.pop()
            continue
        inside = owner and owner[-1][0] == depth or depth == 0
        kind = re.search(r"\b(class|interface|enum|record)\s+(\w+)", head)
        if kind and m.group() == "{":
            rows.setdefault(kind[2], [clean[:at].count("\n") + 1, head])
            owner.append((depth + 1, kind[2]))
        elif inside and owner and head and not head.startswith(("package", "import")):
            method = re.search(r"(\w+)\s*\(", re.sub(r"@\w+(?:\([^)]*\))?", "", head))
            if m.group() == "{" or method or "=" in head or re.search(r"\w\s+\w+$", head):
                rows.setdefault(owner[-1][1], [0, ""]).append([method[1] if method else head.split("=")[0].split()[-1], head])
        if m.group() == "{":
            depth += 1
    for name, (line, head, *members) in rows.items():
        yield str(line), name, "class", [["member", "declaration"], *members], head


READERS: dict[str, Callable[[str], Iterator[Chunk]]] = {
    "csv": read_csv, "tsv": lambda t: read_csv(t, True), "md": read_markdown, "txt": read_markdown, "html": read_html, "htm": read_html, "sql": read_ddl, "ddl": read_ddl, "py": read_python, "java": read_java,
}


#: Readers of bytes.
PACKAGES: dict[str, Callable[[bytes], Iterator[office.Chunk]]] = {"xlsx": office.read_workbook, "xlsm": office.read_workbook, "docx": office.read_document, "docm": office.read_document, "pptx": office.read_presentation, "pptm": office.read_presentation}


def plan_scan(files: DataFrame, paths: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files (path) to read, and findings (code, target): P002 outputs that would share a name, P007
    paths under which nothing is, P014 exclude patterns and how many files each hides (zero too)."""
    kept = files.where(~F.col("path").rlike(SKIPPED))
    for pattern in exclude:
        kept = kept.where(~F.col("path").rlike(pattern))
    one = files.agg(*(F.count_if(F.contains("path", F.lit(p))).alias(f"p{i}") for i, p in enumerate(paths)), *(F.count_if(F.col("path").rlike(x)).alias(f"x{i}") for i, x in enumerate(exclude)))
    rows = [F.struct(F.lit("P007").alias("code"), F.when(F.col(f"p{i}") == 0, p).alias("target")) for i, p in enumerate(paths)]
    rows += [F.struct(F.lit("P014").alias("code"), F.concat(F.lit(f"{x}: "), F.col(f"x{i}").cast("string")).alias("target")) for i, x in enumerate(exclude)]
    told = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("target is not null")
    name = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    clash = kept.groupBy(folder.alias("f"), name.alias("n")).agg(F.count("*").alias("k")).where("k > 1").select(F.lit("P002").alias("code"), F.concat_ws("/", "f", "n").alias("target"))
    return kept, told.union(clash)


def read_files(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """Anchored chunks of every known file below ``path``; unknown kinds give P001 rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for pattern in [SKIPPED, *(exclude or [])]:
        files = files.where(~F.col("path").rlike(pattern))
    return parse_files(files.select("path", "content"))


def parse_files(files: DataFrame) -> DataFrame:
    """path, content -> chunks, given out a file at a time from batches of few files."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in frames:
            out, size = [], 0
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                size += len(content)
                if out and size >= GIVEN_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], len(content)
                ending = path.rsplit(".", 1)[-1].lower()
                reader, package = READERS.get(ending), PACKAGES.get(ending)
                if reader is None and package is None:
                    out.append((path, None, None, None, "error", None, None, "P001"))
                    continue
                try:
                    found = list(package(bytes(content)) if package else reader(decode(bytes(content))))
                except Exception as e:  # one bad file must not stop the rest
                    out.append((path, None, None, None, "error", None, str(e), "P010"))
                    continue
                if not any(len(c) < 6 or c[5] is None or c[2] != "finding" for c in found):
                    out.append((path, None, None, None, "error", None, None, "P009"))
                out += [(path, f"{kind[0]}{k}", at, heading, kind, rows, text, code[0] if code else None) for k, (at, heading, kind, rows, text, *code) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, SCHEMA)


def fingerprints(files: DataFrame) -> DataFrame:
    """path and the first 12 hex digits of its content's SHA-256."""
    return files.select("path", F.substring(F.sha2("content", 256), 1, 12).alias("digest"))
