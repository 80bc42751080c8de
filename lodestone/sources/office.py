"""Readers of Office packages (xlsx, docx, pptx): zip and XML only, one file a call.

Each gives chunks (at, heading, kind, rows, text, code); a chunk with a code is a finding about the
file. A part that cannot be read costs its own chunk only.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

Chunk = tuple[str, str, str, "list[list[str]] | None", "str | None", "str | None"]
Cell = tuple[int, int]

#: Cells this far apart are one region; a region of this area with fewer than one
#: filled cell in SPARSE is a list of cells; namespaces and date formats of the file format.
GAP, SPARSE, SPARSE_AREA = 2, 8, 100
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
PROPERTIES = ("creator", "lastModifiedBy", "title", "subject", "description", "created", "modified")


def finding(code: str, at: str, text: str) -> Chunk:
    return (at, "", "finding", None, text, code)


class Package:
    """Parts of a zip, their relations, and what could not be read."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.broken: list[tuple[str, str]] = []

    def xml(self, part: str) -> ET.Element | None:
        """The root of a part; None (and a note) if it is missing or damaged."""
        try:
            return ET.fromstring(self.zip.read(part))
        except (KeyError, ET.ParseError, zipfile.BadZipFile, zlib.error) as e:
            self.broken.append((part, str(e)))
            return None

    def relations(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, last word of the type, target part, outside) of a part."""
        folder, name = posixpath.split(part)
        path = f"{folder}/_rels/{name}.rels".lstrip("/")
        root = self.xml(path) if path in self.names else None
        out = []
        for r in root if root is not None else ():
            outside = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not outside:
                target = posixpath.normpath(posixpath.join("/", folder, target)).lstrip("/")
            out.append((r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], target, outside))
        return out

    def of_kind(self, part: str, *kinds: str) -> list[str]:
        return [t for _, k, t, outside in self.relations(part) if k in kinds and not outside and t in self.names]

    def common(self, main: str) -> Iterator[Chunk]:
        """Properties, macros, outside references, images without a reader, damaged parts."""
        core = self.xml("docProps/core.xml") if "docProps/core.xml" in self.names else None
        told = [f"{e.tag.rsplit('}', 1)[-1]}: {e.text}" for e in (core if core is not None else ()) if e.tag.rsplit("}", 1)[-1] in PROPERTIES and e.text]
        if told:
            yield finding("P005", "docProps", "\n".join(told))
        if any(n.endswith("vbaProject.bin") for n in self.names):
            yield finding("P006", main, "macros are in the file")
        if any("/media/" in n for n in self.names):
            yield finding("P016", main, f"images not read: {sum('/media/' in n for n in self.names)}")
        for part, why in self.broken:
            yield finding("P008" if "drawing" in part or "chart" in part or "diagram" in part else "P012", part, why)


# cells and regions


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_of(ref: str) -> Cell:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    if not m:
        raise ValueError(f"no cell: {ref}")
    column = 0
    for ch in m[1]:
        column = column * 26 + ord(ch) - 64
    return int(m[2]), column


def regions(cells: dict[Cell, str]) -> list[list[Cell]]:
    """Cells connected over at most GAP rows and columns, in reading order of their corners."""
    left, out = set(cells), []
    while left:
        seed = left.pop()
        found, open_ = [seed], [seed]
        while open_:
            r, c = open_.pop()
            near = [(r + i, c + j) for i in range(-GAP, GAP + 1) for j in range(-GAP, GAP + 1)]
            hit = [x for x in near if x in left]
            left.difference_update(hit)
            open_ += hit
            found += hit
        out.append(sorted(found))
    return sorted(out, key=lambda g: (g[0][0], min(c for _, c in g)))


@dataclass
class Frame:
    """The rectangle around a region: rows and columns between its ends, empty ones included."""

    top: int
    left: int
    bottom: int
    right: int
    filled: int

    @classmethod
    def of(cls, region: list[Cell]) -> Frame:
        columns = [c for _, c in region]
        return cls(region[0][0], min(columns), region[-1][0], max(columns), len(region))

    @property
    def area(self) -> int:
        return (self.bottom - self.top + 1) * (self.right - self.left + 1)

    @property
    def sparse(self) -> bool:
        return self.area >= SPARSE_AREA and self.area > self.filled * SPARSE

    @property
    def at(self) -> str:
        start, end = f"{column_name(self.left)}{self.top}", f"{column_name(self.right)}{self.bottom}"
        return start if start == end else f"{start}:{end}"


def fill_merged(cells: dict[Cell, str], merged: list[str]) -> None:
    """Values of cells merged over rows are given to all of them, down to the last filled row; cells
    merged within one row stay as they are."""
    last = max((r for r, _ in cells), default=0)
    for area in merged:
        a, _, b = area.partition(":")
        (top, left), (bottom, _) = cell_of(a), cell_of(b or a)
        value = cells.get((top, left))
        if value and bottom > top:
            for row in range(top + 1, min(bottom, last) + 1):
                cells.setdefault((row, left), value)


# values


def shown_number(raw: str, fmt: int | str | None) -> str:
    """A stored number as a sheet shows it: dates, elapsed hours, shares, else 15 digits."""
    x = float(raw)
    code = fmt if isinstance(fmt, str) else ""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code).lower()
    if "[h" in bare or fmt == 46:
        minutes = int(round(x * 1440))
        return f"{minutes // 60}:{minutes % 60:02d}"
    if (isinstance(fmt, int) and fmt in DATE_FORMATS) or re.search(r"[ymdhs]", bare):
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(x * 86400))
        if x < 1:
            return moment.strftime("%H:%M:%S" if moment.second else "%H:%M")
        if not (moment.hour or moment.minute or moment.second):
            return moment.strftime("%Y-%m-%d")
        return moment.strftime("%Y-%m-%d %H:%M:%S" if moment.second else "%Y-%m-%d %H:%M")
    if fmt in (9, 10) or "%" in bare:
        digits = 2 if fmt == 10 else len(m[1]) if (m := re.search(r"\.(0+)%", bare)) else 0
        return f"{x * 100:.{digits}f}%"
    return f"{x:.15g}"


def _runs(element: ET.Element, ns: str) -> str:
    return "".join(t.text or "" for t in element.iter(f"{ns}t"))


@dataclass
class Sheet:
    cells: dict[Cell, str] = field(default_factory=dict)
    notes: dict[str, list[list[str]]] = field(default_factory=dict)  # kind -> (cell, text)
    merged: list[str] = field(default_factory=list)
    hidden: int = 0

    def note(self, kind: str, ref: str, text: str) -> None:
        self.notes.setdefault(kind, []).append([ref, text])


def _formats(root: ET.Element | None) -> list[int | str]:
    """The number format of each cell style."""
    if root is None:
        return []
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in root.iter(f"{S}numFmt")}
    xfs = root.find(f"{S}cellXfs")
    return [own.get(n, n) for x in (xfs if xfs is not None else ()) for n in [int(x.get("numFmtId", "0"))]]


def _read_sheet(root: ET.Element, strings: list[tuple[str, bool]], formats: list[int | str]) -> Sheet:
    """Only cells that are there; a sheet's used range is never walked."""
    out = Sheet(merged=[m.get("ref", "") for m in root.iter(f"{S}mergeCell")])
    hidden_columns = [(int(c.get("min", "0")), int(c.get("max", "0"))) for c in root.iter(f"{S}col") if c.get("hidden") in ("1", "true")]
    for row in root.iter(f"{S}row"):
        for c in row.findall(f"{S}c"):
            ref, kind, v = c.get("r", ""), c.get("t", "n"), c.findtext(f"{S}v")
            struck = False
            if kind == "s" and v is not None:
                text, struck = strings[int(v)]
            elif kind == "inlineStr":
                text = _runs(c, S)
            elif kind == "b":
                text = "TRUE" if v == "1" else "FALSE"
            elif kind in ("str", "e"):
                text = v or ""
            elif v is not None:
                style = int(c.get("s", "0"))
                text = shown_number(v, formats[style] if style < len(formats) else None)
            else:
                text = ""
            if not text.strip():
                continue
            at = cell_of(ref)
            out.cells[at] = text
            if kind == "e":
                out.note("error", ref, text)
            if struck:
                out.note("struck", ref, text)
            if row.get("hidden") in ("1", "true") or any(a <= at[1] <= b for a, b in hidden_columns):
                out.hidden += 1
    return out


def _strings(root: ET.Element | None) -> list[tuple[str, bool]]:
    """Shared strings, and whether a run of one is struck out; phonetic runs do not count."""
    out = []
    for si in root.findall(f"{S}si") if root is not None else ():
        parts = [si.findtext(f"{S}t") or "", *(r.findtext(f"{S}t") or "" for r in si.findall(f"{S}r"))]
        out.append(("".join(parts), any(True for _ in si.iter(f"{S}strike"))))
    return out


# drawings


def _shape_text(shape: ET.Element) -> str:
    return "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in shape.iter(f"{A}p"))))


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def drawing_chunks(root: ET.Element, heading: str, at: str) -> Iterator[Chunk]:
    """Texts of shapes, and the connectors between them: from, to, direction (by arrow heads)."""
    names: dict[str, str] = {}
    texts, edges = [], []
    for e in root.iter():
        if _local(e) == "sp":
            ident = next((x.get("id", "") for x in e.iter() if _local(x) == "cNvPr"), "")
            names[ident] = _shape_text(e)
            if names[ident]:
                texts.append([ident, names[ident]])
    for e in root.iter():
        if _local(e) != "cxnSp":
            continue
        ends = {_local(x): x.get("id", "") for x in e.iter() if _local(x) in ("stCxn", "endCxn")}
        heads = {_local(x): x.get("type", "none") for x in e.iter() if _local(x) in ("headEnd", "tailEnd")}
        start, end = (names.get(ends.get(k, ""), "") for k in ("stCxn", "endCxn"))
        forward, back = heads.get("tailEnd", "none") != "none", heads.get("headEnd", "none") != "none"
        if back and not forward:
            start, end = end, start
        edges.append([start, end, "both" if forward and back else "forward" if forward or back else "none"])
    if texts:
        yield (at, heading, "graphic", [["shape", "text"], *texts], None, None)
    if edges:
        yield (at, heading, "kinks", [["from", "to", "direction"], *edges], None, None)


def chart_chunk(root: ET.Element, heading: str, at: str) -> Chunk:
    """Title, and each series' name, categories and values (references)."""

    def ref(series: ET.Element, name: str) -> str:
        e = series.find(f"{C}{name}")
        return next((f.text or "" for f in e.iter(f"{C}f")), "") if e is not None else ""

    def name(series: ET.Element) -> str:
        e = series.find(f"{C}tx")
        return next((v.text or "" for v in e.iter(f"{C}v")), "") or next((f.text or "" for f in e.iter(f"{C}f")), "") if e is not None else ""

    title = root.find(f".//{C}title")
    rows = [[name(s), ref(s, "cat") or ref(s, "xVal"), ref(s, "val") or ref(s, "yVal")] for s in root.iter(f"{C}ser")]
    return (at, heading, "chart", [["series", "categories", "values"], *rows], _shape_text(title) if title is not None else "", None)


def _drawings(package: Package, part: str, heading: str) -> Iterator[Chunk]:
    for drawing in package.of_kind(part, "drawing"):
        root = package.xml(drawing)
        if root is not None:
            yield from drawing_chunks(root, heading, drawing)
        for chart in package.of_kind(drawing, "chart"):
            found = package.xml(chart)
            if found is not None:
                yield chart_chunk(found, heading, chart)
        for diagram in package.of_kind(drawing, "diagramData"):
            data = package.xml(diagram)
            boxes = [[t] for pt in (data.iter() if data is not None else ()) if _local(pt) == "pt" and (t := _shape_text(pt))]
            if boxes:
                yield (diagram, heading, "diagram", boxes, None, None)


# workbooks


def _comments(package: Package, part: str, sheet: Sheet) -> None:
    for comments in package.of_kind(part, "comments"):
        root = package.xml(comments)
        for c in root.iter(f"{S}comment") if root is not None else ():
            sheet.note("memo", c.get("ref", ""), _runs(c, S))
    for threads in package.of_kind(part, "threadedComment"):
        root = package.xml(threads)
        for c in root if root is not None else ():
            sheet.note("memo", c.get("ref", ""), "".join(t.text or "" for t in c.iter() if _local(t) == "text"))


def read_workbook(content: bytes) -> Iterator[Chunk]:
    """Sheets of a workbook: regions of cells as tables or, when sparse, as lists of cells; errors,
    memos, links, struck texts, drawings and charts; hidden sheets are named and not read."""
    package = Package(content)
    main = next((t for t in package.of_kind("", "officeDocument")), "xl/workbook.xml")
    book = package.xml(main)
    if book is None:
        raise ValueError(package.broken[-1][1])
    targets = {i: t for i, _, t, _ in package.relations(main)}
    strings = _strings(package.xml(s[0]) if (s := package.of_kind(main, "sharedStrings")) else None)
    formats = _formats(package.xml(s[0]) if (s := package.of_kind(main, "styles")) else None)
    for entry in book.iter(f"{S}sheet"):
        name, part = entry.get("name", ""), targets.get(entry.get(f"{R}id", ""), "")
        if entry.get("state", "visible") != "visible":
            yield finding("P003", name, "hidden sheet not read")
            continue
        root = package.xml(part)
        if root is None:
            continue  # a damaged sheet: the others are read, the part is reported below
        sheet = _read_sheet(root, strings, formats)
        _comments(package, part, sheet)
        outside = {i: t for i, k, t, far in package.relations(part) if k == "hyperlink"}
        for link in root.iter(f"{S}hyperlink"):
            sheet.note("link", link.get("ref", ""), outside.get(link.get(f"{R}id", ""), "") or link.get("location", ""))
        fill_merged(sheet.cells, sheet.merged)
        for region in regions(sheet.cells):
            frame = Frame.of(region)
            if frame.sparse:
                yield (frame.at, name, "xcells", [[f"{column_name(c)}{r}", sheet.cells[r, c]] for r, c in region], None, None)
            else:
                yield (frame.at, name, "table", [[sheet.cells.get((r, c), "") for c in range(frame.left, frame.right + 1)] for r in range(frame.top, frame.bottom + 1)], None, None)
        for kind, rows in sorted(sheet.notes.items()):
            yield (name, name, kind, sorted(rows, key=lambda x: cell_of(x[0].partition(":")[0])), None, None)
        if sheet.hidden:
            yield (name, name, "outline", None, f"{sheet.hidden} filled cells in hidden rows or columns", None)
        yield from _drawings(package, part, name)
    for link in package.of_kind(main, "externalLink"):
        yield finding("P004", link, next((t for _, _, t, far in package.relations(link) if far), ""))
    yield from package.common(main)


# documents


def _paragraph(p: ET.Element) -> str:
    """Visible text; deleted runs do not count."""
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out).strip()


def _table(table: ET.Element) -> list[list[str]]:
    """Rows of cell texts; cells merged downwards repeat the text above."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        row = []
        for tc in tr.findall(f"{W}tc"):
            text = "\n".join(filter(None, map(_paragraph, tc.findall(f"{W}p"))))
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and not text and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row.append(text)
        if row:
            rows.append(row)
    return rows


def read_document(content: bytes) -> Iterator[Chunk]:
    """Sections of a document under their heading path, tables, comments, notes, headers and footers;
    tracked changes are reported, deleted text is left out."""
    package = Package(content)
    main = next((t for t in package.of_kind("", "officeDocument")), "word/document.xml")
    root = package.xml(main)
    if root is None:
        raise ValueError(package.broken[-1][1])
    levels = {}
    for styles in package.of_kind(main, "styles"):
        sheet = package.xml(styles)
        for style in sheet.iter(f"{W}style") if sheet is not None else ():
            name = style.find(f"{W}name")
            m = re.fullmatch(r"(?:heading|見出し) ?([1-9])", (name.get(f"{W}val", "") if name is not None else "").strip(), re.IGNORECASE)
            if m:
                levels[style.get(f"{W}styleId", "")] = int(m[1])
    path: list[tuple[int, str]] = []
    held: list[str] = []
    n = 0

    def out() -> Iterator[Chunk]:
        if held:
            yield (str(n), " > ".join(t for _, t in path), "section", None, "\n".join(held), None)
            held.clear()

    body = root.find(f"{W}body")
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            text = _paragraph(e)
            style = e.find(f"{W}pPr/{W}pStyle")
            level = levels.get(style.get(f"{W}val", "")) if style is not None else None
            if level and text:
                yield from out()
                n += 1
                path = [*(x for x in path if x[0] < level), (level, text)]
            elif text:
                held.append(text)
        elif e.tag == f"{W}tbl" and (rows := _table(e)):
            yield from out()
            yield (str(n), " > ".join(t for _, t in path), "table", rows, None, None)
    yield from out()
    for kind, word, tag in (("comments", "memo", "comment"), ("footnotes", "footnote", "footnote"), ("endnotes", "footnote", "endnote")):
        for part in package.of_kind(main, kind):
            notes = package.xml(part)
            rows = [[x.get(f"{W}id", ""), x.get(f"{W}author", ""), t] for x in (notes if notes is not None else ()) if x.tag == f"{W}{tag}" and (t := "\n".join(filter(None, map(_paragraph, x.iter(f"{W}p")))))]
            if rows:
                yield (part, "", word, rows, None, None)
    for part in package.of_kind(main, "header", "footer"):
        edge = package.xml(part)
        text = "\n".join(filter(None, map(_paragraph, edge.iter(f"{W}p")))) if edge is not None else ""
        if text:
            yield (part, "", "margin", None, text, None)
    if any(True for e in root.iter() if e.tag in (f"{W}ins", f"{W}del")):
        yield finding("P019", main, "tracked changes: insertions are read, deletions are left out")
    yield from package.common(main)


# presentations


def read_presentation(content: bytes) -> Iterator[Chunk]:
    """Slides in the order of the presentation: title, texts, tables, connectors, notes, comments;
    hidden slides are named and not read."""
    package = Package(content)
    main = next((t for t in package.of_kind("", "officeDocument")), "ppt/presentation.xml")
    root = package.xml(main)
    if root is None:
        raise ValueError(package.broken[-1][1])
    targets = {i: t for i, _, t, _ in package.relations(main)}
    listed = root.find(f"{P}sldIdLst")
    for k, entry in enumerate(listed if listed is not None else (), 1):
        part = targets.get(entry.get(f"{R}id", ""), "")
        slide = package.xml(part)
        if slide is None:
            continue
        title, texts = "", []
        for sp in slide.iter(f"{P}sp"):
            text, ph = _shape_text(sp), next((x for x in sp.iter(f"{P}ph")), None)
            if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                title = text.replace("\n", " ")
            elif text:
                texts.append(text)
        heading = title or f"slide {k}"
        if slide.get("show") == "0":
            yield finding("P003", str(k), f"hidden slide not read: {heading}")
            continue
        if texts or title:
            yield (str(k), heading, "section", None, "\n".join(texts), None)
        for table in slide.iter(f"{A}tbl"):
            yield (str(k), heading, "table", [[_shape_text(tc).replace("\n", " ") for tc in tr.findall(f"{A}tc")] for tr in table.findall(f"{A}tr")], None, None)
        yield from (c for c in drawing_chunks(slide, heading, str(k)) if c[2] == "kinks")
        for notes in package.of_kind(part, "notesSlide"):
            page = package.xml(notes)
            said = [t for sp in (page.iter(f"{P}sp") if page is not None else ()) if any(x.get("type") == "body" for x in sp.iter(f"{P}ph")) and (t := _shape_text(sp))]
            if said:
                yield (str(k), heading, "note", None, "\n".join(said), None)
        for comments in package.of_kind(part, "comments", "comment"):
            page = package.xml(comments)
            rows = [[t] for c in (page if page is not None else ()) if (t := "".join(x.text or "" for x in c.iter() if _local(x) in ("text", "t")).strip())]
            if rows:
                yield (str(k), heading, "memo", rows, None, None)
        yield from (c for c in _drawings(package, part, heading) if c[2] in ("chart", "diagram"))
    yield from package.common(main)
