"""Office packages made by hand, and the readers' findings."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from lodestone.sources import office, readers, sinks

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS = {
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": office.W[1:-1], "a": office.A[1:-1], "p": office.P[1:-1], "c": office.C[1:-1],
    "r": REL, "xdr": "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing",
}


def xml(body):
    head = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())
    tag = re.match(r"<[\w:]+", body)[0]
    return f'<?xml version="1.0" encoding="UTF-8"?>{tag} {head}{body[len(tag):]}'


def rels(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"{" TargetMode=%sExternal%s" % (chr(34), chr(34)) if far else ""}/>' for i, kind, target, far in rows) + "</Relationships>"


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def workbook():
    cells = '<s:row r="1"><s:c r="A1" t="s"><s:v>0</s:v></s:c><s:c r="B1" t="s"><s:v>1</s:v></s:c></s:row>'
    cells += '<s:row r="2"><s:c r="A2" t="inlineStr"><s:is><s:t>x</s:t></s:is></s:c><s:c r="B2" s="1"><s:v>45000</s:v></s:c></s:row>'
    cells += '<s:row r="3" hidden="1"><s:c r="B3" s="2"><s:v>0.125</s:v></s:c></s:row><s:row r="4"><s:c r="A4" t="e"><s:v>#REF!</s:v></s:c><s:c r="B4"><s:v>0.1</s:v></s:c><s:c r="C4" s="3"><s:v>1.5</s:v></s:c></s:row>'
    cells += '<s:row r="40"><s:c r="Z40" t="b"><s:v>1</s:v></s:c></s:row>'
    sheet = f'<s:worksheet><s:sheetData>{cells}</s:sheetData><s:mergeCells><s:mergeCell ref="A2:A3"/><s:mergeCell ref="B1:C1"/></s:mergeCells><s:hyperlinks><s:hyperlink ref="A1" r:id="l1"/></s:hyperlinks></s:worksheet>'
    shape = lambda i, t: f'<xdr:sp><xdr:nvSpPr><xdr:cNvPr id="{i}"/></xdr:nvSpPr><xdr:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></xdr:txBody></xdr:sp>'
    line = '<xdr:cxnSp><xdr:cNvCxnSpPr><a:stCxn id="2"/><a:endCxn id="3"/></xdr:cNvCxnSpPr><a:ln><a:headEnd type="arrow"/></a:ln></xdr:cxnSp>'
    chart = '<c:chartSpace><c:title><a:p><a:r><a:t>Sales</a:t></a:r></a:p></c:title><c:ser><c:tx><c:strRef><c:f>S!B1</c:f><c:strCache><c:v>2024</c:v></c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:f>S!A2:A4</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>S!B2:B4</c:f></c:numRef></c:val></c:ser></c:chartSpace>'
    return {
        "_rels/.rels": rels(("a", "officeDocument", "xl/workbook.xml", False)),
        "xl/workbook.xml": xml('<s:workbook><s:sheets><s:sheet name="S" sheetId="1" r:id="r1"/><s:sheet name="H" sheetId="2" state="hidden" r:id="r2"/><s:sheet name="D" sheetId="3" r:id="r3"/></s:sheets></s:workbook>'),
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml", False), ("r2", "worksheet", "worksheets/sheet1.xml", False), ("r3", "worksheet", "/xl/worksheets/bad.xml", False), ("r4", "sharedStrings", "sharedStrings.xml", False), ("r5", "styles", "styles.xml", False), ("r6", "externalLink", "externalLinks/e1.xml", False)),
        "xl/externalLinks/e1.xml": xml("<s:externalLink></s:externalLink>"),
        "xl/externalLinks/_rels/e1.xml.rels": rels(("x", "externalLinkPath", "other.xlsx", True)),
        "xl/worksheets/sheet1.xml": xml(sheet),
        "xl/worksheets/bad.xml": "<broken",
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("l1", "hyperlink", "http://x.y", True), ("l2", "comments", "../comments1.xml", False), ("l3", "drawing", "../drawings/d1.xml", False)),
        "xl/sharedStrings.xml": xml("<s:sst><s:si><s:t>名称</s:t></s:si><s:si><s:r><s:rPr><s:strike/></s:rPr><s:t>old </s:t></s:r><s:r><s:t>new</s:t></s:r><s:rPh><s:t>kana</s:t></s:rPh></s:si></s:sst>"),
        "xl/styles.xml": xml('<s:styleSheet><s:numFmts><s:numFmt numFmtId="170" formatCode="[h]:mm"/></s:numFmts><s:cellXfs><s:xf numFmtId="0"/><s:xf numFmtId="14"/><s:xf numFmtId="10"/><s:xf numFmtId="170"/></s:cellXfs></s:styleSheet>'),
        "xl/comments1.xml": xml('<s:comments><s:commentList><s:comment ref="B2"><s:text><s:t>why</s:t></s:text></s:comment></s:commentList></s:comments>'),
        "xl/drawings/d1.xml": xml(f"<xdr:wsDr>{shape(2, 'A')}{shape(3, 'B')}{line}</xdr:wsDr>"),
        "xl/drawings/_rels/d1.xml.rels": rels(("c1", "chart", "../charts/c1.xml", False), ("c2", "chart", "../charts/c2.xml", False)),
        "xl/charts/c1.xml": xml(chart),
        "xl/charts/c2.xml": "not xml",
        "xl/vbaProject.bin": "x",
        "docProps/core.xml": "<p><creator>me</creator></p>",
    }


def test_workbook():
    got = list(office.read_workbook(pack(workbook())))
    tables = [(at, rows) for at, _, kind, rows, _, _ in got if kind == "table"]
    assert tables == [("A1:C4", [["名称", "old new", ""], ["x", "2023-03-15", ""], ["x", "12.50%", ""], ["#REF!", "0.1", "36:00"]]), ("Z40", [["TRUE"]])]
    by = {c[2]: c for c in got}
    assert by["error"][3] == [["A4", "#REF!"]] and by["memo"][3] == [["B2", "why"]] and by["link"][3] == [["A1", "http://x.y"]] and by["struck"][3] == [["B1", "old new"]]
    assert by["graphic"][3] == [["shape", "text"], ["2", "A"], ["3", "B"]] and by["kinks"][3][1] == ["B", "A", "forward"]
    assert by["chart"][3][1] == ["2024", "S!A2:A4", "S!B2:B4"] and by["chart"][4] == "Sales" and by["outline"][4].startswith("1 ")
    codes = sorted((c[5], c[0]) for c in got if c[5])
    assert codes == [("P003", "H"), ("P004", "xl/externalLinks/e1.xml"), ("P005", "docProps"), ("P006", "xl/workbook.xml"), ("P008", "xl/charts/c2.xml"), ("P012", "xl/worksheets/bad.xml")]


def test_regions_against_all_pairs():
    rng = random.Random(4)
    for n in (0, 1, 30, 120):
        cells = {(rng.randint(1, 40), rng.randint(1, 40)): "x" for _ in range(n)}
        root = {c: c for c in cells}

        def find(c, root=root):
            while root[c] != c:
                c = root[c]
            return c

        for a in cells:
            for b in cells:
                if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= office.GAP:
                    root[find(a)] = find(b)
        want = {}
        for c in cells:
            want.setdefault(find(c), []).append(c)
        assert sorted(map(sorted, want.values())) == sorted(office.regions(cells))
    wide = office.Frame.of(sorted([(1, 1), (3, 3), (5, 5), (7, 7), (9, 9), (11, 11)]))
    assert wide.sparse and wide.at == "A1:K11" and not office.Frame.of([(1, 1), (1, 2)]).sparse
    assert [office.column_name(n) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"] and office.cell_of("$AB$12") == (12, 28)


def test_document():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=%s{style}%s/></w:pPr>" % (chr(34), chr(34)) if style else ""}{text}</w:p>'
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    cell = lambda x, merge="": f'<w:tc><w:tcPr>{merge}</w:tcPr>{p(t(x) if x else "")}</w:tc>'
    start, more = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    table = f"<w:tbl><w:tr>{cell('k', start)}{cell('1')}</w:tr><w:tr>{cell('', more)}{cell('2')}</w:tr></w:tbl>"
    body = p(t("before")) + p(t("One"), "H1") + p(t("a") + "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>" + t("b") + "</w:ins>") + p(t("Two"), "H2") + table + p(t("Three"), "H1") + p(t("end"))
    parts = {
        "word/document.xml": xml(f"<w:document><w:body>{body}</w:body></w:document>"),
        "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml", False), ("c", "comments", "comments.xml", False), ("h", "header", "header1.xml", False)),
        "word/styles.xml": xml('<w:styles><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="見出し 2"/></w:style></w:styles>'),
        "word/comments.xml": xml(f'<w:comments><w:comment w:id="0" w:author="me">{p(t("hm"))}</w:comment></w:comments>'),
        "word/header1.xml": xml(f"<w:hdr>{p(t('top'))}</w:hdr>"),
    }
    got = list(office.read_document(pack(parts)))
    assert [(c[1], c[4] or c[3]) for c in got if c[2] in ("section", "table")] == [("", "before"), ("One", "ab"), ("One > Two", [["k", "1"], ["k", "2"]]), ("Three", "end")]
    assert [(c[2], c[3] or c[4]) for c in got if c[2] in ("memo", "margin")] == [("memo", [["0", "me", "hm"]]), ("margin", "top")] and [c[5] for c in got if c[5]] == ["P019"]


def test_presentation():
    sp = lambda text, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=%s{ph}%s/>" % (chr(34), chr(34)) if ph else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    tbl = "<a:tbl><a:tr><a:tc><a:p><a:r><a:t>c</a:t></a:r></a:p></a:tc></a:tr></a:tbl>"
    parts = {
        "ppt/presentation.xml": xml('<p:presentation><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/><p:sldId r:id="h"/></p:sldIdLst></p:presentation>'),
        "ppt/_rels/presentation.xml.rels": rels(*((i, "slide", f"slides/{i}.xml", False) for i in "abh")),
        "ppt/slides/a.xml": xml(f"<p:sld>{sp('body')}{tbl}</p:sld>"),
        "ppt/slides/b.xml": xml(f"<p:sld>{sp('First', 'title')}{sp('text')}</p:sld>"),
        "ppt/slides/h.xml": xml(f'<p:sld show="0">{sp("no")}</p:sld>'),
        "ppt/slides/_rels/b.xml.rels": rels(("n", "notesSlide", "../notes/n.xml", False)),
        "ppt/notes/n.xml": xml(f"<p:notes>{sp('said', 'body')}{sp('1', 'sldNum')}</p:notes>"),
    }
    got = list(office.read_presentation(pack(parts)))
    assert [(c[0], c[1], c[2], c[3] or c[4]) for c in got] == [("1", "First", "section", "text"), ("1", "First", "note", "said"), ("2", "slide 2", "section", "body"), ("2", "slide 2", "table", [["c"]]), ("3", "", "finding", "hidden slide not read: slide 3")]


def test_files_and_findings(spark, tmp_path):
    files = {"a.xlsx": pack(workbook()), "b.docx": b"no zip", "c.html": "<h2>T <b>x</b></h2><p>a&amp;&eacute;</p><script>no</script>".encode(), "d.csv": "一行だけ".encode("cp932"), "e.pdf": b"%PDF", "sub/a.csv": b"x,y\n1,2\n", "sub/A.tsv": b"x\ty\n"}
    (tmp_path / "sub").mkdir()
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = readers.read_files(spark, str(tmp_path)).withColumn("f", F.substring_index("file", "/", -1)).collect()
    codes = {(r.f, r.code) for r in got if r.code}
    assert {("a.xlsx", "P003"), ("a.xlsx", "P012"), ("b.docx", "P010"), ("d.csv", "P018"), ("e.pdf", "P001")} <= codes
    assert [(r.heading, r.text) for r in got if r.f == "c.html"] == [("T x", "aé&".replace("é&", "&é"))]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    kept, told = readers.plan_scan(listed, [str(tmp_path), "/nowhere"], [r"\.pdf$", "zzz"])
    found = {(r.code, r.target.replace(str(tmp_path), "")) for r in told.collect()}
    assert kept.count() == 6 and {("P007", "/nowhere"), ("P014", r"\.pdf$: 1"), ("P014", "zzz: 0")} <= found and sum(c == "P002" for c, _ in found) == 1
    assert readers.garbled("ﾃｽﾄ\x85") and not readers.garbled("日本語 abc") and not readers.garbled("abc")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", "k", 2, 0.5, 1)], "tenant string, kind string, quantity int, unit_price double, amount int")
    assert sinks.invoice_csv(rows) == b'tenant,kind,quantity,unit_price,amount\r\n"a,b",k,2,0.5000,1\r\n'
    bad = rows.select(F.raise_error(F.lit("no")).alias("x"))
    told = sinks.write_each({"bad": bad, "good": rows}, str(tmp_path))
    assert [t[:3] for t in told] == [("error", "P011", "bad")] and spark.read.parquet(f"{tmp_path}/good").count() == 1
    old = spark.createDataFrame([("p", "1", 1), ("q", "2", 1)], "path string, digest string, captured int")
    assert sorted(map(tuple, sinks.merge_manifest(old, old.limit(1).selectExpr("'p' as path", "'9' as digest", "2 as captured")).collect())) == [("p", "9", 2), ("q", "2", 1)]
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", None)], "`from` string, `to` string, label string")
    assert sinks.mermaid(edges).split("\n")[0] == "flowchart LR" and "n0 -->|x| n1" in sinks.mermaid(edges)
