"""Plan files, printed reports, the command line, merges and containment on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.operators import joins, merge, service
from lodestone.plans import files, render
from lodestone.streaming import metering


def test_plan_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "x", "v": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "x", "v": 2, "rules": [1], "m": {"a": 1}}))
    (tmp_path / "c.json").write_text(json.dumps({"rules": [2], "m": {"b": 2}, "v": 3}))
    assert [(d.get("name"), d.get("v")) for d in files.documents(str(tmp_path))] == [(None, 3), ("x", 2)]
    assert files.merged_rules([f"{tmp_path}/{n}.json" for n in "bc"]) == {"name": "x", "v": 3, "rules": [1, 2], "m": {"a": 1, "b": 2}}


def test_publish(spark, tmp_path):
    table = spark.createDataFrame([("b", "x|y"), ("a", None)], "id string, note string")
    made = render.publish([{"name": "R", "phase": "1", "sections": [{"title": "T", "table": table, "order": ["id"]}, {"title": "E", "table": table.limit(0), "order": ["id"]}]}], str(tmp_path))
    text = (tmp_path / "1" / "R.md").read_text()
    assert made == ["1/R"] and "| a | ― |\n| b | x\\|y |" in text and "E: no rows" in text and "(1/R.md)" in (tmp_path / "index.md").read_text()
    assert "<td>x|y</td>" in (tmp_path / "1" / "R.html").read_text()
    rows, total = render.cells(table, ["id"], 1)
    assert (len(rows), total) == (1, 2) and "1 more rows" in render.markdown("T", table.columns, rows, total)


def test_command_line(spark, tmp_path, capsys):
    assert main(["queries"]) == 0 and "gate_report" in capsys.readouterr().out and main(["nonsense"]) == 2
    items = spark.createDataFrame([("a", "t", "draft", {"n": ""}, [])], "id string, type string, status string, attrs map<string,string>, gaps array<string>")
    relations = spark.createDataFrame([("r", "a", "zz", 1)], "type string, `from` string, `to` string, ord int")
    items.write.parquet(f"{tmp_path}/items")
    relations.write.parquet(f"{tmp_path}/relations")
    (tmp_path / "v.json").write_text(json.dumps({"item_types": ["t"], "attributes": [{"owner": "t", "name": "n", "required": True}], "relations": [{"name": "r", "from_types": ["t"], "to_types": ["t"]}]}))
    assert main(["check", f"{tmp_path}/items", f"{tmp_path}/relations", f"{tmp_path}/v.json"]) == 1
    out = capsys.readouterr().out
    assert "error E010 a.n" in out and "error E022" in out
    (tmp_path / "p.json").write_text(json.dumps({"name": "P", "phase": "x", "sections": [{"kind": "items", "type": "t", "columns": ["n"], "heading": "H"}]}))
    assert main(["publish", f"{tmp_path}/p.json", f"{tmp_path}/items", f"{tmp_path}/relations", f"{tmp_path}/out"]) == 0
    assert "## H" in (tmp_path / "out" / "x" / "P.md").read_text()


def test_merges_with_nulls(spark):
    rows = [("k", 1, None, None, None, None), ("k", 2, "n", "st", "", ["b", None]), ("k", 3, "m", "tt", "v", ["a", "b"]), ("k", 3, "m", "tt", "w", []), (None, 1, "x", "y", None, None)]
    df = spark.createDataFrame(rows, "k string, i int, name string, st string, s string, m array<string>")
    got = {r.k: r for r in merge.merge_records(df, "k", ["i"], "name", "st", ["s"], ["m"], [], ["i"]).collect()}
    assert (got["k"]["name"], got["k"].statement, got["k"].conflicts, got["k"].m) == ("n", "st", ["tt"], ["b", "a"])
    assert {got["k"].s, *got["k"].s_conflicts} == {"v", "w"} and len(got["k"].sources) == 4 and got[None].n_records == 1
    edges = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "p", "x"), ("a", 3, "q", "y"), ("b", 1, "", None)], "k string, i int, v string, note string")
    out = {r.k: r for r in merge.merge_edges(edges, ["k"], ["i"], ["v"], "note").collect()}
    assert (out["a"].v, out["a"].v_conflicts, out["a"].note, out["a"].n_edges) == ("p", 1, "x\ny", 3) and (out["b"].v, out["b"].v_conflicts, out["b"].note) == (None, 0, "")


def test_containment_against_all_pairs(spark):
    words = "one two three four five six seven eight nine ten eleven".split()
    text = " ".join(words)
    docs = [(1, f"x {text} y"), (2, f"pre{text}post"), (3, text.replace(" ", "  ")), (4, None), (5, "three four"), (6, text[2:])]
    items = [(1, text), (2, "three four"), (3, None), (4, text[2:-2]), (5, " ".join(words[:8])), (6, "e two three four five six seven eight n")]
    got = joins.contained(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, item string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t)


def test_folders_and_pages(spark, tmp_path):
    assert not metering.stored(spark, f"{tmp_path}/no") and service.page(spark.range(0), ["id"], 1).count() == 0
    spark.range(3).write.parquet(f"{tmp_path}/yes")
    assert metering.stored(spark, f"{tmp_path}/yes")
    pairs = joins.near_statements(spark.createDataFrame([(1, "t", "a long statement here", ["a"], "review"), (2, "t", "a long statement there", ["b"], "review"), (3, "t", "a long statement there", ["c"], "deprecated")], "id int, type string, statement string, sources array<string>, status string"))
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    none = joins.near_statements(spark.createDataFrame([(1, "t", "a long statement here", ["a"]), (2, "t", "a long statement there", ["b"])], "id int, type string, statement string, sources array<string>"), children=spark.createDataFrame([("p", 1), ("p", 2)], "parent string, id int"))
    assert none.count() == 0 and spark.range(1).select(F.lit(1)).count() == 1


def test_stores_are_read_back(spark, tmp_path):
    from lodestone.sources import stores

    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "type": "t", "status": "draft", "n": 1, "ok": True, "tags": ["a", 2], "none": None}, {"type": "r", "from": "x", "to": "y", "order": 3}, "stray"]))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"id": 1}')
    (tmp_path / "d.json").write_text("null")
    items, relations, findings = stores.load_store(spark, str(tmp_path))
    r = items.first()
    assert (r.id, r.attrs, r.lists) == ("x", {"n": "1", "ok": "true"}, {"tags": ["a", "2"]}) and items.count() == 1
    assert [(x["from"], x["to"], x.ord) for x in relations.collect()] == [("x", "y", 3)]
    assert sorted(x.target.rsplit("/", 1)[1] for x in findings.collect()) == ["a.json#3", "b.json#0", "c.json#0"]


def test_printed_tables_are_read_back(spark):
    from lodestone.sources import stores

    rows = [["a", "x|y\nz"], ["b", ""]]
    text = render.markdown("T", ["id", "note"], rows, 2) + "\n```\n| no | table |\n| --- | --- |\n```\n"
    assert list(stores.markdown_tables(text)) == [("T", ["id", "note"], rows)]


@pytest.mark.parametrize("name", ["findings_references", "gate_report"])
def test_references_are_joined_once(spark, capsys, name):
    """The findings read the joined references, not the line items again for each rule."""
    from lodestone.queries import QUERIES

    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert "lineitem" not in capsys.readouterr().out
