import random
import unicodedata
from datetime import date, timedelta
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking, text
from lodestone.operators import checks, joins, merge, numbering, predicates, search
from lodestone.plans import sections
from lodestone.sources import readers, sinks
from lodestone.streaming import metering


def test_exclusion_passes_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in df.where(predicates.matches({"x": {"not": ["a", None]}})).collect()] == ["b", None]
    assert df.where(predicates.matches({"x": ["a"]})).count() == 1


def test_fill_gaps_against_loop(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, rng.randint(1, 60)])) for g in "ab" for i in range(60)]
    got = {(r.g, r.i): r.assigned for r in numbering.fill_gaps(spark.createDataFrame(rows, "g string, i int, n int"), "g", "n", [F.col("i")]).collect()}
    for g in "ab":
        used = {n for h, _, n in rows if h == g and n}
        free = (k for k in range(1, 1000) if k not in used)
        for h, i, n in rows:
            if h == g:
                assert got[g, i] == (n if n else next(free))


def test_format_number_is_a_minimum(spark):
    df = spark.createDataFrame([(7,), (1000,)], "n int").select(numbering.format_number(F.lit("FR-"), F.col("n"), 3).alias("x"), numbering.numbers_in(F.lit("FR-012"), "FR-", 3).alias("y"))
    assert [(r.x, r.y) for r in df.collect()] == [("FR-007", 12), ("FR-1000", 12)]


def _equals_sql(spark, name, path, tables):
    from lodestone.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    got, rel = QUERIES[name](spark, str(path)), con.sql(ORACLE[name])
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_business_key_beyond_three_digits(spark, tmp_path):
    orders = spark.range(2100).select(F.col("id").alias("o_orderkey"), F.to_timestamp(F.when(F.col("id") % 2 == 0, "2024-01-01 10:00:00").otherwise("2024-01-02 00:00:00")).alias("o_orderdate"))
    _equals_sql(spark, "business_key", tmp_path, {"orders": orders})


def test_renumbering_beyond_three_digits(spark, tmp_path):
    part = spark.range(1, 2300).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("p_brand"))
    _equals_sql(spark, "renumbering", tmp_path, {"part": part})


def test_natural_key(spark):
    df = spark.createDataFrame([("a10",), ("a2",), ("b",), ("1",)], "x string")
    assert [r.x for r in df.orderBy(numbering.natural_key(F.col("x"))).collect()] == ["a2", "a10", "b", "1"]


def test_merge_records(spark):
    rows = [("c", "f", 1, "N", "short", "", ["x"], "p"), ("c", "f", 2, "M", "longer", "v", ["y", "x"], "q p"), ("c", "f", 3, "N", "second", "w", None, "p")]
    df = spark.createDataFrame(rows, "k string, f string, i int, name string, st string, s string, m array<string>, a string")
    r = merge.merge_records(df, "k", ["f", "i"], "name", "st", ["s"], ["m"], ["a"], ["f", "i"]).first()
    assert (r["name"], r["statement"], r["s"], r["s_conflicts"], r["m"], r["a"]) == ("N", "longer", "v", ["w"], ["x", "y"], "p\n\nq p")
    assert sorted(r["conflicts"]) == ["second", "short"] and r["n_names"] == 2 and len(r["sources"]) == 3


def test_effective_latest_start_wins(spark):
    prices = spark.createDataFrame([("k", "2020-01-01", "2020-12-31", 1.0), ("k", "2020-06-01", None, 2.0)], "kind string, a string, b string, unit_price double")
    prices = prices.select("kind", F.to_date("a").alias("valid_from"), F.to_date("b").alias("valid_to"), "unit_price")
    facts = spark.createDataFrame([("k", "2020-05-31"), ("k", "2020-06-01"), ("k", "2019-01-01"), ("z", "2020-06-01")], "kind string, d string")
    got = [r.unit_price for r in joins.effective(facts, prices, "kind", "d").orderBy("kind", "d").collect()]
    assert got == [None, 1.0, 2.0, None]


def test_effective_against_all_periods(spark):
    """A later period that has ended gives way to an earlier one that still holds."""
    rng, day = random.Random(12), lambda n: date(2024, 1, 1) + timedelta(days=n)
    starts = rng.sample(range(200), 25)
    rows = [("k" if i % 3 else "m", day(a), None if i % 7 == 0 else day(a + rng.randint(0, 60)), float(i)) for i, a in enumerate(starts)] + [("k", day(0), None, 99.0), ("z", None, None, 1.0)]
    prices = spark.createDataFrame(rows, "kind string, valid_from date, valid_to date, unit_price double")
    facts = spark.createDataFrame([(k, day(n)) for k in "kmz" for n in range(-2, 300, 3)], "kind string, d date")
    for r in joins.effective(facts, prices, "kind", "d").collect():
        fits = [(f, u) for k, f, t, u in rows if k == r.kind and f is not None and f <= r.d and (t is None or r.d <= t)]
        assert r.unit_price == (max(fits)[1] if fits else None)


def test_near_statements_against_all_pairs(spark):
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog and runs"
    texts = ["".join(c for c in base if rng.random() > p) for p in (0, 0.1, 0.2, 0.3, 0.5) for _ in range(6)]
    rows = [(f"{i:02}", "t", s, [str(i)]) for i, s in enumerate(texts)]
    got = {(r.a, r.b) for r in joins.near_statements(spark.createDataFrame(rows, "id string, type string, statement string, sources array<string>")).collect()}
    bare = ["".join(s.split()) for s in texts]
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if min(len(bare[i]), len(bare[j])) >= max(8, 0.75 * max(len(bare[i]), len(bare[j]))) and SequenceMatcher(None, bare[i], bare[j], autojunk=False).ratio() >= 0.75}
    assert got == want


def test_unique_suffix(spark):
    files = spark.createDataFrame([("a.b.c",), ("x.b.c",), ("a.d",)], "path string")
    names = spark.createDataFrame([("b.c",), ("a.b.c",), ("d",), ("os",)], "name string")
    got = {r.name: (r.hits, r.file) for r in joins.unique_suffix(names, files).collect()}
    assert got == {"b.c": (2, None), "a.b.c": (1, "a.b.c"), "d": (1, "a.d"), "os": (0, None)}


def test_rerank_and_decision(spark):
    ranked = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, pos long")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.9), (9, 1.0)], "id int, rerank double")
    assert [r.id for r in search.rerank(ranked, scores, 2).orderBy("pos").collect()] == [2, 1, 3]


def test_top_by_query_in_blocks(spark, monkeypatch):
    """Every pair is scored, over several blocks; copies, zero, null, short and long vectors too."""
    rng = random.Random(8)
    vecs = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(90)] + [[1.0, 2.0, 0.0, 1.0]] * 40 + [[0.0] * 4, None, [], [1.0], [1.0, None, 1.0, 1.0]]
    rows = list(enumerate(vecs))
    rng.shuffle(rows)
    monkeypatch.setattr(search, "INDEX_BLOCK", 30)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(search, "STEP", 4)
    index = spark.createDataFrame(rows, "vec_id long, v array<float>")
    queries = index.where("vec_id % 5 = 0 or vec_id > 128").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))
    found = {}
    for r in search.top_by_query(index, queries, 10).collect():
        found.setdefault(r.query, []).append((-r.score, r.vec_id))

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 6) if norm else 0.0

    want = {i: sorted((-cosine(v, w), j) for j, w in enumerate(vecs))[:10] for i, v in enumerate(vecs) if i % 5 == 0 or i > 128}
    assert {q: [j for _, j in sorted(x)] for q, x in found.items()} == {q: [j for _, j in x] for q, x in want.items()}


def test_reindex_agreement_makes_no_table_of_pairs(spark, capsys):
    from lodestone.queries import QUERIES

    QUERIES["reindex_agreement"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "collect_list" not in plan


def test_chunks_cover_text():
    body = "# T\n" + "\n\n".join("word " * 300 for _ in range(8)) + "\n## U\nshort tail"
    parts = list(chunking.split_text(body))
    assert parts[0][1] == 0 and parts[-1][2] == len(body) and parts[-1][0] == "T > U"
    assert all(chunking.estimate(p) <= chunking.LONGEST and body[a:b] == p == p.strip() for _, a, b, p in parts)
    assert all(n[1] <= b or not body[b : n[1]].strip() for (_, a, b, _), n in zip(parts, parts[1:], strict=False))
    assert list(chunking.split_text("")) == [] == list(chunking.split_text(" \n "))


def test_chunks_are_given_out_in_pieces(spark, monkeypatch):
    """Many and long texts: no batch of a worker's answer is much more than its limit, and the chunks
    are those of each text alone."""
    texts = {i: "\n\n".join(f"word{j} " * 200 for j in range(i % 40)) for i in range(600)} | {600: None}
    want = [(k, i, h, a, b, p, chunking.estimate(p)) for k, s in texts.items() for i, (h, a, b, p) in enumerate(chunking.split_text(s or ""))]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in chunking.chunk(docs, "doc_id", "text").orderBy("doc_id", "seq_no").collect()] == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(chunking.BATCH_ROWS)
    monkeypatch.setattr(chunking, "GIVEN_CHARS", 20_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": [s or "" for s in texts.values()]})
    parts = list(chunking.chunk_batches(iter([batch])))
    assert sum(p.num_rows for p in parts) == len(want) and max(sum(map(len, p.column("body").to_pylist())) for p in parts) < 20_000 + 4 * chunking.LONGEST


def test_chunk_ends():
    """A rest within the longest size is one chunk; a short last one joins the one before it."""
    assert len(list(chunking.split_text("a" * 2400))) == 1  # 672 tokens
    text = "a" * 2800 + "\n\n" + "b" * 20
    assert [len(p) for *_, p in chunking.split_text(text)] == [len("a" * 1830), 2800 - (1830 - 230) + 22]
    tail = list(chunking.split_text("# A\n" + "x" * 2790 + "\n\n" + "y" * 100))
    assert tail[-1][2] == 4 + 2790 + 2 + 100 and all(chunking.estimate(p) >= chunking.SHORTEST for *_, p in tail)
    two = list(chunking.split_text("# A\n" + "x" * 200 + "\n# B\nend"))
    assert [h for h, *_ in two] == ["A", "B"]
    for t in ("日本語" * 900, "mixed 日本 text " * 300):
        ruler = chunking.Ruler(t)
        for a, b in ((0, 10), (5, 800), (17, len(t))):
            assert ruler.tokens(a, b) == chunking.estimate(t[a:b])
        end, back = ruler.end(3, 100), ruler.back(0, 500, 64)
        assert chunking.estimate(t[3:end]) <= 100 < chunking.estimate(t[3 : end + 4]) and chunking.estimate(t[back:500]) <= 64 < chunking.estimate(t[back - 4 : 500])


def test_text_functions(spark):
    df = spark.createDataFrame([("Ａｂ　Ｃーー x、y.z",)], "t string")
    r = df.select(text.normalize_query(F.col("t")).alias("q"), text.readable_link(F.lit("a%20b+c")).alias("l"), text.readable_link(F.lit("50%")).alias("bad"), text.token_estimate(F.lit("あいう")).alias("n"), text.safe_file_name(F.lit('a/b:"c.')).alias("f"), text.is_empty_text(F.lit("--- * ")).alias("e")).first()
    assert tuple(r) == ("ab cー x y.z", "a b+c", "50%", 2, "a_b__c", True)


def test_query_normal_form_whole_texts(spark, tmp_path):
    from lodestone.queries import QUERIES

    texts = {1: "Ａb" * 100 + " tail", 2: "word " * 70, 3: "word " * 150, 4: "a" * 512, 5: "a" * 513, 6: "", 7: None}
    rows = [(i, 0, "user", x) for i, x in texts.items()] + [(8, 1, "user", "no first turn")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {i: " ".join(unicodedata.normalize("NFKC", x or "").lower().split()) for i, x in texts.items()}
    want = {i: x if 0 < len(x) <= 512 else None for i, x in whole.items()}
    assert {r.conv_id: r["query"] for r in QUERIES["query_normal_form"](spark, str(tmp_path)).collect()} == want


def test_readers(spark, tmp_path):
    files = {
        "a.csv": b"a;b\r\n1;\"x\r\ny\"\r\n\r\n2\r\n3;z\r\n4;z\r\n5;w\r\n",
        "b.sql": "create table t_a (id bigint primary key, price numeric(11, 2) default 0, constraint u unique (id)); -- x;y\ncomment on table t_a is 'it''s';\ncreate unique index i on t_a (id) where id > 0; drop table z;".encode(),
        "c.py": b"import os\nLIMIT = 3\nclass A:\n    x: int\n    def f(self, a=1) -> int:\n        raise ValueError('x')\n",
        "d.java": b'package p.q;\nimport java.util.List;\n@Entity(name = "x{")\npublic class Foo {\n  private int n = 3; // {\n  public int bar(int a) { if (a > 1) { return 2; } return a; }\n}\n',
        "e.md": "pre\n# H\n```\n# not\n```\nbody".encode(),
        "f.bin": b"x",
        "g.py": b"def (",
        "h.tsv": "名\t値\n".encode("cp932"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in readers.read_files(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.file[-6:].split("/")[-1], []).append(r)
    assert got["a.csv"][0].rows == [["a", "b"], ["1", "x\r\ny"], ["2", ""], ["3", "z"], ["4", "z"], ["5", "w"]] and got["a.csv"][0].heading == "ragged"
    kinds = {r.kind: r for r in got["b.sql"]}
    assert kinds["table"].rows[2] == ["price", "numeric(11, 2)", "default 0"] and kinds["comment"].text == "it's" and kinds["other"].text == "1" and kinds["index"].rows[1][:3] == ["t_a", "id", "○"]
    assert any(r.heading == "A" and r.rows[1][:4] == ["f", "self, a=1", "int", "ValueError"] for r in got["c.py"])
    java = next(r for r in got["d.java"] if r.kind == "class")
    assert java.heading == "Foo" and [m[0] for m in java.rows[1:]] == ["n", "bar"]
    assert [(r.heading, r.text) for r in got["e.md"]] == [("", "pre"), ("H", "```\n# not\n```\nbody")]
    assert got["f.bin"][0].code == "P001" and got["g.py"][0].code == "P010" and got["h.tsv"][0].rows == [["名", "値"]]


def test_sections(spark):
    items = spark.createDataFrame([("a", "t", "draft", {"n": "A"}), ("b", "t", "deprecated", {"n": "B"}), ("c", "u", "draft", {})], "id string, type string, status string, attrs map<string,string>")
    rel = spark.createDataFrame([("r", "c", "a", 1)], "type string, `from` string, `to` string, ord int")
    with pytest.raises(sections.PlanError):
        sections.compile_section({"kind": "items"}, items, rel)
    assert [r.id for r in sections.compile_section({"kind": "items", "type": "t", "columns": ["n"]}, items, rel).collect()] == ["a"]
    assert sections.compile_section({"kind": "trace", "type": "t", "relation": ["r"], "side": "to", "columns": ["n"]}, items, rel).first().linked == "c"
    twice = rel.union(rel)
    trace = {"kind": "trace", "type": "t", "relation": ["r"], "side": "to", "columns": ["n"]}
    assert sections.compile_section(trace, items, twice).first().n_linked == 1  # one other end, linked twice
    assert sections.compile_section(trace, items, rel.where("false")).count() == 0  # nothing linked at all: no rows
    assert sections.compile_section(trace | {"full": True}, items, rel.where("false")).first().linked == "―"
    assert sections.compile_section(trace | {"label": "n"}, items.union(items.limit(0)), rel.withColumn("from", F.lit("b"))).first().linked == "b B"
    null = spark.createDataFrame([(None, "x", "y", 1)], rel.schema)
    vocab = checks.Vocabulary(item_types=["t", "u"], relations=[checks.Relation("r", ["u"], ["t"])])
    full = items.union(spark.createDataFrame([("d", None, "draft", {})], items.schema)).withColumn("gaps", F.array().cast("array<string>"))
    assert [(r.code, r.target) for r in checks.validate(full, rel.union(null), vocab, ["E003", "E020"]).collect()] == [("E003", "d"), ("E020", "x-y")]
    assert sections.drop_blank_columns(items.select("id", F.lit("").alias("x"), "type"))[1] == ["x"]


def test_gate_and_coverage(spark):
    anchors = spark.createDataFrame([("f", "a1", "alpha beta"), ("f", "a2", "x")], "file string, anchor string, text string")
    records = spark.createDataFrame([("f", "a1", "gamma"), ("f", "a9", "x")], "file string, anchor string, statement string")
    found = checks.coverage_gate(anchors, records, records.where("false"))
    assert sorted((r.code, r.target) for r in found.collect()) == [("G001", "f#a2"), ("G004", "f#a9")]
    assert [r.code for r in checks.grounded(records, anchors).collect()] == ["G005"]
    assert checks.gate(found).first().errors == 2
    assert "2.1.0" in sinks.sarif(found)


def test_upsert_and_invoice(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    lines = spark.createDataFrame([("t", "search", 3, 1.5, 4)], "tenant string, kind string, quantity int, unit_price double, amount int")
    assert sinks.invoice_csv(lines).endswith(b"t,search,3,1.5000,4\r\n")


def test_token_bucket(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{s:02}") for i, s in enumerate([0, 0, 0, 1, 5, 5, 5, 5])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s string").withColumn("ts", F.to_timestamp("s"))
    got = [r.accepted for r in metering.token_bucket_batch(df, 1.0, 2.0).orderBy("k").collect()]
    assert got == [True, True, False, True, True, True, False, False]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    metering.daily_usage(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start().processAllAvailable()
    assert spark.sql("select sum(n) as n from daily").first().n == events.count()
    q = metering.token_bucket(stream, 1 / 14400, 5.0).writeStream.outputMode("append").format("memory").queryName("bucket").start()
    q.processAllAvailable()
    want = metering.token_bucket_batch(events, 1 / 14400, 5.0)
    assert spark.table("bucket").exceptAll(want).count() == 0 and spark.table("bucket").count() == events.count()
    for s in spark.streams.active:
        s.stop()
