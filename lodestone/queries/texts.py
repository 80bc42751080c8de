"""Text extraction, normalisation, estimates, snippets, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import chunking, text
from lodestone.operators import joins
from lodestone.queries.registry import query
from lodestone.sources import readers


def _html_sql(col: str) -> str:
    """The same steps in SQL, one tag at a time (its expressions have no back references)."""
    blank = "[ \\t\\r\\x0B\\f\\x{00a0}\\x{3000}]*"
    t = col
    for tag in ("script", "style", "nav", "header", "footer"):
        t = f"regexp_replace({t}, '<{tag}\\b.*?</{tag}>', '', 'gis')"
    for n in range(1, 7):
        t = f"regexp_replace({t}, '<h{n}\\b[^>]*>\\s*(.*?)\\s*</h{n}>', chr(10) || chr(10) || '{'#' * n} \\1' || chr(10) || chr(10), 'gis')"
    t = f"regexp_replace({t}, '<br\\s*/?>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '</(p|div|li|tr|table|section|article|blockquote)>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for name, char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {char})"
    t = f"regexp_replace({t}, '{blank}\\n{blank}', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g')"


@query(f"select page_id, sha256({_html_sql('html')}) as text_hash, length({_html_sql('html')})::bigint as n_chars from pages")
def html_text(t, spark):
    """Visible text of each page."""
    d = t("pages").select("page_id", text.html_to_text(F.col("html")).alias("x"))
    return d.select("page_id", F.sha2("x", 256).alias("text_hash"), F.length("x").cast("long").alias("n_chars"))


@query(f"""with l as (select page_id, unnest(string_split({_html_sql('html')}, chr(10))) as line, generate_subscripts(string_split({_html_sql('html')}, chr(10)), 1) as pos from pages),
 s as (select *, sum(case when regexp_matches(line, '^#{{1,6}} ') then 1 else 0 end) over (partition by page_id order by pos) as section from l)
 select page_id, section::bigint as section, count(*)::bigint as n_lines, max(case when regexp_matches(line, '^#{{1,6}} ') then line end) as heading from s group by 1, 2""")
def heading_section(t, spark):
    """Lines by the heading above them."""
    w = Window.partitionBy("page_id").orderBy("pos")
    l = t("pages").select("page_id", F.posexplode(F.split(text.html_to_text(F.col("html")), "\n")).alias("pos", "line"))
    head = F.col("line").rlike("^#{1,6} ")
    s = l.withColumn("section", F.sum(F.when(head, 1).otherwise(0)).over(w).cast("long"))
    return s.groupBy("page_id", "section").agg(F.count("*").alias("n_lines"), F.max(F.when(head, F.col("line"))).alias("heading"))


_NORM = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '　', ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query(f"select doc_id, sha256({_NORM}) as text_hash, length({_NORM})::bigint as n_chars from documents")
def normalize_ingest(t, spark):
    """Ingest normal form."""
    d = t("documents").select("doc_id", text.normalize_ingest(F.col("text")).alias("x"))
    return d.select("doc_id", F.sha2("x", 256).alias("text_hash"), F.length("x").cast("long").alias("n_chars"))


@query("select doc_id, case when length(text) = 0 then 0 else greatest(1, round_even(length(text) * 0.28, 0)::int) end::bigint as n_tokens from documents")
def token_estimate(t, spark):
    """Weighted length of each document (no wide characters in these tables)."""
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query("""with d as (select doc_id, text, nullif(least(coalesce(nullif(instr(lower(text), 'thou'), 0), 1000000000), coalesce(nullif(instr(lower(text), 'tion'), 0), 1000000000)), 1000000000) as first_at from documents),
 s as (select *, greatest(0, coalesce(first_at, 1) - 1 - 40) as start from d)
 select doc_id, case when start > 0 then '…' else '' end || substr(text, start + 1, 160) || case when start + 160 < length(text) then '…' else '' end as snippet from s""")
def snippet(t, spark):
    """A window around the earliest term."""
    terms = F.array(F.lit("thou"), F.lit("tion"), F.lit("x"))
    return t("documents").select("doc_id", text.snippet(F.col("text"), terms).alias("snippet"))


@query()
def near_statement_pairs(t, spark):
    """Benchmark statements and reworded ones that say nearly the same (tested on a fixture)."""
    d = t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("statement"))
    again = d.select((F.col("id") + 1_000_000).alias("id"), F.regexp_replace("statement", r"\b(the|of|and|de|la|der|die) ", "").alias("statement"))
    both = d.union(again).select("id", F.concat(F.lit("type"), F.col("id") % 10).alias("type"), "statement", F.array(F.col("id").cast("string")).alias("sources"), F.when(F.col("id") % 17 == 0, "deprecated").otherwise("review").alias("status"))
    return joins.near_statements(both)


@query()
def chunks(t, spark):
    """Documents in chunks with overlap (cursor over paragraphs, tested on a fixture)."""
    return chunking.chunk(t("documents"), "doc_id", "text")


@query()
def query_normal_form(t, spark):
    """First turns of conversations as search queries (compatibility forms have no SQL)."""
    d = t("conversations").where("turn = 0").select("conv_id", F.col("text").alias("q"))
    return d.select("conv_id", text.normalize_query(F.col("q")).alias("query"))


@query("select page_id, regexp_replace(url, '[0-9]+', 'N', 'g') as shape, replace(replace(url, '|', '\\|'), chr(10), '<br>') as cell, substr(sha256(url), 1, 12) as short_hash from pages")
def link_forms(t, spark):
    """Digits masked, cells escaped, short hashes."""
    u = F.col("url")
    return t("pages").select("page_id", text.mask_digits(u).alias("shape"), text.escape_markdown_cell(u).alias("cell"), text.short_hash(u).alias("short_hash"))


@query()
def parsed_pages(t, spark):
    """Pages through the html reader: sections with their headings (tested on a fixture)."""
    files = t("pages").where("html is not null").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return readers.parse_files(files).select("file", "anchor", "heading", "kind", "code", F.sha2("text", 256).alias("text_hash"))
