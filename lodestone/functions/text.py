"""Text functions as column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags whose content goes, and tags that end a line.
DROPPED_TAGS = ("script", "style", "nav", "header", "footer")
BLOCK_TAGS = "p|div|li|tr|table|section|article|blockquote"
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Weights of the token estimate for wide and other characters.
WIDE_WEIGHT, OTHER_WEIGHT = 0.72, 0.28
WIDE = "[\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uFF66-\\uFF9F]"


def html_to_text(col: Column, decode: Callable[[Column], Column] | None = None) -> Column:
    """Visible text of html: headings as # lines apart from the rest, a line break after blocks,
    entities decoded (``decode``, by default the common ones), lines trimmed, at most one blank
    line in a row."""
    t = F.regexp_replace(col, f"(?is)<({'|'.join(DROPPED_TAGS)})\\b.*?</\\1>", "")
    for n in range(1, 7):
        t = F.regexp_replace(t, f"(?is)<h{n}\\b[^>]*>\\s*(.*?)\\s*</h{n}>", "\n\n" + "#" * n + " $1\n\n")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>", "\n")
    t = F.regexp_replace(t, f"(?i)</(?:{BLOCK_TAGS})>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    if decode is None:
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(name), F.lit(char))
    else:
        t = decode(t)
    t = F.regexp_replace(t, "[ \\t\\r\\x0B\\f\\u00a0\\u3000]*\\n[ \\t\\r\\x0B\\f\\u00a0\\u3000]*", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")


def normalize_ingest(col: Column) -> Column:
    """One newline form, no invisible or control characters, no trailing blanks or blank runs."""
    t = F.regexp_replace(col, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "[\\u200B-\\u200D\\u2060\\uFEFF\\u00AD]", "")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    t = F.replace(t, F.lit("　"), F.lit(" "))
    t = F.regexp_replace(t, "[ \\t]+\\n", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t"))


def is_empty_text(col: Column) -> Column:
    """Nothing but rules and bullets."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[\\s\\u3000\\-=_*#|]+", "") == ""


def token_estimate(col: Column) -> Column:
    """max(1, half-even round of the weighted length), 0 for empty text."""
    wide = F.length(col) - F.length(F.regexp_replace(col, WIDE, ""))
    x = F.bround(wide * F.lit(WIDE_WEIGHT) + (F.length(col) - wide) * F.lit(OTHER_WEIGHT), 0)
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), x.cast("int"))).cast("bigint")


def snippet(body: Column, terms: Column, lead: int = 40, window: int = 160) -> Column:
    """A window from ``lead`` characters before the earliest term of two or more characters."""
    at = F.array_min(F.filter(F.transform(F.filter(terms, lambda t: F.length(t) >= 2), lambda t: F.instr(F.lower(body), F.lower(t))), lambda i: i > 0))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(1)) - 1 - lead)
    cut = F.substring(body, (start + 1).cast("int"), F.lit(window))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + window < F.length(body), "…").otherwise(""))


def search_terms(query: Column) -> Column:
    return F.filter(F.split(query, " "), lambda t: t != "")


def is_phrase(query: Column) -> Column:
    return query.rlike('^".*"$') & (F.length(query) >= 2)


def term_frequency(text: Column, term: Column | str) -> Column:
    """Occurrences that do not overlap."""
    t = F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(t) > 0, (F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).otherwise(0).cast("bigint")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All html entities; the built-in chain above knows the common ones."""
    return s.map(lambda x: None if x is None else html.unescape(x))


#: Marks that part search words; full stops and commas stay, they belong to codes.
QUERY_NOISE = "[。、・「」『』()\\[\\]{}【】〈〉〔〕…‥]"


def normalize_query(col: Column, longest: int = 512) -> Column:
    """NFKC, lower case, marks as spaces, one closing long mark of a word cut, blanks collapsed;
    null for blank queries and for those of more than ``longest`` characters as typed."""
    t = F.regexp_replace(F.lower(nfkc(col)), QUERY_NOISE, " ")
    t = F.regexp_replace(t, "ー(?=[\\s\\u3000]|$)", "")
    t = F.btrim(F.regexp_replace(t, "[\\s\\u3000]+", " "), F.lit(" "))
    return F.when((F.length(col) <= longest) & (F.regexp_replace(col, "[\\s\\u3000]+", "") != ""), t)


def mask_digits(col: Column) -> Column:
    return F.regexp_replace(col, "\\d+", "N")


def escape_markdown_cell(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def safe_file_name(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, '[\\\\/:*?"<>|\\x00-\\x1F]', "_"), "^[. ]+|[. ]+$", "")


def readable_link(col: Column) -> Column:
    """Percent-decoded, or unchanged where that fails. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def short_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 12)


def cache_key(model: Column, kind: Column, text: Column) -> Column:
    """Key of an embedding: model, kind, and the text in NFKC with blanks collapsed."""
    return F.sha2(F.concat_ws("\x00", model, kind, F.btrim(F.regexp_replace(nfkc(text), "\\s+", " "))), 256)


def full_match(col: Column, pattern: str) -> Column:
    return col.rlike(f"^(?:{pattern})$")


def labelled_rows(header: Column, row: Column) -> Column:
    """A record of a table as ``column: value`` lines; blank values and those without a heading go."""
    pairs = F.zip_with(header, row, lambda h, v: F.when((F.trim(F.coalesce(v, F.lit(""))) != "") & (F.trim(F.coalesce(h, F.lit(""))) != ""), F.concat(F.trim(h), F.lit(": "), F.trim(v))))
    return F.array_join(F.array_compact(pairs), "\n")


def unwrap_markdown(col: Column) -> Column:
    """Links and images of Markdown as their texts, but for lines inside code fences."""

    def line(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")

    folded = F.aggregate(
        F.split(col, "\n", -1),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("code")),
        lambda a, x: F.struct(F.concat(a["out"], F.array(F.when(a["code"] | x.rlike(r"^\s*(```|~~~)"), x).otherwise(line(x)))).alias("out"), F.when(x.rlike(r"^\s*(```|~~~)"), ~a["code"]).otherwise(a["code"]).alias("code")),
        lambda a: F.array_join(a["out"], "\n"),
    )
    return folded


#: First bytes (hexadecimal) of file kinds.
MAGIC = (("504b0304", "zip"), ("d0cf11e0a1b11ae1", "ole"), ("25504446", "pdf"), ("89504e470d0a1a0a", "png"), ("ffd8ff", "jpeg"), ("47494638", "gif"), ("1f8b", "gzip"), ("efbbbf", "utf8-bom"), ("fffe", "utf16le"), ("feff", "utf16be"))


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes; null when none fits."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    return F.coalesce(*(F.when(head.startswith(m), kind) for m, kind in MAGIC))


def elapsed(seconds: Column) -> Column:
    """[h]:mm of a number of seconds."""
    minutes = F.floor(seconds / 60)
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def sheet_date(stamp: Column) -> Column:
    """A cell's date: the date alone at midnight, else with the time; seconds only when they are set."""
    time = F.date_format(stamp, "HH:mm:ss")
    return F.when(time == "00:00:00", F.date_format(stamp, "yyyy-MM-dd")).when(time.endswith(":00"), F.date_format(stamp, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))


@F.pandas_udf(StringType())
def general_number(value: pd.Series) -> pd.Series:
    """A number with up to 15 significant digits, without trailing zeros."""
    return value.map(lambda x: None if pd.isna(x) else f"{x:.15g}")


def percent(value: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(value * 100, digits)), F.lit("%"))


def points(emu: Column) -> Column:
    """Drawing units as points."""
    return emu / 12700.0
