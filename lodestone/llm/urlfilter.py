"""URL filters: allow and block rules, carried to aliases over redirect and canonical-link edges.

Nodes are urls in one form: lower-case host without a default port, path, query without tracking
parameters; scheme and fragment do not count. Edges join a page's url with the targets of its
canonical links and redirects. Every node is judged by the rules, whether it is a page or only a
target; a block reaches all nodes of its component but those that an allow rule fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, fresh
from lodestone.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are expressions of one row; more are a table, joined on host suffixes and
#: path prefixes.
INLINE_RULES = 200
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that name a visit and not a page.
TRACKING = "utm_[a-z]+|gclid|fbclid|dclid|msclkid|mc_cid|mc_eid|igshid|yclid|_ga"
_TAGS = {"link": r"(?is)<link\b[^>]*>", "meta": r"(?is)<meta\b[^>]*>", "base": r"(?is)<base\b[^>]*>"}
#: The entities that occur in attributes of urls. The ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is named once: as a plain expression it would be copied to every place
    where ``fn`` uses it, and copies of copies multiply."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]], what: str) -> Column:
    """The longest rule that fits (its text, or its verdict), else null. ``rules``: (verdict,
    host/path) pairs; equal texts: the allow rule."""
    tries = []
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "allow")):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        tries.append(F.when(fits, F.lit(text if what == "rule" else verdict)))
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def rules_by_join(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, says for the distinct ``places`` (host, path) that a rule fits; ``rules``:
    verdict, rule. Each place asks with every suffix of its host and with its path cut at every
    length that rules have: an equi-join, whatever the number of rules of one host."""
    cut_rule = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("at"), F.expr("substr(rule, instr(rule, '/'))").alias("start")).where("instr(rule, '/') > 0")
    best = cut_rule.groupBy("at", "start").agg(F.min("verdict").alias("says"), F.min("rule").alias("rule"))  # allow before block
    lengths = [r[0] for r in best.select(F.length("start")).distinct().limit(4097).collect()]
    if len(lengths) > 4096:
        raise ValueError("rules of more than 4096 different path lengths")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.transform(F.array(*map(F.lit, lengths or [1])), lambda n: F.substring("path", 1, n)))
    asked = places.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("at"), starts.alias("starts")).select("host", "path", "at", F.explode("starts").alias("start"))
    found = asked.join(best, ["at", "start"])
    return found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "says"), F.struct(F.length("rule"), "rule")).alias("r")).select("host", "path", "r.rule", "r.says")


def canonical(url: Column) -> Column:
    """The node of a url: host, path and the query that is left without tracking parameters; an
    empty path is ``/``. Null without a host."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    path, query = path_of(url), query_of(url)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{TRACKING})(?:=|$)")), "&")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _decoded(col: Column) -> Column:
    for entity, sign in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(sign))
    return F.btrim(col)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; empty where it is absent."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    one = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*'([^']*)'""", 1)
    bare = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*([^\s"'>]+)""", 1)
    return _decoded(_let(found, lambda f: F.when(f != "", f).otherwise(_let(one, lambda o: F.when(o != "", o).otherwise(bare)))))


def resolve(base: Column, link: Column) -> Column:
    """``link`` as a whole url, read on a page with the url ``base``: whole urls, //host, /path,
    ?query and relative paths with . and .. segments. Null for a bare fragment, an empty link, a
    scheme without a host and a base without a host."""
    return _let(base, lambda b: _let(link, lambda x: _resolved(b, x)))


def _resolved(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.when(path_of(base) == "", F.lit("/")).otherwise(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1))
    rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)

    def walked(whole: Column) -> Column:
        steps = F.aggregate(
            F.split(whole, "/", -1),
            F.array().cast("array<string>"),
            lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a)).otherwise(F.concat(a, F.array(x))),
        )
        path = F.concat(F.array_join(steps, "/"), F.when(whole.rlike(r"/\.\.$"), F.lit("/")).otherwise(F.lit("")))
        return _let(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))

    def on_host(bare: Column) -> Column:
        whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
        path = _let(F.regexp_replace(whole, r"(?:/\.)+(?=/|$)", ""), walked)
        return F.when(bare == "", F.concat(root, path_of(base), rest)).otherwise(F.concat(root, path, rest))

    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == "") | link.startswith("#") | (root == ""), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .otherwise(_let(F.regexp_extract(link, r"(?s)^([^?#]*)", 1), on_host))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst: whole urls joined by canonical links and redirects in the pages' html. All such
    tags count, entities are decoded, and links are resolved against the first <base> or the page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    near = html.rlike(r"(?i)canonical|http-equiv")  # most pages are done after this
    rows = pages.where(near & F.col("url").isNotNull()).select("url", *(F.regexp_extract_all(html, F.lit(p), 0).alias(k) for k, p in _TAGS.items()))
    canonicals = F.transform(F.filter("link", lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")), lambda t: _attribute(t, "href"))
    refresh = F.filter("meta", lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    redirects = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1))
    base = F.coalesce(resolve(F.col("url"), _attribute(F.get("base", F.lit(0)), "href")), F.col("url"))
    # resolved and filtered below the explode: filters on its rows are not copied past it
    targets = F.transform(F.array_distinct(F.concat(canonicals, redirects)), lambda x: resolve(F.col("base"), F.btrim(x)))
    rows = rows.withColumn("base", base).select(F.col("url").alias("src"), F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("dst"))
    return rows.distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict. ``rules``: (verdict, host/path) pairs, or a table
    of verdict and rule; ``edges``: src, dst (urls), by default those of the pages' html.

    A rule that fits decides. Otherwise a page is blocked if any node of its component is blocked by
    a rule; an explicit allow protects the page that it fits, not its aliases, and does not stop a
    block from passing. Pages without a host are their own component and allowed. Null html has no
    links; repeated rows are judged alike; columns of the added names are replaced, others pass,
    whatever their names. Nodes in components are known by 128-bit hashes. Only nodes of edges
    are shuffled, hubs are aggregated before shuffles."""
    spark = pages.sparkSession
    if isinstance(rules, list) and len(rules) > INLINE_RULES:
        rules = spark.createDataFrame(rules, "verdict string, rule string")
    edges = link_edges(pages) if edges is None else edges

    def ruled(rows: DataFrame, rule: str, says: str) -> DataFrame:
        if isinstance(rules, list):
            return rows.withColumns({rule: rule_for(F.col("host"), F.col("path"), rules, "rule"), says: rule_for(F.col("host"), F.col("path"), rules, "verdict")})
        held, path = fresh(rows, "at", "start")
        found = rules_by_join(rows, rules).select(F.col("host").alias(held), F.col("path").alias(path), F.col("rule").alias(rule), F.col("says").alias(says))
        rows = rows.drop(rule)
        return rows.join(found, (F.col("host") == F.col(held)) & (F.col("path") == F.col(path)), "left").drop(held, path)

    # nodes of edges: their hashes, their components, and which of them a block rule fits
    named = edges.select("src", "dst", canonical(F.col("src")).alias("a"), canonical(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b")
    named = cut(named.select("src", "dst", F.md5("a").alias("a"), F.md5("b").alias("b")), "url-edges")
    roots = cut(components(named, "a", "b"), "url-components")
    nodes = named.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.col("a").alias("node")), F.struct(F.col("dst").alias("url"), F.col("b").alias("node")))).alias("n")).select("n.*")
    nodes = nodes.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    bad = ruled(nodes, "rule", "says").where("says = 'block'").select("node").distinct()
    blocked = roots.join(roots.join(bad, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")
    node, alias, says = fresh(pages.drop("host", "path", "rule", "verdict"), "node", "alias", "says")
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = ruled(out, "rule", says)
    reached = cut(blocked.select(F.col("node").alias(alias)), "url-blocked")
    if reached.count() <= INLINE_RULES * 1000:
        reached = F.broadcast(reached)
    out = out.withColumn(node, F.md5(canonical(F.col("url")))).join(reached, F.col(node) == F.col(alias), "left")
    out = out.withColumn("verdict", F.coalesce(says, F.when(F.col(alias).isNotNull(), "block").otherwise("allow")))
    return out.drop(node, alias, says)
