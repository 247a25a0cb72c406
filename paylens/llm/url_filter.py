"""URL filters with redirect equivalence.

Redirects and canonical links tie URLs to each other; the connected components
of these ties are classes of aliases. A URL that a rule fits takes the rule's
verdict. Another takes its class's: allow if an alias is allowed by a rule,
else block if an alias is blocked by one, else allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case; path: then up to ``?``, ``#`` or the end. A URL that is null or
has no ``://`` has neither, fits no rule but one of an empty host, and has no
aliases. A rule fits its host and all subdomains if the path starts with the
rule's; the longest (host and path together) wins, of equals an allow.

Ties come from ``<link rel=canonical href>``, from ``<meta http-equiv=refresh>``
and from a table of redirects; what stands in comments, scripts and styles of a
page ties nothing. A node is a URL's host, its path with ``.`` and ``..``
resolved, and its query, so URLs that differ in one of these are two pages; the
scheme and what follows ``#`` do not count. Rules fit an alias by its resolved
path. In links, character references to ASCII characters are read, and a link
of another scheme without ``://`` (``mailto:``) ties nothing.

Null html ties nothing. Repeated rows are judged alike and come out as often as
they come in; an empty table gives an empty one. Long URLs and pages are read
whole. Ties between rules go to allow, then to the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import prepare
from paylens.llm.components import components

Rule = tuple[str, str, str]  # verdict, host, path
#: Rules are part of the plan, so they are bounded.
MAX_RULES = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*[\"']?([^\"'>\s]+)"


_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_REFERENCE = r"&#(?:0*[0-9]{1,3}|[xX]0*[0-9a-fA-F]{1,2});"
#: References by name, without that to ``&`` itself, which is read last.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))


def resolved(path: Column) -> Column:
    """The path without segments ``.`` and ``..``; ``/`` if it is empty."""
    parts = F.split(path, "/", -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))
    parts = F.when(path.rlike(r"/\.\.?\z"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(path == "", "/").when(F.instr(path, "/.") > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def unescaped(link: Column) -> Column:
    """The link with its references to ASCII characters read."""
    for name, letter in NAMED.items():
        link = F.replace(link, F.lit(name), F.lit(letter))

    def read(text: Column, reference: Column) -> Column:
        digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
        code = F.conv(digits, 16, 10).cast("int")
        code = F.when(F.lower(reference).startswith("&#x"), code).otherwise(F.conv(digits, 10, 10).cast("int"))
        return F.when((code > 0) & (code < 128) & (code != 38), F.replace(text, reference, F.char(code))).otherwise(text)

    link = F.aggregate(F.regexp_extract_all(link, F.lit(_REFERENCE), F.lit(0)), link, read)
    return F.regexp_replace(link, "&(?:amp|#0*38|#[xX]0*26);", "&")


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The position of the rule that decides, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][0] != "allow", i))
    return F.coalesce(
        F.lit(None).cast("int"),
        *[
            F.when(((host == rules[i][1]) | host.endswith("." + rules[i][1])) & path.startswith(rules[i][2]), i)
            for i in order
        ],
    )


def _target(link: Column, host: Column, path: Column) -> Column:
    """A link as an absolute URL; null where it leads to no page."""
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .when(link.startswith("?"), F.concat(F.lit("x://"), host, path, link))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), link))
    )


def key_of(url: Column) -> Column:
    """The node of a URL, null if it has no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, resolved(path_of(url)), query_of(url)))


def ties(pages: DataFrame, url_col: str, html_col: str, redirects: DataFrame | None) -> DataFrame:
    """(a, b): keys of URLs that stand for the same page, each pair once."""
    # A step of its own, so that each page is cut once for all patterns.
    read = pages.select(F.col(url_col).alias("source"), F.regexp_replace(F.col(html_col), _UNREAD, "").alias("page"))
    page = F.col("page")
    found = [F.regexp_extract(page, _CANONICAL, i) for i in (1, 2, 3)]
    canonical = F.coalesce(*[F.when(f != "", f) for f in found])
    refresh = F.regexp_extract(page, _REFRESH, 1)
    linked = read.select("source", F.explode(F.array(canonical, refresh)).alias("link"))
    linked = linked.where("link is not null and link <> ''").withColumn("host", host_of(F.col("source"))).where("host <> ''")
    edges = linked.select("source", _target(F.trim(unescaped(F.col("link"))), F.col("host"), path_of(F.col("source"))).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source"), F.col("target")))
    a, b = key_of(F.col("source")), key_of(F.col("target"))
    return edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row a page: its host and path, the rule that fits (host and path, or null) and the verdict.

    ``redirects`` has columns source and target, both URLs. A node with very
    many aliases is a row as any other: classes carry two flags, not members.
    """
    prepare(pages.sparkSession)
    edges = ties(pages, url_col, html_col, redirects).checkpoint()
    roots = components(edges, "a", "b").checkpoint()
    node_rule = fitting_rule(F.substring_index("node", "/", 1), F.regexp_extract("node", r"(?s)^[^/]*(/[^?]*)", 1), rules)
    verdicts = F.array(*[F.lit(r[0]) for r in rules]) if rules else F.array().cast("array<string>")
    explicit = F.get(verdicts, node_rule)
    classes = (
        roots.withColumn("explicit", explicit)
        .groupBy("root")
        .agg(F.bool_or(F.col("explicit") == "allow").alias("allowed"), F.bool_or(F.col("explicit") == "block").alias("blocked"))
    )
    aliases = roots.join(classes, "root").select(F.col("node").alias("key"), "allowed", "blocked")
    url = F.col(url_col)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    own = own.withColumn("n", fitting_rule(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(r[1] + r[2]) for r in rules]) if rules else F.array().cast("array<string>")
    by_class = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return own.join(aliases, "key", "left").select(
        "page_id",
        "host",
        "path",
        F.get(names, F.col("n")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("n")), by_class).alias("verdict"),
    )
