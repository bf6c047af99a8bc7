"""URL filters over redirect equivalence.

Rules block or allow a host with its subdomains below a path. Redirects and
canonical links connect urls that name the same page; a decision on one alias
holds for the others. The reference's records carry no urls, so the operator is
general: it takes any table of ids and urls.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import ascii_lower, connected_components


class UrlRule(NamedTuple):
    """``where`` is a host and a path, like ``example.org/en/``; ``verdict`` is allow or block."""

    where: str
    verdict: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """The url that a site's redirects usually end at: no scheme, ``www.`` or ``m.``, query, fragment, final slash or ``.html``.

    Urls that differ in their query alone therefore count as one page.
    """
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    return F.concat(F.lit("//"), host, F.regexp_replace(url_path(url), r"(/|\.html?)$", ""))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty if it is missing."""
    at = lambda group: F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))", group)
    return F.trim(F.concat(at(1), at(2), at(3)))


def absolute_url(base: Column, to: Column) -> Column:
    """``to`` as found on the page ``base``, made absolute; null if it leads to no other url.

    Takes absolute urls, ``//host/path``, ``/path``, paths relative to the page's
    folder with ``.`` and ``..``, and ``?query``. A fragment alone, another
    scheme without ``://`` (mailto, script) or a base without ``://`` gives null.
    """
    scheme = F.regexp_extract(base, r"^[^:/?#]*:(?=//)", 0)
    root = F.concat(scheme, F.lit("//"), F.regexp_extract(_rest(base), r"^[^/?#]*", 0))
    path = url_path(base)
    joined = F.when(to.startswith("/"), to).when(to.startswith("?"), F.concat(path, to)).otherwise(
        F.concat(F.regexp_extract(F.concat(F.lit("/"), path), r"^/(.*/)?", 1), to)
    )
    tail = F.regexp_extract(joined, r"[?#].*$", 0)
    steps = F.split(F.regexp_replace(F.regexp_extract(joined, r"^[^?#]*", 0), "^/", ""), "/")
    # a final dot step names a folder: it leaves an empty last step
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda so_far, x: F.when(x == ".", so_far)
        .when(x == "..", F.slice(so_far, 1, F.greatest(F.size(so_far) - 1, F.lit(0))))
        .otherwise(F.concat(so_far, F.array(x))),
    )
    here = F.concat(root, F.lit("/"), F.array_join(walked, "/"), tail)
    return (
        F.when((to == "") | to.startswith("#"), None)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (scheme == ""), None)
        .when(to.startswith("//"), F.concat(scheme, to))
        .otherwise(here)
    )


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): every canonical link and refresh redirect that pages declare, made absolute.

    Tags and attributes count in any case and order, values quoted or not. A
    null url or html, or a target that leads nowhere, gives no link.
    """
    h = F.col(html)
    low = F.lower(h)
    none = F.array().cast("array<string>")
    links = F.when(low.contains("canonical"), F.regexp_extract_all(h, F.lit(r"(?i)<link\s[^>]*>"), F.lit(0)))
    metas = F.when(low.contains("http-equiv"), F.regexp_extract_all(h, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)))
    canonical = F.filter(links, lambda t: _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    refresh = F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.concat(
        F.coalesce(F.transform(canonical, lambda t: _attribute(t, "href")), none),
        F.coalesce(
            F.transform(refresh, lambda t: F.regexp_extract(_content(t), r"(?i)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"'\s]+)", 1)), none
        ),
    )
    found = pages.select(F.col(url).alias("a"), F.explode(to).alias("to"))
    target = absolute_url(F.col("a"), F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")))
    return found.select("a", target.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def _content(tag: Column) -> Column:
    """The content of a refresh, which may hold quotes of the other kind."""
    at = lambda group: F.regexp_extract(tag, r"(?i)[\s\"']content\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", group)
    return F.trim(F.concat(at(1), at(2), at(3)))


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none: the table as one expression."""
    none = (F.lit(None).cast("string"), F.lit(None).cast("string"))

    def add(so_far: tuple[Column, Column], r: UrlRule) -> tuple[Column, Column]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        return F.when(fits, F.lit(r.where)).otherwise(so_far[0]), F.when(fits, F.lit(r.verdict)).otherwise(so_far[1])

    return reduce(add, sorted(rules, key=lambda r: (len(r.where), r.where)), none)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    links: DataFrame | None = None,
    url: str = "url",
) -> DataFrame:
    """Every page with its ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``links`` (a, b) are redirect and canonical edges between urls; the usual
    alias of each url is always linked. The longest fitting rule decides a page.
    A page without one follows its aliases: allowed if any alias is allowed by a
    rule, else blocked if any is blocked, else allowed. Aliases are the connected
    component of its url, whether or not they are pages themselves. Null urls
    have no alias and are allowed; repeated rows get equal verdicts; other
    columns are carried along, those of the four names replaced. Decisions meet
    by url and component, never by host, and hubs are combined before a shuffle.
    """
    base = pages.drop("host", "path", "rule", "verdict", "component_id")
    u = F.col(url)
    edges = base.where(u.contains("://")).select(u.alias("a"), alias_of(u).alias("b"))
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
        # targets have their usual aliases too
        target = links.where(F.col("b").contains("://"))
        edges = edges.unionByName(target.select(F.col("b").alias("a"), alias_of(F.col("b")).alias("b")))
    members = connected_components(edges)
    own = matching_rule(url_host(F.col("id")), url_path(F.col("id")), rules)[1]
    decided = (
        members.groupBy("component_id")
        .agg(F.bool_or(own == "allow").alias("allowed"), F.bool_or(own == "block").alias("blocked"))
        .where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)))
    )
    blocked = members.join(decided.select("component_id"), "component_id", "left_semi").select(
        F.col("id").alias("_id"), F.lit(True).alias("_blocked")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        base.withColumns({"host": url_host(u), "path": url_path(u)})
        .withColumns({"rule": rule, "_own": verdict})
        .join(blocked, u == F.col("_id"), "left")
        .withColumn(
            "verdict",
            F.coalesce("_own", F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))),
        )
        .drop("_own", "_id", "_blocked")
    )
