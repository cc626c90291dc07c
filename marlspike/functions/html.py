"""Markup functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspike.functions import url as U

#: Entities in the order they are resolved; the order makes `&amp;lt;` come out as `<` (fixed values).
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
#: Meta keys of a publishing time, by trust (fixed values).
PUBLISHED_KEYS = "article:published_time og:published_time publishdate pubdate publisheddate date dc.date dc.date.issued".split()


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def strip_tags(markup: Column) -> Column:
    """Text of markup: scripts, styles and tags become a space, then entities, then white space."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return _squeezed(text)


def strip_tags_loose(markup: Column) -> Column:
    """The discovery variant: comments go first, entities in any case, no apostrophe entity."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, sign in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = F.regexp_replace(text, f"(?i)&{entity};", sign)
    return _squeezed(text)


def main_text(markup: Column, limit: int = 8000) -> Column:
    """Text of the first main, else article, else body, else everything, cut to `limit` with an ellipsis."""
    chosen = F.coalesce(*[F.nullif(F.regexp_extract(markup, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("main", "article", "body")], markup)
    text = strip_tags(chosen)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def title(markup: Column) -> Column:
    return _squeezed(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def tag_texts(markup: Column, tag: str, limit: int = 20) -> Column:
    texts = F.transform(F.regexp_extract_all(markup, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), strip_tags_loose)
    return F.slice(F.filter(texts, lambda t: t != ""), 1, limit)


def link_texts(markup: Column, limit: int = 60) -> Column:
    texts = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), strip_tags_loose)
    return F.slice(F.filter(texts, lambda t: F.length(t).between(2, 30)), 1, limit)


def resolved(reference: Column, base: Column) -> Column:
    """An absolute address for a reference on a page; null for mail, script and empty ones."""
    ref = F.trim(reference)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when((ref == "") | ref.startswith("#"), None)
        .when(ref.rlike(r"^(?i)https?://"), ref)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .otherwise(F.concat(folder, F.regexp_replace(ref, r"^\./", "")))
    )


def links(markup: Column, base: Column) -> Column:
    """array<struct<url, class>> of href and src, in order; class is feed, sitemap, attachment or page, in this precedence."""
    found = F.regexp_extract_all(markup, F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']([^\"'#][^\"']*)[\"']"), 1)
    urls = F.filter(F.transform(found, lambda r: resolved(r, base)), lambda u: u.isNotNull())
    kind = lambda u: F.when(u.rlike(r"(?i)(rss|atom|feed)[^/]*(\.xml)?$|/feed/?$"), "feed").when(u.rlike(r"(?i)sitemap[^/]*\.(xml|txt)"), "sitemap").when(U.is_attachment(u), "attachment").otherwise("page")
    return F.transform(urls, lambda u: F.struct(u.alias("url"), kind(u).alias("class")))


def same_site_links(markup: Column, base: Column, limit: int = 200) -> Column:
    """Distinct addresses on the page's own host, anchors cut, first ones kept."""
    urls = F.transform(links(markup, base), lambda x: F.regexp_replace(x["url"], r"#.*$", ""))
    return F.slice(F.array_distinct(F.filter(urls, lambda u: U.domain_of(u) == U.domain_of(base))), 1, limit)


def pagination_links(markup: Column, base: Column) -> Column:
    """Distinct addresses of links whose label says next or more, or whose file is a numbered list."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)(<a\b[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.{0,40}?</a>)"), 1)
    reference = lambda t: F.regexp_extract(t, r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    leads = lambda t: F.regexp_replace(t, r"<[^>]+>", "").rlike("(?i)下一页|下页|next|more|更多|»") | reference(t).rlike(r"(?i)(^|/)(list|index)\d+\.htm[^/]*$")
    return F.array_distinct(F.filter(F.transform(F.filter(tags, leads), lambda t: resolved(reference(t), base)), lambda u: u.isNotNull()))


def search_forms(markup: Column, limit: int = 20) -> Column:
    """array<struct<action, method, inputs>> of forms with a text input (up to ten inputs each)."""
    forms = F.regexp_extract_all(markup, F.lit(r"(?is)(<form\b.*?</form>)"), 1)
    text_input = r"(?is)<input\b(?![^>]*type\s*=\s*[\"']?(?:hidden|submit|button|checkbox|radio|image|file|password|reset))[^>]*>"
    name = lambda tag: F.regexp_extract(tag, r"(?i)\bname\s*=\s*[\"']([^\"']+)[\"']", 1)
    shaped = F.transform(
        forms,
        lambda f: F.struct(
            F.regexp_extract(f, r"(?is)^<form\b[^>]*\baction\s*=\s*[\"']([^\"']*)[\"']", 1).alias("action"),
            F.when(F.upper(F.regexp_extract(f, r"(?is)^<form\b[^>]*\bmethod\s*=\s*[\"']?(\w+)", 1)) == "POST", "POST").otherwise("GET").alias("method"),
            F.slice(F.filter(F.transform(F.regexp_extract_all(f, F.lit(f"({text_input})"), 1), name), lambda n: n != ""), 1, 10).alias("inputs"),
        ),
    )
    return F.slice(F.filter(shaped, lambda s: F.size(s["inputs"]) > 0), 1, limit)


def published_raw(markup: Column) -> Column:
    """array<struct<raw, from>> of structured publishing times, best first: meta keys, then time tags. Never body text."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)
    key = lambda tag: F.lower(F.coalesce(F.nullif(attribute(tag, "property"), F.lit("")), F.nullif(attribute(tag, "name"), F.lit("")), attribute(tag, "itemprop")))

    def of_key(wanted: str) -> Column:
        return F.transform(F.filter(tags, lambda t: key(t) == wanted), lambda t: F.struct(attribute(t, "content").alias("raw"), F.lit("meta").alias("from")))

    metas = [of_key(k) for k in PUBLISHED_KEYS]
    times = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"'][^>]*>"), 1), lambda r: F.struct(r.alias("raw"), F.lit("time-tag").alias("from")))
    return F.filter(F.concat(*metas, times), lambda x: x["raw"] != "")
