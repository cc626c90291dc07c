"""Address functions as Catalyst expressions. Invalid addresses come back as the docstrings say, never as errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visit (fixed values).
TRACKING_PARAMETERS = "utm_source utm_medium utm_campaign utm_term utm_content ref spm fbclid gclid".split()
#: Document extensions (fixed values).
ATTACHMENT_EXTENSIONS = "pdf doc docx xls xlsx ppt pptx csv txt rtf odt ods odp zip rar 7z epub wps et dps".split()
#: Media and page assets (fixed values).
ASSET_EXTENSIONS = "jpg jpeg png gif webp svg ico bmp tif tiff css js mjs woff woff2 ttf eot otf map mp3 mp4 avi mov wmv flv mkv webm ogg wav".split()
#: Files about a site, not of it (fixed values).
META_FILES = "robots.txt sitemap.xml sitemap.txt sitemap.xml.gz security.txt humans.txt ads.txt llms.txt manifest.json".split()
#: Document content types (fixed values).
ATTACHMENT_MIME = r"^(?i)application/(pdf|msword|rtf|epub\+zip|vnd\.openxmlformats-officedocument|vnd\.ms-excel|vnd\.ms-powerpoint|vnd\.oasis\.opendocument)|^(?i)text/csv"
#: Last path steps that stand for containers of pages (fixed values).
CONTAINERS = "list|index|default|more|search|column|category|tag|nav|menu"

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(_ABSOLUTE), F.lit(False))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)


def host(url: Column) -> Column:
    """Host in lower case without user and port; '' for what is no absolute address."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^[^@]*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(_bare(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def domain_of(url: Column) -> Column:
    """Host without a leading www.; '' where there is none."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def site_root(url: Column) -> Column:
    """The last two labels of the host."""
    return F.array_join(F.slice(F.split(host(url), r"\."), F.greatest(F.lit(-2), -F.size(F.split(host(url), r"\."))), F.lit(2)), ".")


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts or equal last two labels; false where either is no address."""
    return (host(a) != "") & (host(b) != "") & ((host(a) == host(b)) | (site_root(a) == site_root(b)))


def normalize_url(url: Column) -> Column:
    """Trimmed, without anchor and tracking parameters, host in lower case; scheme kept; what is no address stays as it is."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    plain = F.regexp_replace(url, r"#.*$", "")
    base, query = F.regexp_replace(plain, r"\?.*$", ""), F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING_PARAMETERS)), "&")
    start = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substr(base, F.length(start) + 1)
    whole = F.concat(F.lower(start), F.when(rest == "", "/").otherwise(rest), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(is_absolute(url), whole).otherwise(url)


def fingerprint(url: Column) -> Column:
    """Identity of an item: trimmed, no anchor, http as https, host in lower case; parameters kept."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    start = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(is_absolute(F.trim(url)), F.concat(F.regexp_replace(F.lower(start), r"^http://", "https://"), F.substr(plain, F.length(start) + 1))).otherwise(F.trim(url))


def discovered_key(url: Column) -> Column:
    """Key of the discovery merge: no anchor, http as https."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(?i)http://", "https://")


def normalize_domain(text: Column) -> Column:
    """A bare lower-case domain from an address or domain."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?i)[a-z][a-z0-9+.-]*://", ""), r"[/?#].*$", ""), r":\d+$", ""))


def extension(url: Column) -> Column:
    """Lower-case extension of the last path step, or ''."""
    return F.lower(F.regexp_extract(F.element_at(F.split(_bare(url), "/"), -1), r"^.+\.([A-Za-z0-9]{1,8})$", 1))


def last_step(url: Column) -> Column:
    return F.lower(F.element_at(F.split(_bare(url), "/"), -1))


def column_key(url: Column) -> Column:
    """Pages of one list share a key."""
    return F.regexp_replace(url, r"(?i)/(list|index)\d*\.htm", "/$1.htm")


def is_meta_file(url: Column) -> Column:
    return F.coalesce(last_step(url).isin(*META_FILES), F.lit(False))


def is_attachment(url: Column, mime: Column | None = None) -> Column:
    by_mime = F.coalesce(F.trim(mime).rlike(ATTACHMENT_MIME), F.lit(False)) if mime is not None else F.lit(False)
    return ~is_meta_file(url) & (by_mime | F.coalesce(extension(url).isin(*ATTACHMENT_EXTENSIONS), F.lit(False)))


def is_asset(url: Column) -> Column:
    return F.coalesce(extension(url).isin(*ASSET_EXTENSIONS), F.lit(False))


def is_structural(url: Column) -> Column:
    """Home pages, folders and list pages, by the path alone; what is no address is none."""
    p = path(url)
    return is_absolute(url) & ((p == "") | p.endswith("/") | p.rlike(rf"(?i)/({CONTAINERS})[\d_-]*(\.[a-z0-9]{{1,6}})?$"))


def is_content_page(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)/(page|content|article|detail)\.htm|/c\d+a\d+/"), F.lit(False))


def item_kind(url: Column, mime: Column | None = None, source: Column | None = None) -> Column:
    """attachment, paper, api, page or unknown, in this order of precedence."""
    by_source = source if source is not None else F.lit(None).cast("string")
    return F.when(is_attachment(url, mime), "attachment").when(by_source == "arxiv", "paper").when(by_source == "api", "api").when(url.rlike(r"^(?i)https?://"), "page").otherwise("unknown")


def is_high_value(kind: Column) -> Column:
    return kind.isin("attachment", "paper", "api")


def is_worthy(url: Column, source: Column, is_baseline: Column, mime: Column | None = None) -> Column:
    """Whether a candidate becomes an item: web address, no meta file, no structural page; all of a declared
    interface; of a first scan only what is of high value."""
    kind = item_kind(url, mime, source)
    return F.when(~F.coalesce(url.rlike(r"^(?i)https?://"), F.lit(False)), False).when(is_meta_file(url), False).when(is_structural(url), False).when(source == "api", True).when(is_baseline, is_high_value(kind)).otherwise(True)


def decode_redirect(url: Column, parameter: str) -> Column:
    """The percent-decoded target in a redirect's parameter; null where it has none."""
    raw = F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1), F.lit(""))
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def decode_base64_redirect(url: Column) -> Column:
    """Target in parameter u as base64url behind the mark a1; null where it does not decode."""
    raw = F.nullif(F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]*)", 1), F.lit(""))
    text = F.translate(raw, "-_", "+/")
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def paper_id(url: Column) -> Column:
    """The identifier after /abs/ at the end of an address, else null."""
    return F.nullif(F.regexp_extract(url, r"/abs/([^/?#]+)$", 1), F.lit(""))


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """`{name}` in a template replaced by columns; null as soon as one is missing or empty."""
    import re

    parts: list[Column] = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = fields.get(name)
            parts.append(F.lit(None).cast("string") if value is None else F.nullif(value.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def encode_paper_query(query: Column) -> Column:
    out = query
    for was, now in (("+", "%2B"), ('"', "%22"), ("&", "%26"), ("#", "%23"), (" ", "+")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def encode_component(text: Column) -> Column:
    """Percent-encoded as a component of an address: letters, digits and -_.!~*'() stay."""
    out = F.url_encode(text)
    for was, now in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def search_url(base: Column, template: Column, term: Column) -> Column:
    """A site's search address: its base without final slashes and its template with the term for `{q}` (the first only)."""
    parts = F.split(template, r"\{q\}", 2)
    return F.concat(F.regexp_replace(base, r"/+$", ""), parts[0], F.when(template.contains("{q}"), F.concat(encode_component(term), F.get(parts, F.lit(1)))).otherwise(""))


def meta_search_url(base: Column, query: Column, categories: Column | None = None, language: Column | None = None) -> Column:
    """The address of a meta search that answers in JSON; empty categories and languages are left out."""
    out = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/search?q="), F.url_encode(query), F.lit("&format=json&safesearch=0"))
    for name, value in (("categories", categories), ("language", language)):
        if value is not None:
            out = F.concat(out, F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"&{name}="), F.url_encode(value))).otherwise(""))
    return out


def kind_tag(kind: Column) -> Column:
    """The tag that a list shows before an item (fixed values)."""
    return F.when(kind == "attachment", "[附件]").when(kind == "paper", "[论文]").when(kind == "api", "[公告]").otherwise("[页面]")
