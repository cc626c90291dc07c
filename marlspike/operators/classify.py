"""Classifiers of responses, as Catalyst expressions; the order of their tests is part of their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspike.functions import html as H

#: Phrases of challenge pages that no ordinary page has, searched in the whole text (fixed values).
STRONG_CHALLENGE = ["verifying your browser", "just a moment", "checking your browser", "attention required", "challenge-platform", "cf-chl", "不是机器人", "拖动滑块", "slide to verify", "drag the slider", "are you a robot", "robot check"]
STRONG_BLOCK = ["unusual traffic", "automated access", "access from your network", "we have been receiving a large volume"]
HEAD = 8000
#: Words of paging and counts, and of result headings (fixed values).
COUNT_WORDS = r"下一页|下页|尾页|共\s*\d+\s*页|共\s*\d+\s*条|找到\s*\d+|约\s*\d+\s*条"
RESULT_WORDS = r"搜索?结果|检索结果|(?i:search\s+results?)"


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def challenge(markup: Column, status: Column) -> Column:
    """none, rate-limit, js-challenge, ip-block, waf or unknown."""
    full = F.lower(markup)
    title = F.lower(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = F.concat_ws("\n", F.left(full, F.lit(HEAD)), title)
    refused = status.isin(403, 202, 503)
    return (
        F.when(status == 429, "rate-limit")
        .when(_any(full, STRONG_CHALLENGE), "js-challenge")
        .when(_any(full, STRONG_BLOCK), "ip-block")
        .when(full.contains("security checkpoint"), "waf")
        .when(refused & _any(head, ["captcha", "recaptcha", "hcaptcha"]), "js-challenge")
        .when(refused & _any(head, ["access denied", "forbidden"]), "waf")
        .when(refused & title.contains("anomaly") & _any(head, ["duckduckgo", "challenge"]), "ip-block")
        .when(refused & (title.contains("attention required") | title.contains("403 forbidden")), "waf")
        .when((status == 200) & title.contains("anomaly") & head.contains("duckduckgo"), "ip-block")
        .when(status >= 400, "unknown")
        .otherwise("none")
    )


def zero_shape(markup: Column, parsed: Column) -> Column:
    """Why a result page gave no result: anomaly, no-results-text, no-blocks, blocks-no-anchors, all-ads-filtered or unknown."""
    blocks = F.size(F.split(markup, r"(?i)<div[^>]*class=\"[^\"]*result[^\"]*\"")) - 1
    anchors = F.size(F.regexp_extract_all(markup, F.lit(r"(?i)(class=\"result__a\")"), 1))
    return (
        F.when(markup.rlike(r"(?i)anomaly\.js|anomaly-modal|cc=botnet|bots use duckduckgo too"), "anomaly")
        .when(markup.rlike(r"(?i)no\s+results|did not match|没有找到|找不到|未找到"), "no-results-text")
        .when(blocks == 0, "no-blocks")
        .when(anchors == 0, "blocks-no-anchors")
        .when(parsed == 0, "all-ads-filtered")
        .otherwise("unknown")
    )


def tool_zero_shape(has_text: Column, parse_ok: Column, raw: Column, kept: Column) -> Column:
    return F.when(~has_text, "no-text-node").when(~parse_ok, "text-not-json").when(raw == 0, "empty-results").when(kept == 0, "all-filtered").otherwise("unknown")


def looks_like_results(markup: Column, term: Column, baseline: Column) -> Column:
    """Whether a page answers a search: not the page without search, and an echo, a list, paging or result words."""
    body, base = H.strip_tags(markup), H.strip_tags(baseline)
    ratio = F.try_divide(F.length(body), F.length(base))
    same = (body != "") & (F.left(body, F.lit(400)) == F.left(base, F.lit(400))) & (ratio > 0.9) & (ratio < 1.1)
    listed = F.size(F.regexp_extract_all(markup, F.lit(r"(?i)(<li\b)"), 1)) >= 5
    return ~F.coalesce(same, F.lit(False)) & (body.contains(term) | listed | body.rlike(COUNT_WORDS) | body.rlike(RESULT_WORDS))


def rate_limited(status: Column, body: Column) -> Column:
    return (status == 429) | F.coalesce(body.rlike(r"(?i)rate.?limit|too many|1015"), F.lit(False))
