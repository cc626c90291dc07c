"""Query and text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms (fixed values).
STOP_WORDS = (
    "的 了 和 是 在 有 与 及 或 为 对 从 到 把 被 这 那 你 我 他 她 它 们 个 上 下 中 大 小 不 一 二 三 四 五 六 七 八 九 十 年 月 日 时 分 "
    "the and for with from that this are was were you your our its has have been will can not but all any more"
).split()

#: Shapes of credentials, in the order they are erased (fixed values).
CREDENTIALS = [
    (r"(?i)\bBearer\s+\S+", "Bearer [redacted]"),
    (r"(?i)(?<![A-Za-z0-9])(api[_-]?key|token|secret|password|passwd|passphrase|authorization)\s*[:=]\s*\S+", "$1=[redacted]"),
    (r"\b(sk|rk|pk)-[A-Za-z0-9_-]{8,}", "[redacted]"),
    (r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}", "[redacted]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{16,}", "[redacted]"),
    (r"\bAKIA[0-9A-Z]{12,}", "[redacted]"),
    (r"[A-Za-z0-9+/=_-]{32,}", "[redacted]"),
]


def redact(text: Column) -> Column:
    for pattern, instead in CREDENTIALS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def truncate(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def terms(text: Column) -> Column:
    """Candidate terms: all 2- to 4-grams of runs of Chinese characters, and Latin words of three or more signs; no stop words."""
    runs = F.regexp_extract_all(text, F.lit("([一-龥]{2,})"), 1)

    def grams(n: int) -> Column:
        return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1))), lambda i: F.substr(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    words = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9-]{2,})"), 1)
    every = F.concat(grams(2), grams(3), grams(4), words)
    return F.filter(every, lambda t: ~F.lower(t).isin(*STOP_WORDS))


def route(query: Column) -> Column:
    """general, code, academic or code+academic by the words of a question."""
    q = F.lower(query)
    code = q.rlike(r"\b(github|gitlab|repo|repository|npm|pypi|crate|sdk|library|framework|api|implementation|source code|monorepo)\b") | q.rlike("(源码|源代码|代码库|仓库|插件|库|框架|实现方式|依赖)")
    academic = q.rlike(r"\b(paper|papers|arxiv|preprint|study|studies|survey|literature|benchmark|dataset)\b") | q.rlike("(论文|文献|综述|研究进展|学术|数据集)")
    return F.when(code & academic, "code+academic").when(code, "code").when(academic, "academic").otherwise("general")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def query_variants(keywords: Column) -> Column:
    """Up to eight distinct forms: as given, as a phrase, without small words, as questions."""
    kw = F.trim(keywords)
    core = F.array_join(F.filter(F.split(kw, r"\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^(?i)(的|了|是|在|与|和|及|how|to|the|a|an|for|of|in|on)$")), " ")
    latin = kw.rlike(r"^[a-zA-Z\s]+$")
    forms = F.array(
        kw, F.concat(F.lit('"'), kw, F.lit('"')), F.when((core != "") & (core != kw), core),
        F.when(latin, F.concat(F.lit("what is "), kw)).otherwise(F.concat(F.lit("什么是 "), kw)), F.when(latin, F.concat(kw, F.lit(" tutorial guide"))).otherwise(F.concat(kw, F.lit(" 教程 指南"))),
    )
    return F.when(kw == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.array_compact(forms)), 1, 8))


def fan_out(query: Column, limit: int = 4) -> Column:
    """The question and angles on it; of Latin text the first six longer words lead."""
    q = F.trim(query)
    core = F.array_join(F.slice(F.filter(_words(F.regexp_replace(q, "[?!.\"'`]", "")), lambda w: F.length(w) > 3), 1, 6), " ")
    latin = q.rlike(r"^[\x20-\x7E\s]*$")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wide = F.array(q, clean(core), clean(F.concat(core, F.lit(" best practices 2026"))), clean(F.concat(F.lit("how to "), core)), clean(F.concat(core, F.lit(" implementation techniques"))))
    other = F.array(q, clean(F.concat(q, F.lit(" 教程 指南"))), clean(F.concat(q, F.lit(" 最佳实践"))))
    forms = F.filter(F.array_distinct(F.when(latin, wide).otherwise(other)), lambda f: f != "")
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(forms, 1, max(1, limit)))


def simplify_query(query: Column) -> Column:
    """The first four words of a longer question without punctuation, else ''."""
    words = _words(F.regexp_replace(query, "[\"'`?？!！。，,、：:；;()（）]+", " "))
    return F.when(F.size(words) <= 4, "").otherwise(F.array_join(F.slice(words, 1, 4), " "))


def paper_query(raw: Column) -> Column:
    """Plain words become distinct terms joined by AND; what holds query syntax passes."""
    q = F.trim(raw)
    distinct = F.array_distinct(_words(q))
    return F.when(q.rlike(r"[:\"()]|\b(?:AND|OR|ANDNOT)\b") | (F.size(distinct) <= 1), q).otherwise(F.array_join(F.transform(distinct, lambda t: F.concat(F.lit("all:"), t)), " AND "))


def repo_key(name: Column) -> Column:
    """Words of a repository's name in sorted order: spelling and word order do not matter."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"[-_\s]+"), lambda w: w != "")), "-")


def rank_terms(query: Column) -> Column:
    """Words of a question that count as hits; repeated words count again."""
    return F.filter(F.split(F.lower(query), "[^a-z0-9一-鿿]+"), lambda w: F.length(w) >= 3)
