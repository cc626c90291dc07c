"""Garbled text from wrong character encoding (problem 3).

Method: a multinomial classifier on hashed byte bigrams is trained on sound lines of the corpus and on
the same lines garbled synthetically by each encoding chain. For each line it predicts the chain; the
chain is inverted and the line counts as garbled only if the inverse decodes strictly. Besides, a
replacement character that stands for lost text is damage that no inverse can mend.

The sample of training lines is bounded by `TRAINING_LINES`; everything else covers all rows.

Defined cases: null and empty texts are sound; numeric and named character references are resolved
before a line is judged, so a correct reference is sound and references to garbled characters are
damage; damaged characters between quotation marks, or a replacement character that the text names as
a sign, are mentions and no damage.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.sampling import least_hashed
from marlspike.session import table

#: Upper bound of the lines the classifier is fitted on.
TRAINING_LINES = 4000
BUCKETS = 8192
#: right encoding, encoding that was used instead, how many times over
CHAINS = [
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp1250", 1),
    ("utf-8", "cp1254", 1), ("utf-8", "cp1251", 1), ("utf-8", "gb18030", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2),
    ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("koi8-r", "cp1251", 1), ("cp1251", "koi8-r", 1), ("gb18030", "cp1252", 1), ("gb18030", "latin-1", 1),
    ("cp1252", "latin-1", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp437", 1), ("cp1252", "cp1251", 1), ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1),
]
#: Sound lines that stand in where the corpus has too few of its own.
SEED_LINES = [
    "Größe und Übersicht der Gebühren für das nächste Jahr – früher als geplant.", "Synthèse des résultats d’été à la mairie, déjà publiée « en août ».",
    "La página añade una versión según el índice público: 5 € por año.", "Реестр объявлений описывает полный перечень на втором этапе.",
    "附件列表确认了上一轮的结果，共重试三次。", "The reader’s “first pass” costs 20 € – a rare outcome…", "Søk på «ærlig» ga Ø, Å og Æ.", "Cena: 40 zł – źródło ćwiczeń.",
    "Το γραφείο δημοσίευσε τον κατάλογο των τελών για το επόμενο έτος.", "Реєстр оголошень містить повний перелік, їх опубліковано вчора.", "نشر المكتب قائمة الرسوم للعام القادم.", "המשרד פרסם את רשימת האגרות לשנה הבאה.",
    "사무소는 내년 수수료 목록을 발표했다.", "事務所は来年の手数料の一覧を公開しました。", "कार्यालय ने अगले वर्ष की शुल्क सूची प्रकाशित की।", "Văn phòng công bố danh sách lệ phí năm tới.",
]

LOST = "�"
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_WINDOW = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
#: A few characters between quotation marks: the text speaks of them.
_MENTION = re.compile(r"[“\"'«‘„]([^\x00-\x7f“”«»„]{1,6})[”\"'»’“]")
_NAMED_SIGN = re.compile(r"(?i)\b(?:sign|character|symbol|mark|glyph|letter|zeichen|signe|caractère|signo|símbolo|carácter|знак|символ)s?[\s:]+[“\"'«]?�[”\"'»]?(?!\w)|[“\"'«]�[”\"'»]")
_TWO_ALPHABETS = regex.compile(r"\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")


@cache
def charmap(codec: str) -> dict[int, str]:
    """Bytes to characters; bytes a codec leaves undefined stand for the control character of that number."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@cache
def _bytemap(codec: str) -> dict[str, int]:
    return {ch: b for b, ch in charmap(codec).items()}


def _is_multibyte(codec: str) -> bool:
    return codec in ("gb18030", "utf-8")


def misread(text: str, right: str, wrong: str, times: int = 1) -> str | None:
    """`text` stored in `right` and read as `wrong`; None where it cannot be stored so."""
    for _ in range(times):
        try:
            raw = text.encode(right)
        except UnicodeEncodeError:
            return None
        text = raw.decode(wrong, "replace") if _is_multibyte(wrong) else "".join(map(charmap(wrong).__getitem__, raw))
    return text


def reread(text: str, right: str, wrong: str) -> str | None:
    """The inverse of one misreading; None where it does not decode strictly."""
    try:
        raw = text.encode(wrong) if _is_multibyte(wrong) else bytes(map(_bytemap(wrong).__getitem__, text))
        return raw.decode(right)
    except (KeyError, UnicodeError):
        return None


@cache
def plausible(ch: str) -> bool:
    """Whether a repaired text may hold the character: any that is assigned and no control. Which language it belongs to
    does not matter; the classifier has named the chain, and the inverse must decode strictly."""
    return ch in "\t\u200b\u200c\u200d\ufeff\u00ad" or unicodedata.category(ch) not in ("Cc", "Cn", "Co", "Cs")


@cache
def _sequences(wrong: str) -> re.Pattern:
    """What the bytes of one UTF-8 character look like when read as `wrong`."""
    chars = charmap(wrong)

    def group(low: int, high: int) -> str:
        return "[" + "".join(re.escape(chars[b]) for b in range(low, high + 1)) + "]"

    follow = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xC2, 0xDF)}{follow}|{group(0xE0, 0xEF)}{follow}{{2}}|{group(0xF0, 0xF4)}{follow}{{3}})+")


#: Right encodings of languages whose letters are mostly ASCII.
WESTERN = ("cp1252", "mac_roman", "cp850")


def _within_words(line: str, restored: str) -> bool:
    """Whether the characters that change come back as letters inside words or as C1 signs' own characters:
    with mostly ASCII letters around, a sign between spaces says nothing of the encoding."""
    inside = outside = 0
    for i, (was, now) in enumerate(zip(line, restored)):
        if was != now:
            beside = restored[i - 1 : i] + restored[i + 1 : i + 2]
            ok = "\x80" <= was <= "\x9f" or (now.isalpha() and any(c.isascii() and c.isalpha() for c in beside))
            inside, outside = inside + ok, outside + (not ok)
    return inside >= 1 and not outside and (inside >= 2 or "\x80" <= max(line) <= "\x9f")


def repair(line: str, chain: tuple[str, str, int]) -> str | None:
    """The line with the chain inverted wherever it decodes strictly to plausible characters; None if nowhere."""
    right, wrong, times = chain
    mended = False
    for left in range(times - 1, -1, -1):
        if right == "utf-8" and not _is_multibyte(wrong):
            def mend(match: re.Match) -> str:
                nonlocal mended
                restored = reread(match[0], right, wrong)
                # what is still misread once may hold controls
                if restored is None or not (left or all(map(plausible, restored))):
                    return match[0]
                mended = True
                return restored

            line = _sequences(wrong).sub(mend, line)
        elif right == "utf-8":
            def mend_run(match: re.Match) -> str:
                nonlocal mended
                restored = reread(match[0], right, wrong)
                if restored is None or not all(plausible(c) or c.isascii() for c in restored):
                    return match[0]
                mended = True
                return restored

            line = _NOT_ASCII.sub(mend_run, line)
        else:
            restored = reread(line, right, wrong)
            if restored is None or restored == line or not all(c.isascii() or plausible(c) for c in restored):
                return None
            if right in WESTERN and not _within_words(line, restored):
                return None
            mended, line = True, restored
    return line if mended else None


def features(line: str) -> list[int]:
    """Hashed byte bigrams of the parts that are not ASCII, each with its neighbours."""
    out: list[int] = []
    for part in _WINDOW.findall(line):
        raw = part.encode("utf-8", "surrogatepass")
        out += [(a * 257 + b) * 40_503 % 65_521 % BUCKETS for a, b in zip(raw, raw[1:])]
    return out


def _examples(lines: list[str]) -> Iterator[tuple[int, str]]:
    for line in lines:
        yield 0, line
        for number, (right, wrong, times) in enumerate(CHAINS, 1):
            garbled = misread(line, right, wrong, times)
            if garbled is not None and garbled != line:
                yield number, garbled


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((len(CHAINS) + 1, BUCKETS), np.int64)
    for batch in batches:
        for label, line in _examples(batch["line"].tolist()):
            for bucket in features(line):
                counts[label, bucket] += 1
    label, bucket = np.nonzero(counts)
    yield pd.DataFrame({"label": label.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[label, bucket]})


def _seems_sound(line: str) -> bool:
    return LOST not in line and not any(repair(line, c) for c in CHAINS if c[0] == "utf-8" and c[2] == 1 and c[1] not in ("cp1251", "gb18030"))


def train(lines: DataFrame, bound: int = TRAINING_LINES) -> np.ndarray:
    """Log likelihoods, one row a class (0: sound), fitted on at most `bound` of the lines (column `line`),
    those of least hash. The model's size is fixed, whatever the corpus."""
    sample = least_hashed(lines.filter(F.col("line").rlike(r"[^\x00-\x7f]") & (F.length("line") <= 2000)).select("line"), ["line"], bound)

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[batch["line"].map(_seems_sound)]

    counted = sample.repartition(8, "line").mapInPandas(sound, "line string").mapInPandas(_count, "label int, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(CHAINS) + 1, BUCKETS), 0.05)
    counts[counted["label"], counted["bucket"]] += counted["n"]
    for label, line in _examples(SEED_LINES):
        for bucket in features(line):
            counts[label, bucket] += 1
    return (np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))).astype(np.float32)


def _sounder(restored: str, found: list[int], model: np.ndarray) -> bool:
    """Whether the restored line reads more like sound text than the line did, whose bigrams are `found`, and has no word of two
    alphabets: between encodings of one byte a character every reading decodes, so strictness alone proves nothing."""
    now = features(restored)
    if _TWO_ALPHABETS.search(restored):
        return False
    return not now or model[0, now].mean() > model[0, found].mean()


def judge(line: str, model: np.ndarray) -> tuple[str | None, str]:
    """(chain, repaired line); chain is None for a sound line and `lost` where characters are gone."""
    shown = _REFERENCE.sub(lambda m: html.unescape(m[0]), line) if "&" in line else line
    if shown.isascii():
        return None, line
    plain = _MENTION.sub(" ", shown)
    lost = LOST in plain and LOST in _NAMED_SIGN.sub(" ", plain)
    found = features(plain)
    if found:
        scores = model[:, found].sum(axis=1)
        for label in np.argsort(-scores)[:4]:
            if label == 0:
                break
            chain = CHAINS[label - 1]
            # one lone character is no ground to reread a whole line from one single-byte encoding to another
            if chain[0] != "utf-8" and scores[label] - scores[0] < 12:
                continue
            restored = repair(plain, chain)
            if restored is not None and (chain[0] == "utf-8" or _sounder(restored, found, model)):
                right, wrong, times = chain
                return f"{right}>{wrong}" + f"*{times}" * (times > 1), repair(shown, chain) or line
    return ("lost", line) if lost else (None, line)


SCHEMA = "rec_id bigint, chain string, repaired string"


def damaged(rows: DataFrame, id_col: str, text_col: str, model: np.ndarray) -> DataFrame:
    """rec_id, chain (of most damaged lines), repaired: the records with at least one damaged line."""
    candidates = rows.filter(F.col(text_col).rlike(r"[^\x00-\x7f]|&#?[A-Za-z0-9]{2,30};")).select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chains, texts = [], [], []
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = text.as_py().split("\n")
                judged = [judge(line, model) for line in lines]
                named = [chain for chain, _ in judged if chain]
                if named:
                    ids.append(rec_id)
                    chains.append(max(sorted(set(named)), key=named.count))
                    texts.append("\n".join(line for _, line in judged))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chains, pa.string()), pa.array(texts, pa.string())], names=["rec_id", "chain", "repaired"])

    return candidates.mapInArrow(run, SCHEMA)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages = table(spark, sf_dir, "doc_extract"), table(spark, sf_dir, "fetch_result")
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).unionByName(pages.select(F.explode(F.split("content", "\n")).alias("line")))
    model = train(lines)
    a = damaged(documents, "extract_id", "text", model).withColumn("tbl", F.lit("doc_extract"))
    return a.unionByName(damaged(pages, "fetch_id", "content", model).withColumn("tbl", F.lit("fetch_result")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("tbl", "rec_id")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("tbl", "rec_id", "chain", "repaired")


ORACLES: dict[str, str] = {}
