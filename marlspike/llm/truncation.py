"""Text cut off by field limits or during transfer (problem 10).

Method: a value is cut where it is a strict prefix of a longer one elsewhere. Prefixes are sought twice.
Whole texts: those that can have a longer copy (see `copies_continue`) are range-partitioned and sorted, so
that a text stands right before its longer copies, and one scan of neighbours finds every such text. Most
cut texts have no copy; for these the windows that end the text (its last words, names and numbers replaced
by their kind) are hashed by all but their last word, every text's windows with the same hash are counted,
and the last words are sorted and scanned: a window that goes on elsewhere, or whose last word is the strict
prefix of a word that stands there elsewhere, was cut; one that ends a share of the other lines was not.

What has no prefix elsewhere is no case, unless the text shows the cut itself: a mark added at its end, half
a character, a code fence that is never closed, or a size that is its source's limit.

Defined cases: null, empty and blank texts are none; a text that equals another is no strict prefix of
it and no evidence for or against it; texts are compared whole; a null source is a source of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.session import ship, staged, table

#: Texts under this length are compared by prefixes of 1, 2, 4, ... characters, others by one of this length.
SHORT = 64
#: Words of the windows, longest first; the last counts as the word that may be cut.
WINDOWS = (6, 4, 2)
#: So many other texts whose line or window ends alike, and one in so many that go on, show that it is complete.
MIN_COMPLETE, COMPLETE_SHARE = 2, 20
#: Size of the bitmap of window hashes that decides which windows are counted at all; it is fixed, and exact
#: joins follow, so a fuller bitmap only lets more rows through.
BITS = 1 << 25
#: Marks that a cutting field adds (fixed values).
MARKS = r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(…\)|\(\.\.\.\)|\(more\)|>>|»»|(?:…|\.\.\.)? ?Read (?:on|more)|(?:…|\.\.\.) ?(?:more|continued|mehr|weiterlesen|suite|lire la suite|más|leer más|далее|читать далее|全文|阅读全文))"
#: White space and invisible signs that may follow a text's end.
BLANKS = " \t\n\x0b\f\r\x85\xa0\xad     　﻿" + "".join(map(chr, [*range(0x2000, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065)]))

_MARKED = regex.compile(r"[\p{L}\p{N},;:–—(\"“«'’”)\]\s]" + MARKS + "$")
_SENTENCE = regex.compile(r"[.!?。！？؟।][\"'”’»›)\]）」』】*_]*$")
_NUMBER = regex.compile(r"(?:^|[\s(])\d+\.(?:\d+\.)?$")
_FENCE = regex.compile(r"^\s*```", regex.M)
_HAN = regex.compile(r"[\p{Han}。！？，、；：（）]")
_IDENTIFIER = regex.compile(r"\p{N}|[\p{L}\p{N}][-_/.](?=[\p{L}\p{N}])|^/\p{L}|/$")


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def kind(word: str) -> str:
    """A word with names, numbers and identifiers, tags and signs replaced by their kind; a sign at its end stays."""
    end = word[-1] if not word[-1].isalnum() and len(word) > 1 else ""
    if word[0] == "#" and len(word) > 1:
        return "#"
    if _IDENTIFIER.search(word):
        return "0" + end
    if word[0].isupper():
        return "A" + end
    if not word.isascii() and not any(c.isalnum() for c in word):
        return "*"
    return word


def words_of(line: str) -> list[str]:
    """A line's words; Chinese characters and signs are words each."""
    return (_HAN.sub(r" \g<0> ", line) if _HAN.search(line) else line).split()


# whole texts

SCAN = "kind string, part int, value string, follower string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted distinct values: those that their follower begins with, and the partition's first and last."""
    part = TaskContext.get().partitionId()
    first = last = None
    for batch in batches:
        kinds, values, followers = [], [], []
        for value in batch.column(0).to_pylist():
            if last is None:
                first = value
            elif value.startswith(last) and value != last:
                kinds.append("prefix")
                values.append(last)
                followers.append(value[len(last) : len(last) + 1])
            last = value
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([part] * len(kinds), pa.int32()), pa.array(values, pa.string()), pa.array(followers, pa.string())], names=["kind", "part", "value", "follower"])
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array(["edge"]), pa.array([part], pa.int32()), pa.array([last], pa.string()), pa.array([first], pa.string())], names=["kind", "part", "value", "follower"])


def strict_prefixes(values: DataFrame, column: str) -> DataFrame:
    """value, follower (the character that follows it in a longer value) of each value that is a strict
    prefix of another. Equal values count once."""
    ordered = values.select(F.col(column).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    scanned = staged(ordered.mapInArrow(_scan, SCAN), "prefixes", "kind")
    # one row a partition
    edges = scanned.filter("kind = 'edge'").select("value", F.lead("follower").over(Window.orderBy("part")).alias("next"))
    across = edges.filter("next IS NOT NULL AND startswith(next, value) AND next <> value").select("value", F.expr("substring(next, length(value) + 1, 1)").alias("follower"))
    return scanned.filter("kind = 'prefix'").select("value", "follower").unionByName(across)


#: Line ends sort last, so that a text's first follower goes on inside the line if any of them does.
_LATE = ("\n\r", "\U0010ffff\U0010fffe")


def copies_continue(documents: DataFrame, text_col: str) -> DataFrame:
    """whole (hash of the text), goes_on (inside its last line) of the texts that are a strict prefix of a longer one.

    A text of `SHORT` characters or more can only be one if another text has the same first `SHORT`; a shorter one if
    another has its first 2^k characters, the most it has. Only texts that share such a prefix are sorted, whole.
    """
    text = F.col(text_col)
    size = F.length(text)
    levels = [2**k for k in range(SHORT.bit_length() - 1)]
    # every text's hashes at the levels it reaches; the key that decides for it is that of the highest
    reached = F.filter(F.array(*[F.when(size >= n, F.xxhash64(F.lit(n), F.substring(text, 1, n))) for n in [*levels, SHORT]]), lambda h: h.isNotNull())
    keyed = documents.filter(F.length(trimmed(text)) > 0).select(text.alias("text"), F.xxhash64(text).alias("whole"), reached.alias("starts"))
    hashes = staged(keyed.select("whole", F.explode("starts").alias("start"), F.element_at("starts", -1).alias("top")), "text-starts")
    # the starts that decide for one text and that another text has as well
    shared = hashes.groupBy("start").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.max((F.col("start") == F.col("top")).cast("int")).alias("decides")).filter("a <> b AND decides = 1").select("start")
    wanted = staged(hashes.join(shared, "start", "left_semi").select("whole").distinct(), "text-candidates")
    texts = keyed.select("whole", F.translate("text", *_LATE).alias("late")).join(wanted, "whole", "left_semi")
    found = strict_prefixes(texts, "late")
    return found.groupBy(F.xxhash64(F.translate("value", *reversed(_LATE))).alias("whole")).agg(F.max((~F.col("follower").isin(*_LATE[1])).cast("int")).alias("goes_on"))


# windows


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Lexicon(dict):
    """word -> number of its kind; the kinds' texts and hashes."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.kinds: dict[str, int] = {"^": 0}
        self.texts: list[str] = ["^"]
        self.hashes: list[int] = [_hash("^")]

    def __missing__(self, word: str) -> int:
        k = kind(word)
        at = self.kinds.get(k)
        if at is None:
            at = self.kinds[k] = len(self.texts)
            self.texts.append(k)
            self.hashes.append(_hash(k))
        self[word] = at
        return at


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def contexts(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word (hash of its kind; `starts` its line's first place, which holds `^`) a row for each of WINDOWS, the
    hash of the words before it in that window, and a last row with the hash of all words before it in its line; 0
    where the line has not so many."""
    n = len(kinds)
    place = np.arange(n)
    out = np.zeros((len(WINDOWS) + 1, n), np.uint64)
    for row, width in enumerate(WINDOWS):
        value = np.full(n, width, np.uint64)
        for back in range(1, width):
            before = np.zeros(n, np.uint64)
            before[back:] = kinds[:-back] if back < n else 0
            value = _mix(value ^ before)
        out[row] = np.where(place - width + 1 >= starts, value, np.uint64(0))
    # sums of words mixed with their place in the line
    summed = np.cumsum(_mix(kinds ^ _mix((place - starts).astype(np.uint64))))
    until = np.concatenate([[np.uint64(0)], summed[:-1]])
    line = _mix(until - np.concatenate([[np.uint64(0)], summed])[starts] + np.uint64(1))
    out[-1] = np.where(place > starts, line, np.uint64(0))
    return out


def _streams(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind number, first place of the line, text number, end (0 goes on, 1 ends a line, 2 ends the text) of each word of the texts."""
    numbers: list[int] = []
    sizes: list[int] = []
    of: list[int] = []
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            words = words_of(line)
            if words:
                numbers.append(0)
                numbers += map(lexicon.__getitem__, words)
                sizes.append(len(words) + 1)
                of.append(i)
    size, owner = np.array(sizes, np.int64), np.array(of, np.int64)
    first = np.cumsum(size) - size
    end = np.zeros(len(numbers), np.int8)
    if len(size):
        end[first + size - 1] = 1 + np.append(owner[1:] != owner[:-1], True)
    return np.array(numbers, np.int64), np.repeat(first, size), np.repeat(owner, size), end


ENDS = "doc bigint, source string, whole bigint, chars bigint, bytes bigint, reason string, open boolean, number boolean, word string, contexts array<bigint>"


def ends(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What the end of each document's text looks like: what it shows itself (reason), whether it is open, its last word's
    kind and the hashes of what stands before it."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            keep, chars, octets, reasons, opens, numbers, lasts = [], [], [], [], [], [], []
            for i, cell in enumerate(batch.column(2)):
                text = cell.as_py()
                body = text.rstrip(BLANKS) if text else ""
                if not body:
                    continue
                end = body[-80:]
                last = body[body.rfind("\n") + 1 :].strip(BLANKS)
                reason = "mark" if _MARKED.search(end) else "broken sign" if body[-1] == "�" else "open fence" if "```" in body and len(_FENCE.findall(body)) % 2 else None
                sentence = bool(_SENTENCE.search(end))
                keep.append(i)
                chars.append(len(text))
                octets.append(len(text.encode("utf-8", "surrogatepass")))
                reasons.append(reason)
                # an even fence closes its code
                opens.append(reason is None and not sentence and not last.startswith("```"))
                numbers.append(reason is None and bool(_NUMBER.search(end)))
                lasts.append(last if opens[-1] else "")
            numbers_of, starts, of, end = _streams(lasts, lexicon)
            hashes = contexts(np.array(lexicon.hashes, np.uint64)[numbers_of], starts) if len(numbers_of) else np.zeros((len(WINDOWS) + 1, 0), np.uint64)
            words: list = [None] * len(keep)
            before: list = [None] * len(keep)
            for at in np.flatnonzero(end == 2).tolist():
                words[of[at]] = lexicon.texts[numbers_of[at]]
                before[of[at]] = hashes[:, at].view(np.int64).tolist()
            place = pa.array(keep, pa.int64())
            doc, source, whole = (batch.column(k).take(place) for k in (0, 1, 3))
            yield pa.RecordBatch.from_arrays(
                [doc, source, whole, pa.array(chars, pa.int64()), pa.array(octets, pa.int64()), pa.array(reasons, pa.string()), pa.array(opens, pa.bool_()), pa.array(numbers, pa.bool_()), pa.array(words, pa.string()), pa.array(before, pa.list_(pa.int64()))],
                names=["doc", "source", "whole", "chars", "bytes", "reason", "open", "number", "word", "contexts"],
            )
            if len(lexicon) > 300_000:
                lexicon.reset()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, ENDS)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each of the `BITS` values that a key's hash may have: a sketch of fixed size."""
    bit = F.pmod(F.col("context"), F.lit(BITS))
    words = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(context, {BITS}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(BITS)
    return ((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _repeated(documents: DataFrame, text_col: str) -> DataFrame:
    """context (hash) of the texts that come more than once."""
    return documents.filter(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("context")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("context")


def window_counts(documents: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """context, word, on, ending, inside, low, high of the windows whose context is in `keys`: in how many distinct texts the
    window goes on, ends a line, ends a line before the last; least and greatest hash of the texts in which it goes on or ends inside."""
    context = documents.sparkSession.sparkContext
    bits = context.broadcast(_bitmap(keys))
    # texts that may come again are told apart until they are counted, once each; all others are added up where they are read
    again = context.broadcast(_bitmap(_repeated(documents, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                numbers, starts, of, end = _streams([t.rstrip(BLANKS) for t in part.column(0).to_pylist()], lexicon)
                if not len(numbers):
                    continue
                before = contexts(np.array(lexicon.hashes, np.uint64)[numbers], starts)
                # the whole line counts where it ends
                before[-1][end == 0] = 0
                hit = _marked(bits.value, before) & (before != 0)
                row, at = np.nonzero(hit)
                # a text counts once for a window, with all the ways it ends there
                found = np.stack([before[row, at].view(np.int64), numbers[at], of[at]])
                order = np.lexsort(found)
                found = found[:, order]
                ways = (1 << end[at].astype(np.int64))[order]
                fresh = np.flatnonzero(np.append(True, (found[:, 1:] != found[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, np.int64)
                wholes = part.column(1).to_numpy()
                repeats = pa.array(wholes, mask=~_marked(again.value, wholes.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0][fresh]), pa.array(lexicon.texts, pa.string()).take(pa.array(found[1][fresh])), part.column(1).take(pa.array(found[2][fresh])), repeats.take(pa.array(found[2][fresh])), pa.array((np.bitwise_or.reduceat(ways, fresh) if len(fresh) else fresh).astype(np.int64))],
                    names=["context", "word", "whole", "again", "ways"],
                )
                if len(lexicon) > 300_000:
                    lexicon.reset()

    texts = documents.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("whole"))
    seen = texts.mapInArrow(run, "context bigint, word string, whole bigint, again bigint, ways bigint")
    other = F.when(F.expr("ways & 3") != 0, F.col("whole"))
    ways = {"on": "ways & 1", "ending": "int(ways > 1)", "inside": "(ways >> 1) & 1"}
    edges = [F.min(other).alias("low"), F.max(other).alias("high")]
    once = seen.groupBy("context", "word", "again").agg(*[F.sum(F.expr(e)).alias(n) for n, e in ways.items()], *edges)
    counted = [F.sum(F.when(F.col("again").isNull(), F.col(n)).otherwise((F.col(n) > 0).cast("int"))).alias(n) for n in ways]
    return once.groupBy("context", "word").agg(*counted, F.min("low").alias("low"), F.max("high").alias("high"))


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by context and word: adds in how many texts words stand that begin with the word and are longer."""
    # the rows not yet given out, and those of them that the next word may begin with: [word, place in `pending`]
    opened: list[tuple[str, int]] = []
    pending: list[list] = []
    context = None

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pending), _WINDOW_TYPES)], names=_WINDOW_NAMES)
        pending.clear()
        return out

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            word = row[1]
            if row[0] != context:
                opened.clear()
                context = row[0]
            while opened and not word.startswith(opened[-1][0]):
                opened.pop()
            # rows are given out only where no word is left that a later one may begin with
            if not opened and len(pending) >= 10_000:
                yield given()
            texts = row[2] + row[3]
            for _, at in opened:
                pending[at][7] += texts
            opened.append((word, len(pending)))
            pending.append([*row, 0])
    if pending:
        yield given()


_WINDOW_NAMES = ["context", "word", "on", "ending", "inside", "low", "high", "longer"]
_WINDOW_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 6]


def with_longer(counts: DataFrame) -> DataFrame:
    """`window_counts` with longer: in how many texts a longer word that begins with `word` follows the same context. Words
    that begin alike lie in one task: at most the distinct words of one context with one first letter, which are streamed."""
    rows = counts.select(*_WINDOW_NAMES[:-1])
    placed = rows.repartition("context", F.substring("word", 1, 1)).sortWithinPartitions("context", "word")
    return placed.mapInArrow(_longer, "context bigint, word string, on bigint, ending bigint, inside bigint, low bigint, high bigint, longer bigint")


def cut_off(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc, source, reason of each document whose text was cut."""
    found = staged(ends(documents, id_col, text_col, source_col), "ends")
    opened = found.filter("open AND word IS NOT NULL")
    tails = opened.select("doc", "whole", "word", F.posexplode("contexts").alias("level", "context")).filter("context <> 0")
    counts = staged(window_counts(documents, text_col, tails.select("context")), "windows")
    known = staged(with_longer(counts), "window-kinds")
    own = F.coalesce((F.col("whole") == F.col("low")) | (F.col("whole") == F.col("high")), F.lit(False)).cast("int")
    # a text is no evidence for itself
    weighed = tails.join(known, ["context", "word"]).select(
        "doc", "level", F.greatest(F.col("on") - own, F.lit(0)).alias("on"), (F.col("ending") - 1).alias("ending"), (F.col("inside") - own).alias("inside"), "longer"
    )
    goes_on = (F.col("on") > 0) | (F.col("longer") > 0)
    line = F.lit(len(WINDOWS))
    verdicts = weighed.groupBy("doc").agg(
        # the longest window that any other text holds decides
        F.min(F.when((F.col("level") < line) & (goes_on | (F.col("ending") > 0)), F.struct("level", "on", "ending", "longer"))).alias("best"),
        F.max(F.when(F.col("level") == line, F.struct("inside", "ending"))).alias("line"),
    )
    # where the word is cut, the texts that go on are those that hold a longer one; other texts cut at the same place end alike
    ways_on = F.col("best.on") + F.col("best.longer")
    best_on = ways_on > 0
    whole_line = (F.coalesce("line.inside", F.lit(0)) >= MIN_COMPLETE) | ((F.coalesce("line.ending", F.lit(0)) >= MIN_COMPLETE) & ~best_on)
    few = (F.col("best.ending") < MIN_COMPLETE) | (F.col("best.ending") * COMPLETE_SHARE < ways_on)
    # true: cut; false: complete; null: nothing like it elsewhere
    cut = F.when(F.col("best").isNull(), F.lit(None)).when(whole_line, False).when(best_on, few).when(F.col("best.ending") >= MIN_COMPLETE, False)
    verdicts = verdicts.select("doc", cut.alias("cut"))
    longer = copies_continue(documents, text_col).filter("goes_on = 1")
    judged = found.join(verdicts, "doc", "left").join(longer, "whole", "left")
    reason = F.coalesce("reason", F.when(F.col("open") & F.col("goes_on").isNotNull(), "longer copy").when(F.col("cut"), "prefix"))
    judged = staged(judged.select("doc", "source", "chars", "bytes", reason.alias("reason"), (F.col("open") & F.col("cut").isNull()).alias("unlike"), "number"), "judged-ends")
    # a source's limit is its greatest size, where a text of that size was cut by a prefix; then other texts of
    # that size that end openly and like nothing else, or in a number that looks like a sentence's end, were cut too
    sizes = judged.groupBy("source").agg(F.max("chars").alias("top_chars"), F.max("bytes").alias("top_bytes"), *[F.max(F.when(F.col("reason").isin("longer copy", "prefix"), F.col(c))).alias(f"cut_{c}") for c in ("chars", "bytes")])
    limits = sizes.select(F.col("source").alias("of"), F.when(F.col("top_chars") == F.col("cut_chars"), F.col("top_chars")).alias("limit_chars"), F.when(F.col("top_bytes") == F.col("cut_bytes"), F.col("top_bytes")).alias("limit_bytes"))
    doubtful = judged.filter("reason IS NULL AND (unlike OR number)")
    at_limit = doubtful.join(limits, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("chars") == F.col("limit_chars")) | (F.col("bytes") == F.col("limit_bytes")))
    return judged.filter("reason IS NOT NULL").select("doc", "source", "reason").unionByName(at_limit.select("doc", "source", F.when(F.col("number"), "inside a number").otherwise("at the limit").alias("reason")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select(F.col("doc").alias("doc_id"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, documents, cut, share: how often each source cuts; documents without text count too."""
    documents = table(spark, sf_dir, "documents")
    cut = cut_off(documents, "doc_id", "text", "source").groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    all_of = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    joined = all_of.join(cut, all_of["source"].eqNullSafe(cut["source"]), "left").select(all_of["source"], "documents", F.coalesce("cut", F.lit(0)).alias("cut"))
    return joined.withColumn("share", F.col("cut") / F.col("documents"))


ORACLES: dict[str, str] = {}
