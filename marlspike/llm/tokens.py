"""Encoding of texts with a public tokenizer (problem 8).

Method: bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary (pyahocorasick)
finds every token that occurs in a piece; the encoder walks the piece by longest match and steps back
where neighbouring tokens are not compatible, that is, where the merge rules would never leave the two
side by side. The compatibility of a pair is memoised. The result equals applying the merges by rank, in
time linear in the piece.

Defined cases: null and empty text give an empty list; strings that look like special tokens are ordinary
text; pieces of any length are encoded whole. Lone surrogates cannot occur in Parquet strings.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.session import ship, table

#: Where the vocabulary files lie; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: How byte_bpe_50k cuts a text into pieces before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per worker; beyond it the memory is emptied, which changes no result.
REMEMBERED = 200_000
#: Pairs of tokens remembered per worker, likewise.
REMEMBERED_PAIRS = 2_000_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64


class Encoder:
    """Exact byte-level BPE by longest match and stepping back."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.ids: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.token = [""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.token[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def split(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one (itself twice for a single byte)."""
        made = self.halves.get(rank)
        if made is None:
            parts = [self.ids[c] for c in self.token[rank]]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    joined = self.ids.get(self.token[parts[i]] + self.token[parts[i + 1]])
                    if joined is not None and joined < best:
                        best, at = joined, i
                if at < 0:
                    raise ValueError(f"token {rank} is no product of merges")
                parts[at : at + 2] = [best]
            made = self.halves[rank] = (rank, rank) if len(parts) == 1 else (parts[0], parts[1])
        return made

    def prefix(self, rank: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(rank)
        if found is None:
            token, found = self.token[rank], -1
            for n in range(len(token) - 1, 0, -1):
                if (found := self.ids.get(token[:n], -1)) >= 0:
                    break
            self.shorter[rank] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave `left` and `right` side by side: no merge across their border
        may come before the merges that make the two."""
        key = left << 32 | right
        answer = self.compatible.get(key)
        if answer is None:
            if len(self.compatible) >= REMEMBERED_PAIRS:
                self.compatible.clear()
            answer = self.compatible[key] = self._fits(left, right)
        return answer

    def _fits(self, left: int, right: int) -> bool:
        ids, token = self.ids, self.token
        bound = len(token)
        while True:
            across = ids.get(token[left] + token[right])
            if across is not None and across < bound and self.split(across) == (left, right):
                return False
            # undo the later of the two merges; on equal rank the left one came first
            if left > right:
                bound = left
                inner = self.split(left)[1]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1
                inner = self.split(right)[0]
                if inner == right:
                    return True
                right = inner
            else:
                bound = right + 1
                inner = self.split(right)[0]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = self.split(left)[1]
                if inner == left:
                    return True
                left = inner

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given in Latin-1."""
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        size = len(text)
        longest = [-1] * size
        for end, (rank, length) in self.automaton.iter(text):
            start = end - length + 1
            if longest[start] < 0 or length > len(self.token[longest[start]]):
                longest[start] = rank
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, candidate, token = 0, longest[0], self.token
        while at < size:
            last = out[-1] if out else -1
            while True:
                end = at + len(token[candidate])
                if open_at[end] and (last < 0 or self.fits(last, candidate)):
                    out.append(candidate)
                    at = end
                    candidate = longest[end] if end < size else -1
                    break
                candidate = self.prefix(candidate)
                if candidate < 0:
                    # nothing fits here: this border is closed, take the last token back and try a shorter one
                    open_at[at] = 0
                    out.pop()
                    at -= len(token[last])
                    candidate = last
                    break
        return tuple(out)

    def extend(self, out: array, text: str) -> None:
        known = self.known
        for word in self.pieces.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.piece(word.encode("utf-8").decode("latin-1"))
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.extend(out, text)
        return out.tolist()


class Library:
    """A vocabulary that is no byte-level BPE in ranks, encoded by its own public library."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tool = Tokenizer.from_file(path)
            tool.encode_special_tokens = True
            self.ids = lambda text: tool.encode(text, add_special_tokens=False).ids
        else:
            from sentencepiece import SentencePieceProcessor

            self.ids = SentencePieceProcessor(model_file=path).encode

    def extend(self, out: array, text: str) -> None:
        out.extend(self.ids(text))


_ENCODERS: dict[str, Encoder | Library] = {}


def encoder(folder: str, vocabulary: str) -> Encoder | Library:
    """One encoder a process and vocabulary: ranks (whose pattern of pieces is the same for all), else its library's file."""
    path = f"{folder}/{vocabulary}"
    if path not in _ENCODERS:
        ending = next((e for e in (".tiktoken", ".json", ".model") if os.path.exists(path + e)), None)
        if ending is None:
            raise FileNotFoundError(f"no vocabulary file {path}.tiktoken, .json or .model")
        _ENCODERS[path] = Encoder(path + ending) if ending == ".tiktoken" else Library(path + ending)
    return _ENCODERS[path]


def encoded(rows: DataFrame, text_col: str, *keep: str, out: str = "ids", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and `out`, the ids of the text: one narrow pass, no shuffle."""
    ship(rows.sparkSession)
    source = rows.select(*keep, F.col(text_col).alias("_text_"))
    kept = [f for f in source.schema.fields if f.name != "_text_"]
    schema = source.select(*[f.name for f in kept]).withColumn(out, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(folder, vocabulary)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(batch.num_columns - 1):
                value = text.as_py()
                if value:
                    tool.extend(flat, value)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*[f.name for f in kept], out])

    return source.mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "text", "doc_id")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, documents, tokens, characters: tokens by source of the whole corpus."""
    sized = encoded(table(spark, sf_dir, "documents"), "text", "source", "n_chars").select("source", "n_chars", F.size("ids").cast("bigint").alias("tokens"))
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("n_chars").alias("characters"))


ORACLES: dict[str, str] = {}
