"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one BPE encoding, so it has one last token. The tokens that may end at a place come from an
Aho-Corasick automaton over the vocabulary, in place of a suffix automaton: it reports just the tokens that end there,
where a suffix automaton also matches parts of tokens, which count for nothing. A token is the last one of a prefix exactly if it is compatible with the last
token of the shorter prefix before it. Following the back-pointers from the end of the word gives the ids.

Null text counts as empty; empty text has no tokens. Repeated rows give repeated results. A null doc_id stays null.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import map_texts, table, texts_of

#: Words that a task keeps with their ids before it starts afresh: this bounds memory, not results.
CACHE_WORDS = 400_000
TWO_SPACES = re.compile(r"\s\s")
#: Fixed value: how the vocabulary's pre-tokenizer cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable ones stand for themselves, others for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.rank, self.parts, self.pair = [-1] * size, [None] * size, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[bytes(letters[c] for c in x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = vocab[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[made], self.parts[made] = rank, (left, right)
            self.pair[left << 20 | right] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def forget(self) -> None:
        """Drop the words met so far; the vocabulary stays."""
        self.known.clear()
        self.spaced.clear()
        self.fits.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, put together, encode to just these tokens.

        Back in time from the whole tokens to bytes: the parts that touched at the border must not have merged before
        either became part of something longer. Of merges with one rank the leftmost comes first.
        """
        rank, parts, pair = self.rank, self.parts, self.pair
        left_until = right_until = 1 << 30
        while True:
            merged = pair.get(left << 20 | right)
            if merged is not None and merged < left_until and merged <= right_until:
                return False
            if rank[left] > rank[right]:
                left_until, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                right_until, right = rank[right], parts[right][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        last, came, fits = [-1] * (len(word) + 1), [0] * (len(word) + 1), self.fits
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > CACHE_WORDS:
                        fits.clear()
                    ok = fits[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end + 1], came[end + 1] = token, start
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at = came[at]
        return ids[::-1]

    def _missed(self, word: str) -> bytes:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        ids = self.encode_word(word.encode("utf-8", "replace"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < 64:
            self.known[word] = out
        return out

    def _missed_spaced(self, piece: str) -> bytes:
        if len(self.spaced) > CACHE_WORDS:
            self.spaced.clear()
        out = b"".join([self.known.get(w) or self._missed(w) for w in self.words.findall(" " + piece)])
        if len(piece) < 64:
            self.spaced[piece] = out
        return out

    def _encode_plain(self, text: str) -> bytes:
        """Where no two white spaces meet, a new word begins at each space and a line end is a word of its own."""
        known, spaced, out = self.known, self.spaced, []
        if TWO_SPACES.search(text):
            return b"".join([known.get(w) or self._missed(w) for w in self.words.findall(text)])
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(known.get("\n") or self._missed("\n"))
            first, *rest = line.split(" ")
            out += [known.get(w) or self._missed(w) for w in self.words.findall(first)]
            out += [spaced.get(x) or self._missed_spaced(x) for x in rest]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(
            struct.pack("<I", self.special[piece]) if piece in self.special else self._encode_plain(piece)
            for piece in (self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text])
        )

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, round_trip (whether the ids decode to the text) of each document."""
    path = path or default_path()

    def start():
        t = tokenizer(path)

        def work(doc_id, text):
            ids = [t.encode(x or "") for x in text]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            return {
                "doc_id": doc_id,
                "ids": pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), np.int32)),
                "n_tokens": np.diff(ends).astype(np.int64),
                "round_trip": [t.decode(a) == (b or "") for a, b in zip(ids, text, strict=True)],
            }

        work.done = t.forget
        return work

    return map_texts(texts_of(docs), start, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids count as none."""
    path = path or default_path()

    def start():
        t = tokenizer(path)
        return lambda doc_id, ids: {"doc_id": doc_id, "text": [t.decode(struct.pack(f"<{len(x or [])}I", *(x or []))) for x in ids]}

    return map_texts(ids.select(ids["doc_id"].cast("long").alias("doc_id"), ids["ids"].cast("array<int>").alias("ids")), start, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip: encode each whole text and decode its ids again, in one pass."""
    path = path or default_path()

    def start():
        t = tokenizer(path)

        def work(doc_id, text):
            ids = [t.encode(x or "") for x in text]
            back = [t.decode(x) for x in ids]
            return {
                "doc_id": doc_id,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
                "round_trip": [a == (b or "") for a, b in zip(back, text, strict=True)],
            }

        work.done = t.forget
        return work

    return map_texts(texts_of(docs), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).drop("round_trip")
