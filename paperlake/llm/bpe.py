"""Byte-pair encoding by backtracking, in time linear in the text, and decoding by an offset table.

A word is covered from the left with the longest vocabulary entries that an Aho-Corasick
automaton finds at each place. An entry may follow another if merging would not have
crossed their border earlier, which a table of merge pairs answers; otherwise shorter
prefixes are tried, and then the last entry is taken back. Places once given up are
remembered, so each is left at most once. The result is that of applying all merges in
order of rank, since that result is the one sequence whose neighbours are all compatible.

Vocabularies are those of a tokenizers BPE file with byte-level symbols, with or without
an end-of-word suffix. A word's symbols are characters 0-255 for bytes and, where the
suffix is used, 256-511 for a last byte.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from paperlake.llm.common import text_batches

#: Words whose ids a process keeps, and as many of those before; about 60 MB in all.
CACHE_WORDS = 150_000
_CACHED_CHARS = 64
_PIECE = 1 << 18
_LONG_WORD = 1 << 12
_SPACE = "[\t-\r \x85\xa0  -     　]"


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Starts:
    """The entries that start at each place of a very long word, shortest first, as two arrays of numbers in place of a list for each place."""

    def __init__(self, auto: ahocorasick.Automaton, word: str):
        found = np.fromiter(((end - len(s) + 1) << 16 | len(s) for end, s in auto.iter(word)), dtype=np.int64)
        found.sort()
        self.word, self.sizes = word, (found & 0xFFFF).astype(np.uint16)
        self.first = np.searchsorted(found >> 16, np.arange(len(word) + 1))

    def __getitem__(self, i: int) -> list[str]:
        return [self.word[i : i + n] for n in self.sizes[self.first[i] : self.first[i + 1]].tolist()]


class Vocabulary:
    """Ids, merges and token strings of one BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: chr(b) for b, c in _byte_chars().items()}

        def symbols(token: str) -> str:
            last = bool(self.suffix) and token.endswith(self.suffix)
            s = "".join(byte[c] for c in (token[: -len(self.suffix)] if last else token))
            return s[:-1] + chr(256 + ord(s[-1])) if last else s

        entry = {symbols(t): i for t, i in model["vocab"].items()}
        #: For a merged entry, when it is made and of what; bases are made before all.
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.pair: dict[tuple[str, str], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = map(symbols, m if isinstance(m, list) else m.split(" "))
            self.pair.setdefault((a, b), r)
            if a + b not in self.rank:
                self.rank[a + b], self.parts[a + b] = r, (a, b)
        self.ids = {s: entry[s] for s in entry if len(s) == 1 or self._reachable(s)}
        self.auto = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.auto.add_word(s, s)
        self.auto.make_automaton()
        self.id_bytes = {s: i.to_bytes(4, "little") for s, i in self.ids.items()}
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        parts = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def _reachable(self, s: str) -> bool:
        """Whether merging an entry's own symbols ends in that entry."""
        if s not in self.rank:
            return False
        return self._merge(list(s)) == [s]

    def _merge(self, parts: list[str]) -> list[str]:
        """Merges one after the other, by definition; for single entries only."""
        while len(parts) > 1:
            r, i = min((self.pair.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
            if r == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @functools.lru_cache(maxsize=200_000)
    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b would leave the border between the two."""
        limit = 1 << 40
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            r = pair.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later of the two is undone; of equal ones that is the right one
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def encode_word(self, word: str) -> list[str]:
        """The entries of one word, given as symbols."""
        n = len(word)
        at = [[] for _ in range(n)] if n <= _LONG_WORD else _Starts(self.auto, word)  # entries by start, shortest first
        if n <= _LONG_WORD:
            for end, s in self.auto.iter(word):
                at[end - len(s) + 1].append(s)
        out: list[str] = []
        left = bytearray(b"\x01") * (n + 1)
        pos, k = 0, len(at[0]) - 1
        tries: list[int] = []
        while pos < n:
            while k >= 0:
                s = at[pos][k]
                if left[pos + len(s)] and (not out or self.compatible(out[-1], s)):
                    break
                k -= 1
            if k >= 0:
                out.append(s)
                tries.append(k)
                pos += len(s)
                k = len(at[pos]) - 1 if pos < n else 0
            elif out:
                left[pos] = 0
                pos -= len(out.pop())
                k = tries.pop() - 1
            else:
                raise ValueError("the vocabulary lacks a symbol")
        return out

    def encode_bytes(self, word: bytes) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        s = word.decode("latin-1")
        if self.suffix and s:
            s = s[:-1] + chr(256 + ord(s[-1]))
        return b"".join(map(self.id_bytes.__getitem__, self.encode_word(s)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The token strings with a blank between each two, in UTF-8: pieces of one blob by offset."""
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size + 1)
        out = np.full(ends[-1], 32, dtype=np.uint8)
        first = ends - size - 1
        at = np.arange(size.sum(), dtype=np.int64)
        inside = np.cumsum(size) - size
        shift = np.repeat(start - inside, size)
        out[at + np.repeat(first - inside, size)] = self.blob[at + shift]
        return out[:-1].tobytes()


class WordTokenizer:
    """A vocabulary with end-of-word marks behind NFC, lower case and a split into words, numbers and signs."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.vocabulary = Vocabulary(path)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cache_words = cache_words
        self.gap = re.compile(_SPACE)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        signs = r"[^\p{L}\p{N}" + _SPACE[1:-1]
        plain = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|" + signs + "]+"
        self.split = regex.compile(plain)
        #: Letters and digits of later Unicode versions than the library's, which are signs to it.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        late = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
        known = pre_tokenizers.Split(Regex(r"\p{L}|\p{N}"), "removed", invert=True).pre_tokenize_str(late)
        self.unknown = frozenset(late) - {c for c, _ in known}
        self.split_late = regex.compile(r"(?V1)" + plain.replace("\\p{L}+", "[\\p{L}--[" + "".join(self.unknown) + "]]+").replace("|\\p{N}|", "|[\\p{N}--[" + "".join(self.unknown) + "]]|").replace(signs + "]", "[" + signs + "]||[" + "".join(self.unknown) + "]]")) if self.unknown else self.split
        self.rare = re.compile(f"[{min(self.unknown, default=chr(0x10FFFF))}-\U0010ffff]")

    def normalize(self, text: str) -> str:
        """As the library does it; what is ASCII alone needs lower case only."""
        return text.lower() if text.isascii() else self.library.normalize_str(text)

    def _words(self, text: str) -> Iterator[bytes]:
        cache, before = self.cache, self.before
        late = not text.isascii() and self.rare.search(text) and not self.unknown.isdisjoint(text)
        for m in (self.split_late if late else self.split).findall(text):
            got = cache.get(m)
            if got is None:
                got = before.get(m)
                if got is None:
                    got = self.vocabulary.encode_bytes(m.encode())
                if len(m) <= _CACHED_CHARS:
                    if len(cache) >= self.cache_words:  # words in use move on, the others go
                        self.cache, self.before = cache, before = {}, cache
                    cache[m] = got
            yield got

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Packed ids of a text, in parts; a special token's string is that token."""
        text = text or ""
        for i, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if i % 2:
                yield self.vocabulary.special[part].to_bytes(4, "little")
                continue
            part = self.normalize(part)
            a = 0
            while a < len(part):  # parts end before white space, so no word is cut
                m = self.gap.search(part, a + _PIECE)
                b = m.start() if m else len(part)
                yield b"".join(self._words(part[a:b]))
                a = b

    def decode(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        """The decoded text of packed ids, in parts."""
        first = True
        for p in parts:
            if p:
                if not first:
                    yield b" "
                first = False
                yield self.vocabulary.decode(np.frombuffer(p, dtype="<u4").astype(np.int64))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, ids (packed little-endian unsigned 32-bit integers), n_tokens.

    Null and empty texts have no ids; null ids and equal rows stay; an empty table gives none; a very long text's ids are put
    together from parts. Other columns are not read. The file must be on every executor.
    """

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([b"".join(t.encode(x)) for x in texts])

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias(id_col), encode(F.col(text_col)).alias("ids")).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of packed ids: id and decoded text; null packed ids are none; null ids and equal rows stay; an empty table gives none."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([b"".join(t.decode([x or b""])).decode() for x in ids])

    text_batches(encoded.sparkSession)
    return encoded.select(F.col(id_col).alias(id_col), decode(F.col(ids_col)).alias("text"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document row: id, n_tokens, and SHA-256 of the packed ids and of what they decode to; with_ids, the packed ids as well.

    Texts pass through in parts, so a very long one needs no more memory than itself (and its ids, if asked for). Null texts count
    as empty; null ids and equal rows stay; other columns are not read; an empty table gives none.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")

    @F.pandas_udf(kind)
    def measure(texts: pd.Series) -> pd.DataFrame:
        t, out = tokenizer(path), []
        for x in texts:
            ids, text, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

            def parts(x=x, ids=ids, kept=kept):
                nonlocal n
                for p in t.encode(x):
                    ids.update(p)
                    n += len(p) // 4
                    if with_ids:
                        kept.append(p)
                    yield p

            for piece in t.decode(parts()):
                text.update(piece)
            out.append((n, ids.hexdigest(), text.hexdigest(), *([b"".join(kept)] if with_ids else [])))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in kind.split(", ")])

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias(id_col), measure(F.col(text_col)).alias("m")).select(id_col, "m.*")
