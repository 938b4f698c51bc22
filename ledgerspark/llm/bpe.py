"""Byte-level BPE encoding and decoding by a depth-first walk over a trie of distinct words.

A word of the pre-tokenizer is encoded on its own. For every prefix of a word the walk keeps the *last token* of the
prefix's encoding; the encoding itself follows by stepping back over the last tokens. The last token of a prefix is the
one vocabulary entry that ends it, fits behind the last token of what stands before it, and is its own encoding. (A
token sequence is what the merges produce exactly if that holds for each pair of neighbours.) Words that begin alike
share the nodes of the trie, so the encoding of a common beginning is computed once.

Each task makes a trie of the words that it has not met before. Everything is narrow: no shuffle, no data on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import release_memory, sized

VOCABULARY = "byte_bpe_50k.json"
PIECE_CHARS = 2_000_000  # a task holds the words of so many characters at once, or of one text
CACHED_WORDS = 120_000
TAIL = 3

#: The pre-tokenizer's pattern, a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII and Latin letters only, for which plain classes suffice.
_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", " \\t\\n\\x0b\\x0c\\r"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_any_words, _latin_words = regex.compile(PATTERN).findall, re.compile(LATIN).findall
_beyond_latin = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]").search


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files are; the environment variable TOKENIZER_DIR may name another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """Vocabulary, merges and added tokens of one file, with the word encodings found so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.raw = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.whole = {t: i for t, i in self.ids.items() if self.merged(t) == [t]}  # tokens that are their own encoding
        self.ends: dict[bytes, set[int]] = {}  # lengths of the tokens with that end
        for t in self.whole:
            if len(t) >= TAIL:
                self.ends.setdefault(t[-TAIL:], set()).add(len(t))
        self.tails: dict[bytes, list[int]] = {}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.decimal = {i: str(i) for i in self.raw}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.words: dict[str, str] = {}  # ids in decimal
        self.data: dict[str, bytes] = {}  # what these ids stand for
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied to a short byte string, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _lengths(self, tail: bytes) -> list[int]:
        """Lengths, longest first, of the tokens that a prefix with this end may end with."""
        shorter = {n for n in range(1, min(len(tail), TAIL - 1) + 1) if tail[-n:] in self.whole}
        found = sorted(shorter | self.ends.get(tail, set()), reverse=True)
        if len(self.tails) > CACHED_WORDS:
            self.tails.clear()
        self.tails[tail] = found
        return found

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces at the left (0) or right (1) end of the token while its merges run, each with the rank that ends it."""
        spine = self.spines[side].get(token)
        if spine is None:
            below, whole = [], token
            while len(whole) > 1:
                pair = self.parts[whole]
                below.append((pair[side], self.rank[pair]))
                whole = pair[side]
            spine = self.spines[side][token] = [*reversed(below), (token, len(self.rank))]
        return spine

    def fit(self, pair: int) -> bool:
        """True if the second token of the pair (two ids in one number) stays apart behind the first.

        The ends that meet are followed while the merges run: they join if the rank of their pair comes before the
        ranks at which either is taken up by its own token. Of equal ranks the one further left goes first.
        """
        known, last = True, len(self.rank)
        before, token = self.raw[pair >> 20], self.raw[pair & 0xFFFFF]
        left, right, i, j = self._spine(before, 1), self._spine(token, 0), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = self.rank.get((a, b), last)
            if rank < a_ends and rank <= b_ends and rank < last:
                known = False
                break
            if a_ends == last and b_ends == last:
                break
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
        if len(self.fits) > CACHED_WORDS:
            self.fits.clear()
        self.fits[pair] = known
        return known

    def encode_words(self, words: list[str]) -> None:
        """Encode words that are not known yet, all in one walk over their trie.

        Sorted words are the trie in depth-first order: the beginning that a word shares with the word before it is the
        path to the node where it branches off. The states of that path stay, those below it are computed.
        """
        whole, fits, tails, sizes, decimal, tokens = self.whole, self.fits, self.tails, self.sizes, self.decimal, self.raw
        last = [0]  # by prefix length: the last token of that prefix
        before = b""
        for data in sorted(map(str.encode, words)):
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            before, size = data, len(data)
            for depth in range(shared + 1, size + 1):
                tail = data[depth - TAIL : depth] if depth > TAIL else data[:depth]
                for length in tails.get(tail) or self._lengths(tail):
                    start = depth - length
                    if start < 0:
                        continue
                    token = whole.get(data[start:depth])
                    if token is not None:
                        if not start:
                            break
                        pair = last[start] << 20 | token
                        fit = fits.get(pair)
                        if fit or fit is None and self.fit(pair):
                            break
                else:
                    raise ValueError("a byte is not in the vocabulary")
                last.append(token)
            token = last[size]
            ids, text = decimal[token], tokens[token]
            size -= sizes[token]
            while size:
                token = last[size]
                ids, text = f"{decimal[token]},{ids}", tokens[token] + text
                size -= sizes[token]
            word = data.decode()
            self.words[word] = ids
            self.data[word] = text

    def split(self, text: str) -> list[str]:
        """The words of the pre-tokenizer; added tokens are words of their own."""
        words = _any_words if _beyond_latin(text) else _latin_words
        if self.split_added is None or not any(t in text for t in self.added):
            return words(text)
        return [w for i, part in enumerate(self.split_added(text)) for w in ([part] if i % 2 else words(part))]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """Of each text: the ids in decimal with commas between, their number, and the bytes that they stand for."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
            self.data.clear()
        for token, i in self.added.items():
            self.words[token], self.data[token] = str(i), self.raw[i]
        self.encode_words([w for w in set().union(*split) if w not in self.words])
        out = []
        for words in split:
            ids = ",".join(map(self.words.__getitem__, words))
            out.append((ids, ids.count(",") + 1 if ids else 0, b"".join(map(self.data.__getitem__, words))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``token_ids`` (array of int). Null texts count as empty. A column of that name is replaced."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        model = load(path)
        out: list[list[int]] = []
        for piece in sized([t or "" for t in texts], PIECE_CHARS):
            out += [list(map(int, e[0].split(","))) if e[1] else [] for e in model.encode_texts(piece)]
        return pd.Series(out)

    return docs.withColumn("token_ids", ids(F.col(text_col)))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``tokens`` with ``decoded``, the text of ``token_ids``. Null counts as no ids."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = load(path)
        return pd.Series([model.decode(list(map(int, x)) if x is not None else []) for x in ids], dtype=object)

    return tokens.withColumn("decoded", text("token_ids"))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Long texts are never cut; null counts as empty."""
    path = path or vocabulary_path()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            rows = []
            for piece in sized([t or "" for t in batch["text"]], PIECE_CHARS):
                for ids, n, data in model.encode_texts(piece):
                    text = data.decode("utf-8", "replace").encode()
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].reset_index(drop=True))
            yield out
        release_memory()  # the worker goes on to other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


