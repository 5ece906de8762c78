"""BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table.

A word's bytes become symbols of a 512-letter alphabet (a byte, or a byte that ends its word), over
which every token is a string. At a position the longest matching token is taken if it and the token
before it are compatible, that is, if merging the two tokens' strings by rank would never join a pair
across their border. Otherwise its next shorter prefix token is tried, and at last the token before is
taken back; a position found dead is not visited again, so the time is linear in the word's length.
The sequence in which all neighbours are compatible is unique and is the result of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import HELD, keyed_text, released, runs

#: Cached pieces and blank-separated chunks of a worker; when full, a cache is emptied.
CACHE_ENTRIES = 150_000
_CONTROLS = re.compile("[\x1c-\x1f]")
_FILLED = re.compile("[^\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: Latin-1's printable characters stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class OffsetTable:
    """Byte strings of numbered items in one buffer; joins the strings of many ids at once."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b"".join(items), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in order, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        at = np.arange(int(ends[-1])) + np.repeat(self.start[ids] - ends + size, size)
        return self.buffer[at], ends


class WordBpe:
    """Encoder and decoder of a lower-casing word BPE with word-end marks, from its tokenizer description (JSON text)."""

    def __init__(self, description: str, specials: bool = True):
        import ahocorasick
        import regex
        import tokenizers

        spec = json.loads(description)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not end or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("not a lower-casing word BPE")
        names = {v: k for k, v in model["vocab"].items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names |= {v: k for k, v in added.items()}
        if sorted(names) != list(range(len(names))) or len(names) > 1 << 16:
            raise ValueError("ids must be consecutive and fit in 16 bits")
        self.n_ids, self.added = len(names), added if specials else {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if self.added else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Only for characters whose class differs between versions of Unicode: normalising and parting as the library has it.
        whole = tokenizers.Tokenizer.from_str(description)
        self.normalizer, self.parting = whole.normalizer, whole.pre_tokenizer

        letters = byte_letters()
        self.letters = letters
        # A private letter for each byte that ends its word; tokens are strings over both kinds.
        closing = {c: chr(0xE000 + b) for b, c in enumerate(letters)}
        self.closing = closing
        own = lambda name: name[: -len(end) - 1] + closing[name[-len(end) - 1]] if name.endswith(end) and len(name) > len(end) else name
        vocab = {own(k): v for k, v in model["vocab"].items()}
        self.length = [0] * self.n_ids
        for k, v in vocab.items():
            self.length[v] = len(k)
        # rank: merges by age, single letters first; parts: what a merge joined.
        self.rank = [0] * self.n_ids
        self.parts: list[tuple[int, int] | None] = [None] * self.n_ids
        self.merged: dict[tuple[int, int], int] = {}
        for age, pair in enumerate(model["merges"], 1):
            a, b = (own(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            new = vocab[a + b]
            self.merged.setdefault((vocab[a], vocab[b]), new)
            if self.parts[new] is None:
                self.rank[new], self.parts[new] = age, (vocab[a], vocab[b])
        self.fits: dict[tuple[int, int], bool] = {}
        # A token whose own string merges to something else can never come out.
        reachable = {k: v for k, v in vocab.items() if self.parts[v] is None and len(k) == 1 or self.parts[v] is not None and self.compatible(*self.parts[v], self.rank[v])}
        self.matches = ahocorasick.Automaton()
        for k, v in reachable.items():
            self.matches.add_word(k, v)
        self.matches.make_automaton()
        self.shorter = [-1] * self.n_ids
        for k, v in reachable.items():
            self.shorter[v] = next((reachable[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in reachable), -1)
        self.texts = OffsetTable([names[i].encode() + b" " for i in range(self.n_ids)])
        self.decimals = OffsetTable([b"%d " % i for i in range(self.n_ids)])
        self.of_piece: dict[str, bytes] = {}
        self.of_chunk = _Chunks(self.chunk)

    def compatible(self, a: int, b: int, before: int = 1 << 30) -> bool:
        """Whether no merge older than `before` joins the end of a's string to the start of b's.

        The merges within both strings are undone from the youngest on, so that every pair that meets at
        the border is seen, along with the age up to which it stays there.
        """
        whole = before == 1 << 30
        if whole and (known := self.fits.get((a, b))) is not None:
            return known
        key, out = (a, b), True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and self.rank[joined] < before:
                out = False
                break
            # On equal age, the left occurrence is merged first, so the right one is undone first.
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.parts[a][1]
            elif self.parts[b] is not None:
                before, b = self.rank[b] + 1, self.parts[b][0]
            else:
                break
        if whole:
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            self.fits[key] = out
        return out

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def word(self, s: str) -> bytes:
        """Ids of one piece, given as a letter for each of its bytes."""
        s = s[:-1] + self.closing[s[-1]]
        size, length, shorter, fits, known = len(s), self.length, self.shorter, self.compatible, self.fits
        longest = [0] * size
        for last, token in self.matches.iter(s):
            longest[last + 1 - length[token]] = token  # a later end is a longer match
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            end = at + length[token]
            if not dead[end] and (not out or (known[pair] if (pair := (out[-1], token)) in known else fits(*pair))):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return array("H", out).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids, as 16-bit little-endian numbers, of text without special tokens."""
        if text.isascii():
            low = text.lower()
            pieces = [low] if low.isalpha() else map(self.symbols, self.pieces(low))
        elif max(text) < "\u0250" and "\u0130" not in text:
            pieces = map(self.symbols, self.pieces(unicodedata.normalize("NFC", text).lower()))
        else:
            pieces = [x for x, _ in self.parting.pre_tokenize_str(self.normalizer.normalize_str(text))]
        out = []
        for piece in pieces:
            ids = self.of_piece.get(piece)
            if ids is None:
                if len(self.of_piece) >= CACHE_ENTRIES:
                    self.of_piece.clear()
                ids = self.of_piece[piece] = self.word(piece)
            out.append(ids)
        return b"".join(out)

    def chunk(self, chunk: str) -> bytes:
        if self.split_special and "<" in chunk:
            return b"".join([np.array([self.added[x]], "<u2").tobytes() if x in self.added else self.plain(x) for x in self.split_special.split(chunk) if x])
        return self.plain(chunk)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 16-bit little-endian numbers. Blanks only part pieces, so chunks between them are encoded apart and cached."""
        chunks = _FILLED.findall(text) if _CONTROLS.search(text) else text.split()
        if len(self.of_chunk) > CACHE_ENTRIES:
            self.of_chunk.clear()
        return b"".join(map(self.of_chunk.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' names joined by blanks: without a decoder in its description, that is this tokenizer's decoding."""
        return self.texts.join(np.asarray(ids, np.int64))[0].tobytes()[:-1].decode()


class _Chunks(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


_BUILT: dict[tuple[str, bool], WordBpe] = {}
HELD["codecs"] = _BUILT.clear


def built(description: str, specials: bool = True) -> WordBpe:
    """The codec of a description, built once in each worker."""
    key = hashlib.sha256(description.encode()).hexdigest(), specials
    if key not in _BUILT:
        _BUILT[key] = WordBpe(description, specials)
    return _BUILT[key]


def vocabulary(path: str | None = None) -> str:
    """Text of a tokenizer description; its path is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, *, specials: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each whole text's ids as 16-bit little-endian numbers in a binary; null and empty texts give no ids.

    One pass without a shuffle; the vocabulary (about 2 MB) is broadcast. Repeated rows stay, other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = built(shared.value, specials)
        for batch in released(batches, "codecs"):
            for a, b in runs(batch[text]):
                yield pd.DataFrame({key: batch[key].iloc[a:b], "ids": [codec.encode(x) for x in batch[text].iloc[a:b]]})

    source = keyed_text(docs, key, text)
    return source.mapInPandas(work, f"{key} {source.schema[key].dataType.simpleString()}, ids binary")


def bpe_digests(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256 (, ids)): of encode_documents' output, digests of each text's ids and of their decoding, and with ids the output itself.

    ids_sha256 is of the decimal ids joined by blanks; both digests of an empty text are those of no bytes.
    Null texts count as empty; null keys and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    encoded = encode_documents(docs, path, key=key, text=text)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = built(shared.value)
        for batch in released(batches, "codecs"):
            for a, b in runs(batch["ids"], 1 << 18):
                coded = batch["ids"].iloc[a:b]
                counts = np.array([len(x) // 2 for x in coded], np.int64)
                numbers = np.frombuffer(b"".join(coded), "<u2").astype(np.int64)
                digests = []
                for part in (codec.decimals, codec.texts):
                    buffer, ends = part.join(numbers)
                    ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                    view = memoryview(buffer)
                    digests.append([hashlib.sha256(view[i : max(i, j - 1)]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                yield pd.DataFrame({key: batch[key].iloc[a:b], "n_tokens": counts, "ids_sha256": digests[0], "decoded_sha256": digests[1], **({"ids": coded} if ids else {})})

    return encoded.mapInPandas(work, f"{key} {encoded.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids binary' * ids}")
