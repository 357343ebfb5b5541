"""Exact tokenization at corpus speed.

Both public vocabularies cut a text at white space before any merge is made, so
the ids of a text are the ids of its white-space chunks, one after another.  A
worker cuts a group of texts at once, in Arrow, and codes its chunks by a
dictionary, so each distinct chunk of a group is looked up once and ids are
gathered by code.  A worker encodes a chunk once and then looks it up.  A new chunk of ordinary Latin text
is itself put together from pre-tokens (runs of letters, digits or signs, found
by the vocabulary's own pattern), which the library's model merges once each;
any other chunk, and any text with unusual white space, goes through the whole
library.  Memory has two generations of bounded size, of which the older one is
forgotten in time, so a worker stays small and frequent chunks stay known.
"""

from __future__ import annotations

import os
import string
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct chunks in each of a worker's two generations of memory (some 200 bytes each), and the longest of them.
CACHE_CHUNKS, CACHE_LENGTH = 150_000, 64
#: Bytes of text that are cut into chunks at a time; equal chunks of a group are looked up once.
GROUP_BYTES = 8_000_000

_LOADED: dict[tuple[str, str], "ChunkedTokenizer"] = {}

#: How these vocabularies cut a text before merging, and the printable stand-ins of bytes in byte-level vocabularies.
PREFIX_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_signs() -> list[str]:
    """Printable bytes stand for themselves; the others get code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_SIGNS = _byte_signs()


class _StandIns(dict):
    """Code point -> how byte-level vocabularies write it."""

    def __missing__(self, point: int) -> str:
        self[point] = "".join([_SIGNS[b] for b in chr(point).encode()])
        return self[point]


_STAND_INS = _StandIns()
_DIRTY = regex.compile(r"\s|[ɐ-\U0010FFFF]|[\x00-\x1F\x7F-\x9F]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkedTokenizer:
    """mode 'space': white space only separates, letters are folded to lower case. mode 'prefix': a single space belongs to the chunk after it."""

    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.mode, self.lead = mode, _STAND_INS[32] if mode == "prefix" else ""
        self.pattern = regex.compile(SPACE_PATTERN if mode == "space" else PREFIX_PATTERN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """Lists of chunks. In mode 'prefix' a key stands for itself after a space, but one that begins with \\x01 or \\n for what follows this sign (after the text's beginning or a line feed)."""
        if self.mode == "space":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x01", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type)), " ")

    def _merged(self, part: str) -> bytes:
        """The ids of one pre-token."""
        return array("I", [t.id for t in self.model.tokenize(part.translate(_STAND_INS))]).tobytes()

    def _assembled(self, lead: str, word: str) -> bytes:
        """A chunk without unusual characters, from its pre-tokens; these are remembered as chunks of their own."""
        if self.mode == "space":
            word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
        if word.isalpha():
            return self._merged(lead + word)
        out, young, old = [], self.young, self.old
        for part in self.pattern.findall(lead + word):
            key = part if self.mode == "space" else part[1:] if part[0] == " " else "\x01" + part
            ids = young.get(key) or old.get(key)
            if ids is None:
                ids = self._merged(part)
                if key and len(part) <= CACHE_LENGTH:
                    young[key] = ids
            out.append(ids)
        return b"".join(out)

    def _worked_out(self, key: str) -> bytes | None:
        """The ids of a chunk (None: the whole text must be encoded)."""
        lead, word = "", key
        if self.mode == "prefix":
            lead, word = ("", key[1:]) if key[:1] == "\x01" else ("\n", key[1:]) if key[:1] == "\n" else (" ", key)
        if not word:
            return b"" if self.mode == "space" else None  # None: this white space isn't a lone space or line feed
        if (word.isascii() and word.isalnum()) or not _DIRTY.search(word):
            return self._merged("\n") + self._assembled("", word) if lead == "\n" else self._assembled(lead, word)
        if self.mode == "prefix" and regex.search(r"\s|[\x00-\x1F]", word):
            return None
        return self._raw(word if self.mode == "space" else lead + word)

    def _letters(self, word: str) -> bytes | None:
        """The ids of a chunk of ordinary letters (None: it isn't that)."""
        folded = word.lower() if self.mode == "space" else word
        if not folded.isascii() and (not folded.isalpha() or _DIRTY.search(word)):
            return None
        return array("I", [t.id for t in self.model.tokenize(self.lead + (folded if folded.isascii() else folded.translate(_STAND_INS)))]).tobytes()

    def _find(self, keys: list[str]) -> list[bytes | None]:
        """The ids of distinct chunks, from memory where it has them. Most new ones are letters, or letters and then signs: two pre-tokens, each of which may be known."""
        young, old, glued = self.young, self.old, "\x01" if self.mode == "prefix" else ""
        found = list(map(young.get, keys))
        missing = [i for i, f in enumerate(found) if f is None]
        for i, known in zip(missing, map(old.get, [keys[i] for i in missing]), strict=True):
            key = keys[i]
            if known is None:
                word = key.rstrip(string.punctuation)
                if word.isalpha():
                    known = young.get(word) or old.get(word) or self._letters(word)
                    if known and len(word) < len(key):
                        if len(word) <= CACHE_LENGTH:
                            young[word] = known
                        signs = glued + key[len(word) :]
                        tail = young.get(signs) or old.get(signs) or self._worked_out(signs)
                        if len(signs) <= CACHE_LENGTH:
                            young[signs] = tail
                        known += tail
                if known is None:
                    known = self._worked_out(key)
            found[i] = known
            if known is not None and len(key) <= CACHE_LENGTH:
                young[key] = known
        return found

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = self._chunks(texts)
        coded = lists.flatten().dictionary_encode()
        found = self._find(coded.dictionary.to_pylist())
        at, odd = coded.indices.to_numpy(), np.zeros(len(texts), bool)
        edges = lists.offsets.to_numpy()
        edges = edges - edges[0]
        if None in found:  # white space that needs the whole text
            whole = np.array([f is None for f in found])
            odd |= np.diff(np.concatenate([[0], np.cumsum(whole[at])])[edges]) > 0
            found = [f or b"" for f in found]
        if self.mode == "prefix":
            odd |= pc.match_substring(texts, "\x01").to_numpy(zero_copy_only=False)
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)])), pa.array(np.frombuffer(b"".join(found), "<u4")))
        ids = table.take(coded.indices).flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(n_ids[at])])[edges]
        for i, rare in enumerate(odd.tolist()):
            yield np.frombuffer(self._raw(texts[i].as_py()), "<u4") if rare else ids[starts[i] : starts[i + 1]]

    def encode(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, in order; memory holds a group of texts at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for part in text_groups(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
            yield from self._group(texts[part])
            if len(self.young) > CACHE_CHUNKS:  # what the next texts use comes back from `old`, the rest is forgotten
                self.old, self.young = self.young, {}


def load(path: str, mode: str) -> ChunkedTokenizer:
    """One tokenizer per worker process, reused by its later tasks."""
    if (path, mode) not in _LOADED:
        _LOADED[path, mode] = ChunkedTokenizer(path, mode)
    return _LOADED[path, mode]


def text_groups(sizes: Sequence[int], most: int = GROUP_BYTES) -> list[slice]:
    """Slices of a batch of at most so many bytes (or one text), so that very long texts don't add up."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            out.append(slice(start, i))
            start, held = i, 0
        held += n
    if start < len(sizes):
        out.append(slice(start, len(sizes)))
    return out
