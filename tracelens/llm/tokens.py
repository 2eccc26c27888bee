"""Token ids of whole texts with a public byte-level BPE vocabulary.

The tokenizers library encodes; it is asked once per distinct word. A
byte-level BPE merges inside words only, and a word starts at every single
space and at every single line end. So a batch of texts is cut there by Arrow
and dictionary-encoded, the distinct pieces are encoded, and the ids are
gathered back in order. Pieces and words found so far are kept in dictionaries
of bounded size for the life of the Python worker.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pre-tokenising pattern of the byte-level vocabularies (fixed value); letters
#: stand first, as most words are such and no two branches begin alike.
WORDS = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than spaces and line ends, or beside other white space, or at an end; and the 0 character, which marks pieces here.
ODD = r"[\x00\t\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Pieces and words kept by a worker, and the longest that are kept.
KEPT, KEPT_CHARS = 600_000, 48
#: First characters of pieces that do not stand for themselves after a space.
MARKS = ("", "\0", "\n")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def gathered(parts: pa.ListArray, ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each list's ids in order (unsigned 32-bit); ``ids_of`` gives those of distinct strings."""
    coded = parts.flatten().dictionary_encode()
    found = ids_of(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy()
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    data = b"".join(map(found.__getitem__, codes.tolist()))
    ends = np.append(0, np.cumsum(lengths[codes]))
    bounds = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        # a vocabulary of another kind is encoded text by text
        self.by_word = (
            spec.get("normalizer") is None and spec.get("post_processor") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        )
        self.special = {a["content"]: a["id"] for a in added}
        names = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.split = regex.compile(f"({names})") if added else None
        self.odd = ODD + "".join("|" + "".join(f"\\x{{{ord(c):x}}}" for c in s) for s in self.special)
        self.words, self.letters = regex.compile(WORDS), byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.missed = 0

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; none for null texts."""
        texts = texts.fill_null("")
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), "")
        parts = pc.split_pattern(marked, " ")
        out = gathered(parts, self._pieces)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self._odd(texts[int(i)].as_py())
        return out

    def _odd(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        # a special token in a text encodes to its id, as in the library
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._of_words(p) for p in parts if p)

    def _of_words(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in self.words.findall(text)])

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern. A word after a space is kept like the piece that it also is."""
        kept, key = (self.pieces, word[1:]) if word[:1] == " " and word[1:2] not in MARKS else (self.known, word)
        ids = kept.get(key)
        if ids is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
            if len(kept) < KEPT and len(word) <= KEPT_CHARS:
                kept[key] = ids
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """A piece after a space comes without that space, one after a line end with it, the first of a text after a 0 character."""
        kept = self.pieces
        found = list(map(kept.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        # full dictionaries keep the first, mostly frequent strings until they have missed many
        self.missed += len(new)
        if self.missed > 20 * KEPT:
            kept.clear()
            self.known.clear()
            self.missed = 0
        for i in new:
            p = pieces[i]
            if p.isalpha():
                found[i] = self._word(" " + p)
                continue
            if p[:-1].isalpha() and p[-1] in ".,;:!?":
                ids = self._word(" " + p[:-1]) + self._word(p[-1])
            else:
                ids = self._of_words(p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p)
            found[i] = ids
            if len(kept) < KEPT and len(p) <= KEPT_CHARS:
                kept[p] = ids
        return found


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    return WordEncoder(path)
