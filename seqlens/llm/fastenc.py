"""Exact token ids of the `tokenizers` library, faster.

The vocabulary and merges of a tokenizer file are run by the byte-pair core of tiktoken, which applies merges by the rank of
what they make; that is the order of the file's merges, which is checked when the file is loaded. Texts that hold a special
string, a character on whose class or case the libraries' Unicode tables might differ, or a run of RUN blanks or of RUN other
characters (on which the pattern engine could exhaust its stack), go to `tokenizers` itself.

* byte: byte-level BPE with the file's usual pretoken pattern.
* word: NFC, lower case, white space dropped, merges up to a word's end. The end is a control character after each pretoken,
  and joins the byte before it first.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: The pretoken pattern of byte-level BPE, and that of word BPE for letters up to U+017F (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = re.compile(r"[a-zªµºß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
END = "\x01"
RUN = 10_000
_RUNS = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")
#: Texts with other characters than these go to the library.
_BYTE_OTHER = re.compile(r"[^\x00-ԯ֐-׿ؠ-ي٠-٩ऀ-हḀ-῿ -⁯₠-₿℀-⅏←-⏿①-➿　-ゖ゠-ヿ一-龥가-힣！-～\U0001f300-\U0001f64f]")
_WORD_OTHER = re.compile("[\x00\x01\x1c-\x1f\x7f-\xa0İ²³¹¼-¾]|[^\x00-ſ]")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.kind, self._lib = path, kind, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        vocab, byte = spec["model"]["vocab"], _byte_of()
        suffix = spec["model"]["end_of_word_suffix"] or ""

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if ends else token)) + (END.encode() if ends else b"")

        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        single = [c for c in byte if c in vocab]
        tokens = ([c + suffix for c in single] if suffix else []) + single + made
        ranks: dict[bytes, int] = {}
        ids = []
        for token in tokens:
            key = raw(token)
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token])
        if len(single) < 256 and not suffix or len(set(made)) < len(made):
            raise ValueError("not a byte-pair vocabulary of this kind")
        self.ids = np.array(ids, np.uint32)
        pattern = BYTE_PATTERN if kind == "byte" else rf"[^{END}]+{END}"
        self.core = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = _BYTE_OTHER if kind == "byte" else _WORD_OTHER

    @property
    def lib(self):
        """The library's own tokenizer, loaded when a text needs it."""
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
            self._lib.no_padding()
            self._lib.no_truncation()
        return self._lib

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens added."""
        return [self._one(t) for t in texts]

    def _unusual(self, text: str) -> bool:
        if len(text) >= RUN and _RUNS.search(text):
            return True
        return bool((not text.isascii() or self.kind == "word") and self.other.search(text) or self.special.search(text))

    def _one(self, text: str) -> bytes:
        if self._unusual(text):
            return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "word":
            text = END.join([*WORD_PATTERN.findall(text.lower()), ""])  # up to U+017F all is in normal form C
        return self.ids[array("I", self.core.encode_ordinary(text))].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
