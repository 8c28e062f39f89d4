"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

A byte-level BPE never merges across the pieces of its split pattern, so the ids of a text are
those of its pieces. White space after anything else always begins a piece, so a text may be cut
there into chunks, by plain string functions: mostly a blank and a word. Chunks repeat a lot; the
ids of each distinct one are found once, from its pieces, and looked up after that. Chunks and pieces
are kept in two generations: when the younger is full it becomes the older, and what is asked for
again moves back, so frequent ones survive. With a tokenizer of another make, or where a text holds one of the
tokenizer's special strings, whole texts are encoded directly.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: The split pattern of the byte-level pre-tokenizer, and the same for ASCII text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"""
                 r"""|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
_BATCH_CHARS = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others are counted up from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Joins(Exception):
    """A chunk does not end where the next one begins."""


class Generations(dict):
    """What ``learn`` gives for a key, looked up once; at most ``size`` keys in each of two generations."""

    def __init__(self, learn, size: int):
        super().__init__()
        self.learn, self.size, self.old = learn, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.learn(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class IdEncoder:
    """``path``: a tokenizer file that every executor has at the same place."""

    def __init__(self, path: str, chunks: int = 500_000, pieces: int = 60_000):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = (spec.get("normalizer") is None and model.get("type") == "BPE"
                         and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                         and pre.get("use_regex", True) and not model.get("dropout"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self.id_bytes = [n.to_bytes(4, "little") for n in range(self.size)]
        self.tokenize = self.tokenizer.model.tokenize
        self.split, self.ascii_split = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.pieces = Generations(self._learn_piece, pieces)
        self.chunks = Generations(self._learn_chunk, chunks)

    def _learn_piece(self, piece: str) -> bytes:
        own = self.id_bytes
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():  # letters stand for themselves
            spelled = self.letters[32] + piece[1:]
        else:
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([own[t.id] for t in self.tokenize(spelled)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text from its pieces."""
        pieces = self.ascii_split(text) if text.isascii() else self.split(text)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _learn_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that follows something. One that begins with a blank or line break stands for itself, others for a
        blank and themselves. A word, maybe with a line break before and ASCII punctuation behind it, needs no pattern."""
        if not chunk or chunk[-1].isspace():
            raise _Joins
        lead, body = ("\n", chunk[1:]) if chunk[0] == "\n" else (" ", chunk)
        core = body.rstrip(string.punctuation)
        if not core.isalpha():
            return self._plain(chunk if chunk[0] in "\n " else f" {chunk}")
        tail = self.pieces[body[len(core):]] if len(core) < len(body) else b""
        if lead == "\n":
            return self.pieces[lead] + self.pieces[core] + tail
        return self.chunks[core] + tail if tail else self._learn_piece(f" {core}")

    @staticmethod
    def _joined(chunks: list[str]) -> list[str]:
        """The chunks after the first, those that join made one: where a chunk is empty or ends in white space, the next
        blank or line break is no border."""
        out: list[str] = []
        held = ""
        for chunk in chunks:
            full = chunk if chunk.startswith("\n") else f" {chunk}"
            if not chunk or chunk[-1].isspace():
                held += full
                continue
            full, held = held + full, ""
            out.append(full[1:] if full[0] == " " and full[1] not in "\n " else full)
        return out

    def _ids(self, text: str) -> bytes:
        """The text cut before blanks and line breaks that follow something else, and looked up chunk by chunk."""
        end = len(text.rstrip())
        first, *chunks = text[:end].replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():  # white space that begins the text
            return self._plain(text) if len(text) < 100 else self._after_space(text, end)
        get = self.chunks.__getitem__
        try:
            ids = b"".join(map(get, chunks))
        except _Joins:
            ids = b"".join(map(get, self._joined(chunks)))
        return self._plain(first) + ids + (self._plain(text[end:]) if end < len(text) else b"")

    def _after_space(self, text: str, end: int) -> bytes:
        """A text that begins with white space: up to its first word, then the rest."""
        start = end - len(text[:end].lstrip())
        cut = min((k for k in (text.find(" ", start), text.find("\n", start)) if k >= 0), default=len(text))
        if cut >= end:
            return self._plain(text)
        ids = b"".join(map(self.chunks.__getitem__, self._joined(text[cut:end].replace("\n", " \n").split(" ")[1:])))
        return self._plain(text[:cut]) + ids + (self._plain(text[end:]) if end < len(text) else b"")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if not self.by_piece:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if any(s in t for s in self.special)
                else np.frombuffer(self._ids(t), "<u4") for t in texts]

    def stream(self, rows: Iterator[tuple], chars: int = _BATCH_CHARS) -> Iterator[tuple[object, np.ndarray]]:
        """(key, ids) of the rows (key, text), some texts at a time; a null text is empty."""
        keys, texts, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chars:
                yield from zip(keys, self.encode_all(texts))
                keys, texts, size = [], [], 0
        yield from zip(keys, self.encode_all(texts))


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)
