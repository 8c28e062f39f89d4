"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered to one text: control strings mark where a turn begins or
ends, and control strings inside a text are escaped. The text is encoded once, with the character
offsets of its tokens; a binary search of the sorted spans of the learned turns in the token
starts and ends gives the token ranges under the loss mask. Control strings are tokens of their own, so no
token crosses the border of a turn.

Template: a user's text stands between ``[INST]`` and ``[/INST]``, an assistant's is followed by ``</s>``, any
other role stands between ``[ROLE]`` and ``[/ROLE]`` before its text and ``</s>``. Escaping puts one backslash behind the
first character of a control string, and one more where backslashes already stand there, so
taking one away restores every text.

A conversation is formatted in blocks of ``_TURNS`` turn numbers and parts of about ``_PART`` characters, cut between
turns: usual conversations are one row, and one that holds a third of all turns is spread over tasks and never
held as a whole. Its parts, in order of (block, part), are the text of the conversation.

Defined results: rows are ordered by turn, role and text (nulls first), so repeated rows and ties have a fixed order. A null
text or role is an empty one; a null conv_id is a conversation like others. A text without white space is encoded
in one go; others in stretches of about ``_STRETCH`` characters, which gives the same tokens. No rows give no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from archivesearch.llm.shared import col, shared_path, stored

_TURNS, _PART, _STRETCH = 512, 1 << 20, 1 << 18
FORMATTED = "conv_id long, block long, part int, n_turns int, text string, ids array<int>, loss array<boolean>"
_BORDER = re.compile(r"(?<=\S)(?=\s)")


@dataclass(frozen=True)
class Template:
    """``reserved``: further strings that no text may hold unescaped."""

    ask: str = "[INST]"
    asked: str = "[/INST]"
    role: str = "[ROLE]"
    named: str = "[/ROLE]"
    end: str = "</s>"
    reserved: tuple = ("<s>", "<|endoftext|>")
    learned: tuple = ("assistant",)

    @property
    def controls(self) -> tuple:
        return (self.ask, self.asked, self.role, self.named, self.end, *self.reserved)

    def _pattern(self, slashes: str) -> str:
        return "|".join(re.escape(c[0]) + slashes + re.escape(c[1:]) for c in self.controls)

    def escape(self, text: str) -> str:
        return re.sub(self._pattern(r"\\*"), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self._pattern(r"\\+"), lambda m: m[0][0] + m[0][2:], text)

    def render(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before, in and after the text of a turn."""
        text = self.escape(text)
        if role == "user":
            return self.ask, text, self.asked
        if role == "assistant":
            return "", text, self.end
        return f"{self.role}{self.escape(role)}{self.named}", text, self.end

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            role, close = "assistant", self.end
            if formatted.startswith(self.ask, at):
                role, close, at = "user", self.asked, at + len(self.ask)
            elif formatted.startswith(self.role, at):
                stop = formatted.index(self.named, at)
                role = self.unescape(formatted[at + len(self.role):stop])
                at = stop + len(self.named)
            stop = formatted.index(close, at)
            yield role, self.unescape(formatted[at:stop])
            at = stop + len(close)


@lru_cache(maxsize=2)
def _tokenizer(path: str, controls: tuple) -> Tokenizer:
    """The tokenizer of a file, with the control strings as tokens after its vocabulary. Its own special strings count as text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.add_tokens([AddedToken(c, normalized=False, special=False) for c in controls])
    return tokenizer


def encode(tokenizer: Tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a text, and where each token begins and ends. Long texts are cut before white space that
    follows something else, where a byte-level tokenizer starts a new piece anyway."""
    ids, spans, at = [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int64)], 0
    while at < len(text):
        cut = len(text)
        if cut - at > _STRETCH and (border := _BORDER.search(text, at + _STRETCH)):
            cut = border.start()
        found = tokenizer.encode(text[at:cut], add_special_tokens=False)
        ids.append(np.array(found.ids, np.int32))
        spans.append(np.array(found.offsets, np.int64).reshape(-1, 2) + at)
        at = cut
    whole = np.concatenate(spans)
    return np.concatenate(ids), whole[:, 0], whole[:, 1]


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each sorted span of the text the range of the tokens within it."""
    return np.column_stack([np.searchsorted(starts, spans[:, 0], "left"), np.searchsorted(ends, spans[:, 1], "right")])


class _Part:
    """The turns of one row of the result, rendered one after the other."""

    def __init__(self, conv_id, block, part: int):
        self.key, self.pieces, self.spans, self.chars, self.n_turns = (conv_id, block, part), [], [], 0, 0

    def add(self, template: Template, role: str, text: str) -> None:
        before, text, after = template.render(role, text)
        start = self.chars + len(before)
        if role in template.learned:
            self.spans.append((start, start + len(text)))
        self.pieces += (before, text, after)
        self.chars = start + len(text) + len(after)
        self.n_turns += 1

    def row(self, tokenizer: Tokenizer) -> tuple:
        text = "".join(self.pieces)
        ids, starts, ends = encode(tokenizer, text)
        change = np.zeros(len(ids) + 1, np.int32)
        for a, b in token_ranges(starts, ends, np.array(self.spans, np.int64).reshape(-1, 2)):
            change[a] += a < b
            change[b] -= a < b
        return (*self.key, self.n_turns, text, ids, np.cumsum(change[:-1]) > 0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                                      names=[f.split()[0] for f in FORMATTED.split(", ")])


def format_conversations(rows: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """The columns ``FORMATTED`` of conversations given by turn: conv_id, turn, role, text."""
    turns = rows.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
                        F.coalesce(col("role"), F.lit("")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / _TURNS))
    turns = turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer, template.controls)
        part, done, size = None, [], 0
        for batch in batches:
            for conv_id, block, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "role", "text"))):
                if part is None or part.key[:2] != (conv_id, block) or part.chars >= _PART:
                    if part:
                        done.append(part.row(encoder))
                        size += part.chars
                    follows = part is not None and part.key[:2] == (conv_id, block)
                    part = _Part(conv_id, block, part.key[2] + 1 if follows else 0)
                    if size >= _PART:
                        yield _batch(done)
                        done, size = [], 0
                part.add(template, role, text)
        if part:
            yield _batch([*done, part.row(encoder)])

    return turns.select("conv_id", "block", "role", "text").mapInArrow(formatted, FORMATTED)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class _Read:
    """What is read back of one conversation, part after part."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, tokenizer: Tokenizer, template: Template, text: str, ids: np.ndarray, loss: np.ndarray) -> None:
        for role, own in template.turns(text):
            self.turns.update(f"{role}\n{own}\n".encode())
            self.n_turns += 1
        edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        for a, b in edges.tolist():  # a run of tokens under the mask is the text of one turn
            own = template.unescape(tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False))
            self.loss.update(own.encode())
            self.loss_chars += len(own)
        self.chars += len(text)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read_back(formatted: DataFrame, tokenizer: str, template: Template) -> DataFrame:
    """One row per run of rows with the same conv_id; rows are taken as they stand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, own = _tokenizer(tokenizer, template.controls), None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [f.split()[0] for f in DIGEST.split(", ")]
        for batch in batches:
            done: list[tuple] = []
            conv_id, text, ids, loss = (batch.column(n) for n in ("conv_id", "text", "ids", "loss"))
            for k, key in enumerate(conv_id.to_pylist()):
                if own is None or own.conv_id != key:
                    done += [own.row()] if own else []
                    own = _Read(key)
                own.add(decoder, template, text[k].as_py(), ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done), kinds)], names=names)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*[own.row()]), kinds)], names=names)

    return formatted.select("conv_id", "text", "ids", "loss").mapInArrow(read, DIGEST)


def digest(rows: DataFrame, tokenizer: str, template: Template = Template()) -> DataFrame:
    """Format conversations and read them back: the checksums of their turns and of the text under the mask.

    A part is read back where it was formatted. Only conversations of several parts, if there are any, are formatted
    again and read part after part: their checksums run over the whole text in order, so that one task
    streams each of them."""
    spark = rows.sparkSession
    parts = stored(_read_back(format_conversations(rows, tokenizer, template), tokenizer, template), shared_path(spark, "chats"))
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("long_id"))
    if several.isEmpty():
        return parts
    long = rows.join(several, col("conv_id").cast("long").eqNullSafe(F.col("long_id")), "left_semi")
    ordered = (format_conversations(long, tokenizer, template).repartition("conv_id").sortWithinPartitions("conv_id", "block", "part"))
    short = parts.join(several, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti")
    return short.unionByName(_read_back(ordered, tokenizer, template))
