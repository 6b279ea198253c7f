"""Whole texts to token ids with the tokenizers library, each distinct chunk of text encoded once for each worker.

The byte-level pre-tokenizer never lets a token span a single space between two
characters that aren't white space, nor a run of newlines after such a character.
So a text is cut there, and each chunk (with the space or newlines before it) has the
same ids alone as in its place. Chunks are cut and told apart as Arrow columns, so only distinct ones become Python strings. Texts in which white space meets a space in
other ways, and texts that hold one of the tokenizer's added tokens (which the library reads as that token), are encoded whole. tests/llm hold all of them against the library.
"""

from __future__ import annotations

import os
import sys
from array import array
from itertools import islice, repeat

import numpy as np

from tessera.llm.common import LONGEST_KEPT, worker_state

#: Chunks that a worker remembers, in two generations of half as many each.
REMEMBERED = 800_000
#: Characters that are encoded together.
MOST_CHARS = 2_000_000
#: The letters of the byte-level alphabet: a printable byte stands for itself, the others for code points from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPACE = chr(_BYTE_LETTERS[32])
_UNKNOWN = object()


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class TextEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._limit = max(1, remembered // 2)
        self._new: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}
        self._marks: dict[str, bytes] = {}
        spec = self._tokenizer.pre_tokenizer.__getstate__() if self._tokenizer.pre_tokenizer else b""
        self._model, self._newline = self._tokenizer.model, self.whole("\n")
        self._cuts = b'"ByteLevel"' in spec and b'"add_prefix_space":false' in spec.replace(b" ", b"") and self._tokenizer.normalizer is None

    def whole(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _alone(chunk: str) -> bool:
        """Whether a chunk's ids are its own: those of one may hang on what stands before or behind it, where white space follows the space or the newlines."""
        body = chunk[1:] if chunk[0] == " " else chunk.lstrip("\n")
        return body != "" and not body[0].isspace()

    def _word(self, text: str) -> bytes:
        """The ids of a text that is one pre-token: letters, with a space before them or none. Those of ASCII stand for themselves."""
        spelt = text.replace(" ", _SPACE) if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _bytes([t.id for t in self._model.tokenize(spelt)])

    def _learn(self, unknown: list[str]) -> None:
        """Adds the ids of chunks. A word goes to the model at once; marks at its end are a token of their own, so it serves with any marks."""
        new, old, marks_of = self._new, self._old, self._marks
        rest = []
        # Nothing is remembered of a chunk or word but its ids, or None where it hangs on its neighbours.
        known, word, tokenize, little = old.get, self._word, self._model.tokenize, sys.byteorder == "little"
        for key in unknown:
            if (ids := known(key, _UNKNOWN)) is not _UNKNOWN:
                new[key] = ids
                continue
            spaced = key[0] == " "
            if spaced and (plain := key[1:]).isalpha():
                if key not in new:
                    new[key] = array("I", [t.id for t in tokenize(_SPACE + plain)]).tobytes() if little and key.isascii() else word(key)
                continue
            body = key.rstrip(",.;:!?")
            if spaced and body[1:].isalpha():
                ids = new.get(body) or known(body)
                if ids is None:
                    ids = word(body)
                    if len(body) <= LONGEST_KEPT:
                        new[body] = ids
            elif body[:1] == "\n" and body[1:].isalpha():
                ids = self._newline + word(body[1:])
            else:
                rest.append(key)
                continue
            if len(body) < len(key):
                marks = key[len(body) :]
                if marks not in marks_of:
                    marks_of[marks] = self.whole(marks)
                ids += marks_of[marks]
            new[key] = ids
        new.update((key, None) for key in rest if not self._alone(key))
        todo = (key for key in rest if self._alone(key))
        while batch := list(islice(todo, 4096)):
            for key, e in zip(batch, self._tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                new[key] = _bytes(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the same as the library's encode(text, add_special_tokens=False)."""
        if not self._cuts:
            return [_bytes(e.ids) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        import pyarrow as pa

        column = pa.array(texts, pa.large_string())
        starts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        chunks, first = _cut(data, starts)
        new = self._new
        coded = pa.LargeStringArray.from_buffers(len(chunks) - 1, pa.py_buffer(chunks), pa.py_buffer(data)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(new.get, distinct, repeat(_UNKNOWN)))
        places = [i for i, ids in enumerate(known) if ids is _UNKNOWN]
        unknown = [distinct[i] for i in places]
        self._learn(unknown)
        for i, key in zip(places, unknown, strict=True):
            known[i] = new[key]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        odd = {i for i, t in enumerate(texts) if any(a in t for a in self._added)}
        if ids.null_count:  # the text of each chunk that has no ids of its own
            odd.update((np.searchsorted(first, np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)), "right") - 1).tolist())
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first].tolist()
        found = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        out = [found[a:b] for a, b in zip(ends, ends[1:])]
        for i in odd:
            out[i] = self.whole(texts[i])
        for key in unknown:
            if len(key) > LONGEST_KEPT:
                del new[key]
        if len(new) > self._limit:
            self._new, self._old = {}, new
        del column, coded, ids, found
        pa.default_memory_pool().release_unused()  # else it keeps some 40 MB for the next group
        return out


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where chunks of UTF-8 texts begin, with the end; the number of each text's first chunk, with that of all). A chunk begins with
    a text, a space or a run of newlines; an empty text has none."""
    breaks = data == 10
    marked = data == 32
    marked[:1] |= breaks[:1]
    marked[1:] |= breaks[1:] & ~breaks[:-1]
    marked[starts[:-1][starts[:-1] < starts[1:]]] = True
    chunks = np.append(np.flatnonzero(marked), len(data))
    return chunks, np.searchsorted(chunks, starts)


def encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """One encoder for each worker process; a reused worker keeps what it has learnt."""
    return worker_state(("tokens", path, remembered), lambda: TextEncoder(path, remembered))


def in_groups(texts: list[str | None], most_chars: int = MOST_CHARS):
    """(first index, texts) of consecutive groups that hold about most_chars characters; null is the empty text."""
    at, size, group = 0, 0, []
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= most_chars:
            yield at, group
            at, size, group = i + 1, 0, []
    if group:
        yield at, group
