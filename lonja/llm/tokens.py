"""Token ids of texts by a tokenizers file, each distinct part of a text encoded once per worker.

Byte-level and word-level files split a text before white space that follows another character, between a
line break and a word, and between a letter or number and punctuation, whatever stands around.  The ids of a
text are therefore those of its parts in a row.  Parts are remembered within bounds.  New words of Latin
letters go straight to the library's merge model, as the characters that stand for their bytes; other new parts go
through the whole library, many at a time, in one text with a separator whose id no part can have.  A text is
first cut at the literals of the file's added tokens, which get their own ids, as in the library.

Arrow cuts the texts of a batch at spaces and single line breaks and numbers the words, so that Python sees each
distinct word of a batch once; the ids of a text are then gathered by these numbers.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"(?<=\S)(?=[ \n\t\r])")
UNUSUAL = re.compile(r" (?<=\s )")  # a space after white space, looked for from the space, which is faster
BARE_BREAK = re.compile(r"\n(?:(?<=\s\n)|(?<=\A\n)|(?=\s))")  # a line break beside white space or at the start
CLOSING = ".,;:!?#$%&*"
LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
WORD = re.compile("\n?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: a file takes words to its merge model as they are, or lowered and without the space before them
WAYS = (lambda x: x, lambda x: x.lstrip(" ").lower())
SAMPLES = (" Word", "word", " élève", "Straße", " x", "ÑANDÚ", " Qu")
SEPARATOR = " \x01"
CACHED, CACHED_CHARS, JOINED = 600_000, 48, 400


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The characters that byte-level files use for bytes: printable Latin-1 for itself, others from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


def parts_of(chunk: str) -> list[str]:
    """Cut a chunk at its line breaks and before closing punctuation, where both sides are encoded alone anyway.

    Not after İ, whose lower case ends in a mark that files put to the punctuation.
    """
    lines = chunk.split("\n")
    if len(lines) > 1 and any(not x or x[-1].isspace() or (i and x[0].isspace()) for i, x in enumerate(lines)):
        return [chunk]
    out = []
    for i, line in enumerate(lines):
        if i:
            out.append("\n")
        body = line.rstrip(CLOSING)
        out += [body, line[len(body):]] if body != line and body and body[-1].isalnum() and body[-1] != "İ" else [line]
    return out


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {x: i.to_bytes(4, "little") for x, i in added.items()}
        self.literals = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.separator = self._ids([SEPARATOR])[0]
        self.characters = byte_characters()
        self.model = self.tokenizer.model
        samples = self._ids(list(SAMPLES))
        self.way = next((way for way in WAYS if [self._word(x, way) for x in SAMPLES] == samples), None)
        self.parts: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, way) -> bytes:
        shown = way(word)
        shown = shown.replace(" ", self.characters[0x20]) if shown.isascii() else shown.encode().decode("latin-1").translate(self.characters)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts: words one by one in the merge model, what stays apart from a separator in one text."""
        found = {x: self._word(x, self.way) for x in parts if LETTERS(x)} if self.way else {}
        plain = [x for x in parts if x not in found and (x[:1] == " " or x[:1].isalnum()) and not x[-1].isspace() and "\x01" not in x]
        mark = np.frombuffer(self.separator, np.uint32)
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            ids = np.frombuffer(self._ids([SEPARATOR.join(some) + SEPARATOR])[0], np.uint32)
            ends = np.flatnonzero(ids == mark[-1]) + 1
            if len(ends) == len(some):
                starts = [0, *ends[:-1].tolist()]
                found.update((x, ids[a : b - len(mark)].tobytes()) for x, a, b in zip(some, starts, ends.tolist(), strict=True))
        rest = [x for x in parts if x not in found]
        found.update(zip(rest, self._ids(rest), strict=True))
        return found

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [parts_of(x) for x in chunks]
        new = set().union(*cut).difference(self.parts) if cut else set()
        if len(self.parts) > CACHED:
            self.parts.clear()
            new = set().union(*cut)
        found = self._encode(sorted(new))
        self.parts.update((k, v) for k, v in found.items() if len(k) <= CACHED_CHARS)
        known = self.parts
        return [b"".join([known[y] if y in known else found[y] for y in x]) for x in cut]

    def _easy(self, words: list[str]) -> list[str]:
        """Remember words after a space or a line break that are Latin letters and closing punctuation; the others are given back."""
        table, hard, line_break = self.spaced, [], self._chunks(["\n"])[0]
        for word in words:
            body = word.rstrip(CLOSING)
            if len(word) > CACHED_CHARS or not WORD(body):
                hard.append(word)
                continue
            ids = table.get(body)
            if ids is None:
                ids = line_break + self._word(body[1:], self.way) if body[0] == "\n" else self._word(" " + body, self.way)
                table[body] = ids
            if len(body) < len(word):
                closing = word[len(body):]
                end = self.parts.get(closing)
                table[word] = ids + (self._chunks([closing])[0] if end is None else end)
        return hard

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with the space before it or with the line break that it begins with."""
        table = self.spaced
        if len(table) > CACHED:
            table.clear()
        new = [x for x in words if x not in table]
        hard = self._easy(new) if self.way else new
        line_break = self._chunks(["\n"])[0]
        values = self._chunks([x[1:] if x[:1] == "\n" else " " + x for x in hard])
        for word, value in zip(hard, values, strict=True):
            table[word] = line_break + value if word[:1] == "\n" else value
        out = [table[x] for x in words]
        for word in hard:  # long ones are mostly never seen again
            if len(word) > CACHED_CHARS:
                del table[word]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not any(y in x for x in texts for y in self.added):
            return self._plain(texts)
        cut = [self.literals.split(x) if any(y in x for y in self.added) else [x] for x in texts]
        between = iter(self._plain([y for x in cut for y in x[::2]]))
        return [b"".join([self.added[y] if i % 2 else next(between) for i, y in enumerate(x)]) for x in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        usual = [not UNUSUAL.search(x) and not BARE_BREAK.search(x) for x in texts]
        easy = iter(self._gather([x.replace("\n", " \n") for x, ok in zip(texts, usual, strict=True) if ok]))
        return [next(easy) if ok else b"".join(self._chunks(CHUNK.split(x))) for x, ok in zip(texts, usual, strict=True)]

    def _gather(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose line breaks have a space before them that does not count."""
        if not texts:
            return []
        firsts = self._chunks([x.partition(" ")[0] for x in texts])
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends, words_to = np.frombuffer(ends, np.int64, len(ids) + 1), lists.offsets.to_numpy()
        data, spans = memoryview(data or b""), zip(ends[words_to[:-1] + 1].tolist(), ends[words_to[1:]].tolist(), strict=True)
        return [first + data[a:b] for first, (a, b) in zip(firsts, spans, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker and file, so that what it remembers outlives a task."""
    return ChunkEncoder(path)
