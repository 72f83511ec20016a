"""Ids of texts cut at spaces and line breaks against the whole library."""

import random
from array import array

import pytest
from tokenizers import Tokenizer

from lonja.llm import tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PIECES = ["a", "The", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", "!?", "%%%", "$", "#", "&", "*", "'s", "12", "é", "ß", " x", "́",
          "ñandú", "日本", "\x0b", "\x85", "\xa0", "-", "İ", "İ!", "İ%", "straße.\nAb", "b;\nc", "\n.", "\n9"]


@pytest.mark.parametrize("file", FILES)
def test_texts_get_the_ids_of_the_library(file):
    draw = random.Random(7)
    texts = ["", "\n", " ", "a\n", "\na", "a \nb", "a\n b"] + ["".join(draw.choices(PIECES, k=draw.randrange(14))) for _ in range(2000)]
    library = Tokenizer.from_file(tokens.default_path(file))
    encode = tokens.ChunkEncoder(tokens.default_path(file))
    expected = [array("I", x.ids).tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encode.encode(texts) == expected and encode.encode(texts[::-1]) == expected[::-1]


@pytest.mark.parametrize("file", FILES)
def test_words_beside_line_breaks_are_remembered(file, monkeypatch):
    encode, looked, plain = tokens.ChunkEncoder(tokens.default_path(file)), [], tokens.parts_of
    text = " ".join(f"end{chr(97 + i % 26)}.\nStart{chr(97 + i // 26)}" for i in range(200))
    first = encode.encode([text])
    monkeypatch.setattr(tokens, "parts_of", lambda x: looked.append(x) or plain(x))
    assert encode.encode([text]) == first and len(looked) < 10
