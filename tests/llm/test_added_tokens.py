"""Texts that hold the literals of added tokens get the ids that the library gives by default."""

import random
import zlib
from array import array

import pytest

from lonja.llm import binary_records, packing
from lonja.llm.common import prepare
from lonja.llm.tokens import ChunkEncoder

public = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LITERALS = ["end <|endoftext|> x", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>  c", " <|<|endoftext|>|> ", "x\n<|endoftext|>\n\ny",
            "<|ENDOFTEXT|> <|endoftext|", "no literal here", "", "é <|endoftext|>'s. <|startoftext|>, it", "word " * 300 + "<|endoftext|>" + " word" * 300]


def noise(n):
    rnd = random.Random(9)
    return ["".join(rnd.choice(["a", "B", "é", " ", " ", "\n", ".", "'s", "1", "<|", "|>", "\x01", "<|endoftext|>", "<|startoftext|>"])
                    for _ in range(rnd.randint(0, 20))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path(name))
    return lambda text: plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_default_ones(name):
    ids, texts = library(name), LITERALS + noise(1500)
    want = [ids(x) for x in texts]
    assert [list(array("I", x)) for x in ChunkEncoder(public.path(name)).encode(texts)] == want
    alone = ChunkEncoder(public.path(name))
    assert [list(array("I", alone.encode([x])[0])) for x in texts[:100]] == want[:100]


def test_packing_and_records_have_them(spark):
    docs = prepare(spark).createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string").repartition(3)
    ids = library(FILES[0])
    want = {(i, zlib.crc32(array("I", ids(t) + [0]).tobytes()), len(ids(t)) + 1) for i, t in enumerate(LITERALS)}
    assert {(r.doc_id, r.ids_crc32, r.doc_tokens) for r in packing.pack(docs).collect()} == want
    ids = library(FILES[1])
    rows = binary_records.read_records(binary_records.write_records(docs)).collect()
    assert {r.doc_id: list(array("I", r.ids)) for r in rows} == {i: ids(t) + [1] for i, t in enumerate(LITERALS)}
