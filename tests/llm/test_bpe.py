import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello  world\n\n don't we'll  42x ", "", None, "   ", "a" * 5000, "é ü ß ñ ça va   x", "漢字 かな 한국어 ՘ ࢏ 🙂",
    "<|endoftext|>mid<|endoftext|>", "\x00\x1f\x7f", "tab\tand\r\nline\x0b\x0c.", "Thre*** anor$$$ | x!!", "same", "same",
]


def expected(texts):
    library = Tokenizer.from_file(PATH)
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        yield ids, library.decode(ids, skip_special_tokens=False)


def test_like_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS)
    for row, (ids, text) in zip(got, expected(TEXTS), strict=True):
        assert row.ids == ids and row.decoded == text


def test_digests(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    for i, (ids, text) in enumerate(expected(TEXTS)):
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert bpe.digests(df, PATH).collect() == []


def alike(texts):
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    ids, counts = codec.encode(texts)
    pieces = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in pieces] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.decode(ids, counts) == [library.decode(p.tolist(), skip_special_tokens=False) for p in pieces]


def test_every_character_splits_as_in_the_library():
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    alike(["".join(f"a{c}1{c}!{c} " for c in settled[i : i + 64]) for i in range(0, len(settled), 64 * 7)])


def test_random_mixes():
    draw = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "'S", " ", "  ", "\n", "\t", "a", "é", "1", "!", "漢", "🙂", "\x1c", "\x85", "\xa0", "\u3000", "<|endoftext|>", "\u200b", "\u0301"]
    alike(["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(5000)])


def test_a_very_long_text_of_distinct_words():
    alike([" ".join(f"w{k * 7919 % 1000003}x" for k in range(150_000)), "", "end"])


def test_a_full_pool_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "POOL", 50)
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for k in range(20):
        text = f"some{k} words{k * k} that differ{k} and others"
        assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_forced_cuts_never_split_a_token():
    codec = bpe.Codec(PATH)
    for i, token in codec.bytes_of.items():
        if i not in codec.added.values():
            assert not any(codec.forced[a << 8 | b] for a, b in zip(token, token[1:], strict=False))
