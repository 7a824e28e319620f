import random
import re

import pytest
import regex

tokenizers = pytest.importorskip("tokenizers")

from tideline.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/{bpe.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_the_library_on_random_text(public):
    e, rnd = bpe.encoder(), random.Random(5)
    pool = [chr(i) for i in [*range(0, 0x250), *range(0x300, 0x330), *range(0x400, 0x480), 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x2160, 0x2460, 0x661, 0x4E2D, 0x1F600, 0xAC00, 0x5D0]]
    for _ in range(1500):
        s = "".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice(" aeioutns'\n\t019.,-_") for _ in range(rnd.randint(1, 50)))
        assert e.ids(s) == public(s), repr(s)


@pytest.mark.parametrize("s", ["a" * 5000, "0" * 3000, " " * 2000, "{}" * 2000, "<|endoftext|>", "x<|endoftext|>y", "\r\n\r\n  a", "\x1c\x1d a", "it's we'LL 'll"])
def test_equals_the_library_on_odd_text(public, s):
    assert bpe.encoder().ids(s) == public(s)


def test_every_token_encodes_to_itself(public):
    e = bpe.encoder()
    for data, t in random.Random(1).sample(sorted(e.whole.items()), 3000):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if len(e.words(text)) == 1:
            assert public(text) == [t]


def test_characters_that_both_patterns_class_alike():
    for c in filter(lambda c: not bpe._UNLIKE.search(c), map(chr, range(0x3100))):
        assert bool(re.match(r"[^\W\d_]", c)) == bool(regex.match(r"\p{L}", c))
        assert bool(re.match(r"\d", c)) == bool(regex.match(r"\p{N}", c))
        assert bool(re.match(r"\s", c)) == bool(regex.match(r"\s", c))


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    e = bpe.Encoder(f"{bpe.FOLDER}/{bpe.VOCABULARY}.json")
    text = "one two three four five six seven eight nine ten"
    assert e.ids(text) == bpe.encoder().ids(text) and len(e) <= 5


def test_nulls_empty_texts_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "y"), (None, "c", None)], "doc_id long, text string, ids string")
    rows = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    ids = bpe.encoder().ids("a b")
    assert rows == sorted([(1, []), (2, []), (3, ids), (3, ids), (None, bpe.encoder().ids("c"))], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id").collect()}[3] == len(ids)
