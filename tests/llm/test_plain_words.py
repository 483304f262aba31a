import json

import public_tokenizers
import tokenizers

from hearthline.llm import packing
from hearthline.llm.queries import TOKENIZER


def test_plain_words_get_the_same_ids_without_the_steps_that_do_nothing_to_them():
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    words = [b"a", b"the", b"startoftext", b"z" * 300, b"don", b"zxqjkv", b"tokenisation"]
    runs = [*words, b"The", b"DON'T", b"x1y", b"end.", "Ünï".encode(), "naïve,".encode(), b"12", b"...", b"<|endoftext|>"]
    tables = ({}, {})
    packing.learn_runs(tokenizer, tables, runs)
    wanted = [tokenizer.encode(r.decode(), add_special_tokens=False).ids for r in runs]
    assert [list(memoryview(tables[0][r]).cast("I")) for r in runs] == wanted
    assert packing.plain_words(tokenizer) is not None


def test_an_unknown_tokenizer_is_used_as_it_is():
    made = json.loads(open(public_tokenizers.path(TOKENIZER)).read())
    made["normalizer"] = {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}
    other = tokenizers.Tokenizer.from_str(json.dumps(made))
    assert packing.plain_words(other) is None
    tables = ({}, {})
    packing.learn_runs(other, tables, [b"banana"])
    assert list(memoryview(tables[0][b"banana"]).cast("I")) == other.encode("banana", add_special_tokens=False).ids
