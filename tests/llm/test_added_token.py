"""The vocabulary's added token in texts, held against the tokenizer file as it is."""

from array import array

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import vocabulary

MARK = "<|endoftext|>"
TEXTS = ["end<|endoftext|>next", MARK, MARK * 3, f"a \n {MARK}  b", f"{MARK}x", "<|endoftext|", f"日本{MARK}語 <{MARK}>", f"it{MARK}'s", "<|ENDOFTEXT|>"]


def test_the_added_token_is_one_id():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(vocabulary())
    for text in TEXTS:
        assert array("I", encoder.ids(text)).tolist() == coder.encode(text, add_special_tokens=False).ids
    assert packing.ADDED_ID in array("I", encoder.ids(TEXTS[0]))
