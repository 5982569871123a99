"""The encoder of whole texts against the plain library call."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinlake.llm import tokens as t

ODD = ["", None, " ", "\n", "a\tb c\n d", "  x", "tab\tin word\nnext 's don't 'tis", "<|endoftext|> a<|endoftext|>b", "x" * 500 + " y", "Word. heres, Ab; c: d! e? f.. g.,", "İx ß ǅ. Ünd,", "日本 語\n中."]
KINDS = [("byte_bpe_50k.json", t.spaced), ("word_bpe_49k.json", t.words_only)]


@pytest.mark.parametrize("name, cut", KINDS)
def test_same_as_the_plain_call(name, cut, monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 50)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(" \n\tabC'1.,é<|> ") for _ in range(r.randint(1, 40))) for _ in range(500)]
    enc, plain = t.Encoder(public_tokenizers.path(name), cut), Tokenizer.from_file(public_tokenizers.path(name))
    want = [array("I", plain.encode(x or "", add_special_tokens=False).ids).tobytes() for x in texts]
    assert enc.encode(texts) == want
    assert [y for x in texts for y in enc.encode([x])] == want
    assert enc.encode([]) == []


@pytest.mark.parametrize("name, cut", KINDS)
def test_calls_are_bounded(name, cut):
    """However many new words a batch has, one call of the library holds a bounded number of results."""
    enc, most = t.Encoder(public_tokenizers.path(name), cut), []
    tok = enc.tok

    class Watched:
        def __getattr__(self, what):
            f = getattr(tok, what)
            return (lambda x, **more: most.append(len(x)) or f(x, **more)) if what.startswith("encode_batch") else f

    enc.tok = Watched()
    enc.encode([" ".join(f"{k}w{n}" for n in range(400)) for k in range(100)])
    assert most and max(most) <= 64
