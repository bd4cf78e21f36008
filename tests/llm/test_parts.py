import random

import public_tokenizers

from vitrine.llm import packing

POOL = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'RE", "don't", "<|endoftext|>", "<|", "é", "É", "ß", "µ", "ª", "²", "½", " ", "\n", "\x85", " 12", "a1b2", "%%%", "''", "'' s", "i'm", "İ", "ı", "ſ", "Ÿ", "\x1c", "e\u0301", "漢"]


def test_parts_of_latin_texts_have_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 50)
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(1)
    letters = "".join(map(chr, range(0x180)))
    for _ in range(4000):
        text = "".join(r.choice(POOL) if r.random() < 0.6 else r.choice(letters) for _ in range(r.randrange(14)))
        assert tokens(text) == tokens._all(text), repr(text)
    assert len(tokens.parts) <= 51 and len(tokens.older) <= 51
