"""Token ids of odd words against the library, and blocks with many checkpoints."""

import random

import numpy as np
import public_tokenizers

from doseweave.llm import entropy_coding, token_files


def test_ids_of_odd_words_are_the_library_s(monkeypatch):
    tokens = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_files, "MEMO_WORDS", 40)
    draw = random.Random(3)
    pool = ["House", "HOUSE,", "house!?", "l'été", "ÉTÉ...", "Straße", "İstanbul", "don't", "it's,", "a1b2", "x_y", "...", "ét", "ﬁne", "日本語", "😀a", "\x85b", "a b", "%$#", "A-b", "ÿ", "÷", "<|endoftext|>", "<|x|>", "\x00", "ǅ"]
    texts = [" ".join(draw.choice(pool) + draw.choice(["", "", ",", "'s", "9"]) for _ in range(30)) for _ in range(40)] + ["", " \n\t"]
    for _ in range(2):
        for text, ids in zip(texts, tokens([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids, text
    before = len(tokens.letters)
    tokens([b"Qvz qvz, QVZ! qVz..."])
    assert len(tokens.letters) <= before + 1


def test_blocks_of_many_checkpoints_come_back():
    draw = np.random.default_rng(1)
    ids = np.minimum(draw.zipf(1.2, 3 * entropy_coding.EVERY * entropy_coding.LANES + 77), 49407).astype("<u4")
    table = entropy_coding.FrequencyTable(*np.unique(ids, return_counts=True))
    for n in (0, 1, 1024, 1025, 131072, 131073, len(ids)):
        assert (entropy_coding.decode(entropy_coding.encode(ids[:n], table), table) == ids[:n]).all()
    one = np.full(5000, 9, "<u4")
    table = entropy_coding.FrequencyTable(np.array([9]), np.array([5000]))
    assert (entropy_coding.decode(entropy_coding.encode(one, table), table) == one).all()
