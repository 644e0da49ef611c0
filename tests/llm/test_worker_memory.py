"""What an operator remembers in a Python worker goes when another one's task starts."""

from cuesmith.llm import bpe, packing, shared


def test_others_are_forgotten_and_own_words_stay():
    words, pairs = packing.word_ids(), bpe.encoder()
    words.texts(["some words to remember"])
    shared.take_over("packing")
    assert packing.word_ids() is words and "remember" in packing.word_ids().young
    assert bpe.encoder() is not pairs
    shared.take_over("language")
    assert packing.word_ids() is not words and "remember" not in packing.word_ids().young
