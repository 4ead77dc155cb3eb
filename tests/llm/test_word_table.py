"""The word table of the word-level BPE: what it keeps, and what it forgets."""

import public_tokenizers

from corpusterms.llm import word_bpe


def test_table_is_bounded_within_a_text(monkeypatch):
    table = word_bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(word_bpe, "KEPT", 50)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x é\x01{i}" for i in range(300)) + " " + "z" * 100 + " " + "z" * 100
    found = word_bpe.encode(table, text.encode())
    whole = table.library.encode(text, add_special_tokens=False).ids
    assert found.tolist() == whole
    assert len(table.known) <= 50  # before, all words of a text at once
    assert not any(len(w) > word_bpe.LONGEST for w in table.known)


def test_words_in_use_are_not_forgotten(monkeypatch):
    table = word_bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(word_bpe, "KEPT", 50)
    learnt, learn = [], table.known.learn
    table.known.learn = lambda word: learnt.append(word) or learn(word)
    text = " ".join(f"kata, {chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400))
    found = word_bpe.encode(table, text.encode())
    assert found.tolist() == table.library.encode(text, add_special_tokens=False).ids
    assert learnt.count(b"kata") == 1  # before, once for each time the table was full
    assert len(table.known) <= 50 and len(table.known.before) <= 50


def test_runs_are_their_words():
    table = word_bpe.Words(public_tokenizers.path("word_bpe_49k.json"))
    text = "It's 'tis' Can't, x2.5--y\x1cz\t\x0bÉté's a×b İs ét <|end oftext|> don't." + " It's" * 3
    for _ in range(2):  # learnt, then looked up
        assert word_bpe.encode(table, text.encode()).tolist() == table.library.encode(text, add_special_tokens=False).ids
