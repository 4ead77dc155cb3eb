import hashlib

from hypothesis import given
from hypothesis import strategies as st

from corpusterms.llm import chat_format as C

ROWS = [
    (1, 0, "system", "be [kind] \\ <s>"), (1, 1, "user", "hi"), (1, 2, "assistant", "[/INST] yes\n"), (1, 3, "user", None),
    (1, 4, "assistant", "</s>"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (4, 1, None, "x"), (4, 0, "to]ol[", " y "),
    (4, 2, "assistant", "é漢" * 2000), (4, 2, "assistant", "tie"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "n"),
]


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "turn AS example", "role AS loss")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df.repartition(3))).collect()}
    by = {}
    for c, t, r, x in ROWS:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    first = sorted((r for r in C.format_conversations(df).collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [r.turns for r in first] == [3, 5]
    assert first[1].text.startswith(first[0].text)
    assert C.unescape(first[0].text[first[0].loss_start : first[0].loss_end]) == "[/INST] yes\n"
    assert C.format_conversations(df.limit(0)).collect() == []


@given(st.lists(st.tuples(st.sampled_from(["user", "system", "assistant", "tool", "", "a]b"]), st.text(alphabet="\\<>[]/ISTNROLEY=s \n", max_size=30)), max_size=6))
def test_any_text_reads_back(turns):
    text = "".join("".join(C.turn_parts(r, t)) for r, t in turns)
    assert C.read_turns(text) == turns


def test_long_text_reads_back():
    text = "\\[<" * 300_000 + "a" * 1_000_000
    assert C.read_turns("".join(C.turn_parts("user", text))) == [("user", text)]
