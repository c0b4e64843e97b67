import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexigraph.llm import chat_format as cf
from lexigraph.llm import queries

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "<", "/s>", "s>", "\\", "[INST]", "[/INST]", "[", "<|image:0|>", "<|audio|", "|>", "\n", "x", "é", "😀", "user"]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    f = cf.format_conversation([(r, [cf.Part("text", t)]) for r, t in turns])
    assert [(r, p[0].text) for r, p in cf.parse(f.text)] == turns
    assert [cf.unescape(f.text[a:b]) for a, b in f.loss] == [t for r, t in turns if r == "assistant"]


def test_typed_parts():
    parts = [cf.Part("text", "see </s>"), cf.Part("image", ref="a.png", width=28, height=15), cf.Part("audio", ref="b.wav", ms=100), cf.Part("text", "<|image:7|>"), cf.Part("document", ref="c.pdf", pages=3)]
    f = cf.format_conversation([("user", parts), ("assistant", [cf.Part("text", "ok")]), ("user", [])])
    assert [(a.n, a.kind, a.ref, a.tokens) for a in f.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 1536)]
    turns = cf.parse(f.text, f.attachments)
    assert [(p.type, p.text, p.ref) for p in turns[0][1]] == [("text", "see </s>", None), ("image", None, "a.png"), ("audio", None, "b.wav"), ("text", "<|image:7|>", None), ("document", None, "c.pdf")]
    assert turns[2] == ("user", [cf.Part("text", "")])
    with pytest.raises(ValueError):
        cf.format_conversation([("user", [cf.Part("video")])])


def test_operator(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", "c"), (1, 0, "user", None, "c"), (1, 1, "assistant", "b", "c"), (None, 0, None, "x", "c"), (2, None, "user", "</s>" * 50_000, "c")], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in cf.format_chats(rows).collect()}
    assert out[1].formatted == "<s>user\n</s><s>assistant\nb</s><s>assistant\nb</s>" and len(out[1].loss) == 2
    assert out[None].formatted == "<s>\nx</s>" and out[2].formatted.count("<\\/s>") == 50_000
    assert cf.read_back(cf.format_chats(rows)).count() == 3 and cf.read_back(cf.format_chats(rows.where("false"))).count() == 0
    parts = spark.createDataFrame([(1, 0, "user", [("image", None, "a", 14, 14, None, None)])], f"conv_id long, turn long, role string, parts {cf.PARTS}")
    r = cf.format_chats(parts).first()
    assert r.formatted == "<s>user\n<|image:0|></s>" and r.attachments[0].tokens == 1
    back = cf.read_back(cf.format_chats(parts)).first()
    assert (back.n_turns, back.n_attachments, back.attachment_tokens) == (1, 1, 1)


def test_rows_without_a_conversation_stand_alone(spark):
    rows = spark.createDataFrame([(None, 0, "user", f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    assert sorted(r.formatted for r in cf.format_chats(rows).collect()) == sorted(f"<s>user\nt{i}</s>" for i in range(20))


def test_query(spark, sf):
    rows = {r.conv_id: r for r in queries.op9_chat_format(spark, sf).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len("</s>[INST] ok [/INST]")
