from check import compare, connect
from support import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from wavetrail.llm import chat_format as cf
from wavetrail.llm.registry import ORACLES, QUERIES

TRICKY = st.lists(st.sampled_from([*cf.CONTROLS, "<", "[", "\\", "/", ">", " ", "\n", "a", "![x](a/b.png)", "![](c.mp3)", "![y](z.exe)", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "<|text|>", ""]), TRICKY), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    flat = [(role, *cf.flatten(text)) for role, text in turns]
    formatted, loss = cf.write_conversation([(role, segment) for role, segment, _ in flat])
    sources = [a["source"] for _, _, found in flat for a in found]
    assert cf.read_conversation(formatted, sources) == turns
    assert len(loss) == sum(role == "assistant" for role, _ in turns)


def test_query_equals_sql(spark):
    state, note = compare(spark, connect(SF), "op10_chat_format", SF, QUERIES, ORACLES)
    assert state == "ok", note


def test_typed_parts_nulls_and_ties(spark):
    rows = [
        (1, 0, "user", None, [("text", "see ", None, None, None, None, None), ("image", "", "i.png", 28, 15, None, None), ("audio", "", "a.wav", None, None, 1.5, None)], 9),
        (1, 1, "assistant", "fine ![s](s.pdf)", None, 9),
        (None, None, None, None, None, 9),
        (2, 0, "user", "b", None, 9), (2, 0, "user", "b", None, 9), (2, 0, "assistant", "a", None, 9),
    ]
    part = "array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}, formatted int")
    out = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    one = out[1]
    assert one.formatted == "<s>[INST] see <|image|><|audio|> [/INST] fine <|document|> </s>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i.png", 4), (0, "audio", "a.wav", 38), (1, "document", "s.pdf", 1024)]
    assert one.expanded_tokens == 1066
    assert out[None].formatted == "<s><|role|><|text|><|end|>"
    assert out[2].n_turns == 3 and out[2].formatted == "<s> a </s>[INST] b [/INST][INST] b [/INST]"
    back = {r.conv_id: r for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert back[1].loss_chars == len("fine ![s](s.pdf)")
    assert cf.format_conversations(df.limit(0)).count() == 0
