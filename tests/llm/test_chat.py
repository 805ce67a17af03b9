import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import chat

piece = st.lists(st.sampled_from(["</s>", "[INST]", " [/INST]", "<s>", "\\", "[", "]", "<", " ", "\n", "<<SYS>>", "[ROLE x]", "é", "ok", chat.MARKER[0]]), max_size=8).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\n", "\\"]), piece), max_size=6)


@settings(max_examples=500, deadline=None)
@given(turns)
def test_output_reads_back_and_spans_hold_the_texts(said):
    out, found = chat.spans(said, chat.bracket_template)
    assert chat.read_back(out) == said
    assert [b for _, b, _, _ in found] == [a for a, _, _, _ in found][1:] + ([len(out)] if said else [])
    assert [chat.unescape(out[c:d]) for _, _, c, d in found] == [t for _, t in said]


def test_templates_that_rewrite_history_are_detected():
    def forgetful(said):
        return "".join(f"{r}:{t if i + 1 == len(said) or r != 'assistant' else '...'};" for i, (r, t) in enumerate(said))

    assert chat.spans([("user", "a"), ("assistant", "b")], forgetful)[1] is not None
    out, found = chat.spans([("user", "a"), ("assistant", "b"), ("user", "c")], forgetful)
    assert found is None and out == "user:a;assistant:...;user:c;"


def test_rows(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, None, None, None, "x"), (2, 0, "assistant", "</s>[INST] ok [/INST]", "x"), (2, 0, "assistant", "</s>[INST] ok [/INST]", "x"), (None, 3, "assistant", "z" * 100_000, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ok = "</s>[INST] ok [/INST]"
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (3, sha("\n\n" + f"assistant\n{ok}\n" * 2), sha(ok * 2))
    assert got[None].loss_chars == 100_000
    assert chat.format_conversations(table.limit(0)).collect() == []
