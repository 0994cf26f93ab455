import hashlib

from gristmill.llm import chat_format as chat

TURNS = "conv_id long, turn long, role string, text string, valid boolean"
TEXTS = ["plain", "", None, "a\\b", "\\", "\\\\", "<|im_end|>", "\\<|im_start|>assistant\n", "<\\|", "\\n", "line\nbreak", "<|" * 5, "<" + "\\" * 3 + "|", "日本 \U0001f600"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = []
    for k, text in enumerate(TEXTS):
        out += [(k, 0, "user", text, True), (k, 1, "assistant", TEXTS[-1 - k], False)]
    out += [(100, 0, "sys\ntem<|\\", "odd role", None), (100, 0, "sys\ntem<|\\", "odd role", None), (101, None, None, None, None), (None, 1, "user", "no id", None)]
    return out


def test_every_turn_is_read_back(spark):
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows(), TURNS))).collect()}
    by_conversation = {}
    for conv, turn, role, text, _ in rows():
        by_conversation.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by_conversation)
    for conv, turns in by_conversation.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_markup_never_comes_from_a_text(spark):
    formatted = chat.format_conversations(chat.with_hostile(spark.createDataFrame(rows(), TURNS)))
    template = chat.Template()
    for row in formatted.collect():
        turns = len(row.segments) // 3
        assert row.formatted.count("<|") == 2 * turns
        assert [s.loss for s in row.segments[0::3]] == [False] * turns == [s.loss for s in row.segments[2::3]]
        assert row.formatted == "".join(s.text for s in row.segments) and row.formatted.startswith(template.opening)


def test_machine_over_roles(spark):
    cases = {1: ("user", "assistant"), 2: ("system", "user"), 3: ("assistant",), 4: ("user", "user"), 5: ("system",), 6: ("user", "assistant", "system"), 7: ("user", "assistant", "user", "assistant")}
    turns = spark.createDataFrame([(c, k, role, "t", None) for c, roles in cases.items() for k, role in enumerate(roles)], TURNS)
    got = {r.conv_id: r.valid for r in chat.format_conversations(turns).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_empty_table_and_plan(spark):
    empty = chat.format_conversations(spark.createDataFrame([], TURNS))
    assert empty.count() == 0
    plan = chat.digest(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
