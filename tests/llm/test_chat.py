"""Prefix targets: expansion, escaping and reading back."""

import hashlib

from eventlake.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "<", "</s", "a</s></s>b\n<s>user\n", "", None, "[[INST]", "<<s>", "\\", "line\nline"]


def test_round_trip(spark):
    rows = [(c, t, ["system", "user", "assistant", "to\\ol\n</s>", None][(c + t) % 5], NASTY[(3 * c + t) % len(NASTY)]) for c in range(8) for t in range(c)]
    rows += [(None, 0, "assistant", "no id"), (100, 0, "user", "only a question")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as target")
    examples = chat.expand(turns)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    digest = {r.conv_id: r for r in chat.digests(examples).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for c, told in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == told
        losses = [t for r, t in told if r == "assistant"]
        assert back[c].losses == losses
        assert digest[c].loss_sha256 == hashlib.sha256("".join(losses).encode()).hexdigest()
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
        assert digest[c].formatted_chars == len(back[c].formatted)


def test_examples_in_full(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3")]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {r.example: r for r in chat.with_context(examples).collect()}
    assert len(full) == 2
    assert full[0].context == "<s>user\nq1</s><s>assistant\n" and full[0].target == "a1"
    assert full[1].context == "<s>user\nq1</s><s>assistant\na1</s><s>user\nq2</s><s>assistant\n" and full[1].target == "a2"
    whole = chat.read_back(examples).first().formatted
    for r in full.values():
        assert whole[r.loss_start : r.loss_end] == r.target and whole.startswith(r.context)
    tail = examples.where("not trainable").collect()
    assert [(r.example, r.added, r.target) for r in tail] == [(2, "<s>user\nq3</s>", "")]


def test_ties_and_empty(spark):
    same = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame(same, "conv_id long, turn long, role string, text string")
    assert [t.text for t in chat.read_back(chat.expand(df)).first().turns] == ["a", "a", "b"]
    assert chat.expand(df.limit(0)).collect() == []


def test_read_back_from_examples_in_full(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1</s>"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "last")]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = chat.with_context(examples, tails=True)
    assert {(r.conv_id, r.example, r.trainable) for r in full.collect()} == {(1, 0, True), (1, 1, True), (1, 2, False), (2, 0, False), (3, 0, True)}
    back = {r.conv_id: r for r in chat.read_full(full).collect()}
    assert [t.text for t in back[1].turns] == ["q1", "a1</s>", "q2", "a2", "q3"] and back[1].losses == ["a1</s>", "a2"] and back[3].losses == ["last"] and back[2].losses == []
    # what is read is what the examples hold: their own text under their own mask, and the turns of the longest
    changed = full.selectExpr("conv_id", "example", "replace(context, 'q1', 'Q1') as context", "replace(target, 'a', 'b') as target", "closing", "loss_start", "loss_end", "trainable")
    other = {r.conv_id: r for r in chat.read_full(changed).collect()}
    assert [t.text for t in other[1].turns] == ["Q1", "a1</s>", "q2", "a2", "q3"] and other[1].losses == ["b1</s>", "b2"]
