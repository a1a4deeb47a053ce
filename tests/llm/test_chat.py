"""Chat formatting: exact round trips of made-up and random turns, and the digests against the source."""

from __future__ import annotations

import hashlib
import random

import pytest

from textloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"]


def words(r, n):
    return "".join(r.choice([*MARKS, "\\", "\\\\", " ", "\n", "<", "[", "/", "a", "ß", "😀", "s>", "INST]"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_random_turns_come_back(seed):
    r = random.Random(seed)
    turns = [(r.choice(["user", "assistant", "system", "tool", "", words(r, 3)]), words(r, r.randrange(12))) for _ in range(40)]
    pieces = [chat.settle(*t)[0] for t in turns]
    assert [t[:2] for t in chat.parse("".join(pieces))] == turns
    for (role, text), piece in zip(turns, pieces):
        assert chat.render(role if role in chat.TURN else chat.escape(role), chat.escape(text)) == piece


def test_clean_text_is_rendered_once_and_conflicts_twice():
    assert chat.settle("user", "plain \\ text [x]") == ("[INST] plain \\ text [x] [/INST]", 7, 23, 1)
    assert chat.settle("assistant", "a</s>b") == ("<s> a\\</s>b </s>", 4, 11, 2)
    assert chat.settle("assistant", "a\\</s>b")[0] == "<s> a\\\\</s>b </s>"


@pytest.mark.parametrize("text", ["[INST] a", "a [/INST]", "[INST] a [/INST] ", "x[INST] a [/INST]", "[INST] a <s> b </s> [/INST]", "[INST]a [/INST]", "[ROLE] user [TEXT] a [/ROLE]", "[INST] [/INST]"])
def test_what_the_grammar_does_not_derive(text):
    with pytest.raises(chat.Conflict):
        list(chat.parse(text))


def test_long_runs_are_linear():
    for text in ("\\" * 300_000, "\\" * 100_000 + "</s>", "<s>" * 50_000, "[" * 300_000):
        assert list(chat.parse(chat.settle("user", text)[0]))[0][1] == text


def expected(rows):
    out = {}
    for conv, turn, role, text, _ in rows:
        out.setdefault(conv, []).append((turn is None, turn, role or "", chat.settle(role or "", text or "")[0].encode(), text or ""))
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3]))
        said = "".join(t[4] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[4]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(t[3].decode()) for t in turns))
    return out


def test_digests_of_whole_tables(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool", None]), r.choice([None, "", words(r, 5), "same"]), "clash") for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "no id", None), (5, None, "assistant", "last", None), (6, 0, "user", "same", None), (6, 0, "user", "same", None)]
    rows += [(99, t, "assistant" if t % 2 else "user", words(r, 50), None) for t in range(400)] + [(100, 0, "assistant", "long " * 300_000 + "</s>", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    for part in (1_000_000, 200):
        formatted = chat.format_conversations(df, part)
        assert {x[0]: tuple(x)[1:] for x in chat.digest(formatted).collect()} == want
    assert formatted.where("conv_id = 99").count() > 50
    assert spark.createDataFrame([], SCHEMA).transform(chat.format_conversations).transform(chat.digest).collect() == []


def test_mask_covers_the_assistants_texts(spark):
    rows = [(1, 0, "user", "hi", None), (1, 1, "assistant", "a [INST] b", None), (1, 2, "assistant", "", None)]
    row = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [row.formatted[a:b] for a, b in zip(row.loss_starts, row.loss_ends)] == ["a \\[INST] b", ""]
