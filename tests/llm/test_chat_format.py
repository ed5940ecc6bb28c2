import hashlib
import random

from tablewright.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, state string"


def talk(seed=4):
    dice = random.Random(seed)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "]", "a b", "\n", "é", "<sys>", "[ROLE ", "[/ROLE]", "[ROLE x] y [/ROLE]", " "]
    rows = [(1, 1, "user", None, "x", "y"), (1, 2, "assistant", "", "x", "y"), (2, 5, None, "no role", None, None),
            (None, 1, "user", "no id", None, None), (3, 1, "tool [x]\\o", "t", "", ""), (3, 1, "tool [x]\\o", "t", "", ""),
            (4, 1, "assistant", "y" * 50000 + "</s>", "", "")]
    for conv in range(100, 220):
        for n in range(dice.randint(1, 6)):
            text = "".join(dice.choices(bits, k=dice.randint(0, 12)))
            rows.append((conv, n, dice.choice(["system", "user", "assistant", "tool", "a]b"]), text, "", ""))
    return rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(rows):
    out = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip(spark):
    rows = talk()
    wanted = turns_of(rows)
    made = chat.formatted(chat.segments(spark.createDataFrame(rows, SCHEMA)))
    back = {r.conversation: [(t.role, t.text) for t in r.turns] for r in chat.read_back(made).collect()}
    assert back == wanted
    for r in chat.digests(made).collect():
        turns = wanted[r.conversation]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and r.n_turns == len(turns)
        assert (r.loss_sha256, r.loss_chars) == (sha(loss), len(loss))


def test_control_strings_cannot_end_a_turn(spark):
    nasty = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", nasty, "", ""), (-7, 1, "assistant", nasty, "", "")]
    made = chat.formatted(chat.segments(spark.createDataFrame(rows, SCHEMA))).first()
    assert made.formatted.count("</s>") == 1 and made.formatted.count("[INST]") == 1 and made.formatted.count("[/INST]") == 1


def test_order_of_turns(spark):
    cases = {
        1: (["user", "assistant"], True), 2: (["system", "user", "assistant", "user", "assistant"], True),
        3: (["user", "user", "assistant"], False), 4: (["assistant"], False), 5: (["user"], False),
        6: (["user", "assistant", "system", "user", "assistant"], False), 7: (["tool"], False),
    }
    rows = [(conv, n, role, "t", "", "") for conv, (roles, _) in cases.items() for n, role in enumerate(roles)]
    made = chat.formatted(chat.segments(spark.createDataFrame(rows, SCHEMA)))
    assert {r.conversation: r.in_order for r in made.collect()} == {conv: ok for conv, (_, ok) in cases.items()}


def test_segments_and_empty(spark):
    rows = spark.createDataFrame([(1, 1, "user", "q", "", ""), (1, 2, "assistant", "a", "", "")], SCHEMA)
    got = chat.segments(rows).orderBy("place", "part").select("segment", "loss").collect()
    assert [tuple(r) for r in got] == [("[INST] ", False), ("q", False), (" [/INST]", False), ("<s> ", False), ("a", True), (" </s>", False)]
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.formatted(chat.segments(empty))).collect() == []
