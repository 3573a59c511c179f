"""Round trips of hostile texts, the order machine, and odd rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from thresher.llm.chat_format import DEFAULT, Template, format_chats, read_loss, read_turns


def back(rows, template=DEFAULT):
    out = format_chats(rows, template)
    return {r.conv_id: r for r in out.select("*", read_turns(F.col("formatted"), template).alias("turns"), read_loss(F.col("segments")).alias("loss")).collect()}


def test_hostile_texts_come_back(spark):
    rng = random.Random(9)
    bits = [*DEFAULT.controls, "<|turn:", "<|end|>", "\\", "\\\\", "<", "|", ">", "/", "[", "]", "\n", "é", "😀", "a", "<|turn:user|>", "$1", "\\|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = [(k // 2, k % 2, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    got = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    for c in range(200):
        assert [(t.role, t.text) for t in got[c].turns] == [("user", texts[2 * c]), ("assistant", texts[2 * c + 1])]
        assert got[c].loss == texts[2 * c + 1] and got[c].in_order and got[c].formatted == "".join(s.text for s in got[c].segments)
        for control in DEFAULT.controls[2:]:
            assert control not in got[c].formatted


def test_order_machine(spark):
    orders = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["system", "assistant"], 6: ["user", "assistant", "tool"]}
    rows = [(c, k, r, "t") for c, rs in orders.items() for k, r in enumerate(rs)]
    got = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {c: (r.in_order, r.first_bad) for c, r in got.items()} == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 2)}


def test_another_template(spark):
    t = Template(open="<<", close=">>", end="<</>>", loss_roles=("bot",), follows={"": ("bot",), "bot": ("bot",)}, controls=("<<", ">>"))
    rows = spark.createDataFrame([(1, 0, "bot", "a<<b>>"), (1, 1, "bot", "<</>>")], "conv_id long, turn long, role string, text string")
    r = back(rows, t)[1]
    assert r.in_order and r.loss == "a<<b>><</>>" and [x.text for x in r.turns] == ["a<<b>>", "<</>>"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (None, 0, "user", "n", "x"), (2, 0, "user", "z" * 300_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    got = back(df)
    assert [(t.role, t.text) for t in got[1].turns] == [("", "first"), ("user", ""), ("user", "")] and got[1].n_turns == 3
    assert got[None].n_turns == 1 and len(got[2].turns[0].text) == 300_000
    assert format_chats(df.limit(0)).count() == 0
