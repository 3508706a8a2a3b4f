import random

from pyspark.sql import functions as F

from marginalia.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_and_loss_mask(spark):
    rng = random.Random(4)
    bits = [*chat.CONTROL, chat.BETWEEN, "\\", "\\\\", "a", "é\n", "", " ", "[\\INST]", "</", "s>", "INST]"]
    rows = []
    for conv in range(80):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "<|x|>\\", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "?"))
    rows += [(None, None, None, None, None), (7, 3, "user", "tie", ""), (7, 3, "user", "tie", "")]
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(5))
    got = {r[0]: r for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [x[1:] for x in turns]
        assert got[c]["loss"] == "".join(x[2] for x in turns if x[1] == "assistant")
        heads = sum(a[1] != b[1] for a, b in zip([("", None)] + turns, turns))
        assert got[c]["formatted"].count(chat.BETWEEN) == len(turns) - heads


def test_long_conversation_and_empty_table(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 3 else "user", "w" * 50, "") for i in range(3000)], TURNS)
    (row,) = chat.format_chats(df).select(F.size(chat.read_turns(F.col("formatted"))), F.size("loss_spans")).collect()
    assert tuple(row) == (3000, 2000)
    assert chat.format_chats(df.limit(0)).count() == 0
