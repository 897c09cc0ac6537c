import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from evidra.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string, pieces string, t string"
ODD = [r"\### Assistant: </turn> ok", "<turn user>", "</turn>\n", "<next>", "\\", "\\b\\l\\g", "<\\<>\\>", "", None, "\n", "é👩‍👩‍👧", "\\bl<"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(chats) and len(got) == formatted.count()
    for conv, turns in chats.items():
        turns.sort()
        r = got[conv]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        whole = texts[conv].formatted
        assert r.formatted_chars == len(whole)
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert whole.count("<turn ") == whole.count("</turn>\n") == blocks
        for span, t in zip(texts[conv].loss_spans, (t for t in turns if t[2] == "assistant")):
            said = whole[span.start:span.start + span.length]
            assert said.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\") == t[3]


def test_marks_inside_texts(spark):
    rows = [(i, j, ("user", "assistant")[j % 2], t) for i, t in enumerate(ODD) for j in range(3)]
    rows += [(100, j, r, t) for j, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a>b\\<c", None) for t in ODD)]
    check(spark, rows)


def test_ties_repeats_and_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), rng.choice((None, 0, 1, 2, 3)), rng.choice(("user", "assistant", "system", None)), rng.choice(ODD)) for _ in range(200)]
    rows += rows[:20] + [(None, 1, "user", "no conversation"), (None, 2, "assistant", "answer")]
    check(spark, rows)


def test_long_and_empty(spark):
    check(spark, [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 20) for i in range(2000)] + [(2, 0, "assistant", "x<" * 300_000)])
    df = spark.createDataFrame([], SCHEMA)
    assert chat.chat_digests(chat.format_chats(df)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    plan = chat.chat_digests(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
