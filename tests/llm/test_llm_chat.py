"""Chat formatting: layouts to turns, escaping, and what is read back, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat
from tablewright.session import settle

TURNS = "conv_id bigint, turn bigint, role string, text string"
BITS = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "n", "\n", "a", "é😀", "<\\|", "<\\n", "<\\\\n"]


def random_turns(seed, rows=600):
    draw = random.Random(seed)
    roles = ["user", "assistant", "a\nb<\\n<|", "<\\\\n", None, ""]
    return [(draw.choice([1, 2, 3, None, 77]), draw.choice([0, 1, 2, None]), draw.choice(roles),
             draw.choice([None, "".join(draw.choices(BITS, k=draw.randint(0, 30)))])) for _ in range(rows)]


def plain(turns):
    """The answer for canonical turns: sorted by turn, role and the hash of the text."""
    found = {}
    rows = turns.withColumn("_hash", F.xxhash64("text")).collect()
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["_hash"])):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    made = {}
    for conv, rows in found.items():
        learnt = "".join(t for role, t in rows if role == "assistant")
        made[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(learnt),
                      hashlib.sha256(learnt.encode()).hexdigest())
    return made


@pytest.mark.parametrize("piece", [50, chat.PIECE])
def test_read_back_is_what_was_given(spark, piece):
    turns = chat.canonical(spark.createDataFrame(random_turns(1), TURNS).repartition(5))
    pieces = chat.formatted(turns, piece=piece)
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(pieces).collect()} == plain(turns)
    if piece == 50:
        assert pieces.count() > 100


def test_a_conversation_of_most_rows_covers_many_tasks(spark):
    turns = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-5).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the table is too small for many tasks
    try:
        pieces = settle(chat.formatted(turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.filter("conv_id = -5").select("part").distinct().count() > 1
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(pieces).collect()} == plain(turns)


def test_spans_are_the_learnt_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "é<|x"), (1, 1, "assistant", "😀 one"), (1, 2, "assistant", ""),
                                   (1, 3, "user", "b"), (1, 4, "assistant", "<|im_end|>")], TURNS)
    [piece] = chat.formatted(turns).collect()
    assert piece["formatted"] == ("<|im_start|>user\né<\\|x<|im_end|>\n<|im_start|>assistant\n😀 one<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
                                  "<|im_start|>user\nb<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n")
    spans = [piece["formatted"][a:b] for a, b in zip(piece["loss_starts"], piece["loss_ends"])]
    assert spans == ["😀 one", "", "<\\|im_end|>"]
    learnt = chat.formatted(turns, template=chat.Template("<|a|>", "<|b|>", ("user",))).first()
    assert [learnt["formatted"][a:b] for a, b in zip(learnt["loss_starts"], learnt["loss_ends"])] == ["é<\\|x", "b"]
    with pytest.raises(ValueError):
        chat.Template("<s>", "</s>")


LAYOUTS = {
    "turn rows": ("conv_id bigint, turn bigint, role string, text string", [(1, 0, "user", "q"), (1, 1, "assistant", "a")]),
    "content rows": ("conv_id bigint, turn bigint, role string, content string", [(1, 0, "user", "q"), (1, 1, "assistant", "a")]),
    "messages": ("conv_id bigint, messages array<struct<role: string, content: string>>", [(1, [("user", "q"), ("assistant", "a")])]),
    "message parts": ("conv_id bigint, messages array<struct<role: string, content: array<struct<type: string, text: string>>>>",
                      [(1, [("user", [("text", "q"), ("image", None)]), ("assistant", [("text", "a")])])]),
    "from and value": ("conv_id bigint, conversations array<struct<from: string, value: string>>", [(1, [("human", "q"), ("gpt", "a")])]),
    "instruction": ("conv_id bigint, instruction string, input string, output string", [(1, "q", "", "a")]),
    "prompt and completion": ("conv_id bigint, prompt string, completion string", [(1, "q", "a")]),
    "prompt and response": ("conv_id bigint, prompt string, response string", [(1, "q", "a")]),
    "question and answer": ("conv_id bigint, question string, answer string", [(1, "q", "a")]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    kind, rows = LAYOUTS[name]
    df = spark.createDataFrame(rows, kind)
    assert chat.chosen(df, chat.LAYOUTS)[0][0].name == name
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert sorted(map(tuple, chat.canonical(df).collect())) == want
    extra = df.selectExpr("*", "'own' AS formatted", "'own' AS part", "'own' AS _learnt", "'own' AS system_note", "1 AS n_turns")
    assert sorted(map(tuple, chat.canonical(extra).collect())) == want


def test_tables_of_several_layouts(spark):
    tables = [spark.createDataFrame([(10 + n, *r[1:]) for r in rows], kind) for n, (name, (kind, rows)) in enumerate(LAYOUTS.items())
              if name not in ("message parts", "content rows")]
    tables.append(spark.createDataFrame([(99, "no completion")], "conv_id bigint, prompt string"))
    tables.append(spark.createDataFrame([(98, "q", "a", "s")], "conv_id bigint, prompt string, completion string, system string"))
    mixed = tables[0]
    for t in tables[1:]:
        mixed = mixed.unionByName(t, allowMissingColumns=True)
    rows = chat.canonical(mixed).collect()
    found = {c: [(r["role"], r["text"]) for r in sorted(rows, key=lambda r: r["turn"]) if r["conv_id"] == c] for c in {r["conv_id"] for r in rows}}
    assert found.pop(98) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert len(found) == 7 and all(turns == [("user", "q"), ("assistant", "a")] for turns in found.values())
    assert [r["conv_id"] for r in chat.unmapped(mixed).collect()] == [99]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id bigint, other string"))


def test_null_parts_foreign_paths_and_no_rows(spark):
    given = spark.createDataFrame([(1, "i", None, "o", "s"), (2, "i", "more", None, None)],
                                  "conv_id bigint, instruction string, input string, output string, system string")
    rows = sorted(map(tuple, chat.canonical(given).collect()))
    assert rows == [(1, 0, "system", "s"), (1, 1, "user", "i"), (1, 2, "assistant", "o"), (2, 0, "user", "i\n\nmore"), (2, 1, "assistant", "")]
    beside = spark.createDataFrame([(1, 0, None, None, "x"), (1, 1, "user", "t", None)], f"{TURNS}, output string")
    assert sorted(map(tuple, chat.canonical(beside).collect())) == [(1, 0, "", ""), (1, 1, "user", "t")]
    messages = spark.createDataFrame([(1, None), (2, []), (3, [None, (None, None)])], LAYOUTS["messages"][0])
    assert list(map(tuple, chat.canonical(messages).collect())) == [(3, 0, "", "")]
    empty = chat.formatted(chat.canonical(spark.createDataFrame([], TURNS)))
    assert chat.digests(empty).count() == 0


def test_damage_is_seen():
    reader = chat.Reader(chat.Template())
    with pytest.raises(ValueError):
        reader.read("<|im_start|>user\na<|im_end|>\nstray", [], [])
    with pytest.raises(ValueError):
        reader.read("stray<|im_start|>user\na<|im_end|>\n", [], [])
