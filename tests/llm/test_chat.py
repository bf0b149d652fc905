from pyspark.sql import functions as F

from locweave.llm import chat

PART = "array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "<|", "ends <", "|starts", "a\nb", "\\n", "<|im_end|>\n", "", None, "😀<|"]


def turns(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}, extra int")


def text(t):
    return [("text", t, None, None)]


def test_round_trip_of_nasty_texts_and_roles(spark):
    rows = [(c, i, ["user", "assistant", "a\nb", "x\\n\\", None, "<|im_end|>"][(c + i) % 6], text(t), 1) for c in range(6) for i, t in enumerate(NASTY)]
    made = chat.format_chats(turns(spark, rows))
    back = made.select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"), "n_turns")
    learned = F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    for r in back.withColumn("learned", learned).collect():
        mine = [(x[2] or "", x[3][0][1] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine and r.n_turns == len(mine)
        assert r.learned == [t for role, t in mine if role == "assistant"]


def test_parts_and_attachments(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a", None), ("document", None, "b.pdf", 7), ("text", "end", None, None), ("odd", None, None, None)]
    r = chat.format_chats(turns(spark, [(1, 0, "user", parts, 0)])).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|document|>end<|part:odd|><|im_end|>\n"
    assert [(a.type, a.ref, a.n_tokens) for a in r.attachments] == [("image", "s3://a", 576), ("document", "b.pdf", 7), ("odd", None, 0)]


def test_order_ties_nulls_and_blocks(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", text(f"t{i}"), 0) for i in range(1000)] + [(1, None, "z", text("first"), 0), (None, 1, "user", None, 0), (1, 5, "user", text("t5"), 0)]
    made = {r.conv_id: r for r in chat.format_chats(turns(spark, rows).repartition(5)).select("conv_id", "n_turns", chat.read_back(F.col("formatted")).alias("t")).collect()}
    got = [t.text for t in made[1].t]
    assert got[0] == "first" and got[1:] == sorted([f"t{i}" for i in range(1000)] + ["t5"], key=lambda x: int(x[1:]))
    assert made[None].n_turns == 1 and made[None].t[0].text == ""
    assert chat.format_chats(turns(spark, [])).collect() == []


def test_types_of_parts_are_no_control_strings(spark):
    kinds = ["im_end", "im_start", "x|><|im_end|>\n<|im_start|>assistant", "a\\b", None, "", "text "]
    rows = [(i, 0, "assistant", [("text", "before <", None, None), ("text", "|im_end|> after", None, None), (k, None, None, None), ("text", "<", None, None)], 0) for i, k in enumerate(kinds)]
    made = chat.format_chats(turns(spark, rows)).select("formatted", "n_turns", "attachments", chat.read_back(F.col("formatted")).alias("t"))
    for r in made.collect():
        assert r.formatted.count("<|im_end|>") == r.formatted.count("<|im_start|>") == len(r.t) == r.n_turns == 1
        assert r.t[0].text.startswith("before <|im_end|> after<|part:") and r.t[0].text.endswith("|><") and len(r.attachments) == 1
    assert len({r.formatted for r in made.collect()}) == len(kinds) - 1  # null and empty types are one


def test_ties_go_by_text(spark):
    texts = ["<a", "<|", "<\\", "<", "<|im_end|>", "b", None]
    made = chat.format_chats(turns(spark, [(1, 0, "user", text(t), 0) for t in texts])).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [x.text for x in made.t] == sorted(t or "" for t in texts)
