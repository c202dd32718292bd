import hashlib

from pyspark.sql import functions as F

from galleria.llm import chat

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, extra int, formatted string"


def test_parts_become_placeholders(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "s3://a.png", 1024.0 * 512), ("audio", None, "b.wav", 2.4), ("document", None, "c.pdf", None), ("video", "?", "d", 1.0), (None, "end", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts, 1, "x"), (1, 1, "assistant", [("text", "ok", None, None)], 1, "x")], PARTS)
    row = chat.read_back(chat.format_turns(turns)).first()
    assert [t.text for t in row.turns] == ["see <this><image><audio><document>end", "ok"]
    assert [tuple(a) for a in row.attachments] == [("image", "s3://a.png", 512), ("audio", "b.wav", 75), ("document", "c.pdf", 600)]
    assert row.loss_text == "ok"
    start, length = row.loss[0]
    assert row.formatted[start - 1 : start - 1 + length] == "ok"


def test_round_trip_of_control_strings_and_nulls(spark):
    texts = ["</turn>\n", "<turn user>\n", "\\l\\g\\b\\\\", None, "", "\n\n", ">", "a\\", "😀é"]
    rows = [(7, 0, "user", t) for t in ("<", "A", "B", "\\", ">", "a")]  # of one turn and role: ordered by the text itself
    rows += [(i % 2, i, r, t) for i, t in enumerate(texts) for r in ("assistant", "us>er\n<", None)] + [(None, None, None, None)] + [(5, 1, "assistant", "same")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_turns(turns))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(mine), len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_nothing(spark):
    assert chat.format_turns(spark.createDataFrame([], PARTS)).count() == 0
