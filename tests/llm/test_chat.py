import hashlib
import time

from pyspark.sql import functions as F

from rankfold.llm import chat

CONTROLS = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>", "\\", "\\\\<|", "<\\|", "<", "[", "<s></s>[INST][/INST]", "<|", "é\U0001f600\\n", "\\<\\/s>", ""]


def turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    return frame.withColumn("parts", chat.text_parts(F.col("text"))).repartition(3)


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1] or 0, v[2], v[3]))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        out[conv] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_every_control_string_comes_back(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], a + b) for c, a in enumerate(CONTROLS) for t, b in enumerate(CONTROLS)]
    out = chat.format_chat(turns(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == wanted(rows)
    for r in out.collect():  # no control string but the template's own
        inside = r.formatted.replace(chat.END, "").replace(chat.TURN, "").replace(chat.TEXT, "")
        assert not any(c in inside for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
        assert r.formatted.count(chat.TURN) == r.n_turns


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, None, "user", "x"), (None, 3, "assistant", None),
            (2, None, "assistant", "late"), (2, 0, "user", ""), (3, 0, "as<|text|>sistant", "long " * 30000)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_chat(turns(spark, rows))).collect()}
    assert got == wanted(rows)
    assert chat.format_chat(turns(spark, rows).limit(0)).count() == 0


def test_typed_parts(spark):
    text, ref = lambda x: ("text", x, None, None, None, None, None), "s3x"
    rows = [(1, 0, "user", [text("see "), ("image", None, "a.png", 57, 28, None, None), text(" and <|image:9|>"), ("audio", None, "b.wav", None, None, 2.5, None)]),
            (1, 1, "assistant", [text("done")]), (1, 2, "user", [("document", None, None, None, None, None, 3), ("image", None, ref, None, -5, None, None), ("other", "t", None, None, None, None, None)]),
            (2, 0, "user", None), (2, 1, "assistant", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.format_chat(frame).collect()}
    one = out[1]
    assert one.formatted == ("<|turn|>user<|text|>see <|image:0|> and <\\|image:9|><|audio:1|><|end|>\n<|turn|>assistant<|text|>done<|end|>\n"
                             "<|turn|>user<|text|><|document:2|><|image:3|>t<|end|>\n")
    assert [(a.k, a.turn_index, a.type, a.ref, a.placeholder, a.n_tokens) for a in one.attachments] == [
        (0, 0, "image", "a.png", "<|image:0|>", 3), (1, 0, "audio", "b.wav", "<|audio:1|>", 32), (2, 2, "document", None, "<|document:2|>", 768), (3, 2, "image", ref, "<|image:3|>", 1)]
    assert one.expanded_tokens == 804
    (m,) = one.loss_mask
    assert one.formatted[m.start:m.start + m.length] == "done"
    assert out[2].formatted == "<|turn|>user<|text|><|end|>\n<|turn|>assistant<|text|><|end|>\n" and out[2].attachments == []


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_chat(turns(spark, [(1, 0, "user", "x")]).coalesce(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_turns_of_one_conversation(spark):
    """Offsets and placeholder numbers are running sums: 20,000 turns take seconds."""
    n = 20_000
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text [INST] "), F.col("id").cast("string")).alias("text"))
    parts = F.when(F.col("turn") % 4 == 0, F.concat(chat.text_parts(F.col("text")), F.transform(
        chat.text_parts(F.col("text")), lambda p: p.withField("type", F.lit("image"))))).otherwise(chat.text_parts(F.col("text")))
    began = time.time()
    out = chat.format_chat(turns.withColumn("parts", parts)).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    r = out.select("n_turns", F.size("loss_mask").alias("masks"), F.col("attachments.k").alias("k"), F.col("attachments.turn_index").alias("at"),
                   F.col("formatted"), F.element_at("loss_mask", -1).alias("last")).first()
    assert time.time() - began < 60
    assert (r.n_turns, r.masks) == (n, n // 2)
    assert list(r.k) == list(range(n // 4)) and list(r["at"]) == list(range(0, n, 4))
    end = r.formatted[r.last.start:r.last.start + r.last.length]
    assert end == f"text [\\INST] {n - 1}" and f"{n - 4}<|image:{n // 4 - 1}|>" in r.formatted
