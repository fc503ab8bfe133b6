import hashlib

from corpuscle.llm import op1_chat as chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [r"\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>", r"\b\t\x\n\e <|next|>", "", "ä🙂\n\n", None, "\\", "<|<|turn|>|>"]


def rows():
    out = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(HARD)]
    out += [(2, 5, "user", "later"), (2, None, None, "first"), (2, 5, "user", "later"), (3, 0, "<|end|>", "odd role"), (None, 0, "assistant", "no id")]
    return out


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], SCHEMA + ", n_turns int")
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chat.parse_chats(formatted)).collect()}
    masks = {r.conv_id: r for r in formatted.collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows() if c == conv))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        s, at, under = masks[conv].formatted, 0, []
        assert g.formatted_chars == len(s) == sum(n for n, _ in masks[conv].loss_runs)
        for n, take in masks[conv].loss_runs:
            under += [s[at : at + n]] * take
            at += n
        for control, code in chat.CODES:
            under = [u.replace(code, control) for u in under]
        assert "".join(u.replace("\\b", "\\") for u in under) == loss


def test_neighbours_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)
    assert chat.format_chats(df).first().formatted == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"


def test_empty(spark):
    assert chat.digests(chat.parse_chats(chat.format_chats(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_loss_is_read_under_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "one 🙂 <|end|>"), (1, 2, "assistant", "two")], SCHEMA)
    formatted = chat.format_chats(df)
    right = chat.loss_texts(formatted).first().loss
    assert right == ["one 🙂 <|end|>", "two"]
    turned = formatted.withColumn("loss_runs", chat.F.transform("loss_runs", lambda r: chat.F.struct(r["n_chars"].alias("n_chars"), (~r["loss"]).alias("loss"))))
    assert "ask" in "".join(chat.loss_texts(turned).first().loss) and chat.digests(chat.parse_chats(turned)).first().loss_chars != 16


def test_long_conversations_and_texts(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} \\") for i in range(5000)] + [(2, 0, "assistant", "long é " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.parse_chats(chat.format_chats(df))).collect()}
    loss = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (5000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].loss_chars == 7 * 300_000


def test_byte_order_marks_stay(spark):
    texts = ["﻿answer", "﻿", "﻿﻿x", "a﻿", "", "﻿<|end|>﻿"]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "﻿")], SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.parse_chats(chat.format_chats(df))).collect()}
    for conv, loss in ((1, "".join(texts)), (2, "﻿")):
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
