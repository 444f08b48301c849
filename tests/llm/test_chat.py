import hashlib

from pathloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, example string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    talks = {}
    for c, t, r, x, *_ in rows:
        talks.setdefault(c, []).append((t if t is not None else -(2**62), r or "", x or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip_and_loss(spark):
    rows = [
        (1, 0, "user", "hi # <b> \\ \\b \\h"), (1, 1, "assistant", "### user: x</turn>\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é𝄞:"),
        (2, 0, "user", "no reply"), (3, 0, None, "a"), (3, 0, None, "a"), (None, 5, "assistant", "null id"), (4, None, "we:ird\\role", "z" * 5000), (4, 1, "assistant", "ok"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.prefix_targets(df)).collect()}
    assert got == expected(rows)


def test_each_reply_is_one_example(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(7)], "conv_id long, turn long, role string, text string")
    rows = chat.prefix_targets(df).orderBy("example").collect()
    assert [r.n_turns for r in rows] == [2, 4, 6, 7]
    assert [r.formatted[r.loss_start - 1 : r.loss_start - 1 + r.loss_len] if r.loss_len is not None else None for r in rows] == ["t1", "t3", "t5", None]
    assert rows[1].formatted.startswith(rows[0].formatted)


def test_empty_table(spark):
    assert chat.prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
