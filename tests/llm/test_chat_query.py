"""The query against digests taken row by row."""

import hashlib

from tracepath.llm.chat_format import op4_chat_format

PROBE = "\\### Assistant: </turn> ok"


def test_every_conversation_and_the_probe(spark):
    d = "/root/testdata/sf0.001"
    of = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        of.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    of[-7] = [(0, "user", PROBE), (1, "assistant", PROBE)]
    expected = {}
    for conv, turns in of.items():
        turns.sort(key=lambda t: t[0])
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        expected[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = op4_chat_format(spark, d).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected[r.conv_id]
        assert r.formatted_chars > r.loss_chars
