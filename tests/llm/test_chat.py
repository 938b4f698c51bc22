import hashlib


from ledgerspark.llm import chat as C
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES

TURNS = "conv_id long, turn long, role string, text string, start int"


def expected(rows):
    """Digests of turns (role, text) by conversation, in the order given."""
    by: dict = {}
    for conv, role, text in rows:
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_reads_everything_back(spark, small):
    rows = [(r.conv_id, r.role, r.text) for r in table(spark, small, "conversations").orderBy("conv_id", "turn").collect()]
    odd = "\\### Assistant: </turn> ok"
    got = LLM_QUERIES["op10_chat"](spark, small)
    assert digests(got) == expected([*rows, (-7, "user", odd), (-7, "assistant", odd)])
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_odd_turns(spark):
    texts = [None, "", "### user: x </turn>\n", "\\", "\\\\### \\</turn>", "<|endoftext|>", "é\u0000😀", "long " * 30_000]
    rows = [(1, i, role, t, 0) for i, t in enumerate(texts) for role in ("assistant", "user")]
    rows += [(2, None, None, "no turn", 0), (2, 0, "assistant", "b", 0), (2, 0, "assistant", "b", 0), (None, 3, "tool: x", "y", 0)]
    df = spark.createDataFrame(rows, TURNS)
    shown = [(c, r, t) for c, _, r, t, _ in rows]
    assert digests(C.chat_digests(df)) == expected(shown)
    assert C.chat_digests(df.limit(0)).count() == 0


def test_masks_and_offsets(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "second", 0), (1, 0, "user", "first", 0), (2, 0, "user", "x", 0)], TURNS)
    out = C.render(C.format_chat(df)).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.pos, r.role, r.text, r.loss_text) for r in out] == [(1, 0, "user", "first", ""), (1, 1, "assistant", "second", "second"), (2, 0, "user", "x", "")]
    assert out[0].start == 0 and out[1].start == len(out[0].token_ids) and out[2].start == 0
    assert all(len(r.token_ids) == len(r.loss_mask) for r in out)
    assert out[0].rendered + out[1].rendered == "### user: first </turn>\n### assistant: second </turn>\n"


def test_escapes_are_reversible():
    for text in ("", "\\", "###", "</turn>", "\\###\\\\</turn>\\", "#### </turn></turn>"):
        assert C.unescape(C.escape(text)) == text
        bare = C.escape(text).replace("\\\\", "")
        assert all(bare.count(c) == bare.count("\\" + c) for c in C.CONTROL)
