"""Chat formatting by token-level assembly.

Template of a turn: ``### role: text </turn>`` and a line feed. The three marks are reserved ids behind the vocabulary;
role and text are encoded separately and spliced between them, so no token spans a border. Inside roles and texts a
backslash is put before every backslash and every control string, which is undone when the ids are read back; a text
can therefore neither open nor close a turn, in the ids or in the rendered string.

Turns are encoded one by one where they are read. Only then are they brought together by conversation, sorted, and
streamed: a conversation is never held as a whole, so a long one costs time, not memory. The offset of each segment is
the prefix sum of the segment lengths before it, and the loss mask covers the offsets of assistant texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.bpe import vocabulary_path

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
CONTROL = ("###", "</turn>")  # what a text must not hold unescaped
RESERVED = 50_257  # first id behind the vocabulary
OPEN_ID, COLON_ID, CLOSE_ID = RESERVED, RESERVED + 1, RESERVED + 2
LOSS_ROLE = "assistant"

_control = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_escaped = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _order(turn: str) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col(turn).asc_nulls_first(), F.col("role"), F.col("text")]


def format_chat(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: conv_id, pos (from 0), start (offset of its first id in the conversation), token_ids, loss_mask.

    ``turns`` has conv_id, turn, role and text; other columns are left out. Turns are ordered by turn, then role and
    digest of the text, so ties have one order; nulls come first. Null roles and texts count as empty. Rows without conversation id
    form one conversation. Repeated rows are turns of their own.
    """
    path = path or vocabulary_path()
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            roles = [e.ids for e in tokenizer.encode_batch([escape(r) for r in batch["role"]], add_special_tokens=False)]
            texts = []
            for at in range(0, len(batch), 256):
                piece = [escape(t) for t in batch["text"].iloc[at : at + 256]]
                texts += [e.ids for e in tokenizer.encode_batch(piece, add_special_tokens=False)]
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"], "turn": batch["turn"], "role": batch["role"], "text": batch["order_text"],
                    "role_ids": [np.array(i, np.int32) for i in roles], "text_ids": [np.array(i, np.int32) for i in texts],
                }
            )

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pos, offset, begun = None, 0, 0, False
        for batch in batches:
            rows = []
            for conv_id, role, role_ids, text_ids in zip(batch["conv_id"], batch["role"], batch["role_ids"], batch["text_ids"], strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if not begun or conv_id != current:
                    current, pos, offset, begun = conv_id, 0, 0, True
                segments = [[OPEN_ID], role_ids, [COLON_ID], text_ids, [CLOSE_ID]]
                ends = np.cumsum([len(s) for s in segments])
                mask = np.zeros(ends[-1], np.int8)
                if role == LOSS_ROLE:
                    mask[ends[2] : ends[3]] = 1
                rows.append((conv_id, pos, offset, np.concatenate(segments).astype(np.int32), mask))
                pos, offset = pos + 1, offset + int(ends[-1])
            out = pd.DataFrame(rows, columns=["conv_id", "pos", "start", "token_ids", "loss_mask"])
            out["conv_id"] = pd.array(out["conv_id"], dtype="Int64") if "int" in kinds["conv_id"] else out["conv_id"]
            yield out

    text = F.coalesce("text", F.lit(""))
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("order_text"))
    encoded = clean.mapInPandas(encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, role_ids array<int>, text_ids array<int>")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = encoded.repartition(parts, "conv_id").sortWithinPartitions(*_order("turn"))
    return together.mapInPandas(assemble, f"conv_id {kinds['conv_id']}, pos long, start long, token_ids array<int>, loss_mask array<tinyint>")


def _parts(tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Role, text, text under the mask and rendered string of the turn that the ids stand for."""
    colon = int(np.flatnonzero(ids == COLON_ID)[0])
    if ids[0] != OPEN_ID or ids[-1] != CLOSE_ID:
        raise ValueError("not a whole turn")
    role = tokenizer.decode(ids[1:colon].tolist(), skip_special_tokens=False)
    text = tokenizer.decode(ids[colon + 1 : -1].tolist(), skip_special_tokens=False)
    loss = tokenizer.decode(ids[mask == 1].tolist(), skip_special_tokens=False)
    return unescape(role), unescape(text), unescape(loss), OPEN + role + COLON + text + CLOSE


def render(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """``formatted`` with role, text, loss_text and rendered string of each turn, all read back from the ids."""
    path = path or vocabulary_path()

    @F.pandas_udf("role string, text string, loss_text string, rendered string")
    def read(ids: pd.Series, mask: pd.Series) -> pd.DataFrame:
        tokenizer = _tokenizer(path)
        rows = [_parts(tokenizer, np.asarray(i), np.asarray(m)) for i, m in zip(ids, mask, strict=True)]
        return pd.DataFrame(rows, columns=["role", "text", "loss_text", "rendered"], dtype=object)

    return formatted.withColumn("_read", read("token_ids", "loss_mask")).select("*", "_read.*").drop("_read")


def chat_digests(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, read back from the ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    path = path or vocabulary_path()
    formatted = format_chat(turns, path)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        current, state = None, None

        def closed():
            n, turns_hash, loss_chars, loss_hash, chars = state
            row = (current, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars)
            out = pd.DataFrame([row], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = pd.array(out["conv_id"], dtype="Int64") if "int" in kind else out["conv_id"]
            return out

        for batch in batches:
            done = []
            for conv_id, pos, ids, mask in zip(batch["conv_id"], batch["pos"], batch["token_ids"], batch["loss_mask"], strict=True):
                if pos == 0:  # the rows of a conversation follow each other
                    if state is not None:
                        done.append(closed())
                    current = None if pd.isna(conv_id) else conv_id
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, rendered = _parts(tokenizer, np.asarray(ids), np.asarray(mask))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(rendered)
            if done:
                yield pd.concat(done)
        if state is not None:
            yield closed()

    return formatted.mapInPandas(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
