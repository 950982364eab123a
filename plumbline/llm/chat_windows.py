"""Chat formatting: conversations as training windows within a token budget.

A turn is formatted as header, text and end mark, and encoded. Prefix sums of the turns' token
counts tell how many whole turns fit behind the system turn and the repeated history, so every window is
a turn-aligned span. A window is the system turn, at most ``history`` turns that came right before
(context only, within ``history_share`` of the budget), and new turns. The loss mask is 1 on the tokens of new assistant
turns alone: a target is learnt from once, and where it is repeated it is masked.

Conversations are brought together and sorted by one shuffle; each task then streams over its sorted
turns, and holds one conversation at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, list_array, narrow, strings, table
from .token_binary import RANKS, tokenizer

BUDGET, HISTORY, HISTORY_SHARE = 512, 2, 0.5
_SCHEMA = "conv_id {0}, window int, first_turn {1}, last_turn {1}, n_history int, n_tokens int, n_targets int, over_budget boolean, token_ids array<int>, loss_mask array<tinyint>"


def spans(sizes: np.ndarray, budget: int, history: int, history_share: float) -> list[tuple[int, int, int]]:
    """(first, end, history from) of the windows over turns of these sizes; ``budget`` is what is left beside
    the system turn, nothing if that turn alone is as long as the budget or longer. A turn that is too long for it even alone has a window of its own, whole."""
    budget = max(0, budget)
    before = np.concatenate([[0], np.cumsum(sizes)])
    out, at, n = [], 0, len(sizes)
    while at < n:
        # the earliest turn from which the history, both in turns and in tokens, is within bounds
        back = max(at - history, int(np.searchsorted(before, before[at] - int(budget * history_share), "left")), 0)
        while True:
            end = int(np.searchsorted(before, before[back] + budget, "right")) - 1
            if end > at or back == at:
                break
            back += 1  # the first new turn comes before history
        end = max(end, at + 1)
        out.append((at, end, back))
        at = end
    return out


def _windows(path: str, budget: int, history: int, history_share: float, chunk_bytes: int):
    def conversation(conv, turns: list, roles: list[str], ids: list[np.ndarray]) -> Iterator[tuple]:
        system = [k for k, r in enumerate(roles) if r == "system"][:1]
        head = ids[system[0]] if system else np.zeros(0, np.int32)
        rest = [k for k in range(len(roles)) if k not in system]
        if not rest:
            # a lone system turn is context without a target
            yield conv, 0, turns[system[0]], turns[system[0]], 0, 0, len(head) > budget, head, np.zeros(len(head), np.int8)
            return
        sizes = np.array([len(ids[k]) for k in rest], np.int64)
        for w, (first, end, back) in enumerate(spans(sizes, budget - len(head), history, history_share)):
            mine = rest[back:end]
            tokens = np.concatenate([head, *[ids[k] for k in mine]])
            mask = np.concatenate([np.zeros(len(head), np.int8), *[np.full(len(ids[k]), j >= first - back and roles[k] == "assistant", np.int8) for j, k in enumerate(mine)]])
            yield conv, w, turns[rest[first]], turns[rest[end - 1]], first - back, int(mask.sum()), len(tokens) > budget, tokens, mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        ends = bpe.bpe.encode_ordinary("<|end|>\n")
        heads: dict[str, list[int]] = {}
        held: tuple = (None, [], [], [])
        kinds: list[pa.DataType] = []
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            conv, w, a, b, h, t, over, tokens, mask = map(list, zip(*done))
            done.clear()
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(conv, kinds[0]), pa.array(w, pa.int32()), pa.array(a, kinds[1]), pa.array(b, kinds[1]), pa.array(h, pa.int32()), pa.array(size.astype(np.int32)),
                    pa.array(t, pa.int32()), pa.array(over, pa.bool_()), list_array(pa.array(np.concatenate(tokens).astype(np.int32)), size), list_array(pa.array(np.concatenate(mask)), size),
                ],
                ["conv_id", "window", "first_turn", "last_turn", "n_history", "n_tokens", "n_targets", "over_budget", "token_ids", "loss_mask"],
            )

        for batch in chunks(batches, 3, chunk_bytes):
            kinds = kinds or [batch.column(0).type, batch.column(1).type]
            roles = [r if r is not None else "user" for r in batch.column(2).to_pylist()]
            flat, size = bpe.encode(strings(batch.column(3)))
            start = np.cumsum(size) - size
            for k, (conv, turn) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if held[1] and conv != held[0]:
                    done += conversation(*held)
                    held = (conv, [], [], [])
                elif not held[1]:
                    held = (conv, [], [], [])
                role = roles[k]
                if role not in heads:
                    heads[role] = bpe.bpe.encode_ordinary(f"<|{role}|>\n")
                held[1].append(turn), held[2].append(role)
                held[3].append(np.concatenate([heads[role], flat[start[k] : start[k] + size[k]], ends]).astype(np.int32))
                if len(done) >= 2000:
                    yield batch_of()
        if held[1]:
            done += conversation(*held)
        if done:
            yield batch_of()

    return run


def chat_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_share: float = HISTORY_SHARE,
    tokenizer_path: str = RANKS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """(conv_id, window, first_turn, last_turn, n_history, n_tokens, n_targets, over_budget, token_ids, loss_mask).

    Every turn but the system turn is new in exactly one window. The first system turn is in all of a conversation's windows; any
    further one is an ordinary turn. A turn that doesn't fit even alone isn't cut: its window has it
    whole and is marked over_budget; where the system turn alone fills the budget, every turn has such a window. Turns sort by number (null first), then role and text, so ties and
    repeated rows have a fixed order and repeated rows stay. A null role counts as user, a null text as empty; turns
    without a conv_id belong to no conversation and are left out. A conversation of a system turn
    alone gives one window without targets; an empty table gives none. Other columns play no part.
    """
    if budget < 1 or history < 0 or not 0 <= history_share <= 1:
        raise ValueError("budget must be positive, history not negative, history_share in [0, 1]")
    own = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    kinds = [own.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    sorted_turns = own.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return sorted_turns.mapInArrow(_windows(tokenizer_path, budget, history, history_share, chunk_bytes), _SCHEMA.format(*kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(table(spark, sf_dir, "conversations"))
