"""Conversation turns to the scope, query, selection and history that hold after each, as a batch and as a stream.

turns: (conv_id, turn, message, action, query, llm_video_ids, ui_video_ids, selected_index, n_results, clarification) and, where known, what is
selected (selected_title, selected_start, selected_end). Explicit ids
narrow the scope, a refined search inherits it, a new one clears it; the user's own choice of videos bounds it, and takes its place if
nothing is left. Clarifications and selections leave the search as it is; a selection out of range asks back, with an empty
scope.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_fold
from ..operators.ordered import carried, earlier, has_hot_key, ranged, running, unranged
from ..sources.tables import stage
from .states import plain_rows, use_state_store

# What is said and kept for each kind of turn.
ASK_MORE = "可以再多說明一下想找的內容嗎？"
ASK_WHICH = "不確定指的是上一輪的哪一個結果，可以說明是第幾個，或重新描述想找的內容嗎？"
NOTHING_FOUND = "沒有找到足夠相關的片段，可以換個描述方式，或改用人物、動作、物件名稱再試一次。"
UNSURE = "目前搜尋結果的把握度較低，"
SELECTED, SELECTED_TITLE, SELECTED_TIMES = "已選取第 {} 段", "：《{}》", "{:.1f}s–{:.1f}s"
HISTORY_CHARS = 800

OUT = "conv_id bigint, turn bigint, action string, active_query string, scope array<int>, shown_scope array<int>, selected_index int, history string"


def reply_text(n_results: Column, is_confident: Column) -> Column:
    found = F.concat(F.when(is_confident, "").otherwise(UNSURE), F.format_string("找到 %d 個相關片段。", n_results.cast("bigint")))
    return F.when(n_results == 0, NOTHING_FOUND).otherwise(found)


def resolve_scope(llm: Column, ui: Column) -> Column:
    """The model's ids inside the user's choice; the choice if they have nothing in common, or the ids where there is no choice."""
    none = F.array().cast("array<int>")
    llm, ui = F.coalesce(llm, none), F.coalesce(ui, none)
    narrowed = F.filter(llm, lambda x: F.array_contains(ui, x))
    return F.when(F.size(ui) == 0, llm).when(F.size(narrowed) > 0, narrowed).otherwise(ui)


#: What is kept of a conversation after a turn, and what it is before the first.
START = (None, [], None, "", 0)
TURN = ("turn", "message", "action", "query", "llm_video_ids", "ui_video_ids", "selected_index", "n_results", "clarification")
SELECTION = {"selected_title": "string", "selected_start": "double", "selected_end": "double"}


def _whole(turns: DataFrame) -> DataFrame:
    """The turns with all columns that a fold reads; of the selection those that are missing are null."""
    chosen = [(F.col(c) if c in turns.columns else F.lit(None)).cast(kind).alias(c) for c, kind in SELECTION.items()]
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), *TURN, *chosen)


def _folding(conversation):
    now = START

    def step(row):
        nonlocal now
        if row is None:
            return []
        now, shown, action = next_state(now, row)
        return [{"conv_id": conversation, "turn": row["turn"], "action": action, "active_query": now[0], "scope": now[1], "shown_scope": shown, "selected_index": now[2], "history": now[3]}]

    return step


def _piece_folding(k):
    """As _folding, for a piece that begins with a new search: history has the turn's own line only."""
    now = START

    def step(row):
        nonlocal now
        if row is None:
            return []
        now, shown, action = next_state((*now[:3], "", now[4]), row)
        return [{"conv_id": k["conv_id"], "turn": row["turn"], "action": action, "active_query": now[0], "scope": now[1], "shown_scope": shown, "selected_index": now[2], "history": now[3], "message": row["message"]}]

    return step


def _history_folding(_):
    """Puts the lines of a range's turns together."""
    kept = ""

    def step(row):
        nonlocal kept
        if row is None:
            return []
        kept = (f"{kept}\n{row['history']}" if kept else row["history"])[-HISTORY_CHARS:]
        return [{**{c: row[c] for c in row if c != "k"}, "conv_id": row["k"]["conv_id"], "_p": row["k"]["_p"], "history": kept}]

    return step


def conversation_scopes(turns: DataFrame) -> DataFrame:
    """The state after each turn (see OUT): scope is the search's, shown_scope what the turn shows. One sorted pass that holds one state.

    Where a conversation has very many turns, they are cut into pieces before each new search, which keeps nothing of the search before it, and folded side by side.
    The history, which goes on, is put together in ranges of turns, each of which takes over the last characters of those before.
    """
    whole = _whole(turns)
    if not has_hot_key(whole, "conv_id"):
        return ordered_fold(whole, "conv_id", ["turn", "message"], _folding, OUT)
    new = F.coalesce(~F.col("action").isin("clarify", "select_result", "refine_search"), F.lit(True)).cast("bigint")
    parts = unranged(running(ranged(whole, "conv_id", ["turn", "message"]), "conv_id", sums={"_before": new}))
    keyed = parts.withColumn("k", F.struct("conv_id", (F.col("_before") + new).alias("piece"))).drop("conv_id", "_before")
    lines = ordered_fold(keyed, "k", ["turn", "message"], _piece_folding, f"{OUT}, message string")
    rows = ranged(lines, "conv_id", ["turn", "message"]).withColumn("k", F.struct("_p", "conv_id")).drop("conv_id", "_p", "message")
    local = stage(ordered_fold(rows, "k", ["_i"], _history_folding, f"{OUT}, _p bigint, _i bigint"))
    tails = F.array_join(F.collect_list("_t").over(earlier("conv_id")), "\n")
    joined = carried(local, "conv_id", {"_t": F.max_by("history", "_i")}, {"_c": F.nullif(tails, F.lit(""))})
    return unranged(joined.withColumn("history", F.right(F.concat_ws("\n", "_c", "history"), F.lit(HISTORY_CHARS))).drop("_c"))


def selection_text(index: int, title: str | None, start: float | None, end: float | None) -> str:
    """What is said of the chosen result; its title and times where they are known."""
    said = SELECTED.format(index)
    if title is None:
        return said
    return said + SELECTED_TITLE.format(title) + (SELECTED_TIMES.format(start, end) if start is not None and end is not None else "")


def bounded_scope(ids: list[int], choice: list[int]) -> list[int]:
    """resolve_scope for one turn: the ids inside the user's choice, the choice if there are none, all ids where there is no choice."""
    if not choice:
        return ids
    inside = [v for v in ids if v in choice]
    return inside or choice


def next_state(state: tuple, turn: dict) -> tuple[tuple, list[int], str]:
    """One turn of the fold for the stream: (query, scope, selected, history, results) before and after, the shown scope and action."""
    query, scope, selected, history, results = state
    action, index = turn["action"], turn["selected_index"]
    if action == "clarify":
        outcome, shown = turn["clarification"] or ASK_MORE, scope
    elif action == "select_result":
        if index is not None and 1 <= index <= results:
            selected, shown = index, scope
            outcome = selection_text(index, *(turn.get(c) for c in SELECTION))
        else:
            outcome, shown = ASK_WHICH, []
    else:
        inherited = scope if action == "refine_search" else []
        scope = bounded_scope(turn["llm_video_ids"] or inherited, turn["ui_video_ids"] or [])
        query, selected, results = turn["query"], None, turn["n_results"] or 0
        outcome, shown = query or "", scope
    line = f"- 使用者：「{turn['message'] or ''}」→ {action}：{outcome}"
    history = (f"{history}\n{line}" if history else line)[-HISTORY_CHARS:]
    return (query, scope, selected, history, results), shown, action


#: The state of a conversation.
KEPT = "query string, scope array<int>, selected int, history string, results int"


class _Conversations(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", KEPT, self.keep_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        query, scope, selected, history, results = self.state.get() if self.state.exists() else START
        now = (query, [int(v) for v in scope], selected, history, results)
        out = []
        for r in plain_rows(rows, ["turn"]):
            turn = r | {c: [int(v) for v in r[c]] if r[c] is not None else [] for c in ("llm_video_ids", "ui_video_ids")}
            turn |= {c: turn.get(c) for c in SELECTION}
            turn |= {c: None if turn[c] is None else int(turn[c]) for c in ("selected_index", "n_results")}
            now, shown, action = next_state(now, turn)
            out.append({"conv_id": key[0], "turn": r["turn"], "action": action, "active_query": now[0], "scope": now[1], "shown_scope": shown, "selected_index": now[2], "history": now[3]})
        self.state.update(now)
        frame = pd.DataFrame(out)
        frame["selected_index"] = frame["selected_index"].astype("Int32")
        yield frame


def conversation_stream(turns: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The stream twin of conversation_scopes, in append mode: a row for each turn. Turns of a conversation must arrive in order
    of their batches; within a batch they are sorted. With keep_ms a conversation without a turn for so long is forgotten."""
    use_state_store(turns.sparkSession)
    return turns.groupBy("conv_id").transformWithStateInPandas(_Conversations(keep_ms), OUT, "append", "processingTime" if keep_ms else "none")


def history(turns: DataFrame, chars: int = HISTORY_CHARS) -> DataFrame:
    """(conv_id, history): the last `chars` characters of the texts of turns (conv_id, turn, text), a line each. Only the last turns that
    reach so far are put together; null texts are none. A conversation with very many turns is worked off in ranges."""
    order = [F.desc("turn"), F.desc("text")]
    rows = turns.select("conv_id", "turn", "text")
    if has_hot_key(rows, "conv_id"):
        last = unranged(running(ranged(rows, "conv_id", order), "conv_id", sums={"_after": F.length("text") + 1}))
    else:
        later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        last = rows.withColumn("_after", F.coalesce(F.sum(F.length("text") + 1).over(later), F.lit(0)))
    line = F.when(F.col("text").isNotNull() & (F.col("_after") <= chars), F.struct("turn", F.substring("text", -chars, chars).alias("x")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda t: t["x"])
    return last.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("_h")).select("conv_id", F.substring("_h", -chars, chars).alias("history"))


def select_result(turns: DataFrame, results: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, selected_index) with the chosen earlier result (conv_id, rank, segment_id) and whether it is valid."""
    r = results.select("conv_id", F.col("rank").alias("selected_index"), "segment_id")
    return turns.join(r, ["conv_id", "selected_index"], "left").withColumn("is_valid", F.col("segment_id").isNotNull())
