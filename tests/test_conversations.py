from timeloom.queries import turns_of
from timeloom.streaming.conversations import history


def test_history_keeps_whole_turns(spark):
    """Turns of more than 60 characters, one longer than the history, null and empty texts."""
    texts = {1: ["a" * 500, "b" * 700, "c" * 90], 2: ["x" * 900], 3: ["only", None, "two", ""], 4: [None], 5: ["q" * 800, "", "r" * 798]}
    rows = [(i, n, t) for i, ts in texts.items() for n, t in enumerate(ts)]
    got = {x.conv_id: x.history for x in history(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")).collect()}
    assert got == {i: "\n".join(t for t in ts if t is not None)[-800:] for i, ts in texts.items()}


def test_turns_have_whole_messages(spark, data):
    want = {(x.conv_id, x.turn): x.text for x in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    assert {(x.conv_id, x.turn): x.message for x in turns_of(spark, data).collect()} == want


def test_a_selection_is_told_with_its_title_and_times(spark):
    rows = [(1, 1, "find", "new_search", "q", [], [], None, 3, None, None, None, None), (1, 2, "the second", "select_result", None, [], [], 2, None, None, "Second", 1.25, 9.0), (1, 3, "the third", "select_result", None, [], [], 3, None, None, None, None, None), (1, 4, "the ninth", "select_result", None, [], [], 9, None, None, "x", 0.0, 0.0)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, message string, action string, query string, llm_video_ids array<int>, ui_video_ids array<int>, selected_index int, n_results int, clarification string, selected_title string, selected_start double, selected_end double")
    from timeloom.streaming.conversations import ASK_WHICH, conversation_scopes

    got = {r.turn: r for r in conversation_scopes(turns).collect()}
    assert got[2].history.endswith("「the second」→ select_result：已選取第 2 段：《Second》1.2s–9.0s")
    assert got[3].history.endswith("已選取第 3 段") and got[4].history.endswith(ASK_WHICH) and got[4].selected_index == 3 and got[4].shown_scope == []
