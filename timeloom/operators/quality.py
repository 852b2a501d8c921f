"""Rates of description quality, at several groupings in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word lists that the rates count.
VAGUE_WORDS = ("工作", "操作", "進行", "作業", "活動", "忙碌", "設備", "機器", "儀器", "裝置", "處理", "運作", "使用", "顯示", "場景", "環境", "專注", "似乎", "可能", "正在")
CONCRETE_ACTION_WORDS = ("搬", "抬", "舉", "拿起", "放下", "推", "拉", "轉動", "按下", "插入", "焊接", "切割", "倒入", "攪拌", "擦拭", "彎腰", "蹲", "伸手", "遞", "堆疊", "裝入", "取出", "扭", "敲", "撕", "貼")
META_COMPARISON_WORDS = ("第一", "第二", "接著顯示", "隨著", "逐漸", "變化", "略有", "前後", "兩張", "轉為", "然後在")
PERSON_WORDS = ("作業員", "技術人員", "工人", "操作員", "員工", "工程師", "師傅", "男子", "女子", "一名", "一位", "人員")
POSTURE_WORDS = ("彎腰", "蹲", "站", "坐", "伸手", "扶", "握", "抓", "靠", "面向", "背對", "低頭", "抬頭", "雙手", "單手", "手持", "手指", "手臂", "膝", "肩")

RATES = {"vague_rate": VAGUE_WORDS, "concrete_rate": CONCRETE_ACTION_WORDS, "meta_rate": META_COMPARISON_WORDS}
EXTRA_RATES = {"person_rate": PERSON_WORDS, "posture_rate": POSTURE_WORDS}


def hits_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def description_quality(descriptions: DataFrame, groupings: list[tuple[str, ...]], text: str = "visual_description", rates: dict[str, tuple[str, ...]] = RATES) -> DataFrame:
    """(the groupings' columns, n, avg_length, rates) for each set of columns in groupings, () for all rows; the columns that a
    row isn't grouped by are null, and grouping_level tells the sets apart. Empty descriptions don't count."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    # one flag a list and row; the sets are made of these, not of the texts
    rows = descriptions.where(F.coalesce(F.col(text), F.lit("")) != "").select(*columns, F.length(text).alias("_len"), *[hits_any(F.col(text), w).cast("double").alias(f"_{r}") for r, w in rates.items()])
    sets = [[F.col(c) for c in g] for g in groupings]
    measures = [F.count("*").alias("n"), F.round(F.avg("_len"), 1).alias("avg_length"), *[F.round(F.avg(f"_{r}"), 4).alias(r) for r in rates]]
    if not columns:
        return rows.groupBy().agg(*measures)
    return rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping_level"), *measures)
