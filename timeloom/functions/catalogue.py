"""Topics, prices and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import held

# Topics in the order that decides between equals, with their keywords; the topic of the rest.
TOPICS = {
    "運動賽事": ("世界盃", "fifa", "足球", "梅西", "messi", "球賽", "棒球", "龍隊", "全場精華", "進球", "籃球", "nba", "中職", "球員", "賽事", "冠軍戰", "de paul", "dribbling", "球隊", "比賽", "過人"),
    "科技與製造": ("晶片", "chip", "半導體", "工廠", "工厂", "主板", "主機板", "技嘉", "intel", "台積電", "生產線", "制造", "製程", "wafer", "factory", "顯卡", "cpu", "板卡", "電子產品", "製造"),
    "教學課程": ("python", "程式", "教學", "入門", "新手", "安裝", "code", "開發", "javascript", "零基礎", "課程", "tutorial", "軟體", "education", "教育", "學習", "單字", "認識"),
    "數學與科學": ("線性代數", "向量", "數學", "微積分", "矩陣", "物理", "化學", "生物", "定理", "公式"),
    "美食料理": ("壽司", "料理", "食譜", "烹飪", "美食", "做法", "甜點", "餐廳", "recipe", "cooking", "sushi", "海苔", "米飯", "食谱", "烹饪", "甜点", "餐厅", "米饭", "家常菜", "下飯", "下饭", "翻炒", "爆炒", "stir fry"),
    "旅遊": ("旅遊", "觀光", "景點", "行程", "一日遊", "遊記", "自由行", "travel", "地理", "關東", "近畿"),
    "音樂": ("mv", "演唱會", "專輯", "樂團", "鋼琴", "吉他", "music", "歌曲", "音樂"),
    "新聞時事": ("新聞", "報導", "快訊", "記者", "選舉", "疫情", "股市", "政府"),
    "人物與娛樂": ("最美", "beautiful faces", "名人", "明星", "排行", "榜單", "訪談", "綜藝", "搞笑", "vlog", "最美麗"),
}
OTHER_TOPIC = "其他"
TITLE_WEIGHT, SUMMARY_WEIGHT = 3, 1
# Prices in US dollars.
CHAT_PRICES = {"gpt-4o-mini": (0.15 / 1_000_000, 0.60 / 1_000_000)}
EMBEDDING_PRICE, SPEECH_PRICE = 0.02 / 1_000_000, 0.006
VIDEO_URL = r"youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/"


def topic(title: Column, summary: Column, topics: dict[str, tuple[str, ...]] | None = None, other: str = OTHER_TOPIC) -> Column:
    """The topic whose keywords score highest, a title's more than a summary's; of equals the first, without any `other`. Each text is lower-cased once and
    goes once through an automaton of all keywords."""
    rules = TOPICS if topics is None else topics
    words = tuple(dict.fromkeys(w for ws in rules.values() for w in ws))
    number = {w: i for i, w in enumerate(words)}
    names, sets = list(rules), [{number[w] for w in ws} for ws in rules.values()]

    def best(title: str | None, summary: str | None) -> str:
        t, s = (held(words, (x or "").lower()) for x in (title, summary))
        scores = [TITLE_WEIGHT * len(t & own) + SUMMARY_WEIGHT * len(s & own) for own in sets]
        top = max(scores, default=0)
        return names[scores.index(top)] if top else other

    @F.pandas_udf(T.StringType())
    def topic_of(title: pd.Series, summary: pd.Series) -> pd.Series:
        return pd.Series([best(t, s) for t, s in zip(title, summary, strict=True)], dtype=object)

    return topic_of.asNondeterministic()(title, summary)  # so that a plan doesn't repeat it


def is_video_url(url: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(url), F.lit(VIDEO_URL)), F.lit(False))


def chat_cost(usage: DataFrame, prices: dict[str, tuple[float, float]] = CHAT_PRICES) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens, ...) with cost_usd, null with an error for a model without a price; missing
    numbers of tokens cost nothing."""
    table = usage.sparkSession.createDataFrame([(m, *p) for m, p in prices.items()], "model string, _in double, _out double")
    joined = usage.join(F.broadcast(table), "model", "left")
    cost = F.coalesce("prompt_tokens", F.lit(0)) * F.col("_in") + F.coalesce("completion_tokens", F.lit(0)) * F.col("_out")
    error = F.when(F.col("_in").isNull(), F.concat(F.lit("no price for "), F.coalesce("model", F.lit("null"))))
    return joined.withColumn("cost_usd", cost).withColumn("error", error).drop("_in", "_out")


def embedding_cost(tokens: Column) -> Column:
    return F.coalesce(tokens, F.lit(0)) * EMBEDDING_PRICE


def speech_cost(seconds: Column) -> Column:
    return F.coalesce(seconds, F.lit(0)) / 60 * SPEECH_PRICE


# What an item without a title is called, and the addresses that follow from an id.
NO_TITLE = "（無標題）"
WATCH, THUMBNAIL = "https://www.youtube.com/watch?v=", ("https://i.ytimg.com/vi/", "/hqdefault.jpg")


def catalogue_items(raw: DataFrame) -> DataFrame:
    """Search items (video_id, title, url, description, duration_sec, channel, view_count) from the flat ones that a catalogue gives (id,
    title, url, description, duration, channel, uploader, view_count): empty texts are filled by what stands in for them, and a
    duration of nothing, as live videos have, is unknown."""
    text = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    named = lambda c, other: F.when(text(c) != "", F.col(c)).otherwise(other)
    return raw.select(
        text("id").alias("video_id"),
        named("title", F.lit(NO_TITLE)).alias("title"),
        named("url", F.concat(F.lit(WATCH), text("id"))).alias("url"),
        text("description").alias("description"),
        F.when(F.col("duration") != 0, F.col("duration").cast("int")).alias("duration_sec"),
        text("channel", "uploader").alias("channel"),
        "view_count",
    )


def best_thumbnail(items: DataFrame) -> DataFrame:
    """(id, url) of the largest thumbnail of each item, of equals the first: items (id, thumbnails array of (url, width, height)). Without
    any it is the address that follows from the id, and null without an id, too."""
    t = items.select("id", F.posexplode_outer("thumbnails").alias("at", "t"))
    area = F.coalesce(F.col("t.width"), F.lit(0)) * F.coalesce(F.col("t.height"), F.lit(0))
    has = F.coalesce(F.col("t.url"), F.lit("")) != ""
    best = t.groupBy("id").agg(F.max_by("t.url", F.when(has, F.struct(area.alias("area"), (-F.col("at")).alias("at")))).alias("url"))
    fixed = F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit(THUMBNAIL[0]), F.col("id"), F.lit(THUMBNAIL[1])))
    return best.select("id", F.coalesce("url", fixed).alias("url"))
