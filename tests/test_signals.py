"""Text signals with and without the literal test, and token runs inside a row."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from searchloom.operators import assertions, tagging

PARTS = [
    "organic traffic dropped last week", "No traffic drop", "if clicks drop", "rankings", "已经下降", "自然搜索流量下滑", "没有流量下滑", "如果排名下降", "deindexed since May",
    "索引异常 已", "TRAFFIC has declined", "nothing here", "减少 风险", "avoid indexing issues", "骤降", "", "…", "impressions observed loss",
]


def test_literals_lose_no_signal(spark):
    rng = random.Random(3)
    texts = [(n, " ".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4)))) for n in range(400)] + [(1000, None)]
    frame = spark.createDataFrame(texts, "id int, text string")
    cleaned = F.col("text")
    for pattern in (*tagging.RECOVERY_NEGATIONS, *tagging.RECOVERY_HYPOTHETICALS):
        cleaned = F.regexp_replace(cleaned, tagging._java(pattern), "")
    plain = frame.withColumn("c", cleaned).select("id", (tagging.matches_any(F.col("c"), tagging.RECOVERY) & tagging.matches_any(F.col("c"), tagging.RECOVERY_OBSERVED)).alias("r"))
    want = {r["id"]: r["r"] for r in plain.collect()}
    assert {r["id"]: r["recovery"] for r in tagging.recovery_signal(frame).collect()} == want
    assert {True, False} <= set(want.values())
    words = [w for row in tagging.RECOVERY_LITERALS for w in row]
    assert any(not any(w in t.lower() for w in words) for _, t in texts[:-1])


def test_token_runs(spark):
    rng = random.Random(4)
    texts = [(n, " ".join(rng.choice(["a", "b", "buy", "c++", "漢字", "!"]) for _ in range(rng.randrange(12)))) for n in range(100)] + [(100, None)]
    frame = spark.createDataFrame(texts, "text_id int, text string")
    got = {r["text_id"]: (r["tokens"], r["distinct_tokens"], r["top_count"], r["stuffed"]) for r in assertions.text_sanity(frame).collect()}
    for n, text in texts:
        counts = Counter(re.findall(assertions.TOKEN_PATTERN, (text or "").lower()))
        total, kinds, top = sum(counts.values()), len(counts), max(counts.values(), default=0)
        assert got[n] == (total, kinds, top, total >= 8 and (top / total >= 0.5 or kinds / total <= 0.2))
    plan = assertions.text_sanity(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
