"""The driver's documents as Markdown with Chinese passages, for queries that need paragraphs and patterns.

Each line of a document becomes a paragraph. A passage, chosen by the document's number, is added at the end and, for some,
front matter at the start; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import quoted

#: Passages of our own that show the patterns, and plain ones.
PASSAGES = [
    "真正重要的不是速度，而是你是否能长期坚持。本质上，这套方法会稳稳接住你，把结果直接拉满。",
    "首先，我们要看清问题。其次，我们要找到原因。最后，我们要给出办法。综上所述，这件事因此外界也看得明白。",
    "```python\nprint('a')\n\nprint('b')\n```\n\n代码之后是一段普通的话，写得不长。",
    "## 未来展望\n\n这项技术带来了无尽的想象空间，其爆发潜力不容小觑。",
    "- 第一项\n- 第二项\n\n| 甲 | 乙 |\n| 丙 | 丁 |",
    "这种方法被广泛应用于各个领域，受到关注，得到支持，并且加以推广。由此可见，它被认为有效；但是，没有人真正试过。",
    "这是一个普通测试句子。这是另一条普通测试句子。这又是一条普通测试句子。这还是一条普通测试句子。这仍是一条普通测试句子。",
    "他停了一下——这意味着还有别的事。我们等着——即便很晚。她说完了——这表明事情不大。值得注意的是，没人问她。",
    "昨天我去修车，等了两个小时。师傅话不多，手很快。修完他说，下次早点来。",
    "一方面要快，另一方面要稳。显而易见，以下是我的修改。如果你愿意，我可以再改一遍。",
    "没有废话，没有套路，只有干货。问题是什么？答案就是执行力。我更在意的是过程。",
    "　　段首有全角空格。 段尾也有　\n \t\n在 AI 的浪潮中，答案很简单：先做再说。",
]
FRONT = "---\ntitle: 甲\n---\n"
FRONT_EVERY = 7


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), (F.col("doc_id") % len(PASSAGES)).cast("int") + 1)
    front = F.when(F.col("doc_id") % FRONT_EVERY == 0, F.lit(FRONT)).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(front, lines, F.lit("\n\n"), passage).alias("text"))


def corpus_sql() -> str:
    """The same as a common table expression for DuckDB."""
    cases = " ".join(f"WHEN {i} THEN {quoted(p)}" for i, p in enumerate(PASSAGES))
    return (
        f"corpus AS (SELECT doc_id, (CASE WHEN doc_id % {FRONT_EVERY} = 0 THEN {quoted(FRONT)} ELSE '' END) || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) "
        f"|| chr(10) || chr(10) || (CASE doc_id % {len(PASSAGES)} {cases} END) AS text FROM documents)"
    )
