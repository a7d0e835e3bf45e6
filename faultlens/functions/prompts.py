"""Prompt texts. The wording is our own; the structure per strategy is fixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SYSTEM_PROMPT = "你是资深运维专家。只用一个 JSON 对象回答，不要输出其他文字。"
EXPECTED_FORMAT = (
    '{"root_cause": "…", "analysis_process": "…", "solution_steps": ["…"], "confidence": 0.0}'
)
ROLE = "任务：根据一段运维日志判断故障根因，并给出处理办法。"
LOG_TITLE = "# 待诊断日志"
ARTICLES_TITLE = "# 相关知识"
EXAMPLES = (
    "# 示范\n"
    "日志: ERROR worker crashed, java.lang.OutOfMemoryError: GC overhead limit exceeded\n"
    '回答: {"root_cause": "JVM 堆过小，垃圾回收耗尽时间", "analysis_process": "GC overhead 说明回收收效甚微", '
    '"solution_steps": ["增大堆内存", "检查对象泄漏"], "confidence": 0.92}\n'
    "日志: WARN pool exhausted, Connection refused by db-3:5432\n"
    '回答: {"root_cause": "数据库端口未监听", "analysis_process": "连接被直接拒绝，说明主机可达而服务未启动", '
    '"solution_steps": ["启动数据库", "核对端口与防火墙"], "confidence": 0.88}'
)
FORMAT = "# 回答格式\n" + EXPECTED_FORMAT
STEPS = (
    "# 思考顺序\n"
    "一、找出日志里的关键错误\n"
    "二、说明错误之间的因果\n"
    "三、得出最可能的根因\n"
    "四、列出解决步骤\n"
    "请逐步推理，最后只给出 JSON。"
)

# strategy -> blocks in order; "log" and "articles" are filled in per row
LAYOUTS = {
    "ZERO_SHOT": [ROLE, "log", "articles", FORMAT],
    "FEW_SHOT": [ROLE, "articles", EXAMPLES, "log", FORMAT],
    "COT": [ROLE, "articles", "log", STEPS, FORMAT],
}


def pick_strategy(name: Column) -> Column:
    """Upper-cased name; unknown or missing names become FEW_SHOT."""
    return F.when(F.upper(name).isin(*LAYOUTS), F.upper(name)).otherwise("FEW_SHOT")


def article_block(articles: Column) -> Column:
    """array<struct<id, title, content>> -> one line per article under a title; null without articles."""
    lines = F.transform(
        articles,
        lambda a: F.concat(F.lit("- [案例"), a["id"].cast("string"), F.lit("] "), a["title"], F.lit(": "), a["content"]),
    )
    return F.when(F.size(articles) > 0, F.concat(F.lit(ARTICLES_TITLE + "\n"), F.array_join(lines, "\n")))


def user_prompt(strategy: Column, log: Column, articles: Column) -> Column:
    """``concat_ws`` skips the article block of rows without articles."""
    blocks = {"log": F.concat(F.lit(LOG_TITLE + "\n"), log), "articles": articles}

    def layout(name: str) -> Column:
        return F.concat_ws("\n\n", *[blocks[b] if b in blocks else F.lit(b) for b in LAYOUTS[name]])

    return (
        F.when(strategy == "ZERO_SHOT", layout("ZERO_SHOT"))
        .when(strategy == "COT", layout("COT"))
        .otherwise(layout("FEW_SHOT"))
    )
