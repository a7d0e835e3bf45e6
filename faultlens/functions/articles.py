"""Article texts and the rule tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import clip_chars, fold_lower, fold_upper


def _first_rule(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    out = None
    for words, value in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def infer_category(errors: Column) -> Column:
    rules = [(words, category) for category, words in fv.CATEGORY_WORDS.items()]
    return _first_rule(fold_upper(F.array_join(errors, " ")), rules, fv.LEARNED_CATEGORY)


def infer_trigger(keywords: Column) -> Column:
    return _first_rule(fold_lower(F.array_join(keywords, " ")), fv.TRIGGER_RULES, fv.TRIGGER_DEFAULT)


def infer_solution(keywords: Column) -> Column:
    return _first_rule(fold_lower(F.array_join(keywords, " ")), fv.SOLUTION_RULES, fv.SOLUTION_DEFAULT)


def infer_impact(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in fv.IMPACT_BY_CATEGORY.items():
        out = F.when(category == name, text).otherwise(out)
    return F.coalesce(out, F.lit(fv.IMPACT_DEFAULT))


def learned_content(cause: Column, analysis: Column, steps: Column) -> Column:
    label_cause, label_analysis, label_steps = fv.LEARNED_LABELS
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n")))
    return F.concat(
        F.lit(label_cause), cause,
        F.lit("\n\n" + label_analysis), analysis,
        F.lit("\n\n" + label_steps + "\n"), F.array_join(numbered, ""),
    )


def seed_content(category: Column, cause: Column, keywords: Column, log: Column) -> Column:
    group, root, trigger, impact, words, steps, sample = fv.SEED_LABELS
    head = F.concat_ws(
        "\n\n",
        F.concat(F.lit(group), category),
        F.concat(F.lit(root), cause),
        F.concat(F.lit(trigger), infer_trigger(keywords)),
        F.concat(F.lit(impact), infer_impact(category)),
        F.concat(F.lit(words), F.array_join(keywords, ", ")),
        F.concat(F.lit(steps + "\n"), infer_solution(keywords)),
    )
    return F.concat(head, F.lit("\n" + sample + "\n"), log)


def seed_title(category: Column, cause: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit("] "), clip_chars(cause, fv.SEED_TITLE_CHARS))
