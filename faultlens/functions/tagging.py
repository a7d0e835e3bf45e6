"""Known error patterns in a text.

The pattern lists are closed and short, so they are unrolled into plain ``contains`` tests instead of a
lambda over an array: the upper-cased text is then computed once per row (common subexpression) and
everything is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import fold_upper


def _present(upper: Column, words: list[str], extra: dict[str, Column] | None = None) -> Column:
    tests = []
    for word in words:
        hit = F.contains(upper, F.lit(word.upper()))
        if extra and word in extra:
            hit = hit & extra[word]
        tests.append(F.when(hit, word).otherwise(""))
    return F.array_remove(F.array(*tests), "")


def key_errors(text: Column) -> Column:
    """Empty for null texts."""
    return F.slice(_present(fold_upper(text), fv.KEY_ERRORS), 1, fv.MAX_KEY_ERRORS)


def retrieval_keywords(text: Column, errors: Column) -> Column:
    """Key errors, then further patterns not yet there in another spelling; default words if none."""
    twins = {w.upper(): w for w in fv.KEY_ERRORS}
    words, unseen, seen = [], {}, set()
    for word in fv.RETRIEVAL_WORDS:
        if word.upper() in seen:
            continue
        seen.add(word.upper())
        words.append(word)
        if word.upper() in twins:
            unseen[word] = ~F.array_contains(errors, twins[word.upper()])
    found = F.concat(errors, _present(fold_upper(text), words, unseen))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(w) for w in fv.DEFAULT_WORDS]))


def search_vocabulary() -> list[str]:
    """Every word ``retrieval_keywords`` can return."""
    return list(dict.fromkeys(fv.KEY_ERRORS + fv.RETRIEVAL_WORDS + fv.DEFAULT_WORDS))
