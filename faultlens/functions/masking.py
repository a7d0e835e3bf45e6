"""Masking of addresses and secrets with four ordered rules.

The rules are stated for RE2 in ``fixed_values.MASK_RULES``. The Java forms below match the same texts, but

* spell out the ASCII word border and the blank class, because Java's ``\\b`` and ``\\s`` are not RE2's;
* begin with the rarest character class and look behind from there, so most positions fail at once;
* never give characters back in runs (possessive quantifiers), so a megabyte of letters costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WORD = "0-9A-Za-z_"
_RUN = "A-Za-z0-9._%+-"
_ALNUM = "A-Za-z0-9"
_BLANK = r"\t\n\f\r "

# rule name, Java pattern, Java replacement, text without which the rule cannot match
JAVA_RULES = [
    (
        "ip",
        rf"[0-9](?<![{_WORD}].)[0-9]{{0,2}}(?:\.[0-9]{{1,3}}){{3}}(?![{_WORD}])",
        "[IP_REDACTED]",
        ".",
    ),
    (
        # a match starts at the first word character of a run, or right where the match before ended
        "email",
        rf"(?:(?!^)\G|(?<![{_RUN}])([.%+-]*+))[{_RUN}]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}"
        rf"(?:(?<=\|)(?=[{_WORD}])|(?<=[A-Za-z])(?![{_WORD}]))",
        "$1[EMAIL_REDACTED]",
        "@",
    ),
    ("secret", rf"[{_ALNUM}](?<![{_ALNUM}].)[{_ALNUM}]{{31,}}+", "[SECRET_REDACTED]", ""),
    (
        # the word before the sign stays, so it is only looked at
        "token",
        rf"[=:](?<=(?iu:token|secret|key|password|passwd).)[{_BLANK}]*[^{_BLANK},;]+",
        "=[SECRET_REDACTED]",
        "",
    ),
]


def mask(text: Column) -> Column:
    out = text
    for _, pattern, replacement, needs in JAVA_RULES:
        replaced = F.regexp_replace(out, pattern, replacement)
        # no rule adds the needed text, so the untouched column answers for all stages
        out = F.when(F.contains(text, F.lit(needs)), replaced).otherwise(out) if needs else replaced
    return out


def mask_hits(text: Column) -> dict[str, Column]:
    """How often each rule fires on a text, each counted on what the rules before it left."""
    hits = {}
    for name, pattern, replacement, _ in JAVA_RULES:
        hits[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, replacement)
    return hits
