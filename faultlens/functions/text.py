"""Text columns: case folding, tokens, clipping, hashes, size estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultlens.functions import fixed_values as fv

# All patterns are plain ASCII, so only letters whose upper case is an ASCII letter matter: a-z, the long s
# and the dotless i. One mapping pass is much cheaper than full upper-casing and, unlike Java's, one to one.
_TO_UPPER = "abcdefghijklmnopqrstuvwxyz\u017f\u0131"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZSI"

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"


def fold_upper(text: Column) -> Column:
    """Upper case as far as ASCII patterns can see it."""
    return F.translate(text, _TO_UPPER, _UPPER)


def fold_lower(text: Column) -> Column:
    """Lower case, one to one also for the two letters that Java lower-cases by context."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order, repeats kept."""
    return F.transform(F.array_remove(F.split(text, TOKEN_BREAK), ""), fold_lower)


def whole_div(value: Column, divisor: int) -> Column:
    """Integer division without a detour over doubles."""
    return F.call_function("div", value, F.lit(divisor))


def clip_chars(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def clip_bytes(text: Column, n: int) -> Column:
    """Texts over n bytes are cut to the whole characters that fit n bytes, plus '...'."""
    raw = text.cast("binary")

    def inside_character(pos: int) -> Column:
        return F.hex(F.substring(raw, pos, 1)).between("80", "BF")

    cut = (
        F.when(~inside_character(n + 1), n)
        .when(~inside_character(n), n - 1)
        .when(~inside_character(n - 1), n - 2)
        .otherwise(n - 3)
    )
    head = F.substring(raw, F.lit(1), cut).cast("string")
    return F.when(F.octet_length(text) > n, F.concat(head, F.lit("..."))).otherwise(text)


def log_fingerprint(masked: Column) -> Column:
    return F.sha2(masked, 256)


def raw_hash_short(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 32)


def token_estimate(text: Column) -> Column:
    return whole_div(F.octet_length(text), fv.BYTES_PER_TOKEN).cast("int")


def timestamp_range(text: Column) -> Column:
    """Earliest and latest timestamp written in the text; both null when there is none."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(TIMESTAMP), F.lit(0)),
        lambda s: F.try_to_timestamp(F.translate(s, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    found = F.array_compact(found)
    return F.struct(F.array_min(found).alias("start"), F.array_max(found).alias("end"))


def embed_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n"), content)
