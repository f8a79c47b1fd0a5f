"""Text clean-up as column expressions: JVM-side, no shuffle, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, curly marks and what replaces them, the
# ellipsis, and the opening phrase of a chat reply that carries no content.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CURLY = "“”‘’—"
STRAIGHT = "\"\"''-"
ELLIPSIS = "..."
BOILERPLATE = (
    rf"(?iU)^{SPACE}*of course\b[.,:!]*{SPACE}*"
    rf"here(?:{SPACE}+is|['’]s){SPACE}+"
    rf"(?:(?:the|a){SPACE}+)?"
    r"continuation\b"
    rf"(?:{SPACE}+of\b(?:{SPACE}+(?:that|the){SPACE}+text\b)?)?"
    rf"(?:{SPACE}*,?{SPACE}*written{SPACE}+in{SPACE}+the{SPACE}+style{SPACE}+of{SPACE}+[^.:]+)?"
    rf"{SPACE}*[:.]?{SPACE}*"
)


# The same class for scanning long texts: one look-up for Latin-1 characters, one
# range test for all others.
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
_SPACE = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0" + _WIDE + "]"
_NOT_BLANK = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0" + _WIDE + "]"
# runs of white space, except a single blank, which stays as it is
_RUNS = f"{_NOT_BLANK}{_SPACE}*| {_SPACE}+"


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def words(text: Column, limit: int | None = None) -> Column:
    """White-space tokens, the first ``limit`` if given; an empty array for a blank text."""
    if limit is None:
        return F.array_remove(F.split(text, _SPACE + "+"), "")
    # one part may be empty, and the last one holds all that is left
    return F.slice(F.array_remove(F.split(text, _SPACE + "+", limit + 2), ""), 1, limit)


def _pick(test: Column, first: Column, second: Column) -> Column:
    """``first`` where ``test`` holds. Both are always evaluated, so that what they and
    the test have in common is computed once."""
    return F.get(F.array(first, second), F.when(test, 0).otherwise(1))


def to_text(value: Column) -> Column:
    return value.cast("string")


def strip_prompt_prefix(full: Column, prompt: Column) -> Column:
    """``full`` without its first ``length(prompt)`` characters, whatever they are."""
    return F.substring(full, F.length(prompt) + 1, F.length(full))


def clean_continuation(text: Column) -> Column:
    return collapse(F.replace(text, F.lit('"'), F.lit("'")))


def fold_typography(text: Column) -> Column:
    return F.replace(F.translate(text, CURLY, STRAIGHT), F.lit(ELLIPSIS), F.lit(" "))


def normalize_for_match(text: Column) -> Column:
    """Typography folded, ASCII punctuation dropped, white space collapsed; case kept.

    All curly marks turn into punctuation, so both go in one step.
    """
    marks = rf"[\p{{Punct}}{CURLY}]+"
    return collapse(F.regexp_replace(F.replace(text, F.lit(ELLIPSIS), F.lit(" ")), marks, ""))


def remove_overlap(prompt: Column, text: Column) -> Column:
    """Cut an echo of the prompt out of a reply.

    Exact echoes go wherever they stand. If the normalised prompt is still found in
    the normalised remainder, only the last N words are kept, N being the character
    offset of the end of the match (a quirk kept for equal results; 0 keeps all).
    """
    rest = F.replace(text, prompt, F.lit(""))
    needle = normalize_for_match(prompt)
    found = F.instr(normalize_for_match(rest), needle)
    tokens = words(rest)
    total = F.size(tokens)
    end = found - 1 + F.length(needle)
    keep = F.least(_pick((found > 0) & (end > 0), end, total), total)
    return F.array_join(F.slice(tokens, total - keep + 1, keep), " ")


def remove_boilerplate(text: Column) -> Column:
    return strip(F.regexp_replace(text, BOILERPLATE, ""))


def truncate_new_tokens(prompt: Column, text: Column, limit: int = 20) -> Column:
    """Keep ``limit`` white-space tokens beyond those of the prompt.

    Tokens are counted on prompt and text joined without a separator, so the seam may
    merge two of them. A text within the limit is returned as it is.
    """
    seen = F.size(words(prompt))
    full = words(F.concat(prompt, text))
    cut = F.array_join(F.slice(full, seen + 1, limit), " ")
    return _pick(F.size(full) - seen <= limit, text, cut)


def clean_response(prompt: Column, text: Column, limit: int = 20) -> Column:
    """The clean-up of a chat reply: overlap, boilerplate, token limit, in this order."""
    return truncate_new_tokens(prompt, remove_boilerplate(remove_overlap(prompt, text)), limit)
