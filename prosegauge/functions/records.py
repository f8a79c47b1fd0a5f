"""Semi-structured records: dict-like strings, service requests and replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.config import ATTRS

_BAD = "_unparsed"


def scored_text(attributes: Sequence[str] = ATTRS) -> T.StructType:
    """``text`` plus one score per attribute."""
    fields = [T.StructField("text", T.StringType())]
    fields += [T.StructField(name, T.DoubleType()) for name in attributes]
    return T.StructType(fields)


#: A quoted string with its escapes, what stands between strings, or a quote that nothing closes. The loops are
#: possessive, so a long string takes no stack.
_TOKENS = r"""(?s)'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++|['"]"""


def _as_json(literal: Column) -> Column:
    """A Python literal as JSON: bare words and escapes are rewritten, each where it may stand."""

    def rewritten(token: Column) -> Column:
        bare = token
        for word, value in (("None", "null"), ("True", "true"), ("False", "false"), ("nan", "NaN")):
            bare = F.regexp_replace(bare, rf"\b{word}\b", value)
        quoted = F.regexp_replace(token, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
        return F.when(F.substring(token, 1, 1).isin("'", '"'), quoted).otherwise(bare)

    return F.array_join(F.transform(F.regexp_extract_all(literal, F.lit(_TOKENS), F.lit(0)), rewritten), "")


def lenient_struct(value: Column, schema: T.StructType) -> Column:
    """Parse a dict-like string; JSON first, a Python literal where that fails.

    What is neither gives a null, so the row stays.
    """
    checked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "true"}
    first = F.from_json(value, checked, options)
    second = F.from_json(_as_json(value), checked, {**options, "allowBackslashEscapingAnyCharacter": "true"})

    def sound(record: Column) -> Column:
        return F.when(record[_BAD].isNull(), F.struct(*[record[name].alias(name) for name in schema.fieldNames()]))

    # a lambda holds each result, so that nothing is parsed twice
    again = F.transform(F.array(second), sound)[0]
    return F.transform(F.array(first), lambda record: F.coalesce(sound(record), again))[0]


def prompt_message(prompt: Column) -> Column:
    """The chat request for one prompt, as a JSON array with one user message."""
    content = F.concat(F.lit("Continue this text: "), prompt)
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))


def chat_content(reply: Column) -> Column:
    return F.get_json_object(reply, "$.choices[0].message.content")


def summary_scores(reply: Column, attributes: Sequence[str] = ATTRS) -> Column:
    """Attribute scores out of a scoring reply, whose keys are in upper case."""
    value = T.StructType([T.StructField("value", T.DoubleType())])
    summary = T.StructType([T.StructField("summaryScore", value)])
    scores = T.StructType([T.StructField(name.upper(), summary) for name in attributes])
    parsed = F.from_json(reply, T.StructType([T.StructField("attributeScores", scores)]))
    return F.struct(
        *[parsed["attributeScores"][name.upper()]["summaryScore"]["value"].alias(name) for name in attributes]
    )


def model_variant(base: Column, variant: Column) -> Column:
    """``base_variant``, or ``base`` where there is no variant; ``-API`` at the end of a base is spelled ``_API``."""
    return F.concat_ws("_", F.regexp_replace(base, "-API$", "_API"), variant)
