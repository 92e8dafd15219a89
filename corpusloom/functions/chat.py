"""Chat records, ChatML text, and requests to and answers from a model."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.functions.text import WHITESPACE, clean_code, strip


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_content(instruction: Column, context: Column) -> Column:
    return F.when(
        F.coalesce(context, F.lit("")) != "",
        F.concat(instruction, F.lit("\n\nContext: "), context),
    ).otherwise(instruction)


def to_messages(instruction: Column, context: Column, output: Column) -> Column:
    return F.array(
        _message("system", F.lit(K.SYSTEM_MESSAGE)),
        _message("user", user_content(instruction, context)),
        _message("assistant", output),
    )


def chatml_turn(role: Column, content: Column) -> Column:
    """One rendered turn; NULL for roles that are not part of a prompt."""
    return F.when(
        role.isin(*K.CHAT_ROLES),
        F.concat(F.lit(K.TURN_START), role, F.lit("\n"), content, F.lit(K.TURN_END)),
    )


ASSISTANT_OPENER = K.TURN_START + "assistant\n"


def chatml(messages: Column, opener: bool = False) -> Column:
    """ChatML of an array of messages, optionally opening the next answer."""
    turns = F.filter(
        F.transform(messages, lambda m: chatml_turn(m["role"], m["content"])),
        lambda t: t.isNotNull(),
    )
    if opener:
        turns = F.array_append(turns, F.lit(ASSISTANT_OPENER))
    return F.array_join(turns, "\n")


def generation_request(code: Column, model: str = K.GENERATION_MODEL) -> Column:
    prompt = F.concat(
        F.lit(K.GENERATION_PROMPT_HEAD), clean_code(code), F.lit(K.GENERATION_PROMPT_TAIL)
    )
    return F.struct(
        F.lit(model).alias("model"),
        prompt.alias("prompt"),
        F.lit(False).alias("stream"),
        F.lit("json").alias("format"),
        F.struct(F.array(*[F.lit(s) for s in K.GENERATION_STOP]).alias("stop")).alias("options"),
    )


def response_text(raw: Column) -> Column:
    """The answer inside a raw response.

    A response that starts with `{` is a JSON object whose `response` field is
    the answer: '' when the field is absent, NULL when it is not a string or
    the JSON is malformed.  The object is parsed as the only element of an
    array, so that text after its closing brace makes it malformed.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    only_one = (
        F.endswith(strip(raw), F.lit("}"))
        & F.try_variant_get(parsed, "$[0]", "variant").isNotNull()
        & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    )
    field = F.try_variant_get(parsed, "$[0].response", "variant")
    from_json = F.when(
        only_one,
        F.when(field.isNull(), F.lit("")).when(
            F.schema_of_variant(field) == "STRING",
            F.try_variant_get(parsed, "$[0].response", "string"),
        ),
    )
    return strip(F.when(F.startswith(strip(raw), F.lit("{")), from_json).otherwise(raw))


def clean_response(raw: Column) -> Column:
    text = strip(F.btrim(F.btrim(response_text(raw), F.lit('"')), F.lit("'")))
    for prefix in K.RESPONSE_PREFIXES:
        text = F.ltrim(
            F.regexp_replace(text, f"^(?i){re.escape(prefix)}", ""), F.lit(WHITESPACE)
        )
    usable = F.length(text).between(K.MIN_RESPONSE_CHARS, K.MAX_RESPONSE_CHARS)
    return F.when(
        usable, F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))
    )


def fallback_prompt(code: Column) -> Column:
    low = F.lower(code)

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    return (
        F.when(has("class ") & has("def __init__"),
               "Create a class with proper initialization and methods.")
        .when(has("class "), "Write a class with the necessary methods.")
        .when(has("def ") & has("return "),
              "Write a function that processes input and returns a result.")
        .when(has("def "), "Create a function to handle the required functionality.")
        .when(has("import ") | has("from "),
              "Write code with the necessary imports and implementation.")
        .when(has("if __name__"), "Create a script with a main execution block.")
        .when(has("try:") | has("except"), "Write code with proper error handling.")
        .otherwise("Write the necessary code implementation.")
    )
