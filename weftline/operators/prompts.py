"""Prompts of requests: put together with context and media, and read back from request lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import fill_languages, fill_template, is_blank
from weftline.operators.jsonl import kind_at, text_at


def with_context(prompt: Column, context: Column) -> Column:
    """The context at ``{{ .ContextualInformation }}``, or after the prompt and a blank line; nothing without one."""
    at = prompt.rlike(r"\{\{\s*\.\s*ContextualInformation\s*\}\}")
    told = F.coalesce(context, F.lit(""))
    return F.when(at, fill_template(prompt, {"ContextualInformation": told})).when((told != "") & (prompt != ""), F.concat(prompt, F.lit("\n\n"), told)).otherwise(F.concat(prompt, told))


def media_parts(text: Column, images: Column | None = None, audio: Column | None = None, endpoint: str = "chat") -> Column:
    """A message's parts: images before the text, or audio after it. Types that a part lacks are null and left out in JSON."""
    if images is not None and audio is not None:
        raise ValueError("MUTUALLY_EXCLUSIVE_MEDIA")
    if audio is not None and endpoint.endswith(("responses", "completions")):
        raise ValueError("AUDIO_NOT_SUPPORTED")
    if images is not None and endpoint == "completions":
        raise ValueError("MEDIA_NOT_SUPPORTED")
    kind = "array<struct<type:string,text:string,image_url:struct<url:string>,input_audio:struct<data:string,format:string>>>"
    none = F.lit(None)
    plain = F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("struct<url:string>").alias("image_url"), none.cast("struct<data:string,format:string>").alias("input_audio"))
    if images is not None:
        shown = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), none.cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url"), none.cast("struct<data:string,format:string>").alias("input_audio")))
        return F.concat(shown, F.array(plain)).cast(kind)
    if audio is not None:
        heard = F.struct(F.lit("input_audio").alias("type"), none.cast("string").alias("text"), none.cast("struct<url:string>").alias("image_url"), audio.alias("input_audio"))
        return F.array(plain, heard).cast(kind)
    return F.array(plain).cast(kind)


def _parts_text(content: Column, kinds: tuple[str, ...]) -> Column:
    """Texts of the parts of the given types, joined; parts of others are empty."""
    one = lambda p: F.when(text_at(p, "$.type").isin(*kinds) & (kind_at(p, "$.text") == "STRING"), text_at(p, "$.text")).otherwise("")
    return F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(one(p), F.lit(""))), "")


def _contents(v: Column, path: str, kinds: tuple[str, ...], strings: bool) -> Column:
    """The contents of the messages at a path, a line end between; a content of another shape is empty."""

    def one(m: Column) -> Column:
        kind, content = kind_at(m, "$.content"), F.try_variant_get(m, "$.content", "variant")
        listed = F.when(kind.startswith("ARRAY"), _parts_text(content, kinds))
        return F.coalesce(F.when(kind == "STRING", text_at(m, "$.content")).otherwise(listed) if strings else listed, F.lit(""))

    return F.array_join(F.transform(F.try_variant_get(v, path, "array<variant>"), one), "\n")


def prompt_text(v: Column) -> Column:
    """What a request asks, of its messages, else its prompt, else its input; empty for other bodies."""
    return (
        F.when(kind_at(v, "$.body.messages").startswith("ARRAY"), _contents(v, "$.body.messages", ("text",), True))
        .when(kind_at(v, "$.body.prompt") == "STRING", text_at(v, "$.body.prompt"))
        .when(kind_at(v, "$.body.input") == "STRING", text_at(v, "$.body.input"))
        .when(kind_at(v, "$.body.input").startswith("ARRAY"), _contents(v, "$.body.input", ("input_text", "output_text"), False))
        .otherwise("")
    )


def completed_text(reasoning: Column, text: Column) -> Column:
    """What a parsed result says: its reasoning, if any, and a line end before its text."""
    return F.concat(F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(reasoning, F.lit("\n"))).otherwise(""), F.coalesce(text, F.lit("")))


def assemble(system: Column, prompt: Column, prefill: Column, context: Column, source: Column, target: Column) -> Column:
    """A struct (system, prompt, prefill, error) of a translating batch; a null argument is switched off.

    Languages are filled in, the context joins the prompt or stands for it; ``PROMPT_MISSING`` where
    neither prompt nor prefill says anything.
    """
    told = F.when(is_blank(context), "").otherwise(F.coalesce(context, F.lit("")))
    asked = F.coalesce(with_context(fill_languages(prompt, source, target), told), told)
    begun = fill_languages(prefill, source, target)
    return _prompts(fill_languages(system, source, target), asked, begun, F.lit(None).cast("string"))


def assemble_given(given_system: Column, system: Column, given: Column, preset: Column, prefill: Column) -> Column:
    """As :func:`assemble`, of a prompt that is given or one of a preset, not both; a given system text comes before the configured one."""
    some = lambda c: F.nullif(c, F.lit(""))
    both = F.when(some(given).isNotNull() & some(preset).isNotNull(), "MUTUALLY_EXCLUSIVE_INPUTS")
    return _prompts(F.coalesce(some(given_system), system), F.coalesce(some(given), some(preset), F.lit("")), prefill, both)


def _prompts(system: Column, prompt: Column, prefill: Column, error: Column) -> Column:
    missing = F.when(is_blank(prompt) & is_blank(F.coalesce(prefill, F.lit(""))), "PROMPT_MISSING")
    return F.struct(system.alias("system"), F.nullif(prompt, F.lit("")).alias("prompt"), prefill.alias("prefill"), F.coalesce(error, missing).alias("error"))
