"""String expressions: normalising, stripping, templates, lengths, tokens (Column -> Column, no Python on the executors)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: white space of the source language's trim: Unicode separators, ASCII controls 9-13, no-break space and byte order mark.
BLANK = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed: characters that normalising deletes: separators, zero-width and direction marks, controls other than tab and newline.
GARBAGE = r"[\x{2028}\x{2029}\x{200B}\x{200E}\x{200F}\x{FEFF}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{0}-\x{8}\x{B}-\x{1F}\x{7F}]"
#: Fixed: what a response's text may hold when a provider blocked it.
MODERATION_WORDS = ("content filter", "moderation", "safety", "policy", "flagged")
#: Fixed: relative paths of the endpoints that are not chat.
ENDPOINT_PATHS = {"completions": "/v1/completions", "responses": "/v1/responses"}
CHAT_PATH = "/v1/chat/completions"
#: Fixed: scripts whose characters count 1.5 tokens each, and symbols that count 2 (digits, # and * among them).
CJK = r"[\x{4E00}-\x{9FA5}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]"
EMOJI = r"[#*0-9\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1FF}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]"

#: The same symbols, found without testing the long class on characters that cannot be in it.
_EMOJI = r"[#*0-9]|(?=[\x{A9}\x{AE}\x{203C}-\x{10FFFF}])" + EMOJI


def is_blank(text: Column) -> Column:
    """Nothing but white space; the search ends at the first other character."""
    return text.rlike(rf"\A{BLANK}*+\z")


def parsed_json(text: Column) -> Column:
    """The variant of a text that is one JSON value, null if it is none.

    Spark's own parser stops after the first value, whatever follows. So the text is parsed as the
    first item of an array whose second one is the text's hash: what follows a value leaves no such array.
    """
    mark = F.xxhash64(text)
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]"))), "$", "array<variant>")
    # A place in the array, not a branch, tells good from bad: so both uses of the pair share one parse.
    whole = F.coalesce(F.try_variant_get(F.get(pair, F.lit(1)), "$", "bigint") == mark, F.lit(False))
    return F.try_element_at(pair, F.when(whole, 1).otherwise(1 << 30))


def trim_all(text: Column) -> Column:
    """Trims every kind of white space, not only spaces."""
    return F.regexp_replace(text, f"\\A{BLANK}+|{BLANK}+\\z", "")


def normalize(text: Column) -> Column:
    """Unix newlines, and no garbage characters."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), GARBAGE, "")


def strip_empty(text: Column) -> Column:
    """Drops lines of spaces and tabs, and such an end of the text; on top of normalize()."""
    return F.regexp_replace(F.regexp_replace(normalize(text), r"(?dm)^[ \t]*\n", ""), r"\n[ \t]*\z", "")


def double_newlines(text: Column) -> Column:
    """Without empty lines, then a blank line after every line."""
    return F.regexp_replace(strip_empty(text), "\n+", "\n\n")


def clean_output(text: Column, empty: bool, double: bool) -> Column:
    """What is done to a model's output: asked for both, only empty lines go."""
    return strip_empty(text) if empty else double_newlines(text) if double else normalize(text)


def quoted(literal: str) -> str:
    """A literal for Java's regular expressions."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def delete_tagged(text: Column, start: str, end: str) -> Column:
    return F.regexp_replace(text, f"(?s){quoted(start)}.*?{quoted(end)}", "")


def extract_tagged(text: Column, start: str, end: str) -> Column:
    """What stands between the delimiters: parts that are not empty, trimmed, a blank line between."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){quoted(start)}(.*?){quoted(end)}"), F.lit(1))
    return F.array_join(F.transform(F.filter(found, lambda x: x != ""), trim_all), "\n\n")


def strip_pipeline(text: Column, start: str | None = None, end: str | None = None, extract: bool = False, unformat: bool = False, empty: bool = False, double: bool = False) -> Column:
    """Delimited parts are deleted or extracted, then formatting goes if so asked, then newlines are cleaned: one column, one pass."""
    if start and end:
        text = extract_tagged(text, start, end) if extract else delete_tagged(text, start, end)
    if unformat:
        from weftline.functions.markup import strip_markdown

        text = strip_markdown(text)
    return strip_empty(text) if empty and not double else double_newlines(text) if double else normalize(text)


def delimiters(given: str | None, default: tuple[str, str]) -> tuple[str, str]:
    """A pair from one argument: ``a,b`` is both, ``tag`` is <tag> and </tag>, nothing the default."""
    if not given:
        return default
    if "," in given:
        a, b = given.split(",", 1)
        return a, b
    return (given, "</" + given[1:]) if given.startswith("<") else (f"<{given}>", f"</{given}>")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces ``{{ .Key }}`` once; unknown keys stay, and values are not expanded again.

    The template is cut at its placeholders, so that every value is put in by place, not by search.
    """
    mark = r"\{\{\s*\.\s*(\w+)\s*\}\}"
    keys = F.regexp_extract_all(template, F.lit(mark), F.lit(1))
    shown = F.regexp_extract_all(template, F.lit(mark), F.lit(0))
    texts = F.split(template, mark, -1)
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else F.lit(None).cast("map<string,string>")
    filled = F.zip_with(keys, shown, lambda k, s: F.coalesce(F.try_element_at(known, k), s))
    return F.array_join(F.zip_with(texts, F.concat(filled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def fill_languages(template: Column, source: Column, target: Column) -> Column:
    """``{{ .LanguageSource }}`` and ``{{ .LanguageTarget }}``; here no space may follow the dot."""
    for key, value in (("LanguageSource", source), ("LanguageTarget", target)):
        parts = F.split(template, r"\{\{\s*\." + key + r"\s*\}\}", -1)
        template = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _after(value)), ""))
    return template


def _after(value: Column):
    return lambda x: F.concat(value, x)


def graphemes(text: Column) -> Column:
    """Grapheme clusters; in ASCII without carriage returns they are the characters."""
    plain = (F.octet_length(text) == F.char_length(text)) & ~text.contains("\r")
    return F.when(plain, F.char_length(text)).otherwise(F.regexp_count(text, F.lit(r"\X")))


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def approximate_tokens(text: Column) -> Column:
    """1.5 a CJK character, 2 an emoji (digits, # and * count as such), a quarter of every other UTF-16 unit, rounded up."""
    fewer = F.regexp_replace(text, CJK, "")
    rest = F.regexp_replace(fewer, _EMOJI, "")  # each match is one character, so lengths give the numbers of matches
    return F.ceil(1.5 * (F.char_length(text) - F.char_length(fewer)) + 2.0 * (F.char_length(fewer) - F.char_length(rest)) + utf16_length(rest) / 4.0)


def endpoint_path(endpoint: Column) -> Column:
    """Every name with 'responses' or 'completions' as its last part that is not chat, else chat."""
    last = F.regexp_extract(endpoint, r"([a-z]+)$", 1)
    out = F.lit(CHAT_PATH)
    for name, path in ENDPOINT_PATHS.items():
        out = F.when((last == name) & ~endpoint.contains("chat"), F.lit(path)).otherwise(out)
    return out


def is_moderation_block(status: Column, code: Column, message: Column) -> Column:
    named = F.coalesce(code == "CONTENT_FILTER_TRIGGERED", F.lit(False))
    words = F.coalesce(F.lower(message).rlike("|".join(MODERATION_WORDS)), F.lit(False))
    return named | (F.coalesce(status == 403, F.lit(False)) & words)


def api_error_status(code: Column) -> Column:
    """n of API_ERROR_n, else null."""
    return F.regexp_extract(code, r"^API_ERROR_(\d+)$", 1).try_cast("int")


def session_fragment(path: Column, most: int = 28) -> Column:
    """The base name without its extension, letters, digits, _ and - only, cut before the grapheme that would pass ``most`` UTF-16 units."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    kept = F.regexp_extract_all(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", ""), F.lit(r"\X"), F.lit(0))
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def step(acc: Column, g: Column) -> Column:
        full = acc["full"] | (utf16_length(acc["s"]) + utf16_length(g) > most)
        return F.struct(F.when(full, acc["s"]).otherwise(F.concat(acc["s"], g)).alias("s"), full.alias("full"))

    return F.aggregate(kept, start, step)["s"]


def session_id(path: Column, day: Column) -> Column:
    return F.concat(F.lit("tc_"), session_fragment(path), F.lit("_"), F.date_format(day, "yyyyMMdd"))


def natural_key(name: Column, width: int = 20) -> Column:
    """Sorts numbers in names by value: each run of digits, without leading zeros, is padded to ``width``."""
    parts = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), width, "0")).otherwise(F.lower(x))), "")


def strip_fence(text: Column) -> Column:
    """A trimmed text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(trim_all(text), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")


def normalize_locale(name: Column) -> Column:
    """en_US.UTF-8 becomes en-US."""
    return F.replace(F.split_part(name, F.lit("."), F.lit(1)), F.lit("_"), F.lit("-"))


def merge_pattern(pattern: Column) -> Column:
    """Forward slashes, no ./ or / in front, and a bare name matches in every folder."""
    p = F.regexp_replace(F.replace(pattern, F.lit("\\"), F.lit("/")), r"^(?:\./|/)", "")
    return F.when(p.contains("/"), p).otherwise(F.concat(F.lit("**/"), p))


def java_pattern(pattern: str) -> str:
    """A user's ECMAScript pattern for Java: word bounds are ASCII there, and space takes Unicode's."""
    pattern = pattern.replace("\\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    return re.sub(r"(?<!\\)\\s", lambda _: BLANK, pattern)


def same_collated(a: Column, b: Column) -> Column:
    """Equal but for case and accents."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def match_locale(name: Column, available: dict[str, str]) -> Column:
    """The available locale of that name, else the one that is the default of its language (``available``: locale to language), else null."""
    exact = F.lit(None).cast("string")
    for locale, language in reversed(list(available.items())):
        exact = F.when(F.split_part(name, F.lit("-"), F.lit(1)) == language, locale).otherwise(exact)
    for locale in available:
        exact = F.when(name == locale, locale).otherwise(exact)
    return exact
