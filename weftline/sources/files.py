"""Files in and out: texts, JSONL, whole JSON, media, checks before a run, and the ways a target is written.

Everything that reads or writes rows goes through Spark's readers and writers; only small control
files (lists of patterns, configuration) and names are handled on the driver, through Hadoop's file
systems, so that any store that Spark reads will do.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, parsed_json, trim_all

#: Fixed: the largest source that is taken, in bytes.
MOST_BYTES = 100 * 1024 * 1024
#: Fixed: media by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
AUDIO_TYPES = ("mp3", "mp4", "mpeg", "mpga", "m4a", "wav", "webm")


class FileProblem(ValueError):
    """A check that failed; ``code`` names it."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def validate(spark: SparkSession, source: str | None = None, target: str | None = None, most_bytes: int = MOST_BYTES) -> None:
    """ENOENT, FILE_TOO_LARGE, or SOURCE_TARGET_SAME, in that order."""
    if source is not None:
        fs, where = _fs(spark, source)
        if not fs.exists(where):
            raise FileProblem("ENOENT", source)
        if fs.getContentSummary(where).getLength() > most_bytes:
            raise FileProblem("FILE_TOO_LARGE", source)
        if target is not None and fs.makeQualified(where).toString() == fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(target)).toString():
            raise FileProblem("SOURCE_TARGET_SAME", source)


def text_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, text): one row for each file, its whole text."""
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line): lines of files of any size, numbered from 1 in each file; a file may be read by many tasks.

    A line's place is its block's start and its row number in the block; blocks are counted and
    offset, so that no task holds a file.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    inside = Window.partitionBy("file", "_block").orderBy("_at")
    before = Window.partitionBy("file").orderBy("_block")
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n")).select("file", "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    return rows.withColumn("_k", F.row_number().over(inside)).join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_k")).alias("line_no"), "line")


def jsonl_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line, v): JSONL lines that are not blank, with their JSON, null if malformed; raw text and numbers stay."""
    return text_lines(spark, paths).where(~is_blank(F.col("line"))).withColumn("v", parsed_json(F.col("line")))


def is_jsonl(text: Column) -> Column:
    """The first line that is not blank is a JSON object with one of the keys of requests and results."""
    first = trim_all(F.coalesce(F.try_element_at(F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x)), F.lit(1)), F.lit("")))
    keys = F.json_object_keys(first)
    return F.coalesce(first.startswith("{") & parsed_json(first).isNotNull() & F.arrays_overlap(keys, F.array(*map(F.lit, ("custom_id", "response", "error", "body")))), F.lit(False))


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, v, error): whole JSON files; INVALID_JSON where a text is none."""
    rows = text_files(spark, path).withColumn("v", parsed_json(F.col("text")))
    return rows.select("file", "v", F.when(F.col("v").isNull(), "INVALID_JSON").alias("error"))


def stdin_text(spark: SparkSession, stream) -> DataFrame:
    """One row with all that a stream holds, read as UTF-8."""
    raw = stream.read()
    return spark.createDataFrame([("-", raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw)], "file string, text string")


def file_or_literal(spark: SparkSession, value: str | None) -> str:
    """A value that may name a file: blank is empty, one with a newline is itself, an existing file its text, else itself."""
    if value is None or not value.strip():
        return ""
    try:
        if "\n" in value or not exists(spark, value):
            return value
    except IllegalArgumentException:  # no name that a file could have
        return value
    return text_files(spark, value).first()["text"]


# --- names by pattern -----------------------------------------------------------------------------


def pattern_regex(pattern: str) -> str:
    """A glob as a regular expression: ** takes folders, * and ? stay inside one, [] and {} as usual."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(pattern_regex(x) for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def matches(name: Column, patterns: Iterable[str]) -> Column:
    """Whether a relative name meets one of the patterns."""
    found = [name.rlike(f"\\A(?:{pattern_regex(p)})\\z") for p in patterns]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def ignored(name: Column, patterns: Iterable[str]) -> Column:
    """Whether the name, or a folder that it lies in, meets one of the patterns: an ignored folder hides all below it."""
    parts = F.split(name, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    wanted = list(patterns)
    return F.exists(folders, lambda p: matches(p, wanted)) if wanted else F.lit(False)


def list_files(spark: SparkSession, root: str, patterns: Iterable[str] = ("**",), ignore: Iterable[str] = ()) -> DataFrame:
    """(name, path, length) of the files below ``root`` whose relative name meets a pattern and no ignored one; each once."""
    fs, where = _fs(spark, root)
    base = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.substring_index(F.col("path"), base, -1)
    return rows.withColumn("name", name).where(matches(F.col("name"), patterns) & ~ignored(F.col("name"), ignore)).select("name", "path", "length").dropDuplicates(["name"])


def pattern_list(spark: SparkSession, value: str | None) -> list[str]:
    """Patterns from a file (one a line, # begins a comment) or a list with colons; without repeats, in order."""
    text = file_or_literal(spark, value)
    rows = text.splitlines() if value is not None and text != value else text.replace("\n", ":").split(":")
    return list(dict.fromkeys(x.strip() for x in rows if x.strip() and not x.strip().startswith("#")))


# --- media and configuration ------------------------------------------------------------------------


def image_urls(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, url): data URLs of the images among the files, each content once; other files are left out."""
    return data_urls(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content"))


def _base64(content: Column) -> Column:
    """In one line; Spark may wrap."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def data_urls(rows: DataFrame) -> DataFrame:
    """(file, url) of rows (file, content) whose extension is an image's, one for each content."""
    mime = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    kind = F.try_element_at(mime, F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)))
    urls = rows.withColumn("url", F.concat(F.lit("data:"), kind, F.lit(";base64,"), _base64(F.col("content")))).where("url is not null")
    return urls.groupBy("url").agg(F.min("file").alias("file")).select("file", "url")


def audio_part(spark: SparkSession, path: str) -> DataFrame:
    """(data, format) of one audio file; UNSUPPORTED_AUDIO for another kind."""
    kind = posixpath.splitext(path)[1].lstrip(".").lower()
    if kind not in AUDIO_TYPES:
        raise FileProblem("UNSUPPORTED_AUDIO", path)
    return spark.read.format("binaryFile").load(path).select(_base64(F.col("content")).alias("data"), F.lit(kind).alias("format"))


def expand_config(config: object, templates: dict[str, str] | None = None) -> object:
    """Puts ``TEMPLATES`` into ``{{KEY}}`` of every string of a configuration, once, with Unix newlines; the templates themselves are not expanded."""
    if templates is None:
        templates = {k: str(v).replace("\r\n", "\n") for k, v in (config.get("TEMPLATES") or {}).items()} if isinstance(config, dict) else {}
        return {k: v if k == "TEMPLATES" else expand_config(v, templates) for k, v in config.items()} if isinstance(config, dict) else config
    if isinstance(config, str):
        return re.sub(r"\{\{(\w+)\}\}", lambda m: templates.get(m[1], m[0]), config.replace("\r\n", "\n"))
    if isinstance(config, dict):
        return {k: expand_config(v, templates) for k, v in config.items()}
    return [expand_config(v, templates) for v in config] if isinstance(config, list) else config


def load_config(spark: SparkSession, path: str, default: dict) -> dict:
    """A JSON configuration, written first from ``default`` if it is not there, with its templates put in."""
    if not exists(spark, path):
        replace_text(spark, path, json.dumps(default, indent=2))
    try:
        return expand_config(json.loads(text_files(spark, path).first()["text"]))
    except ValueError as e:
        raise FileProblem("INVALID_JSON", path) from e


# --- sinks ----------------------------------------------------------------------------------------------


def create_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    """Writes lines to a path that must not exist (TARGET_EXISTS); parts commit together."""
    if exists(rows.sparkSession, path):
        raise FileProblem("TARGET_EXISTS", path)
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def replace_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    """Writes beside the path, then takes its place by a rename, so that readers see the old or the new lines."""
    spark, beside = rows.sparkSession, path.rstrip("/") + ".new"
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(beside)
    fs, where = _fs(spark, path)
    fs.delete(where, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), where):
        raise FileProblem("RENAME_FAILED", path)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by way of a temporary one."""
    fs, where = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise FileProblem("RENAME_FAILED", path)


def append_requests(chunks: DataFrame, path: str, build, order: list[str]) -> int:
    """Appends request lines to a folder of JSONL files, their ids going on after those it holds; the first new number.

    ``build(rows)`` turns rows with ``custom_id`` into a column ``line``. Only the ids of the target are read.
    """
    from weftline.operators.request import global_ids, next_id

    spark, first = chunks.sparkSession, 1
    if exists(spark, path):
        ids = spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("custom_id"))
        first = next_id(ids)
    build(global_ids(chunks, order, first)).select(F.col("line").alias("value")).write.mode("append").text(path)
    return first


def write_parts(parts: DataFrame, path: str, number: str = "part", text: str = "content") -> None:
    """Each part as a folder part=N of its own, below a folder that must not exist; a part ends with one newline, its own or the writer's."""
    if exists(parts.sparkSession, path):
        raise FileProblem("TARGET_EXISTS", path)
    parts.select(F.regexp_replace(text, r"\n\z", "").alias("value"), F.col(number).alias("part")).write.partitionBy("part").text(path)


def take_lock(spark: SparkSession, path: str) -> bool:
    """Creates a lock file unless it is there; whether this call made it."""
    fs, where = _fs(spark, path)
    try:
        fs.create(where, False).close()
    except Exception as e:  # py4j wraps whatever the store throws
        if fs.exists(where):
            return False
        raise FileProblem("LOCK_FAILED", path) from e
    return True


def drop_lock(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, False)
