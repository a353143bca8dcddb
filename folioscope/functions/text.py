"""Column functions over text: all of them built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of all derived ids, without hyphens. A fixed value.
NAMESPACE_HEX = "a1b2c3d4e5f67890abcdef1234567890"
#: White space in the sense of Unicode and the ASCII separators, but for the newline.
BLANKS = "[\\t\\r\\f\\x0b \\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
WORD = "[\\p{L}\\p{N}_]+"
MAX_EXCERPT = 5000


def normalize_text(c: Column) -> Column:
    """NULs out, at most one blank line in a row, runs of blanks as one space, no blanks at line or text ends.

    Null stays null; a text of blanks alone becomes empty.
    """
    c = F.regexp_replace(F.regexp_replace(c, "\\x00", ""), "\\n{3,}", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, BLANKS, " "), " (?=\\n)", "")
    return F.regexp_replace(c, "^[ \\n]+|[ \\n]+$", "")


def count_tokens(c: Column) -> Column:
    """Words and single marks: the default where no tokenizer is plugged in. Null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))), F.lit(0))


def uuid5(name: Column, namespace_hex: str = NAMESPACE_HEX) -> Column:
    """The name-based UUID (version 5) of ``name`` within a namespace, as its string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def sentences(c: Column) -> Column:
    """Pieces between a full stop, question or exclamation mark and the white space after it; blank ones left out."""
    return F.filter(F.split(c, "(?<=[.!?])\\s+"), lambda s: F.length(F.trim(s)) > 0)


#: Words before a full stop that do not end a sentence. Fixed values.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "ave", "blvd", "dept", "est", "vol", "vs", "etc", "inc", "ltd", "corp", "govt", "approx", "fig", "gen", "no", "ref", "rev", "sgt", "pvt", "e.g", "i.e", "al", "cf",
)


def segment_sentences(c: Column) -> Column:
    """Sentences that start with a capital or a quotation mark, not after a single digit's full stop or an abbreviation."""
    parts = F.split(c, "(?<=[.!?])(?<!\\b\\d\\.)\\s+(?=[A-Z\"'“”])")
    parts = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    short = [F.lit(a) for a in ABBREVIATIONS]

    def add(done: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        goes_on = F.lower(F.regexp_extract(last, "(\\w+)\\.\\s*$", 1)).isin(*short)
        return F.when(goes_on, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def pages(start: Column, end: Column) -> Column:
    """``p. a`` or ``pp. a-b``; null without a first page."""
    return F.when(end.isNotNull() & (end != start), F.concat(F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit("p. "), start.cast("string")))


def citation_label(name: Column, heading: Column, start: Column, end: Column) -> Column:
    """``name, § heading, pages``, what is missing left out; a name must be given."""
    return F.concat_ws(", ", name, F.when(heading != "", F.concat(F.lit("§ "), heading)), pages(start, end))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def file_type(path: Column) -> Column:
    """The supported type that the suffix names, whatever its case, else null; a leading dot makes no suffix."""
    suffix = F.lower(F.regexp_extract(file_name(path), "^.+\\.([^.]+)$", 1))
    return F.when(suffix.isin("pdf", "docx", "txt", "md"), suffix)


def folder_ancestors(folder: Column) -> Column:
    """``/``, ``/a``, ``/a/b`` of ``/a/b``."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(F.size(parts) > 0, F.concat(F.array(F.lit("/")), deeper)).otherwise(F.array(F.lit("/")))


def truncate(c: Column, most: int) -> Column:
    """Text of more than ``most`` characters cut to end in three dots within ``most``."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def fit_name(c: Column, width: int = 55) -> Column:
    """Padded to ``width``, or cut to it with an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(F.rpad(c, width, " "))


def size_text(c: Column) -> Column:
    """Bytes as ``1.5 KB``; terabytes from 1024 GB on."""
    out = F.format_string("%.1f TB", c / 1024.0**4)
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(F.abs(c) < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", c / 1024.0**power)).otherwise(out)
    return F.when(c.isNotNull(), out)


def iso_time(c: Column) -> Column:
    """An ISO date or time as a timestamp, UTC where it names no zone; null for anything else."""
    ok = c.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?([+-]\\d{2}:?\\d{2}|Z)?)?$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(c, "T", " ")))


def time_ago(then: Column, now: Column) -> Column:
    """``3d ago``, ``2h ago``, ``5m ago`` or ``just now``; null for null."""
    s = (F.unix_seconds(now) - F.unix_seconds(then)).cast("long")
    rest = F.pmod(s, F.lit(86400))
    days = F.floor(s / 86400)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d ago"))).when(rest >= 3600, F.concat(F.floor(rest / 3600).cast("string"), F.lit("h ago"))).when(rest >= 60, F.concat(F.floor(rest / 60).cast("string"), F.lit("m ago"))).when(then.isNotNull(), F.lit("just now"))


def parse_timeout(size_bytes: Column) -> Column:
    """Seconds allowed for a file: 60 and 30 more a megabyte, 600 at most; 60 where the size is not known."""
    s = F.floor(60 + F.coalesce(size_bytes, F.lit(0)) / (1024.0 * 1024.0) * 30).cast("int")
    return F.least(F.lit(600), F.greatest(F.lit(60), s))


def augmented_text(text: Column, questions: Column) -> Column:
    """The text below the questions that it answers."""
    lines = F.array_join(F.transform(questions, lambda q: F.concat(F.lit("- "), q)), "\n")
    return F.concat(F.lit("Questions this content answers:\n"), lines, F.lit("\n\n"), text)


def merge_overlapping(texts: Column, most: int = 500) -> Column:
    """Texts put together; where one starts with the end of what is there (up to ``most`` characters), once."""

    def add(done: Column, t: Column) -> Column:
        lengths = F.when(F.least(F.length(done), F.length(t)) > 0, F.sequence(F.least(F.length(done), F.length(t), F.lit(most)), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        shared = F.coalesce(F.try_element_at(F.filter(lengths, lambda i: F.endswith(done, F.left(t, i))), F.lit(1)), F.lit(0))
        return F.when(done.isNull(), t).when(shared > 0, F.concat(done, F.substr(t, shared + 1))).otherwise(F.concat(done, F.lit("\n\n"), t))

    return F.coalesce(F.aggregate(texts, F.lit(None).cast("string"), add), F.lit(""))


def clean_output(c: Column) -> Column:
    """Tool output without ANSI codes, quote marks at line starts and bare fence or format lines."""
    lines = F.split(F.regexp_replace(c, "\\x1b\\[[0-9;]*[A-Za-z]", ""), "\n")
    lines = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("> ")), F.regexp_replace(x, "^[> ]+", "")).otherwise(x))
    return F.array_join(F.filter(lines, lambda x: ~F.trim(x).isin("json", "```json", "```")), "\n")


def code_blocks(c: Column) -> Column:
    """The fenced code blocks of a text, in order."""
    return F.regexp_extract_all(c, F.lit("```[\\s\\S]*?```"), F.lit(0))


def without_code_blocks(c: Column) -> Column:
    """Each fenced block as a numbered placeholder between NULs."""
    blocks = code_blocks(c)
    return F.aggregate(F.sequence(F.lit(0), F.size(blocks)), c, lambda t, i: F.when(i < F.size(blocks), F.regexp_replace(t, "^([\\s\\S]*?)```[\\s\\S]*?```", F.concat(F.lit("$1\u0000CODE_BLOCK_"), i.cast("string"), F.lit("\u0000")))).otherwise(t))


def with_code_blocks(c: Column, blocks: Column) -> Column:
    """Placeholders of :func:`without_code_blocks` back as the blocks they stand for."""
    return F.aggregate(F.sequence(F.lit(0), F.size(blocks)), c, lambda t, i: F.when(i < F.size(blocks), F.replace(t, F.concat(F.lit("\u0000CODE_BLOCK_"), i.cast("string"), F.lit("\u0000")), F.get(blocks, i))).otherwise(t))
