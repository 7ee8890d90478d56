"""Text cleaning as column expressions; entities and Unicode forms go through one Arrow function."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed


@dataclass(frozen=True)
class CleaningOptions:
    comments: bool = True
    entities: bool = True
    tags: bool = True
    form: str | None = "NFKC"
    control: bool = True
    urls: bool = False
    emails: bool = True
    phones: bool = True
    patterns: tuple[str, ...] = field(default_factory=lambda: tuple(fixed.BOILERPLATE))
    spaces: bool = True
    newlines: int | None = 2
    strip_lines: bool = True
    least: int = 10


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, f"(?s){fixed.COMMENT}", "")


_DECIMAL, _HEXADECIMAL = re.compile(r"&#(\d+);"), re.compile("&#x([0-9a-fA-F]+);")


def _character(digits: str, base: int) -> str:
    """The character of a number, U+FFFD where there is none."""
    n = int(digits, base) if len(digits) <= 4000 else -1
    return chr(n) if 0 <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"


def unescaped(text: str) -> str:
    """HTML's entities decoded, then numbers that this has made or that are written in digits of other scripts: decimal ones, then hexadecimal ones."""
    text = html.unescape(text)
    if "&#" in text:
        text = _DECIMAL.sub(lambda m: _character(m[1], 10), text)
        text = _HEXADECIMAL.sub(lambda m: _character(m[1], 16), text)
    return text


def decode_entities(text: Column) -> Column:
    """HTML entities, named and numeric, to their characters, in the two passes of unescaped()."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(unescaped, na_action="ignore")

    return decode(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, fixed.TAG, " ")


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form; ASCII text is in every form."""

    @F.pandas_udf("string")
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v.isascii() else unicodedata.normalize(form, v), na_action="ignore")

    return normalise(text)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, "[\\p{Cc}&&[^\\t\\n\\r]]", "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){fixed.URL}", "")


def strip_emails(text: Column) -> Column:
    """A match can only begin where no letter of a name stands before: with this said, a run without "@" is read once."""
    once = "(?<![a-zA-Z0-9._%+-])" + fixed.EMAIL.replace("+@", "++@", 1)
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, once, "")).otherwise(text)


def strip_phones(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){fixed.PHONE}", "")


def strip_patterns(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?iumd){p}", "")
    return text


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]+", " ")


def collapse_newlines(text: Column, most: int = 2) -> Column:
    return F.regexp_replace(text, "\\n{3,}", "\n" * most)


def strip_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?md)[ \\t]+$", ""), "(?md)^[ \\t]+", "")


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def _plain(options: CleaningOptions, array: bool = False):
    """Entities, tags and Unicode form in one Arrow function; texts without "&", "<" or letters beyond ASCII are spared the step."""
    tag = re.compile(fixed.TAG)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        if options.entities and "&" in text:
            text = unescaped(text)
        if options.tags and "<" in text:
            text = tag.sub(" ", text)
        return text if not options.form or text.isascii() else unicodedata.normalize(options.form, text)

    if array:

        @F.pandas_udf("array<string>")
        def plain(values: pd.Series) -> pd.Series:
            return values.map(lambda items: None if items is None else [one(x) for x in items])

    else:

        @F.pandas_udf("string")
        def plain(values: pd.Series) -> pd.Series:
            return values.map(one)

    return plain


def _rest(text: Column, o: CleaningOptions) -> Column:
    """The steps after the Unicode form."""
    if o.control:
        text = strip_control(text)
    if o.urls:
        text = strip_urls(text)
    if o.emails:
        text = strip_emails(text)
    if o.phones:
        text = strip_phones(text)
    text = strip_patterns(text, o.patterns)
    if o.spaces:
        text = collapse_spaces(text)
    if o.newlines is not None:
        text = collapse_newlines(text, o.newlines)
    if o.strip_lines:
        text = strip_lines(text)
    text = strip_ends(text)
    return F.when(F.length(text) < o.least, F.lit("")).otherwise(text)


def clean_text(text: Column, options: CleaningOptions = CleaningOptions()) -> Column:
    """All steps in order; null and texts shorter than options.least are empty."""
    text = F.coalesce(text, F.lit(""))
    if options.comments:
        text = strip_comments(text)
    if options.entities or options.form:
        text = _plain(options)(text)
    elif options.tags:
        text = strip_tags(text)
    return _rest(text, options)


def clean_list(items: Column, options: CleaningOptions = CleaningOptions()) -> Column:
    """Each item cleaned as a text, empty ones dropped, null where none is left."""
    if options.comments:
        items = F.transform(items, strip_comments)
    if options.entities or options.form:
        items = _plain(options, array=True)(items)
    elif options.tags:
        items = F.transform(items, strip_tags)
    kept = F.filter(F.transform(items, lambda x: _rest(F.coalesce(x, F.lit("")), options)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def clean_courses(courses: DataFrame, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """Courses with cleaned texts and lists; codes in capitals, departments in small letters, a title that cleans to nothing stays.

    Optional texts that clean to nothing are null. Every text has a cleaned form, so no row fails and is kept as it was.
    """
    kinds = dict(courses.dtypes)
    steps: dict[str, Column] = {
        "course_code": F.upper(strip_ends(F.col("course_code"))),
        "course_title": F.coalesce(F.nullif(clean_text(F.col("course_title"), options), F.lit("")), F.col("course_title")),
        "department": F.lower(strip_ends(F.col("department"))),
        "year_range": strip_ends(F.col("year_range")),
        **{c: F.nullif(clean_text(F.col(c), options), F.lit("")) for c in ("objectives", "description", "prerequisites", "assessment")},
        **{c: clean_list(F.col(c), options) for c in ("weekly_topics", "learning_outcomes")},
    }
    return courses.withColumns({c: v for c, v in steps.items() if c in kinds})


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)
