"""What a question asks for, as column expressions over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lectern.functions import fixed


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where there is none (or the group is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def semester_asked(question: Column) -> Column:
    """The semester, 1 to 8, that a question names, or null."""
    low = F.lower(question)
    by_ordinal = F.coalesce(*(F.when(low.rlike(rf"\b(?:{'|'.join(names)})\s+semester\b"), n) for n, names in fixed.ORDINALS.items()))
    word = _found(low, fixed.SEMESTER_WORD)
    cardinal = F.coalesce(F.when(word.rlike("^[0-9]+$"), word.try_cast("int")), *(F.when(word == names[2], n) for n, names in fixed.ORDINALS.items()))
    numbered = _found(low, fixed.NUMBERED_SEMESTER).try_cast("int")
    return F.coalesce(by_ordinal, F.when(cardinal.between(1, 8), cardinal), F.when(numbered.between(1, 8), numbered)).cast("int")


def question_kind(question: Column) -> Column:
    """compare, breakdown, sum_ects, count, list or none: the first kind with a pattern in the question."""
    low = F.lower(question)
    return F.coalesce(*(F.when(_any(low, p), kind) for kind, p in fixed.QUESTION_KINDS.items()), F.lit("none"))


def asked_department(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*(F.when(low.rlike(rf"\b(?:{p})\b"), d) for d, p in fixed.DEPARTMENT_PHRASES.items()))


def asked_semester(question: Column) -> Column:
    """The number after the word semester, else the last semester named by an ordinal or as a season of a year."""
    low = F.lower(question)
    named = [F.when(_contains(low, words), n) for n, words in reversed(fixed.SEMESTER_WORDS.items())]
    return F.coalesce(_found(low, fixed.SEMESTER_NUMBER).try_cast("int"), *named).cast("int")


def asked_year(question: Column) -> Column:
    return _found(F.lower(question), fixed.YEAR_NUMBER).try_cast("int")


def asked_type(question: Column, strict: bool = True) -> Column:
    """The course type named last in the list of types. strict=False matches whole words, so that "te" in "semester" counts no more."""
    low = F.lower(question)
    match = (lambda words: _contains(low, words)) if strict else (lambda words: low.rlike(rf"\b(?:{'|'.join(words)})\b"))
    return F.coalesce(*(F.when(match(words), kind) for kind, words in reversed(fixed.COURSE_TYPE_WORDS.items())))


def asked_prefix(question: Column, strict: bool = True) -> Column:
    """The code prefix before "courses". strict=False takes capitals only, so that "many courses" names none."""
    return F.upper(_found(question, ("(?i)" if strict else "") + fixed.PREFIX_BEFORE_COURSES))


def department_of(name: Column) -> Column:
    """The department with this name, or null."""
    return F.coalesce(*(F.when(F.trim(name) == n, d) for n, d in fixed.DEPARTMENT_NAMES.items()))


def mandatory_lookup(question: Column) -> Column:
    """struct(semester, department) where a question asks for the mandatory courses of a semester, else null."""
    low = F.lower(question)

    def one(pattern: str, s: int, d: int) -> Column:
        semester, department = _found(low, pattern, s).try_cast("int"), department_of(_found(low, pattern, d))
        return F.when(semester.between(1, 8) & department.isNotNull(), F.struct(semester.alias("semester"), department.alias("department")))

    return F.coalesce(*(one(*m) for m in fixed.MANDATORY))


def counting_lookup(question: Column) -> Column:
    """struct(kind, value) where a question counts by code prefix, ects or department, else null."""
    low = F.lower(question)
    prefix = F.upper(_found(low, fixed.COUNT_BY_PREFIX))
    ects = _found(low, fixed.COUNT_BY_ECTS)
    department = department_of(_found(low, fixed.COUNT_BY_DEPARTMENT))
    kinds = (("count_by_prefix", prefix), ("count_by_ects", ects), ("count_by_department", department))
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in kinds))


def route(question: Column) -> Column:
    """mandatory, counting or semantic: which path answers a question."""
    return F.when(mandatory_lookup(question).isNotNull(), "mandatory").when(counting_lookup(question).isNotNull(), "counting").otherwise("semantic")
