"""Metadata predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def matches(**wanted) -> Column | None:
    """All given fields: null is skipped, an empty list too, a list means one of its values. None if nothing is asked."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if v is not None and not (isinstance(v, (list, tuple, set)) and not v)]
    return reduce(lambda a, b: a & b, parts) if parts else None


def keep(df, **wanted):
    condition = matches(**wanted)
    return df if condition is None else df.filter(condition)


def hit_filter(departments=None, year_range=None, course_type=None, semester=None) -> Column | None:
    names = [d.lower() for d in departments] if departments else None
    return matches(department=names, year_range=year_range, course_type=course_type, semester=semester)


def course_filter(df, department=None, semester=None, year=None, course_type=None, code_prefix=None):
    """Courses of a department, semester, year of study (two semesters), type and code prefix; null asks nothing."""
    df = keep(df, department=department, semester=semester, course_type=course_type)
    if year is not None:
        df = df.filter(F.col("semester").isin(2 * year - 1, 2 * year))
    if code_prefix is not None:
        df = df.filter(F.split_part("course_code", F.lit(" "), F.lit(1)) == code_prefix.upper())
    return df


def question_filter(df, kind=None, difficulty=None, department=None, is_trap=None, tags=None):
    df = keep(df, question_type=kind, difficulty=difficulty, is_trap=is_trap)
    if department is not None:
        df = df.filter(F.lower("target_department") == department.lower())
    if tags:
        df = df.filter(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*(F.lit(t.lower()) for t in tags))))
    return df
