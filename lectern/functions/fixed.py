"""Phrases, patterns and names that results depend on, in one place.

Everything here is data that must stay as it is for results to agree; the rules that use it are elsewhere.
"""

# Departments and the phrases that name them in questions, in the order in which they are tried.
DEPARTMENTS = ("se", "ce", "eee", "ie")
DEPARTMENT_PHRASES = {
    "se": "software engineering|se",
    "ce": "computer engineering|ce",
    "eee": "electrical|electronics|eee|ee",
    "ie": "industrial engineering|ie",
}
DEPARTMENT_NAMES = {
    "software engineering": "se",
    "software": "se",
    "se": "se",
    "computer engineering": "ce",
    "computer": "ce",
    "ce": "ce",
    "electrical and electronics engineering": "eee",
    "electrical and electronics": "eee",
    "electrical engineering": "eee",
    "eee": "eee",
    "industrial engineering": "ie",
    "industrial": "ie",
    "ie": "ie",
}

# Departments by name, in headings.
DEPARTMENT_TITLES = {
    "se": "Software Engineering",
    "ce": "Computer Engineering",
    "eee": "Electrical and Electronics Engineering",
    "ie": "Industrial Engineering",
}

# Texts of what the catalog answers; %s stands for values.
CATALOG_TEXTS = {
    "mandatory": "MANDATORY COURSES FOR %s - SEMESTER %s\nTotal: %s courses\n",
    "course_with_ects": "- %s: %s (%s ECTS)",
    "course": "- %s: %s",
    "by_prefix": "COURSES WITH CODE STARTING WITH '%s'",
    "by_ects": "COURSES WITH %s ECTS CREDITS",
    "unique": "Total unique courses: %s",
    "more": "... and %s more",
    "by_department": "COURSES IN DEPARTMENT\nTotal: %s\nMandatory: %s\nElective: %s",
}
QUANTITY_TEXTS = {
    "count": "Found %s courses",
    "list": "Listing %s courses",
    "sum_ects": "Total ECTS: %s\nCourses included (%s):",
    "breakdown": "Course breakdown by semester:",
    "compare": "Course comparison by department:",
    "semester": "\n%s (%s courses):\n",
    "department": "\n%s: %s courses\n",
    "more": "\n  ... and %s more",
}

# Sections of a course and their headings.
SECTION_HEADINGS = {
    "objectives": "Course Objectives",
    "description": "Course Description",
    "prerequisites": "Prerequisites",
    "weekly_topics": "Weekly Topics",
    "learning_outcomes": "Learning Outcomes",
    "assessment": "Assessment Methods",
}

# How a course says that it has no prerequisites.
NO_PREREQUISITES = ("none", "n/a", "-", "")

# Ordinals of semesters.
ORDINALS = {
    1: ("first", "1st", "one"),
    2: ("second", "2nd", "two"),
    3: ("third", "3rd", "three"),
    4: ("fourth", "4th", "four"),
    5: ("fifth", "5th", "five"),
    6: ("sixth", "6th", "six"),
    7: ("seventh", "7th", "seven"),
    8: ("eighth", "8th", "eight"),
}

# Patterns by which a question names a semester or a year.
SEMESTER_WORD = r"\bsemester\s+(\d+|one|two|three|four|five|six|seven|eight)\b"
NUMBERED_SEMESTER = r"\b(\d+)(?:st|nd|rd|th)?\s+semester\b"
SEMESTER_NUMBER = r"semester\s*(\d+)"
YEAR_NUMBER = r"year\s*(\d+)"

# Words by which a question names a semester as a filter; the last semester that matches wins.
SEMESTER_WORDS = {
    1: ["first semester", "semester 1", "1st semester", "fall year 1"],
    2: ["second semester", "semester 2", "2nd semester", "spring year 1"],
    3: ["third semester", "semester 3", "3rd semester", "fall year 2"],
    4: ["fourth semester", "semester 4", "4th semester", "spring year 2"],
    5: ["fifth semester", "semester 5", "5th semester", "fall year 3"],
    6: ["sixth semester", "semester 6", "6th semester", "spring year 3"],
    7: ["seventh semester", "semester 7", "7th semester", "fall year 4"],
    8: ["eighth semester", "semester 8", "8th semester", "spring year 4"],
}

# The code prefix before "courses", with capitals only or with any letters.
PREFIX_BEFORE_COURSES = r"\b([A-Z]{2,4})\s+courses?\b"

# How questions ask for the mandatory courses of a semester: pattern, group of the semester, group of the department.
_PLACE = "(?:software|computer|electrical\\s+and\\s+electronics|industrial)(?:\\s+engineering)?"
MANDATORY = [
    (rf"mandatory\s+courses?\s+(?:in\s+)?semester\s+(\d+)\s+(?:for\s+)?({_PLACE})", 1, 2),
    (rf"mandatory\s+courses?\s+(?:for\s+)?({_PLACE})\s+(?:in\s+)?semester\s+(\d+)", 2, 1),
    (rf"({_PLACE})\s+semester\s+(\d+)\s+mandatory", 2, 1),
    (rf"semester\s+(\d+)\s+mandatory\s+courses?\s+(?:for\s+)?({_PLACE})", 1, 2),
    (r"mandatory\s+courses?\s+(?:in\s+)?semester\s+(\d+)\s+(?:for\s+)?(se|ce|eee|ie)(?:\s|$)", 1, 2),
    (r"(se|ce|eee|ie)\s+semester\s+(\d+)\s+mandatory", 2, 1),
]

# How questions count courses by code prefix, by ects and by department.
COUNT_BY_PREFIX = r"how\s+many\s+(?:unique\s+)?courses?\s+(?:have\s+)?(?:a\s+)?(?:course\s+)?code\s+starting\s+with\s+['\"]?(\w+)['\"]?"
COUNT_BY_ECTS = r"how\s+many\s+courses?\s+(?:have\s+)?(?:exactly\s+)?(\d+)\s+ects"
COUNT_BY_DEPARTMENT = r"how\s+many\s+(?:total\s+)?courses?\s+(?:are\s+)?(?:offered\s+)?(?:in\s+)?(?:the\s+)?(\w+(?:\s+engineering)?)\s+department"

# Question patterns by kind, in the order in which kinds are tried.
QUESTION_KINDS = {
    "compare": ["which (department|program) has (more|fewer|most|least)", "compare .* (number|count|total)", "difference (in|between) .* (courses?|ects)"],
    "breakdown": ["breakdown (by|of)", "(courses?|ects) (per|by|each) (semester|year)", "distribution of"],
    "sum_ects": ["(total|sum|how many) ects", "ects (total|credits?|points?)", "credit hours?"],
    "count": ["how many (courses?|classes?|subjects?)", "number of (courses?|classes?|subjects?)", "count (the )?(courses?|classes?)", "total (courses?|classes?)"],
    "list": ["list (all )?(the )?(courses?|classes?)", "what (courses?|classes?) (are|does)", "show (me )?(all )?(the )?(courses?|classes?)"],
}

# Words that name a course type; the last type that matches wins.
COURSE_TYPE_WORDS = {
    "required": ["required", "mandatory", "compulsory", "must take"],
    "elective": ["elective", "optional", "choice"],
    "technical": ["technical", "technical elective", "te"],
    "free": ["free", "free elective", "fe"],
    "service": ["service", "service course"],
}

# Phrases by which an answer says that it found nothing.
TRAP_PHRASES = ["not found", "no information", "could not find", "don't have information", "doesn't exist", "does not exist", "not in the sources", "no data", "unable to find", "not mentioned", "cannot find", "no record"]
RUN_TRAP_PHRASES = ["not found", "no information", "could not find", "don't have", "doesn't exist", "does not exist", "not in the sources", "no data", "unable to find", "not mentioned", "cannot find"]
ABSTENTION_PHRASES = ["not found in", "could not find", "no information about", "don't have information", "not in the sources", "not mentioned in", "unable to find", "no data available", "sources do not contain"]
HEDGING_PHRASES = ["i think", "i believe", "probably", "might be", "could be", "possibly", "it seems", "appears to", "likely", "perhaps", "maybe"]

# Question categories and modes.
CATEGORY_TYPES = {"A": "factual", "B": "factual", "C": "comparison", "D": "counting", "E": "trap"}
MODE_TYPES = {"single": "factual", "topic": "factual", "compare": "comparison", "quant": "counting", "quant_compare": "counting", "trap": "trap"}

# Patterns of codes, citations and quantities.
CODE = r"\b([A-Z]{2,4})\s*(\d{3})\b"
CITATION = r"\[([^\]]+)\]"
QUANTITY = r"\b(\d+(?:\.\d+)?)\s*(?:ECTS|credits?|hours?|semesters?)\b"
ECTS = r"(\d+(?:\.\d+)?)\s*(?:ECTS|ects)"
CREDITS = r"(\d+(?:\.\d+)?)\s*(?:credits?|cr\.?)"

# Patterns of what cleaning removes.
COMMENT = "<!--.*?-->"
TAG = "<[^>]+>"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+|www\.[^\s<>\"{}|\\^`\[\]]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+\d{10,15}"
BOILERPLATE = [
    r"©\s*\d{4}.*?(?:All rights reserved|Tüm hakları saklıdır)\.?",
    r"Last updated:.*?(?:\n|$)",
    r"Page \d+ of \d+",
    r"Print this page",
    r"Back to top",
    r"Cookie policy.*?(?:\n|$)",
]

# Sizes of chunks, in characters.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 1000, 200, 100
