"""Text rules as column functions: key cleaning, skill lists, seniority labels, links.

All of them map null to what the docstring says and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that a seniority may have; all others are unknown. Fixed values.
SENIORITY_LABELS = ("intern", "junior", "mid", "senior", "lead", "executive", "not_applicable", "unknown")

_ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_key(value: Column) -> Column:
    """Lower case, runs of any white space as one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), _ANY_SPACE, " "))


def clean_key_sql(value: Column) -> Column:
    """The variant of the star schema's models: spaces are trimmed before white space collapses, so
    that a leading tab leaves a space. Kept for parity with keys cleaned in SQL."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\s+", " ")


def parse_semicolon(value: Column) -> Column:
    """The trimmed, non-empty items of a semicolon-separated list; null gives null."""
    return F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda x: x != "")


def clean_list_item(value: Column) -> Column:
    """Fit for a semicolon-separated list: line ends become spaces, semicolons commas."""
    return F.trim(F.translate(value, "\n;", " ,"))


def clean_seniority(value: Column) -> Column:
    """The label in its fixed spelling; whatever isn't a label, null too, is unknown."""
    label = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    return F.when(label.isin(*SENIORITY_LABELS), label).otherwise(F.lit("unknown"))


def distinct_skills(skills: Column, most: int = 10) -> Column:
    """The first spelling of each skill, compared in lower case, in order; ``most`` of them."""
    first = F.filter(skills, lambda x, i: F.array_position(F.transform(skills, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def token_sort(value: Column) -> Column:
    """Words in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(value, r"\s+"), lambda x: x != "")), " ")


def job_id_from_url(url: Column) -> Column:
    """The digits after a dash before ``?position``, else the first digits after a dash, else null."""
    exact, loose = (F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"-(\d+)(?=\?position)", r"-(\d+)"))
    return F.coalesce(exact, loose)


def clean_url(url: Column) -> Column:
    """Of the query only the first ``position`` and ``pageNum``, in this order; the rest as it was."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    tail = F.regexp_extract(url, r"(#.+)$", 1)

    def kept(name: str) -> Column:
        return F.nullif(F.regexp_extract(query, rf"(?:^|&)({name}=[^&]*)", 1), F.lit(""))

    pairs = F.concat_ws("&", kept("position"), kept("pageNum"))
    return F.when(url.isNotNull(), F.concat(head, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""), tail))


def clean_html_text(value: Column) -> Column:
    """No-break spaces as spaces, runs of spaces and tabs as one space, no white space at the ends;
    line ends inside stay."""
    spaced = F.regexp_replace(F.replace(value, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(spaced, r"^(?U)\s+|(?U)\s+$", "")


# --- seniority rules: the first that holds decides. Fixed word lists. ---

EXECUTIVE = "director|executive|vp|vice president|c-level|founder|owner|head|chief|ceo|cto|cfo|coo"
LEAD = "lead|team lead|principal|staff"
SENIOR = "senior|sr|experienced|iii|iv"
MID = "mid|mid-level|intermediate|ii"
JUNIOR = "junior|jr|entry|entry-level|associate|early career"
INTERN = "intern|internship|trainee|student"
NO_TITLE = "open|open to work|looking for|seeking|opportunit(y|ies)|various|multiple positions|submit your resume|tbd|not specified|n/a"
YEARS = r"([0-9]+)[ ]*\+?[ ]*(yrs?|years?)"


def _has(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def _levels(key: Column, raw: bool) -> Column:
    out = F.when(key.rlike(_has(EXECUTIVE)), "executive").when(key.rlike(_has(LEAD + ("|manager" if raw else ""))), "lead")
    for words, label in ((SENIOR, "senior"), (MID, "mid"), (JUNIOR, "junior"), (INTERN, "intern")):
        out = out.when(key.rlike(_has(words)), label)
    return out


def seniority_from_raw(value: Column) -> Column:
    """The level that a raw seniority label stands for, the highest it names; else unknown."""
    return _levels(clean_key(value), True).otherwise("unknown")


def seniority_from_title(value: Column) -> Column:
    """The level that a job title tells: by keyword, else by years of experience; not_applicable
    if it tells none, unknown if it is no title."""
    key = clean_key(value)
    years = F.regexp_extract(key, YEARS, 1)
    n = F.nullif(years, F.lit("")).try_cast("bigint")
    out = _levels(key, False).when(n >= 6, "senior").when(n >= 3, "mid").when(n >= 0, "junior")
    return out.when((key == "") | key.rlike(_has(NO_TITLE)), "unknown").otherwise("not_applicable")
