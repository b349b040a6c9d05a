import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from vocatio.functions import requests, text


def one(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_clean_key_collapses_any_white_space(spark):
    got = one(spark, text.clean_key, [None, "", "  A  B ", "\tFoo", "a  b\n", "ÉA"])
    assert got == ["", "", "a b", "foo", "a b", "éa"]


def test_sql_variant_keeps_a_leading_tab_as_a_space(spark):
    assert one(spark, text.clean_key_sql, ["\tFoo", " a \t b"]) == [" foo", "a b"]


def test_parse_semicolon(spark):
    assert one(spark, text.parse_semicolon, [" a ;; b;", "", None]) == [["a", "b"], [], None]


def test_clean_seniority(spark):
    assert one(spark, text.clean_seniority, [" Senior ", "Not Applicable", "boss", None]) == ["senior", "not_applicable", "unknown", "unknown"]


def test_distinct_skills_keep_first_spelling_and_ten(spark):
    skills = ["Python", "SQL", "python", "sql", *[f"s{i}" for i in range(20)]]
    got = one(spark, text.distinct_skills, [skills], "array<string>")[0]
    assert got == ["Python", "SQL", *[f"s{i}" for i in range(8)]]


def test_token_sort(spark):
    assert one(spark, text.token_sort, ["b a  c"]) == ["a b c"]


def plain_url(url):
    p = urlparse(url)
    q = parse_qs(p.query, keep_blank_values=True)
    return urlunparse((p.scheme, p.netloc, p.path, p.params, urlencode({k: q[k][0] for k in ("position", "pageNum") if k in q}), p.fragment))


def test_clean_url_agrees_with_the_standard_library(spark):
    urls = ["https://a.b/c-12?position=3&pageNum=0&x=1", "https://a.b/c", "https://a.b/c?x=1", "https://a.b/c?pageNum=2&position=1#f", "https://a.b/c?position=&z", "https://a.b/c?position=1&position=2"]
    assert one(spark, text.clean_url, urls) == [plain_url(u) for u in urls]


def test_job_id_from_url(spark):
    assert one(spark, text.job_id_from_url, ["/view/dev-3-at-x-991?position=1", "/view/dev-3-at-x-991", "/view/x", None]) == ["991", "3", None, None]


def test_clean_html_text(spark):
    assert one(spark, text.clean_html_text, ["  a \t b\n c \n"]) == ["a b\n c"]


RAW = {
    "senior": ["Mid, Senior level", "Mid-Senior level", "Senior", "Experienced", "Level III"], "junior": ["Entry level", "Associate", "Early Career"], "intern": ["Internship", "Trainee"], "mid": ["Mid Level", "Intermediate", "Level II"],
    "lead": ["Team Lead", "Manager", "Principal", "Staff"], "executive": ["Director", "VP", "C-Level", "Owner"], "unknown": ["No level specified", "Open role", "TBD"],
}
TITLES = {
    "junior": ["Python Developer, Full Time (2 years experience)", "Data Analyst 1 yr exp", "Software Engineer 0-1 years"], "senior": ["Senior Software Engineer, Backend", "Data Scientist 6+ years", "Financial Analyst 10 yrs"],
    "mid": ["Product Manager 4 yrs", "Software Engineer II", "Intermediate Analyst"], "not_applicable": ["Product Manager", "Driver", "Draftsman (civil/architect)"], "lead": ["Lead/Senior Engineer"],
    "executive": ["VP of Product", "Chief Technology Officer"], "intern": ["Marketing Intern"], "unknown": ["Open to Work", "Looking for Opportunities", "Various Roles", ""],
}


@pytest.mark.parametrize(("rule", "cases"), [(text.seniority_from_raw, RAW), (text.seniority_from_title, TITLES)])
def test_seniority_rules(spark, rule, cases):
    pairs = [(v, label) for label, values in cases.items() for v in values]
    assert one(spark, rule, [v for v, _ in pairs]) == [label for _, label in pairs]


def test_search_url_has_parameters_in_order(spark):
    df = spark.createDataFrame([("data eng", 10, None), ("c++", 20, "7")], "k string, s int, g string")
    url = requests.search_url("http://x/s", F.col("k"), F.col("s"), F.col("g"), f_WT=F.lit(None).cast("string"), sortBy=F.lit("DD"))
    assert [r[0] for r in df.select(url).collect()] == ["http://x/s?keywords=data+eng&geoId=103644278&sortBy=DD&start=10", "http://x/s?keywords=c%2B%2B&geoId=7&sortBy=DD&start=20"]


def test_pages_and_response_classes(spark):
    rows = requests.pages(spark).collect()
    assert len(rows) == 100 and max(r.start for r in rows) == 990 and max(r.batch_no for r in rows) == 9
    assert one(spark, requests.response_class, [200, 404, 429, None], "int") == ["successful", "failed", "retry", "failed"]


def test_runs_stop_after_two_dry_batches(spark):
    df = spark.createDataFrame(list(enumerate([3, 0, 2, 0, 0, 5])), "batch_no int, inserted int")
    assert [r.batch_no for r in requests.runs_until_dry(df).orderBy("batch_no").collect()] == [0, 1, 2, 3, 4]
    assert requests.runs_until_dry(df.where("batch_no < 4")).count() == 4
    assert [r.batch_no for r in requests.runs_until_dry(df, 1).orderBy("batch_no").collect()] == [0, 1]
    assert requests.runs_until_dry(df, 3).count() == 6 and requests.runs_until_dry(df.limit(0)).count() == 0


def test_space_classes_agree_with_python(spark):
    chars = [chr(c) for c in range(1, 0x3100) if re.match(r"\s", chr(c))]
    assert one(spark, text.clean_key, [f"a{c}b" for c in chars]) == ["a b"] * len(chars)
