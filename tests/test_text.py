from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from rolescope.functions import text as t, urls
from rolescope.operators import normalize, query_generation as g, structure


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["  A  b\tC\n", "", "x\x1cy  z", "Äpfel  Für"])
def test_normalize_matches_python(spark, text):
    assert one(spark, t.normalize_text("s"), s=text) == " ".join(text.lower().split())
    assert one(spark, t.strip("s"), s=text) == text.strip()


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\n", "\n", "", "a\x0cb\x85c d\n\n"])
def test_split_lines_matches_python(spark, text):
    assert one(spark, t.split_lines("s"), s=text) == text.splitlines()


def test_tokenise(spark):
    assert one(spark, t.tokenise("s"), s="C++ / C# Für 3D-vision") == ["c++", "c#", "f", "r", "3d", "vision"]


def test_unique_ordered(spark):
    assert one(spark, t.unique_ordered(F.col("s")), s=[" Python ", "python", "", "C", " c", "SLAM"]) == ["Python", "C", "SLAM"]


def test_bullets(spark):
    assert one(spark, t.bullets_or_sentences("s"), s="intro\n- one\n * two\n---\n**bold**") == ["one", "two", "", "bold**"]
    assert one(spark, t.bullets_or_sentences("s"), s="Short. A sentence that is long enough.\nAnother line of good length") == [
        "A sentence that is long enough", "Another line of good length"]


def test_clip_and_pack(spark):
    assert one(spark, t.clip_text("s", 12), s="alpha beta, gamma") == "alpha beta"
    words = " ".join(f"word{i}" for i in range(300)) + " " + "x" * 700 + " end"
    packed, expected, current = one(spark, t.pack_words("s", 520), s=words), [], []
    for w in words.split():
        if current and len(" ".join([*current, w])) > 520:
            expected.append(" ".join(current))
            current = [w]
        else:
            current.append(w)
    assert packed == [*expected, " ".join(current)]
    values = [f"value {i}" for i in range(200)]
    packed = one(spark, t.pack_values(F.col("s"), ", ", 100), s=values)
    assert ", ".join(packed) == ", ".join(values) and max(map(len, packed)) <= 100


def test_title_case(spark):
    for text in ("agile robots", "3d vision x1y", "o'neil gmbh"):
        assert one(spark, t.title_case("s"), s=text) == text.title()


def test_round_to_halves_even(spark):
    values = [76.225, 0.125, 2.674, 0.375]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(t.round_to(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]


@pytest.mark.parametrize("text, expected", [
    ("Remote role. Salary EUR 100000-130000. Great", ("EUR", 100000.0, 130000.0)),
    ("Build Industry 4.0. systems. Compensation later.", None),
    ("from $120k", ("USD", 120.0, None)), ("£ 50,000 to 60,000.50", ("GBP", 50000.0, 60000.5)),
])
def test_salary(spark, text, expected):
    got = one(spark, normalize.salary_range("s"), s=text)
    assert (got if expected is None else (got.currency, got.minimum, got.maximum)) == expected


def test_work_mode(spark):
    for text, mode in (("Hybrid or remote", "hybrid"), ("Work from home", "remote"), ("our OFFICE", "onsite"), ("x", "unknown")):
        assert one(spark, normalize.work_mode("s"), s=text) == mode


def test_skills_are_substrings_unless_whole_word(spark):
    text = "JavaScript across teams"
    assert one(spark, normalize.skill_mentions("s"), s=text) == ["c", "java", "ros"]
    assert one(spark, normalize.skill_mentions("s", whole_word=True), s=text) == []


def test_noise_and_vague(spark):
    noise = lambda r, d: one(spark, normalize.is_noise_requirement(F.col("r"), F.col("d")), r=r, d=d)
    assert noise("c", "good skills") and not noise("c", "C++ and C programming") and not noise("go", "")
    vague = lambda r, d: one(spark, normalize.is_vague_requirement(F.col("r"), t.normalize_text("d")), r=r, d=d)
    assert vague("good communication", "we talk") and not vague("Strong communication", "")
    assert not vague("good communication", "excellent  communication needed")


URLS = ["/jobs/1", "detail.html", "../up", "?q=1", "#frag", "https://other.org/x", "//cdn.org/y", "", "a/./b/../c", "../../../z"]


@pytest.mark.parametrize("base", ["https://www.example.com/careers/list?x=1", "http://example.com", "https://example.com/a/b/"])
def test_join_url_matches_urllib(spark, base):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: r.j for r in rows.select("u", urls.join_url(F.lit(base), "u").alias("j")).collect()}
    assert got == {u: urljoin(base, u) for u in URLS}
    assert one(spark, urls.url_host("s"), s=base) == urlparse(base).netloc


def test_page_links_same_host_only(spark):
    html = '<a href="/jobs/1#x">a</a><a class="b" href=\'https://www.k.com/y?a=1&amp;b=2\'>b</a><a href="https://o.com/">c</a>'
    assert one(spark, urls.page_links("u", "h"), u="https://www.k.com/base", h=html) == [
        "https://www.k.com/jobs/1", "https://www.k.com/y?a=1&b=2"]


def test_sections_keep_python_rules(spark):
    got = one(spark, structure.sections("s"), s="intro\n# A\n## B\n\ntext b\n### C\n- c1\n# D")
    assert [(r.heading, r.level, r.content) for r in got] == [("Introduction", 1, "intro"), ("B", 2, "text b"), ("C", 3, "- c1")]
    assert [(r.heading, r.content) for r in one(spark, structure.sections("s"), s="# Only")] == [("Only", "")]
    assert [(r.heading, r.content) for r in one(spark, structure.sections("s"), s="")] == [("Introduction", "")]


def test_child_sections_use_first_parent_only(spark):
    text = "# P\nx\n## Experience\nx\n### Job 1\na\n#### deep\nb\n### Job 2\nc\n## Other\nd\n## More experience\nx\n### Job 3\ne"
    got = one(spark, structure.child_sections(structure.sections("s"), ["experience"]), s=text)
    assert [r.heading for r in got] == ["Job 1", "Job 2"]


def test_dates(spark):
    got = one(spark, structure.date_range(F.col("s")), s="2022-2025")
    assert (got.start, got.end) == ("2022-2025", None)
    got = one(spark, structure.date_range(F.col("s")), s="May 2020 to now")
    assert (got.start, got.end) == ("May 2020", "now")


def test_german_variants(spark):
    assert one(spark, g.german_variants("s"), s="Mapping Engineer") == ["Mapping Engineer", "mapping ingenieur"]
