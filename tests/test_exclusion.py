import random

from pyspark.sql import functions as F

from postledger.operators import exclusion

NAMES = ["Northern  STAFFING AG", "Plain Co", "Straße & Söhne", "  ", None, "STRASSE", "x"]


def kept(df):
    return sorted(r.company or "" for r in df.collect())


def test_company_fragments(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "company string")
    got = exclusion.exclude_companies(rows, [" northern staffing ", "strasse", "", "  "])
    assert kept(got) == ["", "  ", "Plain Co", "x"]
    assert exclusion.exclude_companies(rows, []).count() == len(NAMES)


def test_table_forms_agree_with_list(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "company string")
    fragments = ["sse", "  ", "ß &", "CO", "a much longer fragment than any of the company names here"]
    table = spark.createDataFrame([(f,) for f in fragments], "fragment string")
    by_list = kept(exclusion.exclude_companies(rows, fragments))
    assert kept(exclusion.exclude_companies_by_table(rows, table)) == by_list
    assert kept(exclusion.exclude_companies_by_table(rows, table)) == by_list
    assert kept(exclusion.exclude_companies_by_table(rows, table.limit(0))) == kept(rows)


def test_title_keywords(spark):
    titles = ["Linux Engineer", "Internal Auditor", "Intern", "internship 2024", "Interns wanted", "übintern", "Head of IT"]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    plain = rows.select(exclusion.title_excluded(F.col("title"), ["linux", "", " of "])).collect()
    assert [r[0] for r in plain] == [True, False, False, False, False, False, True]
    word = rows.select(exclusion.title_excluded_by_word(F.col("title"), [" Intern ", "LINUX", " "])).collect()
    assert [r[0] for r in word] == [True, False, True, True, True, False, False]


def test_many_fragment_lengths_equal_plain_search(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abC é") for _ in range(rng.randrange(60))).strip() for _ in range(400)] + [None, "", "a", "ab", "𝒳yz"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, company string")
    fragments = ["".join(rng.choice("abcdé") for _ in range(rng.choice([3, 5, 6, 7, 8]))) for _ in range(300)]
    fragments += [n[a : a + s] for n in names if n for a, s in [(rng.randrange(len(n)), rng.randrange(9, 60))] if rng.random() < 0.3]
    for wanted in (fragments + ["", None, "yz", "𝒳"], ["zz", "b" * 200], ["a"], []):
        table = spark.createDataFrame([(f,) for f in wanted], "fragment string")
        got = {r.pos for r in exclusion.exclude_companies_by_table(rows, table).collect()}
        assert got == {r.pos for r in exclusion.exclude_companies(rows, [f for f in wanted if f]).collect()}
        assert 400 in got and (len(got) < len(names)) == (wanted != [] and wanted[0] != "zz")
