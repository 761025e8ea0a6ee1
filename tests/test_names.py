"""Person and company names, as column expressions."""

import pytest
from pyspark.sql import functions as F

from moniker.functions import names as N
from moniker.functions import scripts as S
from moniker.functions import variants as V
from moniker.functions.base import words


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Acme Corp.", "acme"), ("ACME  corporation", "acme"), ("3M Company", "3m"), ("Società Ltd", "societ"), ("Inc.", ""), ("AT&T Inc", "at t"), ("", "")],
)
def test_canonical_key(spark, raw, key):
    assert value(spark, V.canonical_key(lit(raw))) == key


@pytest.mark.parametrize(
    ("token", "titled"),
    [("MCMINN", "McMinn"), ("e.a.", "E.A."), ("jean-michel", "Jean-Michel"), ("O'NEIL", "O'neil"), ("j-m", "J-M"), ("mc", "Mc"), ("élan", "Élan")],
)
def test_title_token(spark, token, titled):
    assert value(spark, N.title_token(lit(token))) == titled


def test_strip_marks(spark):
    assert value(spark, N.strip_marks(lit("Łódź Ørsted Æsir Müller ẞ"))) == "Lodz Orsted Aesir Muller ẞ"
    assert value(spark, N.digraph(lit("Müller Ørsted ßa"))) == "Mueller Oersted ssa"


@pytest.mark.parametrize(("token", "forms"), [("Ernst", ["E."]), ("Jean-Michel", ["J.-M.", "J-M", "JM"]), ("-", [])])
def test_initial_forms(spark, token, forms):
    assert value(spark, N.initial_forms(lit(token))) == forms


@pytest.mark.parametrize(
    ("given", "family", "usable"),
    [("Ernst A.", "Mayr", True), ("G", "Mayr", False), ("G.", "Mayr", False), ("Ernst", "M.", False), ("", "Mayr", False), ("J.-M. Paul", "X Yz", True)],
)
def test_usable(spark, given, family, usable):
    assert value(spark, N.is_usable(lit(given), lit(family))) is usable


def test_person_variants(spark):
    got = value(spark, V.person_variants(lit("Ernst August"), lit("van der Berg")))
    assert got[:4] == ["Ernst August Van Der Berg", "ERNST AUGUST VAN DER BERG", "Van Der Berg, Ernst August", "VAN DER BERG, ERNST AUGUST"]
    for form in ("E. A. van der Berg", "E.A. Van Der Berg", "Ernst A. van der Berg", "van der Berg, E.A.", "Ernst van der Berg"):
        assert form in got
    assert len(got) == len(set(got))


def test_person_variants_with_accents_hyphens_and_suffix(spark):
    got = value(spark, V.person_variants(lit("jean-michel"), lit("Müller jr")))
    for form in ("Jean-Michel Müller Jr.", "Jean Michel Mueller Junior", "J.-M. Muller Jr", "JM MÜLLER JR."):
        assert form in got
    assert not any(form.endswith("Müller") for form in got)
    assert value(spark, V.person_variants(lit("Ann"), lit(" "))) == []
    assert value(spark, V.person_variants(lit(""), lit("Plato"))) == ["Plato", "PLATO"]


def test_alternatives_leave_out_swapped_names(spark):
    base = value(spark, V.person_variants(lit("Sedol"), lit("Lee")))
    got = value(spark, V.with_alternatives(lit("Sedol"), lit("Lee"), F.array(F.lit("Yi Sedol"), F.lit("Sedol Yi"))))
    assert got[: len(base)] == base and "Sedol Yi" in got and "Yi Sedol" not in got


def test_company_variants(spark):
    got = value(spark, V.company_variants(lit("johnson & JOHNSON co., ltd.")))
    for form in ("Johnson & Johnson Co., Ltd.", "Johnson and Johnson Co Ltd.", "JOHNSON & JOHNSON", "Johnson & Johnson"):
        assert form in got
    assert len(got) <= V.MOST_COMPANY_FORMS
    assert value(spark, V.company_variants(lit("S.à r.l."))) == ["S.à R.L", "S.À R.L", "S.a R.L", "S.A R.L"]
    assert value(spark, V.company_variants(lit("3M"))) == ["3M"]
    assert "Europe Brands S.A.R.L." in value(spark, V.company_variants(lit("europe brands S.à r.l.")))


@pytest.mark.parametrize(
    ("shown", "given", "family"),
    [("Ada Lovelace", "Ada", "Lovelace"), ("Lovelace, Ada", "Ada", "Lovelace"), ("King, Martin Luther Jr.", "Martin Luther", "King Jr."), ("Plato", "", "Plato"), ("", "", ""), ("A, B, C", "B, C", "A")],
)
def test_split_display(spark, shown, given, family):
    assert tuple(value(spark, N.split_display(lit(shown)))) == (given, family)


def test_heal(spark):
    assert tuple(value(spark, N.heal(lit("Ada King"), lit("")))) == ("Ada", "King")
    assert tuple(value(spark, N.heal(lit("Ada R."), lit("")))) == ("Ada R.", "")
    assert tuple(value(spark, N.heal(lit("Ada"), lit("King")))) == ("Ada", "King")


def test_scripts(spark):
    assert value(spark, S.in_script(lit("ฟยอodor"), lit("th"))) is False
    assert value(spark, S.in_script(lit("Фёдор 2"), lit("cy"))) is True
    assert value(spark, S.in_script(lit("12"), lit("cy"))) is False
    assert value(spark, S.in_script(lit("abc"), lit("la"))) is True
    name = S.cyrillic_name(lit("Иван Иванович Петров"))
    assert tuple(value(spark, name)) == ("Иван", "Иванович", "Петров")
    forms = value(spark, S.expand(lit("Фёдор Иванов"), lit("cy")))
    assert forms[0] == "Фёдор Иванов" and "Федор Иванов" in forms and "Иванов Ф." in forms
    assert value(spark, S.order_flips(lit("王小明"), lit("cn"))) == ["王小明", "小明王"]
    assert value(spark, S.order_flips(lit("田川光一"), lit("cn"))) == ["田川光一"]
    assert value(spark, S.order_flips(lit("김·철수"), lit("kr"))) == ["김·철수", "철수·김"]


def test_simplified_and_traditional(spark):
    table = S.simplified_traditional(spark)
    assert len(table[0]) == len(table[1])
    if table[0]:
        assert "東" in "".join(value(spark, S.expand(lit("东明"), lit("cn"), table)))


def test_words_splits_as_python_does(spark):
    text = "  a b c\td\x1ce \n"
    assert value(spark, words(lit(text))) == text.split()


def test_sql_functions_agree(spark):
    from moniker.functions.register import register

    register(spark)
    rows = ["Acme Corp.", "Łódź Ørsted Müller", "E.A.", " G ", "J.-M. Paul", "", "3M & Söhne GmbH", "æther's \\ d"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    df.createOrReplaceTempView("names")
    pairs = {
        "canonical_key(x)": V.canonical_key(F.col("x")),
        "is_initial(x)": N.is_initial(F.col("x")),
        "is_usable_name(x, x)": N.is_usable(F.col("x"), F.col("x")),
        "strip_diacritics(x)": N.strip_marks(F.col("x")),
        "written_out(x)": N.digraph(F.col("x")),
        "name_words(x)": words(F.col("x")),
    }
    for sql, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {sql} FROM names").collect()]
        assert got == [r[0] for r in df.select(column).collect()], sql
    assert spark.sql("SELECT cluster_is_valid('la{A}\tcy{Б}'), cluster_is_valid('cy{Б}'), cluster_is_valid('la{}')").first() == (True, False, False)
