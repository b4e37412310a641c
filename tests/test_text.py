import pytest
from pyspark.sql import functions as F

from waraq.functions import text as t
from waraq.plans import sqltext as q

LINES = ["١- رأى أرسطوطاليس:", "رأي أرسطوطاليس", "مقدمة (١)", "[٤٧/أ] الفصل الأول", "مُلَخَّصُ البَحْثِ", "(باب العصبات)", "٦", "", " ", "[باب]", "[باب] (٢)", "a & <b>b</b>&nbsp;c", "x  y", "«قول»، ثم"]


@pytest.mark.parametrize("line, want", [("مقدمة (١)", "مقدمه"), ("[٤٧/أ] الفصل الأول", "الفصل الاول"), ("مُلَخَّصُ البَحْثِ", "ملخص البحث"), ("(باب العصبات)", ""), ("٦", ""), ("طيب، صاحب", "طيب صاحب")])
def test_contract_forms(spark, line, want):
    df = spark.createDataFrame([(line,)], "s string")
    assert df.select(t.normalize("s").alias("n")).first().n == want == t.normal(line)


def test_alike(spark):
    assert t.normal("١- رأى أرسطوطاليس:") == t.normal("رأي أرسطوطاليس")
    assert t.anchor_form("[(باب العصبات)]") == t.anchor_form("(باب العصبات)") == "باب العصبات"


DIRT = ["&mdash; x &amp;mdash;", "&#1576;&#x628;&laquo;ق&raquo;", "a &copy b &unknown; &#128; & c", "<i>&lt;b&gt;</i>&amp;lt;", "[باب (١) [٢/ب] &nbsp;]", "(١) (٢) [٤٧/أ] [٢] الفصل", "قال&zwnj;ه &#x200b;"]


@pytest.mark.parametrize("name", ["PLAIN", "STRIP", "NORMAL", "LIGHT", "INSIDE_BRACKETS", "ESCAPE", "SAFE", "TITLE_COLOUR", "EXTRA"])
def test_columns_and_python_agree(spark, name):
    recipe = getattr(t, name)
    df = spark.createDataFrame([(x,) for x in LINES + DIRT] + [(None,)], "s string")
    columns = {r.s: r.n for r in df.select("s", recipe.column("s").alias("n")).collect()}
    run = recipe.python()
    assert columns == {x: run(x) for x in LINES + DIRT} | {None: None}


@pytest.mark.parametrize("column, sql", [(t.plain_text, q.plain), (t.normalize, q.normal), (t.escape_html, q.escaped), (t.safe_name, q.safe_name), (t.strip_title_colour, q.uncoloured), (t.truncate_title, q.shortened)])
def test_sql_written_from_the_contract_agrees(spark, column, sql):
    import duckdb

    lines = LINES + DIRT[4:6] + ['<span class="c5">باب</span>  x', "<b>a</b> &lt;x&gt; &amp;nbsp;", "[(أإآ ىةؤئ)]", "a/b\\c*?  d. ", "one two  three four five six"]
    con = duckdb.connect()
    for r in spark.createDataFrame([(x,) for x in lines], "s string").select("s", column("s").alias("n")).collect():
        assert con.execute(f"SELECT {sql('x')} FROM (SELECT ? AS x)", [r.s]).fetchall()[0][0] == r.n


def test_entities_are_all_resolved(spark):
    import html

    got = [r.n for r in spark.createDataFrame([(x,) for x in DIRT], "s string").select(t.resolved(F.col("s")).alias("n")).collect()]
    assert got == [html.unescape(x) for x in DIRT]


def test_small_functions(spark):
    df = spark.createDataFrame([("  [باب في] ", "a b c d e f", 'x<"&\'>', "  a/b:c*  ", "<span class=\"c5\">t</span> rest", "/book/12/3", None)], "line string, title string, esc string, name string, col string, url string, none string")
    r = df.select(t.bracket_text("line").alias("b"), t.truncate_title("title").alias("t"), t.escape_html("esc").alias("e"), t.safe_name("name").alias("s"), t.safe_name("none").alias("f"),
                  t.strip_title_colour("col").alias("c"), t.extract_id("url", "book").alias("i"), t.escape_html("none").alias("z"), t.normalize("none").alias("n"), t.digits(F.lit("٣٢٥ صفحة")).alias("d"), t.unescape("esc").alias("u")).first()
    assert (r.b, r.t, r.e, r.s, r.f, r.c, r.i, r.z, r.n, r.d) == ("باب في", "a b c d … f", "x&lt;&quot;&amp;&#x27;&gt;", "a_b_c_", "unknown", "rest", 12, "", None, 325)


def test_extra_content_and_prefixes(spark):
    assert not t.says_more("باب في النحو (١)", t.normal("باب في النحو")) and t.says_more("باب في النحو وما يليه من القول", t.normal("باب في النحو"))
    df = spark.createDataFrame([("باب في النحو (١)", "باب في النحو"), ("باب في النحو وما يليه من القول", "باب في النحو")], "a string, b string")
    assert [r.x for r in df.select(t.has_extra_content("a", "b").alias("x")).collect()] == [False, True]
    assert t.unwrap_title("[تمهيد (١)]", "تمهيد") == "تمهيد (١)" and t.unwrap_title("[تمهيد] (١)", "تمهيد") == "تمهيد (١)" and t.unwrap_title("[آخر] (١)", "تمهيد") == "[آخر] (١)"
    assert t.without_heading("اسمه: زيد", "اسمه") == "زيد" and t.without_heading("اسمُه: زيد", "اسمه") == "زيد" and t.without_heading("غيره", "اسمه") == "غيره"
