import html
import re

from tesserae.llm import wrappers


def test_article_of_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in wrappers.op5(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_semantics():
    page = (
        "<!doctype html><title>t</title><body><header>site</header><nav>menu</nav><div class='cookie-notice'>ok</div>"
        "<main><h1>A &amp; B</h1><p>one <b>tw</b>o<br>three&nbsp;x<script>var a='</p>'</script><div class=\"adBox ads\">buy</div><form>f</form>"
        "<ul><li>i<li>j</ul></main><section id=comments>reader</section><aside>side</aside><footer>foot"
    )
    assert wrappers.main_text(page) == "A & B one two three x i j"
    assert wrappers.main_text("") == "" and wrappers.main_text("plain <i>te</i>xt") == "plain text"


def test_constants_become_template(spark):
    shell = "<html><body><div class=top>Same banner line</div><div class=x>story {0} tells of {0}</div><div class=end>Same closing line</div></body></html>"
    rows = [(i, f"http://h.example/{i}", shell.format(i)) for i in range(8)] + [(90, "http://other.example/", shell.format(1)), (91, None, None), (92, "", "")]
    rows += [(80 + i, "http://copy.example/", shell.format(5)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.op5(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 tells of 3" and got[91] == "" and got[92] == ""
    assert "Same banner line" in got[90] and "story 5" in got[80]  # one page, or one page many times, shows no template


def test_tree_matching():
    a, b = wrappers.parse("<ul><li>1</li><li>2</li></ul><p>x</p>"), wrappers.parse("<ul><li>1</li></ul><div>new</div><p>x</p>")
    assert sum(1 for _ in wrappers.match_trees(a, b)) == 4
    assert len(wrappers.constants(a, b)) == 2


def test_empty(spark):
    assert wrappers.op5(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_the_template_decides_inside_and_beside_articles(spark):
    shell = (
        "<html><body><div class=lead>Lead {0} of the page</div><div class=top>Same <b>banner</b> line</div><article><h1>Title {0}</h1>"
        "<p class=note>Read all <i>our</i> stories here.</p><p>Story {0} is told.</p></article><div class=end>Same closing line</div></body></html>"
    )
    rows = [(i, f"http://h.example/{i}", shell.format(i)) for i in range(8)] + [(90, "http://other.example/", shell.format(1))]
    got = {r["page_id"]: r["text"] for r in wrappers.op5(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[3] == "Lead 3 of the page Title 3 Story 3 is told."
    assert got[90] == "Title 1 Read all our stories here. Story 1 is told."  # nothing to align with: the article as it is


def test_templates_do_not_depend_on_partitioning(spark, monkeypatch):
    shell = "<html><body><div class=top>Same banner line</div><div class=x>story {0} of {1}</div></body></html>"
    rows = [(i, f"http://h{i % 5}.example/{i}", shell.format(i, "words " * (i % 7))) for i in range(60)] + [(99, "http://h0.example/odd", "<p>odd")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda df: {r["page_id"]: r["text"] for r in wrappers.op5(df).collect()}
    apart, whole = read(pages.repartition(61, "page_id")), read(pages.coalesce(1))
    monkeypatch.setattr(wrappers, "LEAST_PART_BYTES", 300)
    assert apart == whole == read(pages.repartition(7)) and len(whole) == 61
    assert whole[99] == "odd" and all("banner" not in x for x in whole.values()) and "story 12 of" in whole[12]
