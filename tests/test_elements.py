"""Reading pages as authors leave them."""

import random

import pytest

from studbook.operators import extraction as ex
from studbook.operators.elements import Page, Search, find, find_in

NESTED = """<div class="titlename">x<h1 itemprop=name> Rex <i>the</i> 2nd &amp; last</h1></div><div class='generalInfo wide'>
<DIV CLASS=textRow><div class="big textLabel">Окрас:</div>  <div class="textDescription"><div>dark<div> red </div></div> &eacute;&#33;&#x41;</div></div>
<div class=textRow><div class=textLabel>Владелец</div><div class=textDescription><a class=x href=a.php?x=1&amp;y=2 href=second>Ann</a><b><a href='http://y/'>Bob<br>by</a></b></div></div>
<div class=textRow><div class=textLabel>Alone</div><p>not a description</div></div>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id bigint, html string")


def tags(html):
    return [(e.tag, e.parent.tag) for e in Page(html).elements]


@pytest.mark.parametrize("html, expected", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", ""), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]),
    ("<table><tr><td>1<td>2<tr><th>3<td><table><tr><td>x</table>4</table>", [("table", ""), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("th", "tr"), ("td", "tr"), ("table", "td"), ("tr", "table"), ("td", "tr")]),
    ("<table><thead><tr><td>1<tbody><tr><td>2</table><p>x", [("table", ""), ("thead", "table"), ("tr", "thead"), ("td", "tr"), ("tbody", "table"), ("tr", "tbody"), ("td", "tr"), ("p", "")]),
    ("<p>a<b>b<p>c<div>d</div>e", [("p", ""), ("b", "p"), ("p", ""), ("div", "")]),
    ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", [("dl", ""), ("dt", "dl"), ("dd", "dl"), ("dt", "dl"), ("select", ""), ("option", "select"), ("option", "select")]),
    ("<a href=1>x<a href=2>y</a></b></table></i><br/><img src=x>z", [("a", ""), ("a", ""), ("br", ""), ("img", "")]),
    ("", []), ("no tags & none", []), ("<td>bare<td>cells", [("td", ""), ("td", "")])])
def test_implied_and_stray_tags(html, expected):
    assert tags(html) == expected


def test_texts_entities_and_silent_elements():
    page = Page("<div> a <script>var t = '</p>';</script><style>p{}</style><!-- no --><b> b</b>&nbsp;&lt;c&gt; &xyzzy; &copy</div>")
    assert page.text(page.elements[0]) == "ab<c> &xyzzy; ©" and page.text(page.elements[1]) == "var t = '</p>';"


def test_selectors_and_paths():
    html = "<div id=one class='a  b c'><p data-bind='text: color' hidden>x</p><p class=b>y</p></div>"
    for selector, count in [("div.a.c", 1), (".b", 2), ("div.d", 0), ("p[hidden]", 1), ("p[data-bind*=color]", 1), ("[id=one]", 1), ("#one", 1), ("p", 2), ("p[data-bind=color]", 0)]:
        assert len(find_in(html, Search(selector))) == count, selector
    assert [f["path"] for f in find_in(html, Search("p.b", within="div.a"))] == ["div.a.b.c/p.b"]


def test_labels_of_nested_unquoted_html(spark):
    own = pages(spark, NESTED, None, "", "<div class=textLabel>x")
    values = {(r.page_id, r.position, r.label, r.value) for r in ex.extract_label_values(own).collect()}
    assert values == {(0, -1, "name", "Rexthe2nd & last"), (0, 0, "окрас", "darkredé!A"), (0, 1, "владелец", "AnnBobby")}
    links = sorted((r.label, r.link_no, r.text, r.url) for r in ex.extract_label_links(own, "http://b/").collect())
    assert links == [("владелец", 0, "Ann", "http://b/a.php?x=1&y=2"), ("владелец", 1, "Bobby", "http://y/")]


def test_rows_keep_to_their_own_table(spark):
    html = "<table id=doglist><tr><th>N<tr><td><a href=d1>Rex</a><td>Male<td><table><tr><td>in</table>Sire<td>Dam<td>-<td>2001<tr class='x legenda'><td>a<td>b<td>c<td>d<td>e<td>f</table>"
    found = ex.extract_listing_rows(pages(spark, html), "http://b/").collect()
    assert [(r.position, r.name, r.link, r.sex, r.sire, r.dam, r.birth_date) for r in found] == [(1, "Rex", "http://b/d1", "Male", "inSire", "Dam", "2001")]
    offspring = "<h3 class=t>Your <b>OFFSPRING</b></h3><p>x<table><tr class=legenda><td>1<td>2<td>3<td>4<td>5<td>6<tr><td>JR 1<td><td><a href='?id=7'>Pup</a><td><img src=sp1.gif><td><img class='q boja' alt=red><td>01.02.2003.</table>"
    pup = ex.extract_offspring_rows(pages(spark, offspring)).first()
    assert (pup.uuid, pup.registered_name, pup.sex, pup.color, pup.date_of_birth.year) == ("7", "Pup", 1, "red", 2003)


def test_cards_with_untidy_parts(spark):
    uuid = "0123abcd-0123-0123-0123-0123456789ab"
    html = (f"<div class='itemBox first'><a href='/animal/view/rex-{uuid}' class='big profilePhoto'><img src=x></a><span data-bind='text: registered_name, visible: 1'>Rex <b>II</b></span><i class='icon icon-female'></i>"
            "<div class=italic><span>Sire &amp; Co</span><span>x</span><span>Dam</span></div><span data-bind=year_of_birth>b. 2019</span><div class='x ribbon'>new</div></div><div class=itemBox><a class=profilePhoto href=/none></a></div>")
    card = ex.extract_listing_cards(pages(spark, html)).collect()
    assert [(r.position, r.uuid, r.link_name, r.registered_name, r.sex, r.sire_name, r.dam_name, r.color, r.year_of_birth, r.is_new) for r in card] == [
        (0, uuid, "rex", "RexII", 2, "Sire & Co", "Dam", None, 2019, True)]


def test_other_columns_and_repeated_pages_stay(spark):
    frame = spark.createDataFrame([(1, "<p>a<p>b", 5), (1, "<p>a<p>b", 5), (2, None, 6), (3, "x", 7)], "page_id bigint, html string, score int")
    assert sorted((r.page_id, r.score, r.position, r.text) for r in find(frame, Search("p")).collect()) == [(1, 5, 0, "a")] * 2 + [(1, 5, 1, "b")] * 2
    assert find(frame.limit(0), Search("p")).count() == 0


def test_a_long_page_takes_time_in_proportion():
    """Two megabytes of rows and of tags left open."""
    rows = "<table>" + "<tr><td>cell<td>other" * 60_000
    assert len(find_in(rows, Search("tr", cells=2))) == 60_000
    assert len(find_in("<p>" + "<b><i>x" * 150_000 + "</u>" * 1000, Search("p"))) == 1


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("read", [
    ex.extract_labelled_table, ex.extract_label_values, ex.extract_listing_cards, ex.extract_listing_rows_wide, ex.extract_parents_by_rowspan, ex.extract_offspring_rows, ex.extract_page_outline,
    lambda p: ex.extract_label_links(p, "http://b/"), lambda p: ex.extract_photo_ids(p, "http://b"), lambda p: ex.extract_listing_rows(p, "http://b/"), lambda p: ex.extract_table_rows(p, ["a", "b"]),
    lambda p: ex.extract_section_links(p, "x", "http://b/")])
def test_pages_of_one_partition_are_parsed_on_all_cores_and_once(spark, read):
    own = spark.range(0, 500, 1, 1).selectExpr("id as page_id", "concat('<p>', id) as html")
    text = plan(read(own))
    assert text.count("MapInArrow") == 1, text
    assert "hashpartitioning(page_id#" in text and "REPARTITION_BY_NUM" in text
    used = find(own, Search("p")).selectExpr("spark_partition_id() as part").distinct().count()
    assert used == spark.sparkContext.defaultParallelism


def test_page_ids_that_repeat_or_are_null(spark):
    html = "<div class=sadrzaj><h2>Rex{}</h2><table class=podaci><tr><td>Sex:<td>male<tr><td>Born:<td>{}</table></div>"
    own = spark.createDataFrame([(1, html.format("", 1)), (1, html.format("", 1)), (2, "x"), (None, html.format("", 1)), (3, None), (4, html.format(4, 4))], "page_id bigint, html string")
    found = sorted((r.page_id or 0, r.registered_name or "", sorted(r.info.items())) for r in ex.extract_labelled_table(own).collect())
    one = [("born", "1"), ("sex", "male")]
    assert found == [(0, "", []), *[(1, "Rex", one)] * 4, (2, "", []), (3, "", []), (4, "Rex4", [("born", "4"), ("sex", "male")])]
    article = "<article><h1>A</h1><p>1<p>2</article><footer>F</footer>"
    own = spark.createDataFrame([(1, article), (1, article), (2, "x"), (None, article), (3, "<article><p>1</article>")], "page_id bigint, html string")
    outline = sorted((r.page_id or 0, r.heading or "", r.paragraphs, r.footer or "") for r in ex.extract_page_outline(own).collect())
    assert outline == [(0, "", 0, ""), *[(1, "A", 4, "F")] * 8, (2, "", 0, ""), (3, "", 1, "")]


def test_label_map_of_one_pass(spark):
    found = ex.label_info(pages(spark, NESTED, None, "x"), "http://b/").collect()
    assert [(r.page_id, r.info) for r in found] == [(0, {"name": "Rexthe2nd & last", "окрас": "darkredé!A", "владелец": "AnnBobby", "владелец_url": "http://b/a.php?x=1&y=2"})]


def test_only_the_columns_asked_for_are_made(spark):
    own = pages(spark, NESTED)
    label = Search("div.textLabel", parts=(("value", "+div.textDescription"),))
    every, some = find(own, label), find(own, label, columns=("position", "parts"))
    assert some.columns == ["page_id", "position", "parts"]
    assert [tuple(r) for r in some.orderBy("position").collect()] == [tuple(r) for r in every.select(some.columns).orderBy("position").collect()]


def test_labelled_pages_are_not_sent_to_the_driver(spark):
    """The parsed pages look small beside the texts in them; they are shuffled all the same."""
    text = plan(ex.extract_labelled_table(pages(spark, "<div class=sadrzaj><h2>Rex</h2></div>")))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_plain_markup_is_read_as_the_general_parser_reads_it():
    """Random mixes of plain and broken markup, with and without the short way."""
    class General(Page):
        def _plain(self, html):
            return 0

    def read(page):
        return [(e.tag, e.attributes, e.number, e.last, e.texts, e.parent.number) for e in page.elements], page.texts
    pieces = ["<", "</", ">", "/>", "a", " ", "\n", "=", '"', "'", "&amp;", "&copy", "&#65;", "x=1", 'href="u?a=1&amp;b=2"', "class='k l'", "<!--", "-->", "--", "<!DOCTYPE html>", "<![CDATA[", "<?pi", "é", "\xa0", "<div class=a>", "</div>",
              "<td>", "</td >", "<br/>", "<img src=x/>", "<a href=x y>", "<script>", "</script>", "<style>", "</style >", "<title>", "</title>", "<textarea>", "<P CLASS=Q>", '<x-y a:b.c-d="">', '<a b="1"c>', "<a b==c>", "<a b = c>", "<!-- c -->", "<iframe>", "<li>", "</p>"]
    rng = random.Random(11)
    for _ in range(8000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert read(Page(html)) == read(General(html)), html
    whole = "<!DOCTYPE html><p class='a b' id=x hidden>1 &lt; 2<!-- no --><script>var t='</p>';</script><br/></P>"
    assert Page("")._plain(whole) == len(whole)
