from __future__ import annotations

from marquee.llm import host_paths

SCHEMA = "page_id long, url string, html string, text string, _host string, _paths string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now</div><div id="cookie-notice">Cookies</div>
<{tag} class="{name}"><h1>Title &amp;amp; more</h1><p>First <b>para</b><br>of&nbsp;it<p>Second
  line</p><script>var t="</p>";</script><form>Name <input></form>{more}</{tag}>
<section class="comments"><p>A reader says very much, far more than the article itself has to say,
again and again and again and again.</p></section><aside>Side</aside><footer>&copy; us</footer></body>"""


def text(html):
    return host_paths.read(html).extract([])


def test_article_without_what_stands_around_it():
    for tag, name in (("article", ""), ("div", "post-12 body"), ("main", "x"), ("td", "y")):
        found = text(PAGE.format(tag=tag, name=name, more="<ul><li>one<li>two</ul>"))
        assert found == "Title &amp; more\nFirst para of it\nSecond line\none\ntwo"


def test_odd_pages():
    assert text(None) == text("") == text("<p></p>") == text("<script>x") == text("<nav>menu</nav>") == ""
    assert text("plain words") == "plain words"
    assert text("<p>a < b & c &lt; d") == "a < b & c < d"
    assert text('<div title="a>b">x</div>') == "x"
    assert text("<p>one<p>two<div>three</div>four") == "one\ntwo\nthree\nfour"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = " ".join(f"w{i}" for i in range(50_000))
    assert text(f"<article><p>{long}</p></article>") == long


def test_names_that_only_hold_a_listed_part_are_no_asides():
    body = "<p>" + "story words " * 9 + "</p>"
    for name in ("content has-sidebar", "no-comments", "widget-content", "content-sidebar-wrap"):
        assert text(f'<div class="{name}">{body}</div><div class="ad-slot">Buy</div>').startswith("story")
    page = f'<div><h2 id="related-work">Related</h2>{body}<section class="social-science"><p>More</p></section>'
    assert text(page).split("\n")[0] == "Related" and text(page).endswith("More")
    for name in ("cookie-notice", "related-posts", "site-footer", "sidebar", "comment-list"):
        assert "Aside" not in text(f'<div>{body}<div class="{name}">Aside</div></div>')


def test_title_and_lead_beside_the_long_text_belong_to_it():
    body = "<p>" + "story words " * 30 + "</p>"
    post = f'<div class="post"><h1>Title</h1><p>lead</p><div class="entry">{body * 2}</div></div>'
    found = text(f'<div class="box"><p>box</p></div>{post}<p>Copyright</p>')
    assert found.split("\n")[:2] == ["Title", "lead"] and "box" not in found and "Copyright" not in found
    page = host_paths.read(post)
    assert page.containers[page.best()].path == "body>div.post"


UNIT = "<p>a unit of the story, ten words and some more here</p>"


def test_parts_of_an_article_in_several_containers_stay_together():
    head = "<h2>Second part</h2>"
    two = f'<div class="content"><section class="intro">{UNIT * 20}</section><section class="rest">{head}{UNIT * 8}'
    assert text(two + "</section></div>").count("a unit") == 28 and "Second part" in text(two)
    rows = "".join(f'<div class="r{x}"><div class="c{x}">{UNIT * n}</div></div>' for x, n in (("a", 12), ("b", 11)))
    assert text(rows).count("a unit") == 23
    for cards in ('<div class="card"><p>another story is told here</p></div>' * 20,
                  "<ul>" + '<li><a href="/x">another story is told here</a></li>' * 20 + "</ul>"):
        page = f'<div class="post">{UNIT * 20}</div><div class="more">{cards}</div>'
        assert "another" not in text(page) and text(page).count("a unit") == 20


def test_comments_and_notices_under_further_names():
    for name, times in (("responses", 90), ("discussion", 90), ("adsbygoogle", 3), ("share-this", 3),
                        ("tags", 3), ("paywall-overlay", 3)):
        more = f'<div class="{name}">{"<p>said by a reader</p>" * times}</div>'
        found = text(f'<div class="all"><div class="post">{UNIT * 10}</div>{more}</div>')
        assert found.count("a unit") == 10 and "reader" not in found, name


def test_paths_are_generalised():
    page = host_paths.read('<div class="b post-12 a"><article id="p7"><p>x</p></article></div>')
    assert [c.path for c in page.containers] == [
        "body", "body>div.a.b.post-", "body>div.a.b.post->article"]


def test_the_host_decides_where_a_page_alone_would_err(spark):
    good = "<div class='story'><p>" + "story words " * 20 + "</p></div><div class='box'><p>short</p></div>"
    odd = "<div class='story'><p>tiny story</p></div><div class='box'><p>" + "box words " * 20 + "</p></div>"
    rows = [(i, f"http://USER@Host.example:80/{i}", good) for i in range(4)]
    rows += [(9, "https://host.example/odd", odd), (10, "http://other.example/", odd), (11, None, odd)]
    rows += [(12, "no url", None), (9, "https://host.example/odd", odd)]
    df = spark.createDataFrame([(*r, "t", "h", "p") for r in rows], SCHEMA).repartition(3)
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in host_paths.main_texts(df).collect()]
    assert len(found) == len(rows)
    by_id = {i: t for i, t, _ in found}
    assert by_id[9] == "tiny story"
    assert by_id[10] == by_id[11] == ("box words " * 20).strip()
    assert by_id[12] == ""
    assert all(n == len(t) for _, t, n in found)
    with_text = host_paths.add_main_text(df)
    assert set(with_text.columns) == set(df.columns)
    assert host_paths.main_texts(df.limit(0)).count() == 0


def test_many_hosts_are_joined_instead_of_sent(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/", f"<p>words {i}</p>", "", "", "") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    sent = sorted(host_paths.main_texts(df).collect())
    monkeypatch.setattr(host_paths, "BROADCAST_PATHS", 0)
    assert sorted(host_paths.main_texts(df).collect()) == sent
