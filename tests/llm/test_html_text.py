import html as H
import random
import re
import time

from tessera.llm import html_text as X
from tessera.llm.registry import QUERIES
from tessera.session import table


def article(page):
    """The article of the test pages by their own markers."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[^>]*\Z", "", m[1] if m else "").replace("<br>", "\n")
    blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in blocks if x)


def test_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in table(spark, d, "pages").collect()}
    got = QUERIES["op5_html_line_blocks"](spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def plain_choice(lines):
    """The choice of lines as the method says it: stretches between dives, of which those with a surge stay."""
    marked = any(text and own for text, _, own in lines)
    size = [(len(text) if own else 0) if marked else plain for text, plain, own in lines]
    total = [sum(size[k : k + 3]) for k in range(len(lines))]
    past = 86 if any(x > 86 for x in total) else 0
    stretches, open_ = [], []
    for k in range(len(lines) + 1):
        if k == len(lines) or total[k] == 0:
            stretches.append(open_)
            open_ = []
        else:
            open_.append(k)
    kept = []
    for own in stretches:
        surge = next((k for k in own if total[k] > past and size[k]), None)
        if surge is not None:
            kept += [k for k in own if size[k] or (k >= surge and lines[k][0] and not marked)]
    if kept and not marked:
        kept = [k for k in range(kept[0], kept[-1] + 1) if k in kept or size[k]]
    return kept


def test_choice_of_lines_against_a_plain_version(spark):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    for page in pages:
        bare = re.sub("</?article>", "", page)
        for html in (page, bare):
            lines = X.lines_of(html)
            assert X.kept_lines(lines) == plain_choice(lines)
        assert X.main_text(bare) == X.main_text(page)
    r = random.Random(1)
    for _ in range(3000):
        marked = r.random() < 0.5
        lines = []
        for _ in range(r.randint(0, 25)):
            n = r.choice([0, 0, 0, 3, 30, 100])
            lines.append(("x" * n, r.choice([0, n]), marked and r.random() < 0.6))
        assert X.kept_lines(lines) == plain_choice(lines)


def test_sums_choose_between_stretches():
    text = "This paragraph is long enough to make the sums over line blocks surge past the threshold of the method."
    teaser = "<article><h2>Teaser</h2><p>Short.</p></article>"
    assert X.main_text(f"{teaser}<article><h1>Title</h1><p>{text}</p><p>End.</p></article>{teaser}{teaser}") == f"Title\n\n{text}\n\nEnd."
    assert X.main_text(f"<p>Skip this</p><nav>n</nav><h1>Title</h1><p>{text}</p><p>End.</p><form>f</form><p>Made by us.</p>") == f"Title\n\n{text}\n\nEnd."
    assert X.main_text(f"<main><p>{text}</p><aside>no</aside><aside>no</aside><aside>no</aside><p>Closing.</p></main>") == f"{text}\n\nClosing."


def test_nesting_is_linear():
    for page in (lambda n: "<div>" * n + "x" + "</p></b>" * n, lambda n: "<b>" * n + "<li></li>" * n, lambda n: "<p>" + "<b>" * n + "<div></i>" * n, lambda n: "<ul><li>" * n):
        took = []
        for n in (2000, 16000):
            begin = time.process_time()
            X.main_text(page(n))
            took.append(time.process_time() - begin)
        assert took[1] < 24 * took[0] + 0.2


def test_parts():
    t = X.main_text
    assert t(None) == t("") == t("<nav>a</nav>") == t("<p> </p>") == ""
    assert t("<article><h1>T</h1><p>a  b\n c<br>d</p><p>&lt;x&gt; &amp &eacute;&nbsp;y</article>") == "T\n\na b c d\n\n<x> & é y"
    assert t("<div>menu</div><main><p>one<p>two</main><div>end</div>") == "one\n\ntwo"
    assert t("<article><p>a</p><div class='comments'><p>no</p></div><aside>no</aside><form>no</form><p>b</p></article>") == "a\n\nb"
    assert t("<article><script>var x='</p><p>no';</script><style>p{}</style><!-- no --><p>a</p></article>") == "a"
    assert t("<article><p>fo<b>o</b>bar <a href='x>y'>link</a></p></article>") == "foobar link"
    assert t("<article><p>kept</p><p>cut <b") == "kept\n\ncut"
    assert t("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>") == "1\n\n2\n\na\n\nb"
    assert t("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"


def test_without_an_article():
    text = "This paragraph is long enough to make the sums over line blocks surge past the threshold of the method."
    page = f"<body><div id='menu'><a href=a>A</a></div><ul>{'<li><a href=x>link</a></li>' * 9}</ul><div><p>{text}</p><p>{text}</p></div>{'<div><a href=z>z</a></div>' * 9}<footer>f</footer></body>"
    assert X.main_text(page) == f"{text}\n\n{text}"


def test_short_paragraphs_without_an_article():
    text = "This paragraph is long enough to make the sums over line blocks surge past the threshold of the method."
    short, links = "<div><div><p>Short closing remark.</p></div></div>", "<div><a href=z>z</a></div>" * 9
    assert X.main_text(f"<div><div><p>{text}</p></div></div>{short}") == f"{text}\n\nShort closing remark."
    assert X.main_text(f"{links}<p>{text}</p>{links}{short}{links}<p>{text}</p>{links}") == f"{text}\n\nShort closing remark.\n\n{text}"
    assert X.main_text(f"<p>One short.</p>{links}<p>Another.</p>{links}<p>A third one here.</p>") == "One short.\n\nAnother.\n\nA third one here."


def test_attributes_are_read_one_by_one():
    for tag in ['a href="/hidden-gems"', 'p title="a hidden valley"', 'a href="/p?id=menu"', "a href=/p?id=menu", 'p data-hidden="false"', 'p data-class="menu"', "p title='class=\"ad\"'", 'p title = "x" lang=en']:
        name = tag.split()[0]
        assert X.main_text(f"<article><p>a</p><div><{tag}>text</{name}></div></article>") == "a\n\ntext", tag
    for tag in ["p hidden", "p HIDDEN", 'p title="x" hidden=""', 'p aria-hidden = "true"', "div class=menu", 'div title="a>b" ID=\'menu\'', 'div style="display: none"', "div role=navigation"]:
        name = tag.split()[0]
        assert X.main_text(f"<article><p>a</p><{tag}>text</{name}></article>") == "a", tag


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<article>a</article>", "z"), (1, "u", "<article>a</article>", "z"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in X.extract(rows).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert X.extract(rows.limit(0)).count() == 0


def test_very_long():
    assert len(X.main_text("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999
    assert X.main_text("<article>" + "<div>" * 3000 + "x") == "x"
