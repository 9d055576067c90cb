import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtempo.llm.html_text import text_of, title_of, tree


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b <b>c<p>d</b> e", "a\n\nb c\n\nd e"),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>tail", "- x\n- y\n  - z\n- w\n\ntail"),
        ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>x<br>y", "aa  b\nc   dddd\n\nx\ny"),
        ("<table><caption>cap</caption><tr><th>H1<th>H2<tr><td><p>p1<p>p2<td>q</table>", "cap\n\nH1      H2\np1  p2  q"),
        ("<div hidden>no</div><div style='color:red; display : none'>no</div><!-- <p>c -->yes", "yes"),
        ("<head><title>t</title><style>p{}</style><script>var a='<p>x</p>';</script></head>body", "body"),
        ("a &amp; b &lt;c&gt; &copy &#65;&#x42; &am", "a & b <c> © AB &am"),
        ("<pre> a\n  b </pre>c", " a\n  b\n\nc"),
        ("  many \n\t blanks  <b> inside </b> here ", "many blanks inside here"),
        ("<details><summary>S</summary>hid</details><details open>shown</details>", "S\nshown"),
        ("lone < b > and <3", "lone < b > and <3"),
        ("cut <a href='x", "cut"),
        ("cut </a", "cut"),
        ("cut <a href=x ", "cut"),
        ("an <a href='x>odd</a> quote", "an <a href='x>odd quote"),
        ("<img alt='picture'> <input value=no> <select><option>first<option>no</select>", "picture first"),
        ("<select><optgroup label=g><option>no<option selected>yes</select> <select multiple><option>a<option>b</select>", "yes a b"),
        ("<p>x <math><mi>E</mi><mo>=</mo><annotation>no</annotation></math> y", "x E= y"),
        ("<textarea>a &lt; <b></textarea> <svg><title>no</title><text>drawn</text></svg>", "a < <b> drawn"),
        ("<b><b><b><b><p>x", "x"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("", ""),
        (None, ""),
    ],
)
def test_rendering(page, text):
    assert text_of(page).strip("\n") == text.strip("\n")


def test_titles():
    assert title_of(tree("<title> a &amp;\n b </title><p>x")) == "a & b"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/=\"'&; abplitrdu!-\n", max_size=80))
def test_no_markup_breaks_it(page):
    text_of(page)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "<div>", "<ul>", "<li>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<b>", "</b>", "<a>", "</p>", "</div>", "</ul>", "<pre>", "</pre>", "<h1>", "</h1>"]), max_size=40))
def test_all_text_appears_once_and_outside_tables_in_order(tags):
    page = "".join(f"{t} w{i}w " for i, t in enumerate(tags))
    got = text_of(page)
    assert sorted(got.replace("-", " ").split()) == sorted(f"w{i}w" for i in range(len(tags)))
    if "<table>" not in tags and "<tr>" not in tags and "<td>" not in tags:
        assert [w for w in got.split() if w.startswith("w")] == [f"w{i}w" for i in range(len(tags))]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" * 20_000 + "<p>x" * 500, "<ul><li>" * 3000 + "x", "<a " * 20_000, "<table><tr><td>" * 2000 + "x"])
def test_depth_is_unbounded(page):
    text_of(page)
