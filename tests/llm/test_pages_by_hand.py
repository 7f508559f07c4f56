"""Extraction from pages labelled by hand: rows of `pages`, and pages without names, menus or sections."""

import pytest

from plumbline.llm import html_text

HAND = [
    ("<html><body><p>The council met on Tuesday and agreed to repair the old bridge over the river before winter.</p></body></html>", "The council met on Tuesday and agreed to repair the old bridge over the river before winter."),
    ("<p>One short paragraph, alone on its page.", "One short paragraph, alone on its page."),
    ("<div>Just some words without any markup but a division, and a second sentence.</div>", "Just some words without any markup but a division, and a second sentence."),
    ("<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><h1>Bridge repaired</h1><p>The old bridge is open again. Workers finished on Friday, two weeks early.</p><p>Traffic returns on Monday.</p></td></tr><tr><td>Copyright 2020 Town</td></tr></table>", "Bridge repaired\n\nThe old bridge is open again. Workers finished on Friday, two weeks early.\n\nTraffic returns on Monday."),
    ("<body><div><div><a href=a>Start</a></div><div><a href=b>Contact</a></div></div><div><div><h2>Rain</h2><div>It rained all day. The river rose by a metre.</div><div>People stayed at home, and the shops closed early.</div></div></div><div><a href=c>Imprint</a></div></body>", "Rain\n\nIt rained all day. The river rose by a metre.\n\nPeople stayed at home, and the shops closed early."),
    ("<body><h1>Title</h1><p>First part of the text, which is long enough to be read.</p><p>Second part.</p></body>", "Title\n\nFirst part of the text, which is long enough to be read.\n\nSecond part."),
]
#: The texts of rows of `pages`, read by hand.
PAGES = {
    1: "Shouha the that statre in anstble thention onha ofontionstin\n\nShouha the that statre in anstble thention onha ofontionsting tolyntat and the.\n\nThines to innting thontion onnt and heble annt from.\n\n",
    2: "Reorea. Nd.\n\nReorea. Nd.",
}


@pytest.fixture(scope="module")
def extractor():
    return html_text.train(html_text.training_pages())


def test_bare_and_table_pages(extractor):
    assert [extractor(page) for page, _ in HAND] == [text for _, text in HAND]


def test_generated_plain_pages(extractor):
    pages = list(html_text.plain_pages(150, seed=98))
    right = sum(extractor(page) == "\n\n".join(t for t, label in known if label) for page, known in pages)
    assert right >= 100  # lines like "Arde nha" may be headings or footers


def test_rows_of_pages(spark):
    got = {r.page_id: r.text for r in html_text.op2_html(spark, "/root/testdata/sf0.001").filter("page_id in (1, 2)").collect()}
    assert got[2] == PAGES[2] and got[1].startswith(PAGES[1]) and got[1].endswith("\n\nAnd therhean is the is esndha reedes ha.")
    assert "footer" not in got[1] and "example.net" not in got[1] and "Nicht" not in got[1]
