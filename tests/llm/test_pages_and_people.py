"""Main text of pages and personal data."""

import random
import re

from loomgraph.llm import html_text, pii

PARA = "This is one of the paragraphs of the page, and it was on it for as long as it is here, with all that we have to say of it in the text."


def test_article_between_frames():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad big">Buy the best of it in the world</div>
    <article><h1>Head &amp; &lt;line&gt;</h1><p><b>{PARA}<br><p>Be. Er.</p>  <p>caf&eacute;&nbsp;a\n b</p>
    <aside>no</aside><div id="comment-list"><p>{PARA}</p></div><form><p>no</p></form></article>
    <footer>&copy; site</footer>"""
    assert html_text.main_text(page) == f"Head & <line>\n{PARA}\nBe. Er.\ncafé a b"


def test_pages_without_an_article():
    page = f"<div><a href=x>{PARA}</a></div><div>{PARA} {PARA}<h2>Short head</h2><p>{PARA} {PARA}</div><p>lone tail"
    assert html_text.main_text(page) == f"{PARA} {PARA}\nShort head\n{PARA} {PARA}"
    assert html_text.main_text("") == html_text.main_text("<p></p><script>x") == ""


def test_an_unclosed_menu_ends_at_the_article():
    assert html_text.main_text(f"<nav><ul><li><a href=1>One</a><article><p>{PARA}</article>") == PARA


def test_layout_names_are_no_frames():
    for wrap in ('class="content has-sidebar"', 'id="page" class="no-comments"', 'class="wrapper cookie-consent-off"'):
        assert html_text.main_text(f"<div {wrap}><p>{PARA} {PARA}</p></div>") == f"{PARA} {PARA}"
    page = f'<article><h2 id="related-work">Related</h2><p>{PARA}</p><h2 id="social-impact">Impact</h2><p>{PARA}</p></article>'
    assert html_text.main_text(page) == f"Related\n{PARA}\nImpact\n{PARA}"
    for name in ("site-footer", "comment-list", "ad big", "sidebar-left"):
        assert html_text.main_text(f'<p>{PARA} {PARA}</p><div class="{name}"><p>{PARA} {PARA}</p></div>') == f"{PARA} {PARA}"


def test_an_article_lifts_the_name_of_its_wrapper():
    assert html_text.main_text(f'<div class="widget"><article><p>{PARA}</p></article><article><p>{PARA}</p></article></div>') == f"{PARA}\n{PARA}"
    page = f'<article><p>{PARA}</p></article><div class="related"><article><p>{PARA}</p></article></div>'
    assert html_text.main_text(page) == PARA
    assert html_text.main_text(f'<div id="comments"><article><p>{PARA}</p></article></div><article><p>Be.</p></article>') == "Be."


def test_linked_paragraphs_of_an_article():
    linked = f"Of this it was said <a href=x>{PARA}</a> and so on"
    links = "<ul><li>" + f"<a href=x>{PARA}</a>" + "</ul>" + " | ".join(f"<a href={i}>Some other page {i} of it</a>" for i in range(9))
    assert html_text.main_text(f"<article><p>{PARA}</p><p>{linked}</p>{links}</article>") == f"{PARA}\nOf this it was said {PARA} and so on"


def naive(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub(r"[ -]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["ab@.-%+", "0123456789", "1.", "+1 ()-0", "@a.", "4 -", "é\n "])) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == naive(text), text
    assert pii.base_spans("a" * 300_000 + "@ " + "1" * 300_000 + "@" * 1000) == []


def test_disclosing_terms(spark):
    rows = [(i, f"on day {i} our Zorbatron met jo@x.org in town {'abcdefgh'[i] * 3}") for i in range(4)]
    rows += [(i, f"day {i} in the town, nothing on our met") for i in range(10, 60)]
    rows += [(i, "on day 0 our Zorbatron met jo@x.org in town aaa") for i in range(70, 75)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    text = dict(rows)
    for i in (0, 3, 72):
        assert [text[i][s["start"] : s["end"]] for s in found[i]["added"]] == ["Zorbatron"]
        assert [s["kind"] for s in found[i]["base"]] == ["email"]
    assert not found[20]["added"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[1] == "on day 1 our [NAME] met [EMAIL] in town bbb" and clean[20] == text[20]
    by_join = pii.spans(docs, pii.Settings(broadcast_terms=0)).collect()
    assert sorted(map(tuple, by_join)) == sorted(map(tuple, found.values()))


def test_disclosing_terms_anywhere_in_the_text(spark):
    far = "and then there was more of it to say on that day " * 20
    rows = [(0, f"Zorbatron wrote. {far} mail jo@x.org now. {far} Then Zorbatron left.")]  # one entity, once
    rows += [(i, f"Quuxley {far} ask al@y.org for it") for i in range(1, 40)]  # always in the same wording
    rows += [(i, f"{far} nothing {i}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in (pii.Settings(), pii.Settings(broadcast_terms=0)):
        clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, settings).collect()}
        assert "Zorbatron" not in clean[0] and clean[0].count("[NAME]") == 2 and far in clean[0]
        assert clean[1].startswith("[NAME] and then") and far in clean[1]
        assert clean[100] == dict(rows)[100]
