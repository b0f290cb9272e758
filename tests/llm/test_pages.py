from __future__ import annotations

import pytest

from sightline.llm.page_residue import evidence
from sightline.llm.pages import main_body, residue
from sightline.llm.webpage import Page, content_lines, judged, known_as, main_lines, read, slug, told

PAGE = """<!DOCTYPE html>
<html lang="en"><head><title>Alpha 7</title>
<script>var x = '<p>no</p>';</script>
</head><body>
<div class="zz-1">
<li><a href='/a'>Home</a></li>
<li><a href='/b'>Compare</a></li>
</div>
<noscript>Please enable JavaScript for the best experience.</noscript>
<div class="zz-2">
<section>
<h1>Alpha 7 Pro (AB123)</h1>
<p>The battery lasts two days, says the maker. It charges in an hour.</p>
<div class="zz-9">
<p>Share this page</p>
</div>
<table><tr><td>AB123 / US</td></tr></table>
</section>
</div>
<div class="zz-3">
<p>Related articles</p>
<p>Alpha 8 Pro</p>
</div>
<footer>
<p>All rights reserved.</p>
</footer>
</body></html>"""


def lines_known(*texts):
    return {known_as(t) for t in texts}


def test_main_body_of_markup():
    lines = PAGE.split("\n")
    keep = main_lines(PAGE, "alpha-7-pro", lines_known("Share this page", "Related articles", "Alpha 8 Pro"), pages=12)
    assert [lines[i] for i in keep] == ["<h1>Alpha 7 Pro (AB123)</h1>", "<p>The battery lasts two days, says the maker. It charges in an hour.</p>", "<table><tr><td>AB123 / US</td></tr></table>"]


def test_known_line_does_not_take_its_box_along():
    text = "\n".join(f"<p>Paragraph {i} tells at some length how the phone did in use.</p>" for i in range(40))
    page = f"<html><body>\n<header>\n<a href='/'>Home</a>\n</header>\n<main>\n<h1>Alpha 7 Pro</h1>\n<div>\n{text}\n<a href='/m'>More</a>\n</div>\n<div>\n<p>Related articles</p>\n<a href='/8'>How the Alpha 8 did in use</a>\n<a href='/9'>How the Alpha 9 did in use</a>\n</div>\n</main>\n<footer>\n<p>All rights reserved.</p>\n</footer>\n</body></html>"
    kept = [page.split("\n")[i] for i in main_lines(page, "alpha-7-pro", lines_known("More", "Home", "Related articles", "All rights reserved"), pages=12)]
    assert kept == ["<h1>Alpha 7 Pro</h1>", *text.split("\n")]


@pytest.mark.parametrize("tag", ["section", "article", "div"])
def test_every_region_of_the_body_is_kept(tag):
    body = f"""<h1>Alpha 7 Pro</h1>
<{tag}>
<p>The battery lasts two days, says the maker. It charges in an hour, and the screen is bright.</p>
<p>The hinge feels firm after a week of use, and the phone stays cool.</p>
</{tag}>
<{tag}>
<h2>Specifications</h2>
<table>
<tr><td>Display</td><td>6.1 in</td></tr>
<tr><td>Storage</td><td>128 GB</td></tr>
</table>
</{tag}>
<{tag}>
<p>Notes: figures were taken at room temperature by the maker.</p>
</{tag}>"""
    around = "<div class='zz-1'>\n<a href='/'>Home</a>\n<a href='/s'>Support</a>\n</div>", "<div class='zz-2'>\n<p>Related articles</p>\n<a href='/8'>How the Alpha 8 did in use</a>\n</div>\n<footer>\n<p>All rights reserved.</p>\n</footer>"
    page = f"<html><body>\n{around[0]}\n{body}\n{around[1]}\n</body></html>"
    lines = page.split("\n")
    assert [lines[i] for i in main_lines(page, "alpha-7-pro")] == [x for x in body.split("\n") if any(t in x for t in ("<h", "<p", "<td"))]


def test_main_body_of_plain_text():
    page = "Accept all cookies\nHome | Compare | Support\nHome > Acme US > Beta 12 Pro\nRelated articles\nBeta 14\nBeta 12 Pro\n\nThe hinge feels firm after a week of use, and the\nscreen is bright.\nWas this page helpful? Yes / No\nTerms of use · Privacy policy · © 2031 Acme US\n[0a1b2c3d]"
    about = lines_known("Accept all cookies", "Home", "Compare", "Support", "Related articles", "Was this page helpful? Yes / No", "Terms of use", "Privacy policy", "[1]")
    assert main_lines(page, "beta-12-pro-0000aa", about, pages=12) == [5, 7, 8]


def test_lone_plain_page_is_told_by_its_ratios():
    page = "Shop by brand\nGift vouchers\nOrder tracking\nAlpha 7\nThe hinge feels firm after a week of use, and the screen is bright enough for noon.\nIt charges in an hour, says the maker, and lasts two days of normal use.\nStore hours\nPress room"
    assert main_lines(page) == [3, 4, 5]
    assert [main_lines(page.replace("Alpha 7", "Press room")), main_lines("One line alone.")] == [[3, 4, 5], [0]]


def test_error_page_keeps_its_message():
    page = '<html><body>\n<div>\n<h1>Access denied.</h1>\n<p>Code 12ab34</p>\n</div>\n</body></html>'
    assert main_lines(page) == [2, 3]


@pytest.mark.parametrize("page", ["", " ", "\n\n", "<", "<div", "<p>", "</div></div>", "<div>" * 3000 + "x" + "</div>" * 10, "a" * 200_000, "<p>" + "word " * 100_000 + "</p>"])
def test_odd_pages_do_not_break(page):
    main_lines(page)


def test_two_clusters():
    import numpy as np

    up = content_lines(np.array([3, 2, 4, 90, 80, 120, 70, 2, 3, 1.0]))
    assert up[3:7].all() and not up[[0, 1, 8, 9]].any()


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("Model number: {{ title }}", "placeholder"), ("Buy the [INSERT os version] today in our store.", "placeholder"), ("Welcome, undefined!", "placeholder"), ("Display: null in, storage: null", "placeholder"),
        ("Released on %RELEASE_DATE% in ${region}.", "placeholder"), ("The [object Object] ships with NaN", "placeholder"), ("NaN", "placeholder"), ("Support for <os_version> ends soon.", "placeholder"),
        ("Lorem ipsum dolor sit amet consectetur", "filler"), ("Text text text text text.", "filler"), ("Your headline here", "filler"), ("ダミーテキストです。", "filler"), ("xxxxx xxxx xxx", "filler"), ("asdf asdf qwer asdf", "filler"),
        ("404 - Not Found", "failure"), ("Please enable JavaScript to view this page.", "failure"), ("Zugriff verweigert.", "failure"), ("ただいまメンテナンス中です。", "failure"), ('{"error":"not_found","request":"8ae62c"}', "failure"),
        ("Access denied messages in the gallery are fixed in 4.2.1.", None), ('If the browser shows "404 Not Found", check the address and restart the Alpha 7.', None), ("The font preview shows lorem ipsum text at three sizes.", None),
        ("In the label file, write {{serial}} where the number should go; the tool replaces it.", None), ("Save the log under ${HOME}/logs before you reset the device.", None), ("Empty fields were exported as null or undefined in earlier builds; 5.0 corrects this.", None),
        ("The update server returned error 503 on launch night; build 2.1 was moved to a new server.", None), ("", None), ("   ", None),
    ],
)
def test_evidence(line, kind):
    assert evidence(line) == kind


STANDARD_FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea "
    "commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim "
    "id est laborum."
)


def test_standard_filler_in_any_piece():
    words = STANDARD_FILLER.split()
    for n in (5, 8, 20):
        for a in range(len(words) - n):
            assert evidence(" ".join(words[a : a + n])) == "filler"
    assert evidence("Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.") == evidence("Duis aute irure dolor in reprehenderit") == "filler"
    assert evidence("(Text) text text text") == evidence("One two one two.") == "filler" and evidence("Commercial requests deserve an official answer within a week.") is None


LONG = "the gateway at node seven of the cluster in the second hall gave no answer, " * 6


@pytest.mark.parametrize(
    "line",
    [
        '{"error": "' + LONG + '"}', "Traceback (most recent call last): File main.py, line 7, in start, " + LONG, "Our systems have detected unusual traffic from your network, " + LONG,
        "Access denied. You do not have permission to see this page, as " + LONG, "Error 504, " + LONG,
        "Service unavailable. " + "Please try again in a few minutes. " * 2 + "Contact the operator if this goes on. Reference 18af31. The server is temporarily unable to answer your request because of maintenance or load. Thank you.",
    ],
)
def test_failures_of_any_length(line):
    assert len(line) > 160 and evidence(line) == "failure"


def test_long_text_about_failures_is_none():
    assert evidence("Access denied messages in the gallery are fixed, and " + LONG) is None
    assert evidence("Access denied. The release of last week fixes this message where albums of more than a thousand pictures are opened. " + LONG) is None


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, url string, title string, content string, _key int, kinds string, line_no int")


def test_operators_on_odd_rows(spark):
    rows = [
        ("a", "https://H.example/p/alpha-7-pro-0001", "Alpha", PAGE, 1, "x", 0), ("a", "https://H.example/p/alpha-7-pro-0001", "Alpha", PAGE, 1, "x", 0), ("b", None, None, PAGE, None, None, None),
        ("c", "u", None, None, 1, "x", 1), ("d", "u", None, "  \n ", 1, "x", 1), (None, "u", None, PAGE, 1, "x", 1), ("e", "https://h.example/x", None, "Sorry, the page you are looking for cannot be found.\nCheck the address.", 1, "x", 1),
        ("f", "https://h.example/y", "404", "<html><body>\n<div>\n<p>Your headline here</p>\n</div></body></html>", 1, "x", 1),
    ]
    df = frame(spark, rows)
    body = {(r["id"], r["line_no"]) for r in main_body(df).collect()}
    assert {n for i, n in body if i == "a"} == {n for i, n in body if i == "b"} >= {11, 12, 16} and not {5, 6, 24} & {n for i, n in body if i == "a"}
    assert {i for i, _ in body} == {"a", "b", "e", "f"} and main_body(df).count() == len(body)
    assert {(r["id"], tuple(r["kinds"])) for r in residue(df).collect()} == {("e", ("failure",)), ("f", ("filler",))}
    empty = frame(spark, [])
    assert main_body(empty).count() == 0 and residue(empty).count() == 0


def test_recurrent_line_of_a_host_is_subtracted(spark):
    rows = [(f"{i}", f"https://h.example/p/{i}", None, f"Something went wrong.\nPage {i} tells of a phone that nobody has seen so far.", 0, "", 0) for i in range(30)]
    assert residue(frame(spark, rows)).count() == 0
    assert residue(frame(spark, rows[:5])).count() == 5


@pytest.mark.parametrize("n", [5, 30])
@pytest.mark.parametrize("text", ["Service unavailable.", "Access denied.\nReference 0a{i}bc", "Please enable JavaScript to view this page.\nIf this goes on, write to the operator of the store.\nRay ID: {i}f31 at 12:{i}"])
def test_pages_with_nothing_else_stay_cases(spark, n, text):
    rows = [(f"{i}", f"https://h.example/p/{i}", None, text.format(i=i), 0, "", 0) for i in range(n)]
    assert residue(frame(spark, rows)).count() == n


def test_outage_beside_stored_pages(spark):
    sweeps = [(f"{s}-{i}", f"https://h.example/p/{i}", None, f"Page {i} tells of a phone that nobody has seen so far." if s else "Service unavailable", 0, "", 0) for i in range(30) for s in range(3)]
    assert {r["id"] for r in residue(frame(spark, sweeps)).collect()} == {f"0-{i}" for i in range(30)}


def test_long_lines_with_a_common_start_are_different(spark):
    start = '{"error": "' + "the gateway gave no answer, " * 20
    words = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    rows = [(w, f"https://h.example/p/{w}", None, f'{start} node {w}"}}\nPage {w} tells of a phone that nobody has seen so far.', 0, "", 0) for w in words]
    assert len(start) > 400 and residue(frame(spark, rows)).count() == len(words) == 30


def grown(depth, lines):
    text = "\n".join(f"<p>Paragraph {i} tells at some length how the phone did in use.</p>" for i in range(lines))
    return "<html><body>\n<h1>Alpha 7</h1>\n" + "<div>" * depth + "\n" + text + "\n" + "</div>" * depth + "\n</body></html>"


def test_reading_is_linear():
    import time

    for page, n in ((grown(1, 20_000), 20_001), (grown(3_000, 50), 51), (grown(60, 2_000), 2_001), ("<html><body>\n<script>\n" + "\n".join(f"var x{i} = '<p>{i}</p>';" for i in range(20_000)) + "\n</script>\n<p>Text.</p></body></html>", 1)):
        start = time.process_time()
        assert len(main_lines(page)) == n and time.process_time() - start < 2
    for odd in ("<a " * 50_000, "<!--" * 50_000, "&#x" * 50_000, '<a b="' * 20_000, "a" * 500_000, "<" * 100_000):
        start = time.process_time()
        main_lines("<p>\n" + odd)
        assert time.process_time() - start < 2


def test_depth_of_a_box_does_not_matter():
    for depth in (1, 59, 61, 200):
        page = "<html><body>\n<main>\n" + "<div>" * depth + "\n<h1>Alpha 7</h1>\n<p>The battery lasts two days, says the maker. It charges in an hour.</p>\n<div class='promo'>\n<p>Ten percent off today</p>\n</div>\n" + "</div>" * depth + "\n</main>\n</body></html>"
        assert main_lines(page) == [3, 4]


#: Hosts whose menus, consents, asides, promotions and footers are worded as in no test table; two with markup, two without.
CHROME = [
    (["Shop by brand", "Gift vouchers", "Order tracking", "Student desk", "Field notes"], ["Small files called biscuits help us count visits.", "Fine by me"], ["Others also opened", "Weekly digest for makers"], "Would you tell a friend about this text?", ["Press room", "Ethics charter", "Accessibility promise", "Fax directory"]),
    (["Katalog durchsuchen", "Filialen", "Sendung verfolgen", "Treuekarte", "Werkstatt"], ["Ohne Messdateien läuft hier alles langsamer.", "Passt so"], ["Weitere Fundstücke", "Wochenbrief bestellen"], "Fanden Sie, was Sie suchten?", ["Pressestelle", "Leitbild", "Barrierefreiheit", "Lieferanten"]),
]
SUBJECTS = ["hinge", "panel", "speaker", "camera", "antenna", "charger", "casing", "battery", "stylus", "kernel", "display", "modem"]
FAULTS = ["That page has wandered off.", "We could not load this page.", "The page you wanted no longer exists.", "Our server did not respond in time.", "Your access was refused by the firewall.", "Scripts must be allowed here.", "[[ model_name ]] ships in {colour}.", "Caption goes here"]


def held_out():
    rows, body, bad = [], set(), set()
    for h, (menu, consent, aside, promo, foot) in enumerate(CHROME):
        for markup in (True, False):
            for i in range(24):
                s, t = SUBJECTS[i % 12], SUBJECTS[(i * 5 + 3) % 12]
                fault = i % 8 == 7
                main = [FAULTS[(i // 8 + 3 * h + (0 if markup else 4)) % 8]] if fault else [f"Notes on the {s} and the {t}", f"After week {i} the {s} still held its shape, and the {t} of unit {i * 7} did better than the one before it.", f"Weight: {i + 90} g", f"Our tester in hall {i} compared the {t} with four others and found it quiet, cool and quick to start again."]
                about = [menu[(i + k) % 5] for k in range(4)]
                if markup:
                    wrap = lambda tag, xs: [f"<{tag}>", *(f"<p>{x}</p>" for x in xs), f"</{tag}>"]
                    lines = ["<html><body>", *wrap("div", consent), "<div>", *(f"<li><a href='/{k}'>{x}</a></li>" for k, x in enumerate(about)), "</div>", "<div>"]
                    first = len(lines)
                    inner = [f"<p>{x}</p>" for x in main]
                    where = [first, first + 1, first + 2, first + 6] if not fault else [first]
                    if not fault:
                        inner = [*inner[:3], *wrap("div", [promo]), inner[3]]
                    lines += [*inner, "</div>", *wrap("div", aside), *wrap("div", foot), "</body></html>"]
                else:
                    lines = [*consent, *about]
                    where = [len(lines) + k for k in ((0, 1, 2, 4) if not fault else (0,))]
                    lines += [*(([*main[:3], promo, main[3]]) if not fault else main), *aside, *foot]
                key = f"{h}{markup}{i}"
                rows.append((key, f"https://host{h}{int(markup)}.example/notes/{i}", None, "\n".join(lines), 0, "", 0))
                body |= {(key, w) for w in where}
                if fault:
                    bad.add(key)
    return rows, body, bad


def test_held_out_wording(spark):
    """Recall and precision of lines and of rows on wording that occurs nowhere in the test tables."""
    rows, body, bad = held_out()
    df = frame(spark, rows)
    got = {(r["id"], r["line_no"]) for r in main_body(df).collect()}
    both = len(got & body)
    found = {r["id"] for r in residue(df).collect()}
    print("lines", both / len(body), both / len(got), "rows", len(found & bad) / len(bad), len(found & bad) / max(1, len(found)))
    assert both >= 0.9 * len(body) and both >= 0.9 * len(got)
    assert len(found & bad) >= 0.9 * len(bad) and len(found & bad) >= 0.9 * len(found)


#: Messages and sentences written after the word lists were fixed; two thirds of the messages were told at first, before words were added.
UNSEEN = """We lost this page.|Sorry, we can't seem to find the content you want.|Your connection was reset by the server.|This resource is forbidden.|Login expired, sign in again.|Please allow scripts for this website.|We detected unusual activity, please verify that you are human.|Scheduled maintenance is in progress.|
The store is temporarily closed.|An internal problem occurred.|404|410 Gone|Die Seite konnte nicht geladen werden.|Bitte erlauben Sie Skripte.|La page demandée n'a pas été trouvée.|Erreur du serveur|El acceso fue denegado.|Se requiere JavaScript.|La pagina è stata rimossa.|
Esta página não existe.|Deze pagina bestaat niet.|Страница удалена|ページは削除されました|请求超时|Your headline|Insert a caption here|Lorem dolor amet elit sed|This text is a placeholder.|{{user.name}}|Sample paragraph"""
USUAL = """The page turns with a swipe.|A server rack fits the tray.|Access points are listed on page 4.|The script of the film was written in Rome.|Robots assemble the frame.|The session with the testers took two hours.|An error of two percent is normal.|It was denied a prize in March.|Maintenance of the seals is easy.|The gate opens at nine.|
Die Seite des Herstellers nennt zwölf Stunden.|Le site du fabricant donne la masse.|El error medio es pequeño.|ページをめくる音が小さいです。|请求一张新的保修卡很容易。|The caption of each photo can be edited.|Put the sample on the scale.|The placeholder card keeps the slot clean.|Two headlines fit on the display.|Its text is easy on the eyes."""


def test_unseen_messages():
    said = [x for x in UNSEEN.replace("\n", "").split("|")]
    found, wrong = [x for x in said if evidence(x)], [x for x in USUAL.replace("\n", "").split("|") if evidence(x) not in (None, "interim")]
    print("messages", len(found), len(said), [x for x in said if x not in found], "others", wrong)
    assert len(found) >= 0.9 * len(said) and len(wrong) <= 2


def test_slug():
    assert slug("https://h/p/Alpha-7_pro-00ab/?x=1#y") == "alpha-7-pro-00ab" and slug(None, "Alpha 7 | Acme") == "alpha-7" and slug(None) == ""
