"""HTML extraction, url rules and WARC."""

import gzip
import hashlib
import io
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from leverframe.llm import html_extract, url_rules, warc
from leverframe.llm.queries import oracle_sql, queries
from tests.oracle import SF, connect, same

PROSE = "This is the kind of text that one would want to keep because it has many of the words that are in all of the long sentences, and it is long enough to be decided on its own."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>a  b<br>c</p><p>d</p></article>", "T & U\na b c\nd"),
        ("<nav>x</nav><article><p>one<p>two</article><footer>f</footer>", "one\ntwo"),
        ("<article><p>a</p><div class='comments'><p>no</p></div><aside>s</aside><form>f</form><p>b</p></article>", "a\nb"),
        ("<article><p>a<script>var t='</p>';</script> b</p></article><div class=ad>z</div>", "a b"),
        ("<article><header><h1>H</h1></header><p>x &#x41;&#66; &am", "H\nx AB &am"),
        ("<p>no article, short</p>", "no article, short"),
        (f"<ul><li><a href=1>Home</a></li></ul><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><p>(c) us</p><div><a href=2>more links here</a></div>", f"{PROSE}\nShort one.\n{PROSE}"),
        ("plain < text", "plain < text"),
        ("<div class='cookie-notice'>We use cookies</div><main><p>m</p></main>", "m"),
    ],
)
def test_extract(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div class=post><p>{PROSE}</p></div><section class=comments><article><p>{PROSE} no</p></article></section>", PROSE),
        (f"<div><p>{PROSE}</p></div><aside><article><p>teaser</p></article></aside>", PROSE),
        (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><article><p>A card.</p></article>", f"{PROSE}\n{PROSE}\nA card."),
        (f"<div><p>{'lorem ipsum ' * 30}</p></div><article><p>card</p></article>", f"{('lorem ipsum ' * 30).strip()}\ncard"),
        (f"<div><p>{'lorem ipsum ' * 30}</p></div><article><p>card</p></article><p>{PROSE}</p>", f"card\n{PROSE}"),
        (f"<div><p>{PROSE}</p></div><article><p>{PROSE} a</p><p>b</p><p>{PROSE} c</p></article>", f"{PROSE} a\nb\n{PROSE} c"),
        (f"<article><p>{PROSE}</p><p>{'lorem ipsum ' * 30}</p></article>", f"{PROSE}\n{('lorem ipsum ' * 30).strip()}"),
        (f"<article><p>{PROSE}</p><p><a href=1>one of the links here</a></p><p>Read on:</p><p><a href=2>another of the links</a></p><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<main><div class=ad>x</div><p>a</p><div class=ad>{PROSE}</div><p>b</p></main>", "a\nb"),
    ],
)
def test_marks_are_a_border_only_around_the_main_text(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><p title='The hidden costs'>a</p><p data-hidden=false>b</p><p data-role=comment data-class='ad'>c</p><p title='x class=ad'>d</p></main>", "a\nb\nc\nd"),
        ("<main><p hidden>a</p><p aria-hidden='true'>b</p><p STYLE='color:red; display: none'>c</p><p role=alert>d</p><p aria-hidden=false>e</p></main>", "e"),
        ("<main><div class='x ad'>a</div><div class=site-footer>b</div><div class='comments__list'>c</div><div id=related-posts>d</div><div class=ad-300x250>e</div><p>f</p></main>", "f"),
        (f"<div class='has-sidebar'><p>{PROSE}</p></div><div class='row no-sidebar with_comments'><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
        ("<article><section id=social-impact><p>a</p></section><div id=legal-history><p>b</p></div><h2 id=related-work>c</h2><h2 id=related>d</h2><p>e</p></article>", "a\nb\nc\nd\ne"),
        ("<article><p class=notice>x<div>a</div><p class=notice>x<h2>b</h2>c</article>", "a\nb\nc"),
        ("<article><p class=notice>x<p>a<table><tr><td><p class=notice>y</td><td>b</table><hr>c</article>", "a\nb\nc"),
        ("<article><ul><li class=ad>x<li>a<ul><li class=ad>y<li>b</ul><li>c</ul><dl><dt class=ad>x<dd>d<dt>e</dl></article>", "a\nb\nc\nd\ne"),
        ("<article><p class=notice>x <span class=ad>y<ul><li>a</ul></article>", "a"),
    ],
)
def test_boilerplate_is_named_exactly_and_ends_where_html_ends_it(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><p>a <span class=ad>buy <b>this</b></span>b</p></main>", "a b"),
        ("<main><div>a <span hidden>x <div>y</div> z</span> b</div></main>", "a\nb"),
        ("<main><p>a <button>x</button><select><option>y</select>b</p></main>", "a b"),
        ("<main><p>a <math><mi>x</mi></math> <canvas>y</canvas> <object>z</object></p></main>", "a x y z"),
        (f'<p class="x>{PROSE}', PROSE),
        (f"<p title='it>{PROSE}</p><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        ("<main><p title=it's>a</p><p>b's</p></main>", "a\nb's"),
        ("<main><p>a\x00b</p></main>", "a\x00b"),
        ("<main><table><tr><td>a</div></p></main>b</td></tr></table><p>c</p></main><p>d", "a\nb\nc"),
    ],
)
def test_inline_elements_and_broken_markup(html, want):
    assert html_extract.extract(html) == want


LANGUAGES = [
    "Согласно последним данным, город построил новую школу у реки, и жители теперь могут отдавать туда своих детей уже этой осенью, не дожидаясь конца ремонта старого здания на площади.",
    "根据最新的数据，这座城市在河边修建了一所新的学校，居民们从今年秋天起就可以把孩子送到那里去上学，而不必再等待广场上旧楼的维修工程全部结束；校方还表示，新校舍配有图书馆、实验室和运动场，足以容纳两千名学生，并且计划在明年春天开办面向成年人的夜间课程，欢迎附近的居民踊跃报名参加，同时学校也在招聘有经验的教师。",
]


@pytest.mark.parametrize("text", LANGUAGES)
def test_languages_without_stop_words(text):
    html = f"<nav><a href=1>x</a></nav><div class=ad>{text}</div><div><h1>T</h1><p>{text}</p><p>-</p><p>{text}</p></div><footer>{text}</footer>"
    assert html_extract.extract(html) == f"T\n{text}\n-\n{text}"


def test_second_pass_takes_nearest_neighbours():
    labels = ["good", "short", "good", "short", "bad", "near", "bad"]
    assert html_extract.second_pass(labels, list(range(7))) == [True, True, True, False, False, False, False]
    assert html_extract.second_pass(labels, [0, 1, 2, 3, 5, 6, 7]) == [True, True, True, True, False, False, False]
    assert html_extract.second_pass(["near", "good"], [0, 1]) == [True, True] and html_extract.second_pass(["short"], [0]) == [False]
    assert html_extract.second_pass(["short", "bad", "near", "bad", "short"], [1, 2, 3, 4, 6], (0, 7)) == [True, False, False, False, True]


class Gold(HTMLParser):
    """Another reader of the table's pages: all blocks of the article element."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.blocks, self.now = False, [], []
        self.feed(html or "")
        self.close()
        self.cut()

    def cut(self):
        said = " ".join("".join(self.now).split())
        self.blocks += [said] if said else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.now.append(" " * (tag == "br"))
        if tag in html_extract.BLOCK_TAGS:
            self.cut()
        self.inside |= tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK_TAGS:
            self.cut()
        self.inside &= tag not in ("article", "main")

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_pages_against_another_reader(spark, monkeypatch):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    gold = {i: Gold(h).blocks for i, h in pages.items()}
    assert {i: html_extract.extract(h) for i, h in pages.items()} == {i: "\n".join(b) for i, b in gold.items()}
    # without the marks the densities and neighbours decide alone
    bare = {i: re.sub(r"<(/?)(article|main)\b", r"<\1div", h or "") for i, h in pages.items()}
    found = {i: Counter(html_extract.extract(h).split("\n")) for i, h in bare.items()}
    want = {i: Counter(b) for i, b in gold.items()}
    blocks = sum(w.total() for w in want.values())
    assert sum((w - found[i]).total() for i, w in want.items()) < 0.1 * blocks and sum((f - want[i]).total() for i, f in found.items()) < 0.01 * blocks
    # and both passes matter
    monkeypatch.setattr(html_extract, "second_pass", lambda labels, at, edges=None: [x == "good" for x in labels])
    assert sum(html_extract.extract(h) != "\n".join(gold[i]) for i, h in pages.items()) > 0.5 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "STOP_WORDS", frozenset())
    assert sum(Counter(html_extract.extract(h).split("\n")) != found[i] for i, h in bare.items()) > 0.1 * len(pages)


@pytest.mark.parametrize(
    "html",
    [lambda n: "<div>" * n + "</p></span></b>" * 2 * n + "x", lambda n: "<p><table><td><div>" * n + "</section>" * 2 * n + "<li>" * n, lambda n: '<p a="x ' * n + "<li>" * n + "<b c='" * n, lambda n: f"<div class='{'site-' * n}'>x</div><span class=ad>" * 3 + "<script>" * n],
)
def test_time_grows_with_the_page(html):
    def took(n):
        page = html(n)
        began = time.process_time()
        html_extract.extract(page)
        return time.process_time() - began

    assert took(40_000) < 12 * took(10_000) + 0.5


def test_main_text_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "mine"), (1, "u", "<article>é</article>", "mine")], "page_id long, url string, html string, text string")
    rows = html_extract.main_text(df).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("é", 1)]
    assert html_extract.main_text(df).columns == ["page_id", "url", "text", "n_chars"] and html_extract.main_text(df.where("false")).count() == 0


def test_main_text_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "<p>Hello world</p>", "mine", 2, 3)], ["page_id", "html", "Text", "a.b", "N_CHARS2"])
    out = html_extract.main_text(df)
    assert out.columns == ["page_id", "a.b", "N_CHARS2", "text", "n_chars"]
    assert tuple(out.first()) == (1, 2, 3, "Hello world", 11)


PROSE = "This is a good paragraph with the words that we all know and it is long enough to be good, so that it counts as one of the good ones that are here."


@pytest.mark.parametrize("tag", ["article", "div"])
def test_linked_and_short_blocks_follow_their_neighbours(tag):
    cited, menu = "See <a href=1>the first of these long reports</a> and <a href=2>the second of them</a>", "<p><a href=3>One</a> | <a href=4>Two</a></p>"
    html = f"<{tag}><p>{PROSE}</p><p>{cited}</p><p>{PROSE}</p></{tag}>{menu}"
    assert html_extract.extract(html) == f"{PROSE}\nSee the first of these long reports and the second of them\n{PROSE}"
    assert html_extract.extract(f"<{tag}><p>Hello world</p></{tag}>{menu}") == "Hello world"
    assert html_extract.extract("<h1>Only title</h1><nav><a href=1>x</a></nav>") == "Only title" and html_extract.extract(menu) == ""


def plain_passes(blocks, at, inside):
    """Both passes written out block by block, for a page of known language: text, linked, heading, boilerplate."""
    share = lambda t: html_extract.stop_share(t)[0] / max(1, html_extract.stop_share(t)[1])
    labels = []
    for text, linked, heading, boiler in blocks:
        if boiler or linked == len(text):
            labels.append("bad")
        elif linked > 0.35 * len(text):
            labels.append("linked")
        elif heading or len(text) < 40:
            labels.append("bad" if linked else "short")
        elif share(text) >= 0.2:
            labels.append("good" if len(text) > 140 else "near")
        else:
            labels.append("near" if inside or share(text) >= 0.1 else "bad")
    for weaker in ("near", "short"):
        if "good" not in labels:
            labels = ["good" if x == weaker else x for x in labels]
    kept = []
    for i, label in enumerate(labels):
        decided = [j for j, x in enumerate(labels) if x in ("good", "bad")]
        sides = [max((j for j in decided if j < i), default=None), min((j for j in decided if j > i), default=None)]
        seen = [(abs(at[i] - at[j]), labels[j] == "good") for j in sides if j is not None]
        if inside:
            seen += [(abs(at[i] - place), True) for j, place in zip(sides, (at[0] - 1, at[-1] + 1), strict=True) if j is None]
        nearest = [good for d, good in seen if d == min(seen)[0]]
        good = [g for _, g in seen]
        kept.append(label == "good" or label == "near" and any(good) or label == "linked" and len(good) == 2 and all(good) or label == "short" and bool(nearest) and (any if inside else all)(nearest))
    for i, (_, _, heading, _) in enumerate(blocks[:-1]):
        kept[i] |= heading and labels[i] == "short" and kept[i + 1]
    return kept


@pytest.mark.parametrize("inside", [False, True])
def test_passes_against_their_rules_written_out(inside):
    rng = random.Random(8)
    words = "the of and in that house river blue seven walking lantern".split()
    for _ in range(400):
        blocks, at = [], []
        for _ in range(rng.randint(1, 9)):
            text = " ".join(rng.choices(words, weights=[rng.choice([1, 4])] * 5 + [3] * 6, k=rng.choice([1, 3, 9, 15, 40])))
            blocks.append((text, rng.choice([0, 0, 0, len(text) // 2, len(text), min(3, len(text))]), rng.random() < 0.2, rng.random() < 0.15))
            at.append((at[-1] if at else 0) + rng.randint(1, 4))
        stops = [(0, 0) if b[3] else html_extract.stop_share(b[0]) for b in blocks]
        shown = [s for b, s in zip(blocks, stops, strict=True) if not b[3] and b[1] / len(b[0]) <= 0.35]
        if 2 * sum(s for s, _ in shown) < 0.1 * sum(w for _, w in shown):
            continue
        assert html_extract.passes(blocks, at, stops, (at[0] - 1, at[-1] + 1) if inside else None) == plain_passes(blocks, at, inside)


def test_very_long_page_is_read_whole(spark):
    html = f"<article>{f'<p>{PROSE}</p>' * 20_000}<p>end</p></article>"
    (row,) = html_extract.main_text(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert row["n_chars"] == 20_000 * (len(PROSE) + 1) + 3 and row["text"].endswith("\nend")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en/x", "allow"), ("com", "", "block"), ("example.com", "/d", "allow"), ("com", "/d", "allow")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    rng = random.Random(2)
    hosts, paths = ["net", "example.net", "a.example.net", "b.a.EXAMPLE.net", "xnet", "example.com", "w.example.com", "org", "", "é.com", "net."], ["", "/", "/en/", "/en/x", "/en/xy?q=/", "/d", "/de#a", "/\U0010ffff", "?x", "/en"]
    urls = [None, "no scheme", "://", "http://", "a://b://c/d"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + ["http://x.com/d" + "e" * 50_000] + ["http://www.example.net/en/x"] * 400
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_url_rules_of_many_paths_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    path = lambda: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, 9)))
    many = sorted({(rng.choice(["net", "x.net"]), path()): rng.choice(["allow", "block"]) for _ in range(400)}.items())
    monkeypatch.setattr("tests.llm.test_pages.RULES", [(h, q, v) for (h, q), v in many])
    urls = [f"http://{rng.choice(['net', 'x.net', 'y.x.net'])}{path()}" for _ in range(600)] + [f"http://x.net{path()}"] * 500
    rules = spark.createDataFrame([(h, q, v) for (h, q), v in many], "host string, path string, verdict string")
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: brute(u) for i, u in enumerate(urls)}


def test_url_rules_replace_columns_of_their_names(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/", "b", "h", "p", "r", 5, "i", 2)], "page_id long, url string, best string, host string, PATH string, rule string, verdict long, _id string, n long")
    out = url_rules.judge(df, rules)
    assert out.columns == ["page_id", "url", "best", "_id", "n", "host", "path", "rule", "verdict"]
    assert out.collect() == [(1, "http://a.net/", "b", "i", 2, "a.net", "/", "net/", "block")]


def test_url_rules_without_rules_or_rows(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judge(df, rules.where("false")).collect()] == ["allow"] * 2
    assert url_rules.judge(df.where("false"), rules).count() == 0


@pytest.mark.parametrize("name", ["op3_url_filters", "op4_warc", "op5_exact_dedup"])
def test_queries_match_sql(spark, name):
    same(queries()[name](spark, SF), connect(), oracle_sql()[name])


def test_extraction_finds_the_articles(spark):
    rows = queries()["op1_html_extraction"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)


PAGES = [(1, "http://a/", "x" * 2000), (2, "http://b/\n é", "x" * 2000), (3, None, "short"), (4, "http://c/", "short"), (5, "http://d/", None), (6, "http://e/", "é" * 900), (6, "http://e/", "é" * 900), (None, "http://f/", "y" * 1500)]


@pytest.mark.parametrize("split", [64, 301, 4096, 1 << 20])
def test_warc_round_trip(spark, tmp_path, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "w")
    warc.write(df, path)
    rows = warc.read(spark, path, split_bytes=split).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in rows), key=str)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = i == 1
        want.append((i or 0, "revisit" if revisit else "response", 2 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if revisit else h or ""))
    assert got == sorted(want, key=str)


def test_warc_files_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and text.endswith(b"\r\n\r\n")


def test_large_records_keep_their_end():
    body = b"WARC/1.1\r\n" + bytes(17 << 20)
    made = warc.member(body)
    assert made.endswith(b"\0") and gzip.decompress(made) == body


def test_reader_passes_over_false_magic():
    a = warc.member(warc.record("1", "u", b"one", "d", None, "t"))
    b = warc.member(warc.record("2", "u", b"two", "d", None, "t"))
    data = warc.MAGIC + b"junk" + a + warc.MAGIC + gzip.compress(b"not a record") + b + warc.MAGIC
    for split in (1, 7, 50, 10_000):
        found = [warc.row(*r)[0] for s in range(0, len(data), split) for r in warc.records(warc.Source(io.BytesIO(data), len(data)), s, min(len(data), s + split))]
        assert found == [1, 2]


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").where("false")
    warc.write(df, str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
