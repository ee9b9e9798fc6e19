import gzip
import random
import re
import time

import numpy as np
import pyarrow as pa

from offerscore.llm import decontaminate, html_extract, textops, warc

from .conftest import prose

PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>"
        "<div class='ad-box'>Buy now cheap</div>{open}<h1>Big &amp; new</h1><p>First\n  words <b>he</b>re.<p>Second&nbsp;one<br>next &lt;p&gt;."
        "<aside>Side note</aside><form>Your mail</form><script>x = '<p>no</p>'</script></p><p>{body}</p>{close}"
        "<section id='comments'><p>{body} I disagree with all of it</p></section><footer>&copy; us</footer></body></html>")


def page(rng, mark="article"):
    return PAGE.replace("{open}", f"<{mark}>").replace("{close}", f"</{mark}>").replace("{body}", prose(rng, 30))


def test_main_text(spark):
    rng = random.Random(11)
    pages = [page(rng) for _ in range(8)] + [page(rng, "div")]
    odd = [None, "", "   ", "no markup &amp; all", "<p>unclosed <b>bold", "<nav>only a menu</nav>", "<article></article>", "<!-- c", "<p " + "x" * 5000]
    rows = [(k, f"http://x/{k}", h, k) for k, h in enumerate(pages + odd)] + [(0, "http://x/0", pages[0], 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for k, h in enumerate(pages):
        body = h.split("</p><p>")[1].split("</p>")[0]
        assert by[k]["text"] == "Big & new First words here. Second one next <p>. " + body, k
        assert by[k]["n_chars"] == len(by[k]["text"]) and by[k]["url"] == f"http://x/{k}"
    assert [by[9 + k]["text"] for k in range(4)] == ["", "", "", "no markup & all"]
    assert by[13]["text"] == "unclosed bold" and by[14]["text"] == "" and by[15]["text"] == ""
    assert html_extract.main_text(df.filter("page_id < 0")).collect() == []


def test_weights_are_learned(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(page(rng),) for _ in range(5)], "html string")
    weight = html_extract.weights(df)
    assert weight["word", "p"] > 1 and ("word", "li+a") not in weight      # menus are known by name
    assert weight["tag", "nav"] < weight["tag", "p"] < 0
    assert html_extract.weights(df.filter("false")) == {}


def response(body, http="Content-Type: text/html; charset=utf-8\r\n", more="", kind="response"):
    block = b"HTTP/1.1 200 OK\r\n" + http.encode() + b"\r\n" + body
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>Hi &amp; <b>b</b>ye</p><script>x</script><p>two", 0), (2, None, None, 0), (None, "u", "", 0)],
                                  "page_id long, url string, html string, record int")
    records = warc.responses(pages)
    source = {r["page_id"]: bytes(r["record"]) for r in records.collect()}
    out = warc.derive(records, "page_id").collect()
    assert len(out) == 6
    for r in out:
        headers, block = warc.parse(bytes(r["record"]))
        old, old_block = warc.parse(source[r["page_id"]])
        assert warc.header(headers, "WARC-Refers-To") == warc.header(old, "WARC-Record-ID") == r["refers_to"]
        assert warc.header(headers, "WARC-Type") == r["warc_type"] and warc.header(headers, "WARC-Date") == warc.header(old, "WARC-Date")
        assert warc.digest_ok(warc.header(headers, "WARC-Block-Digest"), block) and r["block_digest_ok"] and r["payload_digest_ok"]
        assert r["source_payload_digest"] == warc.header(old, "WARC-Payload-Digest")
        if r["warc_type"] == "metadata":
            assert f"warc-WARC-Block-Digest: {warc.header(old, 'WARC-Block-Digest')}" in block.decode()
    text = {r["page_id"]: warc.parse(bytes(r["record"]))[1].decode() for r in out if r["warc_type"] == "conversion"}
    assert text == {1: "Hi & bye\ntwo", 2: "", None: ""}
    assert len({r["record_id"] for r in out}) == 6
    assert warc.derive(records.filter("page_id < 0"), "page_id").collect() == []


def test_warc_encodings_and_faults():
    body = "<p>café</p>".encode("latin-1")
    zipped = gzip.compress(body)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(zipped[i:i + 7]), zipped[i:i + 7]) for i in range(0, len(zipped), 7)) + b"0\r\n\r\n"
    made = warc.derive_one(response(chunked, "Content-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n"))
    assert warc.parse(made[1]["record"])[1].decode() == "café" and made[0]["payload_digest_ok"] is None
    assert warc.derive_one(response(b"x", more="WARC-Payload-Digest: sha1:AAAA\r\n"))[0]["payload_digest_ok"] is False
    assert warc.derive_one(response(b"x", kind="request")) == []
    for bad in (None, b"", b"nonsense", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort", response(b"x").replace(b"WARC-Record-ID", b"X")):
        assert warc.derive_one(bad)[0]["error"]
    assert warc.parse(warc.derive_one(response(b"\xff\xfe", "Content-Type: image/png\r\n"))[1]["record"])[1] == b""


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_normalise():
    texts = ["  Ab,C  d!", "", "--", "É x", "a", " b"]
    data, ends = decontaminate.normalise(*textops.buffers(pa.array(texts)))
    cut = np.concatenate([[0], ends])
    assert [bytes(data[i:j]).decode() for i, j in zip(cut, cut[1:])] == ["ab c d", "", "", "É x", "a", "b"]


def test_scan_against_edit_distance():
    rng = random.Random(13)
    items = [(k, prose(rng, rng.randint(8, 25))) for k in range(12)]
    patterns = decontaminate.Patterns(items, 0.05, 128)
    flat = [bytes(t).decode() for t in patterns.text]
    for _ in range(60):
        parts = [prose(rng, 12)]
        for p in rng.sample(flat, 2):
            s = list(p)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(s))
                s[at:at + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
            parts += ["".join(s), prose(rng, 9)]
        text = " ".join(" ".join(parts).split())
        data = np.frombuffer(text.encode(), np.uint8)
        got = {i for _, i in patterns.search(data, np.array([len(data)]))}
        want = {int(patterns.item[k]) for k, p in enumerate(flat) if edits(p, text) <= patterns.budget[k]}
        assert got == want


def test_scan_in_stretches(monkeypatch):
    """Repetitive items and texts, cut into many stretches and pattern ranges, give the same."""
    rng = random.Random(15)
    items = [(k, prose(rng, 6) + " zero" * 20 + " " + prose(rng, 6)) for k in range(9)] + [(9, "na " * 90)]
    text = " ".join([prose(rng, 9), items[3][1], "zero " * 60, items[7][1][:-2], "na " * 150, prose(rng, 9)])
    patterns = decontaminate.Patterns(items, 0.05, 128)
    data, ends = decontaminate.normalise(*textops.buffers(pa.array([text, text[:40], "na " * 120])))
    whole = patterns.search(data, ends)
    assert {(0, 3), (0, 7), (0, 9), (2, 9)} <= set(whole)
    for posts in (20_000, 60_000):
        monkeypatch.setattr(decontaminate, "POSTS", posts)
        monkeypatch.setattr(decontaminate, "VERIFY", 50)
        assert patterns.search(data, ends) == whole


def test_html_unclosed_elements():
    """Many elements without an end cost no more than their number."""
    start = time.time()
    page = "<article><p>" + "<b>one more word <i>here</i> <span>" * 20_000 + "</article><div class=menu>" + "<div>x" * 20_000
    assert html_extract.extract(page, {}) == " ".join(["one more word here"] * 20_000)
    assert time.time() - start < 20


def test_decontaminate(spark, docs, none):
    rng = random.Random(14)
    long = prose(rng, 120)
    items = [(1, prose(rng, 20)), (2, long), (3, "Short item?"), (None, prose(rng, 18)), (5, None), (6, " ")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    more = [(901, "before " + items[0][1].upper().replace(" ", ", ") + " after"), (902, long[150:450]), (903, "a short item"), (904, "short items"),
            (None, items[3][1]), (905, items[0][1]), (905, items[0][1])]
    table = docs.select("doc_id", "text", "item_id").unionByName(spark.createDataFrame([(i, t, 0) for i, t in more], "doc_id long, text string, item_id int"))
    for block in (16 << 20, 200):
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.scan(table, bench, block_bytes=block).collect()}
        assert got == {901: [1], 902: [2], 903: [3], None: [-1], 905: [1]}
    left = decontaminate.clean(table, bench)
    assert left.columns == table.columns and left.count() == docs.count() + 1
    assert decontaminate.scan(none, bench).collect() == []
    assert decontaminate.scan(table, bench.filter("false")).collect() == []
    assert decontaminate.clean(table, bench.filter("false")).count() == table.count()


def test_an_element_is_closed_from_any_depth():
    page = "<body><nav>" + "<div>" * 300 + "menu words " * 20 + "</nav><p>" + "article words " * 20 + "</p></body>"
    assert html_extract.extract(page, {}) == ("article words " * 20).strip()


def test_quotes_against_edit_distance(monkeypatch):
    """Any 50 bytes of an item with at most 2 edits are found, and nothing else besides whole patterns."""
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(9, 45))) for k in range(8)]
    whole, patterns = decontaminate.Patterns(items, 0.05, 128), decontaminate.Patterns(items, 0.05, 128, 50)
    more = 0
    for k in range(25):
        t = rng.choice(items)[1]
        n = min(len(t), rng.choice([44, 48, 50, 50, 54, 70, 95]))
        at = rng.randint(0, len(t) - n)
        s = list(t[at:at + n])
        for _ in range(rng.randint(0, 4)):
            spot = rng.randrange(len(s))
            s[spot:spot + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
        text = " ".join((prose(rng, 4) + " " + "".join(s) + " " + prose(rng, 4)).split())
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.array([len(data)])
        old = {i for _, i in whole.search(data, ends)}
        want = old | {i for i, t in items if any(edits(t[a:a + 50], text) <= 2 for a in range(len(t) - 49))}
        got = {i for _, i in patterns.search(data, ends)}
        assert got == want, (k, got, want)
        more += len(want - old)
    assert more > 5
    texts = [items[0][1][:60], "x " + items[1][1][-55:] + " y", "zero " * 60]
    data, ends = decontaminate.normalise(*textops.buffers(pa.array(texts)))
    found = patterns.search(data, ends)
    monkeypatch.setattr(decontaminate, "POSTS", 20)
    monkeypatch.setattr(decontaminate, "VERIFY", 3)
    assert patterns.search(data, ends) == found and {(0, 0), (1, 1)} <= set(found)


def test_partial_passages(spark):
    rng = random.Random(22)
    items = [(1, prose(rng, 80)[:190]), (2, prose(rng, 90)[:400]), (3, prose(rng, 90)[:250])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "so " + items[0][1][:95] + " it"), (2, "so " + items[0][1][95:] + " it"), (3, "so " + items[1][1][37:37 + 140] + " it"),
            (4, "so " + items[2][1][101:155] + " it"), (5, "so " + items[2][1][100:130] + " it"), (6, prose(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontaminate.scan(docs, bench).collect()} == {1: [1], 2: [1], 3: [2], 4: [3]}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {5, 6}


def test_marks_are_evidence():
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    # generated ids inside an article; links, controls and replies under such an id still go
    page = (f"<article><h2 id='search-algorithms'>Search algorithms</h2><p>{a}</p><h3 id=alert-types>Alert types</h3><p id='social-life'>{b}</p>"
            f"<section id='related-work'><h2>Related work</h2><p>{c}</p></section><div id='related-posts'><a href=x>{d}</a> read</div>"
            f"<div id='newsletter-box'>Sign up <input></div><div id='comments-list'><p>{d}</p></div><div class='share-row'>Share this</div></article>")
    assert html_extract.extract(page, {}) == f"Search algorithms {a} Alert types {b} Related work {c}"
    # a wrapper or form around a page's text; what is marked inside it still goes
    for wrapper in ("div class='page no-sidebar'", "div id=has-header", "form action=x"):
        page = f"<body><nav>{d}</nav><{wrapper}><p>{a}</p><div class='sidebar'>Side words</div><p>{b}</p></{wrapper.split()[0]}><div class=footer>{c}</div></body>"
        assert html_extract.extract(page, {}) == f"{a} {b}", wrapper
    # beside an article they stay out, however long
    page = f"<article><p>{a}</p></article><div class='sidebar'><p>{b} {c} {d}</p></div><form><p>{b} {c} {d}</p></form>"
    assert html_extract.extract(page, {}) == a
    assert html_extract.extract(f"<div><p>{a}</p></div><div id=comments><p>{b} {c} {d}</p></div>", {}) == a
    start = time.time()
    assert html_extract.extract("<div class=menu>x" * 20_000, {}) != "" and time.time() - start < 20


def test_the_region_against_all_regions():
    """The scan's region has the largest sum of all; of equal sums it ends first, and is the shortest of those."""
    rng = random.Random(24)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        regions = [(sum(scores[i:j]), -j, i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        total, end, start = max(regions, default=(0.0, 0, 0))
        assert html_extract.best_region(scores) == ((start, -end) if total > 0 else (0, 0)), scores
    # the same over the pieces of pages
    for _ in range(10):
        for weight in ({}, {("word", "p@in"): 3.0, ("tag", "p@in"): -0.1, ("tag", "nav@out"): -3.0}):
            scores, _ = html_extract.scored(page(rng, rng.choice(["article", "main", "div"])), weight)
            start, end = html_extract.best_region(scores)
            best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
            assert abs(sum(scores[start:end]) - best) < 1e-9


def test_whole_articles_around_dropped_elements(spark):
    """Nothing inside an article is lost to a long dropped element, short blocks, lists or links."""
    rng = random.Random(25)
    a, b = prose(rng, 40), prose(rng, 40)
    links = "<ul>" + "".join(f"<li><a href=x>link{k}</a></li>" for k in range(20)) + "</ul>"
    items = "<ul>" + "".join(f"<li>{prose(rng, 5)}</li>" for _ in range(20)) + "</ul>"
    bodies = [f"<p>{a}</p><aside>{prose(rng, 60)}</aside><p>{b}</p>", f"<p>{a}</p><nav>{links}</nav><p>{b}</p>",
              "".join(f"<div>{prose(rng, 6)}</div>" for _ in range(10)), f"<p>{a}</p>{items}", f"<p>{a}</p>{links}<p>{b}</p>",
              "".join(f"<p>{prose(rng, 5)} <a href=x>more</a></p>" for _ in range(10)), f"<p>{a}</p><div class=ad>{prose(rng, 90)}</div>{items}"]
    html = [f"<html><body><nav>{links}</nav><div class=ad>{a}</div><{mark}><h1>Some heading words</h1>{x}</{mark}><footer>{a}</footer></body></html>"
            for x in bodies for mark in ("article", "main")]
    learned = html_extract.weights(spark.createDataFrame([(page(rng),) for _ in range(250)], "html string"))
    for x in html:
        want = re.sub(r"(?s)<(aside|nav|footer)>.*?</\1>|<div class=ad>.*?</div>|<[^>]*>", " ", x).split()
        for weight in (learned, {}):
            assert html_extract.extract(x, weight).split() == want, x
    # text outside of a marked article stays out, also where no name or class marks it
    assert html_extract.extract(f"<div><p>{b}</p></div><article><p>{a}</p></article><div><p>{b}</p></div>", learned) == a
    # a mark that holds nothing does not count
    assert html_extract.extract(f"<article></article><div><p>{a}</p></div>", learned) == a


def test_warc_repeated_rows(spark):
    rows = [(1, "http://a/", "<p>one"), (1, "http://a/", "<p>one"), (1, "http://b/", "<p>one")]
    out = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id").collect()
    assert len(out) == 6 and sorted(r["warc_type"] for r in out) == ["conversion"] * 3 + ["metadata"] * 3
    assert {warc.parse(bytes(r["record"]))[1].decode() for r in out if r["warc_type"] == "conversion"} == {"one"}
