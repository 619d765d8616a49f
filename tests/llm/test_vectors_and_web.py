"""Top-k search, WARC and HTML extraction."""

import base64
import gzip
import hashlib
import random
import time
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, html_text, knn, warc


def brute_topk(rows, k):
    ok = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in ok:
        if q % 50 == 0:
            best = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)})[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_topk_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "SHARE", 150)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) + 3 * (i % 4))]) for i in range(600)]
    same = rows[7][1]
    rows += [(i, same) for i in range(600, 760)]  # one very common vector, also asked
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (1200, [0.0] * 6), (1250, [1.0, 2.0]), (1251, [2.0, 2.0]), (1300, [9.0] * 3), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit("x")).repartition(5)
    got = knn.search(df, F.col("vec_id") % 50 == 0, 5, pivots=12)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == brute_topk(rows, 5)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert knn.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    doubled = knn.search(df.union(df.where("vec_id = 3")), F.col("vec_id") % 50 == 0, 5, pivots=12)
    assert doubled.count() == got.count()


def test_pruning_sends_less_than_everything():
    """Tight, far clusters: a vector reaches few bins."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    pivots = np.eye(8) * 1000
    x = np.repeat(pivots, 50, axis=0) + rng.normal(size=(400, 8))
    batch = pa.RecordBatch.from_arrays([pa.array([[int(a) for a in v] for v in x]), pa.array([[i] for i in range(400)])], names=["v", "ids"])
    sent = sum(b.num_rows for b in knn._replicated(pivots, np.full(8, 5.0), np.full(8, 900_000.0), np.arange(8))(iter([batch])))
    assert sent == 400


def test_exact_beyond_float():
    a = np.array([[2**40, 1]], np.int64)
    assert knn._exact(a, a)[0, 0] == 2**80 + 1


PAGES = [(1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, "x" * 999), (4, "http://c/", "x" * 999), (5, "u\r\nv", None), (6, "u", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 200), (8, "p", "é\r\n\r\nWARC/1.1\r\n" * 200), (9, "n", "nul\0" * 500), (2, "http://b/", "x" * 1000), (None, "z", "x" * 1000), (10, "long", "y" * 3_000_000)]


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_warc_round_trip(spark, by_sql, rows_of, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("payload", F.lit("")).repartition(3)
    got = warc.round_trip(pages)
    assert got.where("record_type = 'quarantined'").count() == 0
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    known = [p for p in PAGES if p[0] is not None]
    frame = pd.DataFrame(known, columns=["page_id", "url", "html"])
    assert rows_of(got.where("page_id IS NOT NULL").select(*columns)) == by_sql("op6_warc", pages=frame)
    none = got.where("page_id IS NULL").first()
    assert (none.record_type, none.refers_to, none.payload_bytes) == ("revisit", 2, 1000)
    assert got.where("page_id = 5").first().url == "u%0D%0Av" and got.where("page_id = 3").first().url is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def members(n):
    return [warc.make_record(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * 20) + b"\r\n\r\n" for i in range(n)]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    parts = [gzip.compress(m) if zipped else m for m in members(8)]
    whole = b"".join(parts)
    ids = lambda data: [f["warc-record-id"] for _, _, f, _ in warc.salvage(data) if f]
    gaps = lambda data: [(o, n) for o, n, f, _ in warc.salvage(data) if f is None]
    assert len(ids(whole)) == 8 and not gaps(whole)
    starts = np.cumsum([0, *map(len, parts)])
    at = int(starts[3]) + len(parts[3]) // 2
    hurt = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
    assert len(ids(hurt)) == 7 and gaps(hurt) == [(int(starts[3]), len(parts[3]))]
    junk = parts[0] + b"\x1f\x8b\x08junk WARC/1.1\r\nno header" + b"".join(parts[1:])
    assert len(ids(junk)) == 8 and len(gaps(junk)) == 1
    torn = whole[: int(starts[7]) + 20]
    assert len(ids(torn)) == 7 and gaps(torn) == [(int(starts[7]), 20)]
    lost = b"".join(parts[:2]) + parts[2][:30] + b"".join(parts[3:])
    assert len(ids(lost)) == 7 and gaps(lost)[0][0] == int(starts[2])
    pieces = [(o, n) for o, n, *_ in warc.salvage(hurt)]
    assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) == len(hurt)
    assert list(warc.salvage(b"")) == []


def test_member_of_several_records_that_is_cut_off():
    """The records before the file's end are recovered; a member that is damaged inside is quarantined whole."""
    rng = random.Random(4)
    body = b"".join(warc.make_record(k, f"http://x/{k}", bytes(rng.randrange(256) for _ in range(3000)), None) + b"\r\n\r\n" for k in range(4))
    whole, first = gzip.compress(body), gzip.compress(members(1)[0])
    found = list(warc.salvage(first + whole[: len(whole) * 5 // 8]))
    assert [f["warc-target-uri"] for *_, f, _ in found if f is not None] == ["http://h/0", "http://x/0", "http://x/1"]
    assert sum(n for _, n, *_ in found) == len(first) + len(whole) * 5 // 8 and found[-1][2] is None
    hurt = bytearray(whole)
    hurt[len(whole) * 5 // 8] ^= 255
    assert [f for *_, f, _ in warc.salvage(bytes(hurt) + first) if f is not None][0]["warc-target-uri"] == "http://h/0"


def test_repeated_ids_leave_k_others(spark):
    """An asking id with several vectors near the top still gets k rows of other ids."""
    rows = [(0, [1.0, k / 8]) for k in range(6)] + [(k, [0.5, k / 16]) for k in range(1, 9)]
    got = knn.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    best = sorted({(-sum(a * b for a, b in zip(q, x)), i) for k, q in whole if k == 0 for i, x in whole if i != 0})[:5]
    assert [(r.rank, r.vec_id, r.score) for r in got.sort("rank").collect()] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_salvage_random_damage():
    rng, parts = random.Random(2), members(20)
    for _ in range(60):
        data = bytearray(b"".join(parts))
        a = rng.randrange(len(data))
        del data[a : a + rng.randrange(1, 400)]
        found = list(warc.salvage(bytes(data)))
        assert sum(n for _, n, *_ in found) == len(data) and sum(f is not None for *_, f, _ in found) >= 16


def test_reader_reads_files_and_quarantines(spark, tmp_path):
    parts = members(3)
    (tmp_path / "a.warc").write_bytes(parts[0] + b"garbage" + parts[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[2]))
    rows = warc.read(spark, str(tmp_path), with_payload=True).collect()
    assert sorted(r.page_id for r in rows if r.page_id is not None) == [0, 1, 2]
    gap = next(r for r in rows if r.record_type == "quarantined")
    assert bytes(gap.payload) == b"garbage" and gap.offset == len(parts[0]) and gap.length == 7
    one = next(r for r in rows if r.page_id == 2)
    assert bytes(one.payload) == b"<p>page 2</p>" * 20 and one.payload_digest == hashlib.sha1(bytes(one.payload)).hexdigest()
    assert base64.b32encode(bytes.fromhex(one.payload_digest)).decode() in parts[2].decode()


HTML = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header><h2>Site</h2></header><article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>\n  text.<br>More&nbsp;x</p><div class='ad'>Buy</div><p>&lt;i&gt; ü &#233; &amp;amp;</p><ul><li>first<li>second</ul><form>Name <input></form><aside>side</aside><div id=comments><p>nice!</p></div><p>.</p></article><footer>(c)</footer></body></html>",
     "Head&line\n\nOne bold text. More x\n\n<i> ü é &amp;\n\nfirst\n\nsecond\n\n."),
    ("<body><div class='cookie-notice'>We use cookies</div><div id='sidebar'><p>links</p></div><div><p>" + "Long text here. " * 30 + "</p><p>Short.</p></div><div class='footer'>bye</div>", "Long text here. " * 29 + "Long text here.\n\nShort."),
    ("<article>a < b and c > d <script>if (a</p>b) '<p>'</script><p>x</p><!-- <p>no</p> --><p>y</p><!-- open <p>z</p></article>", "a < b and c > d\n\nx\n\ny"),
    ("<main><p title='a > b'>q</p><section class=related-posts><p>r</p></section></main><p>out</p>", "q"),
    ("<article><p hidden>h</p><div style='display:none'>n</div><div role=navigation>m</div><p>kept</p></article>", "kept"),
    ("<article><p>" + "word " * 100_000 + "</p></article>", ("word " * 100_000).strip()),
    ("<div><table><tr><td>1<td>2<tr><td>3</table></div>", "1\n\n2\n\n3"),
    ("<p>unclosed <b>bold <p>next <a href='x", "unclosed bold\n\nnext <a href='x"),
]


@pytest.mark.parametrize("k", range(len(HTML)))
def test_extract(k):
    assert html_text.extract(HTML[k][0]) == HTML[k][1]


def test_surge_and_dive():
    assert html_text.spans([0, 0, 0, 50, 60, 0, 0, 0, 0, 2, 0, 0, 0, 90], 40) == [(1, 5), (11, 14)]
    assert html_text.spans([], 1) == [] and html_text.spans([5], 1) == [(0, 1)]


class Tree(HTMLParser):
    """Pages as nested lists [name, parts], with the ends that paragraphs and items leave out."""

    def __init__(self, html):
        super().__init__()
        self.open = [["", {}, []]]
        self.feed(html)
        self.close()

    def handle_starttag(self, name, attributes):
        if name in ("p", "li") and self.open[-1][0] == name:
            self.open.pop()
        node = [name, {k: v or "" for k, v in attributes}, []]
        self.open[-1][2].append(node)
        if name not in html_text.VOID:
            self.open.append(node)

    def handle_endtag(self, name):
        if name in [x[0] for x in self.open[1:]]:
            while self.open.pop()[0] != name:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_extract(html):
    """The method on a tree: lines, sums over all windows, stretches, and the articles or elements that they choose."""
    lines = []  # text, outside links, article, element of the paragraph

    def walk(node, article, owner, linked):
        name, attributes, parts = node
        tokens = {t for k in ("class", "id") for t in attributes.get(k, "").lower().split()}
        if name in html_text.BOILERPLATE or name == "header" and not article or tokens & html_text.NAMES:
            lines.extend([("", 0, None, None)] * 3)
            return
        article = article or (id(node) if name in ("article", "main") else None)
        if name not in html_text.BETWEEN | html_text.INLINE:
            owner = id(node)
        buffer = node[3:] and node[3] or []

        def flush():
            text = " ".join("".join(t for t, _ in buffer).split())
            if text:
                own = owner if name in html_text.PARAGRAPHS else None
                lines.append((text, sum(c.isalnum() for t, k in buffer for c in t if not k) if any(k for _, k in buffer) else len(text), article, own))
            buffer.clear()

        def inline(part, linked):
            if isinstance(part, str):
                buffer.append((part, linked))
            elif part[0] == "br":
                buffer.append((" ", linked))
            elif part[0] in html_text.INLINE:
                for x in part[2]:
                    inline(x, linked or part[0] == "a")
            else:
                flush()
                walk(part, article, owner, linked)

        for part in parts:
            inline(part, linked)
        flush()

    walk(Tree(html or "").open[0], None, None, False)
    has = any(a for _, _, a, _ in lines)
    weight = [n * (10 if a or not has else 1) for _, n, a, _ in lines]
    if not any(weight):
        weight = [len(t) * (10 if a or not has else 1) for t, _, a, _ in lines]
    sums = [sum(weight[i : i + 3]) for i in range(len(weight))]
    least = max(1, int(0.15 * max(sums, default=0)))
    state, stretch, k = False, [None] * len(lines), 0
    for i, x in enumerate(sums):
        k += not state and x >= least
        state = x >= least or state and x > 0
        stretch[i] = k if state else None
    chosen = {}
    for i, (_, _, a, _) in enumerate(lines):
        if stretch[i] and weight[i]:
            chosen[a or -stretch[i]] = chosen.get(a or -stretch[i], 0) + weight[i]
    articles = {a for a in chosen if a > 0}
    if articles and max(chosen[a] for a in articles) >= max((w for a, w in chosen.items() if a < 0), default=0):
        return "\n\n".join(t for t, _, a, _ in lines if t and a in articles)
    kept = set()
    for s in {-a for a in chosen if a < 0}:
        ends = [i for i in range(len(lines)) if stretch[i] == s and weight[i] and not lines[i][2]]
        kept |= {i for i in range(ends[0], ends[-1] + 1) if lines[i][0] and not lines[i][2]}
    owners = {lines[i][3] for i in kept} - {None}
    return "\n\n".join(x[0] for i, x in enumerate(lines) if x[0] and not x[2] and (i in kept or x[3] in owners))


LONG = "A sentence of the story that goes on for a while. " * 8
SHAPED = [
    f"<body><div><a href=1>Home</a></div><div>Menu</div><div class=x><a>one</a> <a>two</a></div><div><h1>Title</h1><p>{LONG}</p><div class=ad>Buy</div><p>{LONG}</p><div class=ad>Buy</div><p>The end.</p></div><div><a href=2>Terms</a></div>",
    f"<body><article><p>Teaser</p></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>",
    f"<main><h1>T</h1><p>{LONG}<p>short</main><main><p>{LONG}</p></main><article><p>x</article>",
    "<ul><li><a href=1>first</a><li><a href=2>second link</a></ul>",
]


def test_extract_against_plain_version():
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    for html in [*pages, *SHAPED]:
        assert html_text.extract(html) == plain_extract(html)


def test_windows_decide():
    story, teaser, *_ = SHAPED
    assert html_text.extract(story).startswith("Title\n\nA sentence") and html_text.extract(story).endswith("The end.")
    # With a threshold of one character every line surges, and with windows of a line the stretch ends at each short one.
    assert "Menu" in html_text.extract(story, peak=0) and html_text.extract(story, window=1) != html_text.extract(story, peak=0)
    assert "Teaser" not in html_text.extract(teaser) and LONG.strip() in html_text.extract(teaser)
    far = f"<div>{LONG}</div><div class=ad></div><div class=ad></div><div>cookies are used</div>"
    assert html_text.extract(far) == LONG.strip() and "cookies" in html_text.extract(far, peak=0)


@pytest.mark.parametrize("part", ["<p style='display:block;float:none'>stay</p>", "<p><math><mi>stay</mi></math></p>", "<section class='search-results social-policy'><p>stay</p></section>", "<p data-id=ad class='reads-ad-hoc'>stay</p>"])
def test_parts_of_the_article_stay(part):
    assert html_text.extract(f"<article><p>one</p>{part}<p>two</p></article>") == "one\n\nstay\n\ntwo"


@pytest.mark.parametrize("part", ["<p style='color:red; DISPLAY : none'>go</p>", "<div class='site-footer'>go</div>", "<div id='cookieNotice'>go</div>", "<div class='big ad-300x250'>go</div>", "<div class='comments-area'><p>go</p></div>"])
def test_boilerplate_goes(part):
    assert html_text.extract(f"<article><p>one</p>{part}<p>two</p></article>") == "one\n\ntwo"


def test_deep_and_unmatched_markup_is_linear():
    deep = "<div>" * 100_000 + "<p>x</p>" + "</p>" * 100_000 + "</div>" * 100_000 + "<b>" + "<div>" * 50_000 + "</b>" * 50_000 + "<p>y"
    began = time.time()
    assert html_text.extract(deep) == "x\n\ny" and time.time() - began < 20


def test_main_text_table(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(HTML)] + [(None, None, "<p>é"), (2, "u2", "plain")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2))
    got = html_text.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(HTML) + 2
    for r in got.collect():
        assert r.text == ("é" if r.page_id is None else HTML[r.page_id][1]) and r.n_chars == len(r.text)
    assert html_text.main_text(pages.limit(0)).count() == 0
