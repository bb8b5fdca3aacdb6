import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from prose_audit.llm import html_extract as he

SMALL = "/root/testdata/sf0.001"


def plain(page):
    """The article of the test tables' pages, by a regular expression."""
    import html

    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if x)


def text_of(page):
    found = he.blocks(page)
    return "\n".join(t for z, t in found if z == he.best_zone(found))


def test_markup():
    assert text_of("") == "" and text_of("just text &amp; more") == "just text & more"
    assert text_of("<p>a<b>b</b> c<br>d  \n e&nbsp;f&#233;&eacute</p><p>next") == "ab c d e féé\nnext"
    assert text_of("<p>1 < 2 and <b>3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text_of("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>never closed <p>x") == "yes"
    page = (
        "<html><body class='no-sidebar'><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class=\"cookie-notice\">We use cookies</div>"
        "<div id=sidebar><p>Links</p></div><main><article class='post'><header class=entry-header><h1>Title</h1><p>by me</p></header><p>First <a href='x'>link</a> here.</p>"
        "<div class='ad-slot'>Buy</div><aside>More</aside><ul><li>one<li>two</ul><form><label>Mail</label><input></form><blockquote>Quote</blockquote>"
        "<p hidden>gone</p><p style='display: none'>gone</p></article><section id='comments'><article><p>Nice post!</p></article></section></main><footer>(c)</footer></body>"
    )
    assert text_of(page) == "Title\nFirst link here.\none\ntwo\nQuote"
    assert text_of("<div class='content'><p>Body text</p></div><div><p>Other</p></div>") == "Body text"
    assert text_of("<div><p><a href=1>menu</a> <a href=2>menu</a></p><p>Plain text here</p></div>") == "Plain text here"
    assert text_of("<p>" + "x " * 200_000 + "</p><a href='unclosed><p>y") .startswith("x x")


def plain_runs(pages):
    """On how many of the pages each run of RUN tokens stands."""
    count = Counter()
    for words in pages:
        count.update({" ".join(words[i : i + he.RUN]) for i in range(len(words) - he.RUN + 1)})
    return count


def test_suffix_arrays_against_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        tokens = np.array(rng.choices(range(3), k=rng.randrange(2, 300)))
        order, shared = he.suffix_array(tokens)
        most = 2 * he.DEPTH - 1
        keys = [tuple(tokens[i : i + most].tolist()) for i in range(len(tokens))]
        assert sorted(order.tolist()) == list(range(len(tokens))) and [keys[i] for i in order] == sorted(keys)
        for k in range(1, len(tokens)):
            a, b = keys[order[k - 1]], keys[order[k]]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        pages = [rng.choices("ab", k=rng.randrange(1, 40)) for _ in range(12)]
        for least in (1, 3):
            assert dict(zip(*he.run_pages(pages, least))) == {r: n for r, n in plain_runs(pages).items() if n >= least}


def plain_host(pages):
    """Main texts of a host's pages, by counting the runs of all distinct pages."""
    mains = [he.main_blocks(p) for p in pages]
    kinds = {tuple(t) for _, t in mains if t}
    count = plain_runs([he.stream(list(k)) for k in kinds])
    out = []
    for zone, texts in mains:
        least, share = he.MOST if zone == he.ARTICLE else he.FEW
        enough = max(least, math.ceil(share * len(kinds) - 1e-9))
        words, gone = he.stream(texts), set()
        for i in range(len(words) - he.RUN + 1):
            if count[" ".join(words[i : i + he.RUN])] >= enough:
                gone |= set(range(i, i + he.RUN))
        left = " ".join("" if i in gone and w != he.MARK else w for i, w in enumerate(words))
        out.append("\n".join(x for x in (" ".join(block.split()) for block in left.split(he.MARK)) if x))
    return out


def hosts(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    notices = ["this site is run by volunteers and needs your help today %d" % k for k in range(4)]
    rows = []
    for host in range(5):
        for i in range(rng.choice([2, 8, 40])):
            text = " ".join(rng.choices(words, k=40))
            if rng.random() < 0.7:
                at = rng.randrange(len(text.split()))
                text = " ".join([*text.split()[:at], notices[host % 4], *text.split()[at:]])
            inner = f"<p>{text}</p>" + f"<div>Home</div><div>About us</div><div>Contact</div><div>Imprint {host}</div>" * (rng.random() < 0.8)
            html = rng.choice(["<article>%s</article>", "<div>%s</div>", "<main>%s</main>"][: 1 + 2 * (host % 2)]) % inner
            rows += [(len(rows) + k, f"http://h{host}.example/{i}", html) for k in range(rng.choice([1, 1, 3]))]
    return rows


def test_host_boilerplate(spark, monkeypatch):
    """Whatever the size of the shares, texts are those of a plain comparison over the whole host."""
    rows = hosts(1)
    want = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        own = [r for r in rows if r[1].split("/")[2] == host]
        want |= dict(zip([r[0] for r in own], plain_host([r[2] for r in own])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for share in (4 << 20, 2000):
        monkeypatch.setattr(he, "SHARE_BYTES", share)
        assert {r.page_id: r.text for r in he.main_texts(df).collect()} == want
    changed = [p for p, _, html in rows if want[p] != he.MARK.join(he.main_blocks(html)[1])]
    assert len(changed) > 0.3 * len(rows)  # what no markup names is found by the runs alone


def test_hostile_pages_take_linear_time():
    for page in ("<!" * 500_000, "<div>" * 100_000 + "</p>" * 100_000, "<a '" * 250_000, "<p " * 300_000, "<b>" * 200_000 + "</i>" * 200_000, '<a ">' * 200_000, "<!--" * 250_000, "&" * 1_000_000):
        start = time.perf_counter()
        he.blocks(page)
        assert time.perf_counter() - start < 3


def test_tables_pages(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = df.collect()
    got = {r.page_id: r for r in he.main_texts(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark, monkeypatch):
    pages = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>x y</p>"), (3, "http://a/", "<p>x y</p>"), (None, "nowhere", "<p>z</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    assert sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in he.main_texts(df).collect()) == sorted(
        (p or 0, u or "", {None: "", "": "", "<p>x y</p>": "x y", "<p>z</p>": "z"}[h], {None: 0, "": 0, "<p>x y</p>": 3, "<p>z</p>": 1}[h]) for p, u, h in pages
    )
    assert he.main_texts(df.limit(0)).count() == 0
    monkeypatch.setattr(he, "SHARE_BYTES", 20)
    assert he.main_texts(df).count() == len(pages)


LONG = "The council met on Tuesday and heard twelve speakers before it voted. " * 5


def test_class_words_lose_no_article():
    body = "<p>Body</p>"
    assert text_of(f'<div class="entry-content has-comments">{body}</div>') == "Body"
    assert text_of(f'<article><div class="post-content share-enabled">{body}</div></article>') == "Body"
    assert text_of(f'<div id="main" class="no-ads">{body}</div>') == "Body"
    assert text_of(f'<form id="aspnetForm"><article><h1>Title</h1>{body}<label>Mail</label></article></form>').startswith("Title\nBody")
    assert text_of(f'<article><p>One.</p><div class="notice-of-results">{body}</div></article>') == "One.\nBody"
    assert text_of(f'<main><p>{LONG}</p><article class="teaser"><p>Read on</p></article></main>') == LONG.strip()
    assert text_of(f'<div class="wrapper ads"><article><p>{LONG}</p></article><div class="ads">Buy</div></div>') == LONG.strip()
    assert text_of(f'<div class="widget"><p>{LONG}</p></div><div class="cookie">Cookies</div>') == LONG.strip()
    assert text_of(f'<header><article><p>{LONG}</p></article></header><nav>Home</nav>') == LONG.strip()
    assert text_of(f'<article class="post comments-open"><p>{LONG}</p></article>') == LONG.strip()


def test_class_words_that_stand_for_what_they_say():
    page = f'<article><h1>Title</h1><p>Short text.</p></article><section id="comments"><article class="comment"><p>{LONG}</p></article></section>'
    assert text_of(page) == "Title\nShort text."
    assert text_of(f'<article><p>Short text.</p><div class="comment-list"><p>{LONG}</p></div></article><div class="related">More</div>').startswith("Short text.")
    assert text_of('<article><p>Text.</p><form class="search"><label>Mail</label><p>Enter it</p></form><div class="cookie-notice">We use cookies</div></article>') == "Text."
    assert text_of("<article><p>Text.</p><span class='share'>Share</span> it</article>") == "Text.\nit"
    assert text_of(f'<main><p>Some text of the page.</p><article class="comment"><p>{LONG}</p></article></main>') == "Some text of the page."


def test_words_of_a_share_are_hashed_once(monkeypatch):
    rng = random.Random(4)
    texts = [[" ".join(rng.choices(["the", "of", "and", "to", "in", "a", f"w{k}"], k=60)), "one two three four five six seven eight nine"] for k in range(30)]
    pack = zstandard.ZstdCompressor().compress
    rows = [{"host": "h", "kind": k, "page_id": k, "url": "u", "blocks": pack("\n".join(["0", *own]).encode())} for k, own in enumerate(texts)]
    share = pa.Table.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("kind", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.binary())]))
    hashed, plain = [], he.xxhash.xxh64_intdigest
    monkeypatch.setattr(he.xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or plain(w))
    candidates = he._candidates(share)
    counts = he._count_runs(share, candidates)
    assert max(Counter(hashed).values()) == 2  # once by each of the two steps
    streams = [he.stream(own) for own in texts]
    want = Counter(w for own in streams for w in {" ".join(own[i : i + he.RUN]) for i in range(len(own) - he.RUN + 1)})
    got = {r["run"]: r["n"] for r in counts.to_pylist()}
    assert got.pop(None) == len(texts) and sorted(got.values()) == sorted(want.values())
    common = pa.table({"run": [r for r, n in got.items() if n == len(texts)]}).append_column("most", pa.array([True] * 4))
    hashed.clear()
    cleaned = he._clean_share(share, common)
    assert max(Counter(hashed).values()) == 1
    assert cleaned["text"].to_pylist() == [own[0] for own in texts]
