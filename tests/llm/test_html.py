"""Page differencing: what names of classes may drop, copies, neighbours across ranges, and a brute-force version."""

import random
import time

from chronoframe.llm import html_extract as H


def text_of(page):
    return H.main_text(H.text_lines(page))


def test_names_of_wrappers_drop_no_article():
    for page in ('<div class="page has-sidebar"><div class="post"><p>Real article text here.', '<article class="social post"><p>Real article text here.', '<div class="comments"><p>Real article text here.', '<body class="nav-open"><div id="no-comments"><p>Real article text here.'):
        assert text_of(page) == "Real article text here."
    assert text_of('<div class="post"><p>Story.<div class="sidebar">Side</div><div class="social">Share</div>') == "Story."
    assert text_of('<div class="related"><article>Teaser</article></div><div><p>The body of the page, in an element of no name.') == "The body of the page, in an element of no name."


def test_time_is_in_proportion():
    began = time.time()
    for page in ("<p>" * 40_000 + "x", '<a "' * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<" * 40_000, "<b>" * 40_000 + "</p>" * 40_000):
        text_of(page)
    same = ["line"] * 20_000
    assert len(H.shared_lines(["x", *same], [*same, "y"])) == 20_000
    assert time.time() - began < 30


def test_halved_alignments(monkeypatch):
    rng = random.Random(3)
    for cells in (1 << 26, 12):
        monkeypatch.setattr(H, "CELLS", cells)
        for _ in range(300):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            found = sorted(H.shared_lines(a, b))
            assert len(found) == best[-1][-1]
            it = iter(b)
            assert all(any(a[i] == y for y in it) for i in found)


def pages():
    rng = random.Random(5)
    out = [(None, None, None), (1, "nohost", "<p>x"), (1, "nohost", "<p>x"), (2, "http://a.com/1", ""), (3, None, "<p>no url")]
    for i in range(40):
        host = ("a.com", "b.org", "c.net")[i % 3]
        body = f"story {rng.random()} " + " ".join(f"w{rng.randrange(99)}" for _ in range(20))
        out.append((10 + i, f"http://{host}/{'xyz'[i % 2]}/{rng.randrange(50)}", f"<body><p>{host} site<p>{body}<p>Menu of {host}<p>All rights</body>"))
    out += [(99, "http://a.com/x/copy", out[8][2]), (out[8][0], out[8][1], out[8][2]), (out[8][0], out[8][1], "<p>another page under one id")]
    return out


def test_ranges_do_not_show(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda n: sorted(map(str, H.extract(df.repartition(3), n).collect()))
    whole = key(1)
    assert len(whole) == len(rows) and key(4) == whole and key(64) == whole


def test_brute_force(spark):
    """Every page against its nearest neighbour in the order of host, path and id, by plain Python."""
    rows = [r for r in pages() if r[0] is not None and r[0] >= 10 and r[0] != 99]
    rows = list({r[0]: r for r in rows}.values())
    split = lambda u: tuple(u.split("://")[1].split("/", 1))
    ordered = sorted(rows, key=lambda r: (*split(r[1]), r[0]))
    near = lambda a, b: -1 if split(a)[0] != split(b)[0] else next((k for k, (x, y) in enumerate(zip(split(a)[1], split(b)[1], strict=False)) if x != y), min(len(split(a)[1]), len(split(b)[1])))
    lines = lambda h: [x for x in h.replace("<body>", "").replace("</body>", "").split("<p>") if x]
    expected = {}
    for i, (page_id, url, source) in enumerate(ordered):
        others = [(near(url, o[1]), -k, o) for k, o in enumerate(ordered[max(0, i - 1) : i] + ordered[i + 1 : i + 2])]
        others = sorted((o for o in others if o[0] >= 0), reverse=True, key=lambda o: o[:2])
        mine = lines(source)
        other = next((lines(o[2][2]) for o in others if max(mine, key=len) not in lines(o[2][2])), [])
        expected[page_id] = " ".join(x for x in mine if x not in other)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(df, 5).collect()} == expected
