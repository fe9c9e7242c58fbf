"""The training-data operators against brute force, over whole small tables and edge cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoframe.llm import decontaminate as DC
from chronoframe.llm import flac, html_extract, pii, sharding, simhash, token_files, toxicity, url_filter
from chronoframe.llm import sentencepiece_codec as SP
from chronoframe.llm.common import table
from chronoframe.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long, bucket int, _h int, _fp int, ids string"
LONG = "word " * 50_000
ROWS = [
    (1, None, "en", None, 0, 1, 1, 1, 1, "x"),
    (2, "", "en", "a", 0, 1, 1, 1, 1, "x"),
    (None, "no id here, call +49 30 12345678", None, "a", 0, 1, 1, 1, 1, "x"),
    (None, None, None, None, None, None, None, None, None, None),
    (3, "same text twice", "en", "a", 0, 1, 1, 1, 1, "x"),
    (3, "same text twice", "en", "a", 0, 1, 1, 1, 1, "x"),
    (4, "same text twice", "de", "b", 0, 1, 1, 1, 1, "x"),
    (5, LONG, "en", "b", 0, 1, 1, 1, 1, "x"),
    (6, "Ünïcödé 😀 \t\x00 tail\n\n<|endoftext|> it's", "fr", "b", 0, 1, 1, 1, 1, "x"),
    (7, "   ", "fr", "b", 0, 1, 1, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_oracles(spark, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


# 1


URLS = [None, "", "nohost/en/", "http://", "http://COM/en/1", "https://a.b.example.COM/en/7?x=/y", "http://community/en/", "ftp://x.net/de/8/9#a", "http://example.net/de/8", "http://examplexnet/de/8", "http://a.org?/es/", "http://a.org/es/", "http://a.com/en", "http://..com/en/ü", "x://y://com/en/", "http://a.com/en/" + "z" * 20_000, "http://" + "l." * 3000 + "org/es/"]


def judged(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2], len(fits)


def test_url_filter(spark):
    data = [(i % 7 if i % 5 else None, u, "h", "p") for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(data, "page_id long, url string, host string, stack string")
    for rules in (url_filter.RULES, [], [("com", "", "block"), ("com", "/en/", "allow"), ("com", "/en/zz", "block"), ("a.com", "/", "allow")]):
        got = url_filter.filter_urls(df, url_filter.rules_frame(spark, rules))
        expected = sorted((str(i), *map(str, judged(u, rules))) for i, u, *_ in data)
        assert sorted((str(r.page_id), *map(str, (r.host, r.path, r.rule, r.verdict, r.n_rules))) for r in got.collect()) == expected
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0


# 2


def check_shards(got, n_shards=8):
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values(), default=0) - min((counts[i] for i in range(n_shards)), default=0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_sharding(spark, docs, edge, none):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows(sharding.shard_documents(docs))
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    check_shards(got)
    mix = Counter(r["source"] for r in got)
    for s in range(8):
        part = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(part[k] - mix[k] / 8) <= 1.5 for k in mix)
    again = rows(sharding.shard_documents(docs.repartition(7)))
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(rows(sharding.shard_documents(edge))) == len(ROWS)
    check_shards(rows(sharding.shard_documents(edge)))
    assert sharding.shard_documents(none).count() == 0


def test_sharding_in_many_buckets(spark):
    slim = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 600).cast("string"))).alias("source"))
    got = [r.asDict() for r in sharding.interleave(slim, 8, bucket_rows=64).collect()]
    check_shards(got)
    hot = Counter(r["shard"] for r in got if r["source"] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 8


def test_write_shards(spark, docs, edge, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    sharding.write_shards(edge, str(tmp_path / "edge"))
    assert sorted(spark.read.parquet(str(tmp_path / "edge")).columns) == sorted([*edge.columns, "shard", "slot"])


# 3


def brute_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(13, len(w))
        windows = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else ()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination(spark, docs, edge):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short ITEM é"), (3, "solo"), (4, None), (5, "..."), (6, "two words"), (7, "x y z"), (2, "short item é")]
    passage = items[0][1].upper().replace(" ", " - ")
    data = [(1, "start " + passage + " end"), (2, "solo short item é two words x y z a b c"), (3, None), (4, ""), (5, "nothing " * 400 + "solo"), (6, "one two three four five six seven eight nine ten eleven twelve"), (7, "item short é xy z"), (1, "x y z")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in data], "doc_id long, text string, item_id string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((i, *brute_contamination(t, items)) for i, t in data)
    for options in ({}, {"shard_words": 5}, {"block_bytes": 20}):
        got = DC.contamination(df, bench, **options)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == expected
    kept = DC.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not e[-1] for e in expected)
    m = [r for r in DC.longest_matches(df, bench).collect() if r.item_id == "1"]
    assert [(r.doc_id, r.item_word, r.doc_word, r.n_words) for r in m] == [(1, 0, 1, 14)]
    assert DC.contamination(edge, bench.limit(0)).where("contaminated").count() == 0
    assert DC.contamination(df.limit(0), bench).count() == 0


# 4


def test_html_blocks():
    page = '<!DOCTYPE html><body><nav>menu<p>more</nav><div class="Cookie-Notice">c</div><article><h1>T&amp;t</h1><p>a<b>b</b>c&nbsp; d<br>e<p>f<!-- <p>no</p> --><form>form<input></form><aside>side</aside><ul class="comments"><li>rude</ul><script>if(a<b){"</p>"}</script>&lt;g&gt;</article>after<footer>f</footer>'
    assert html_extract.main_text(html_extract.text_lines(page), None) == "T&t abc d e f <g>"
    assert html_extract.text_lines(None) == [] and html_extract.text_lines("plain & simple <b") == [("plain & simple", html_extract.OPEN)]
    assert html_extract.main_text(html_extract.text_lines("<main>m</main><p>x</p>"), None) == "m"


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = sorted(html_extract.shared_lines(a, b))
        assert len(found) == best[-1, -1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


def test_differencing_of_open_pages(spark):
    make = lambda body: f"<body><p>Site name<p>{body}<p>All rights</body>"
    data = [(1, "http://h.com/a/1", make("first unique story of the day")), (2, "http://h.com/a/2", make("second unique story of the day")), (3, "http://h.com/b", make("third unique story of the day")), (4, "http://other.com/a/1", make("alone")), (5, None, None), (6, "http://h.com/a/2", make("second unique story of the day"))]
    df = spark.createDataFrame([(*d, "c") for d in data], "page_id long, url string, html string, text string").coalesce(1)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "first unique story of the day" and got[3] == "third unique story of the day"
    assert got[4] == "Site name alone All rights" and got[5] == ""
    assert "second unique story of the day" in got[2] and "second unique story of the day" in got[6]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_articles_are_kept_whole(spark, sf):
    import html

    pages = table(spark, sf, "pages")
    expected = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)
        body = body[1] if body else r.html.split("<article>")[1].split("<footer")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|footer)[^>]*>", body)]
        expected[r.page_id] = " ".join(b for b in blocks if b)
    for r in html_extract.extract(pages).collect():
        assert r.text == expected[r.page_id]
        assert r.n_chars == len(r.text)


# 5


@pytest.fixture(scope="module")
def model():
    with open(SP.model_path(), "rb") as f:
        return f.read()


def weird_texts():
    rng = np.random.default_rng(4)
    alphabet = list("abcdeé▁ \n日😀.,!<>sthe inter\t\0")
    return ["", " ", "  a  b ", "\n\n a\n", "▁x▁▁y", "a" * 300, " " * 40 + "x", "<s> </s> <unk> <0x0A>", *("".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(400))]


def test_sentencepiece_equals_the_library(model, docs):
    import sentencepiece

    ours, theirs = SP.load_model(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in [*weird_texts(), *(r.text for r in docs.collect())]:
        ids = ours.encode(t)
        assert ids.tolist() == theirs.encode(t)
        assert ours.decode(ids).decode() == theirs.decode(ids.tolist())


def test_unigram_takes_the_best_sum(model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    ours = SP.SentencePieceModel(proto.SerializeToString())

    def best(text):
        score = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            score[e] = score[e - 1] + ours.unknown_score
            for s in range(max(0, e - 20), e):
                if (i := ours.pieces.get(text[s:e])) is not None:
                    score[e] = max(score[e], score[s] + ours.scores[i])
        return score[-1]

    for t in weird_texts()[:150]:
        t = t.replace(" ", "▁")
        total = sum(ours.scores[i] if i >= 0 else ours.unknown_score for i in ours.segment(t))
        assert total == pytest.approx(best(t), abs=1e-6, rel=1e-12)


def test_codec_edges(edge, none):
    got = rows(SP.codec_digest(edge, SP.model_path()))
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    assert [r["n_pieces"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    wide = SP.encode_documents(edge, SP.model_path())
    assert wide.columns == [c for c in edge.columns if c not in ("text", "ids")] + ["ids", "round_trip"] and wide.where("round_trip").count() == len(ROWS)
    assert SP.codec_digest(none, SP.model_path()).count() == 0


# 6


def brute_segments(scores):
    """Repeatedly the best segment left (shortest, then first), then on both sides of it."""
    out = []

    def find(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and j + 1 - i < best[2] - best[1]):
                    best = (total, i, j + 1)
        if best:
            find(a, best[1])
            out.append((best[1], best[2], best[0]))
            find(best[2], b)

    find(0, len(scores))
    return out


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = np.round(rng.normal(-0.3, 2, rng.integers(0, 25)), 3)
        assert [(a, b, pytest.approx(x)) for a, b, x in toxicity.maximal_segments(s)] == brute_segments(s.tolist())


def test_toxicity(spark, docs, edge, none):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    m = toxicity.fit(d, labels)
    got = toxicity.score_documents(d, m).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.95 and np.mean([s >= 0.3 for s in toxic]) > 0.9 and np.mean([s >= 0.3 for s in clean]) < 0.02
    again = toxicity.fit(d.repartition(5), labels.repartition(3))
    assert again.weights == m.weights and again.coefficients == pytest.approx(m.coefficients)
    e = rows(toxicity.score_documents(edge, m))
    assert len(e) == len(ROWS) and all(r["predicted"] == 0 for r in e)
    assert toxicity.drop_toxic(edge, m).columns == edge.columns and toxicity.score_documents(none, m).count() == 0
    first = next(r.doc_id for r in got if r.toxic and r.predicted)
    p = toxicity.toxic_passages(d.where(F.col("doc_id") == first), m).collect()
    assert p and all(r.first_word < r.end_word and r.log_e <= math.log(0.05) for r in p)


def test_toxicity_without_labels(spark, edge):
    m = toxicity.fit(edge, spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    assert len(rows(toxicity.score_documents(edge, m))) == len(ROWS)


# 7


def test_flac_round_trips(monkeypatch):
    rng = np.random.default_rng(6)
    noisy = rng.integers(0, 256, 64 * 200, dtype=np.uint8).tobytes()
    walk = (np.cumsum(rng.integers(-2, 3, 64 * 300)) % 256).astype(np.uint8).tobytes()
    wave = (128 + 100 * np.sin(np.arange(8192) / 50)).astype(np.uint8).tobytes()
    payloads = [bytes(64), b"a" * 64, b"x" * 5056, noisy, walk, wave, bytes([0, 255] * 4096), (bytes(4000) + b"\xff" * 96) * 2, flac.payload_of("Ein Text, été.".encode() * 700)]
    files = flac.encode_many(payloads)
    assert [b"".join(x for _, x in f) for f in flac.decode_many(files)] == payloads
    for p, f in zip(payloads, files, strict=True):
        assert flac.encode_many([p]) == [f]
        info, points, at = flac.read_header(f)
        assert b"".join(x for _, x in flac._decode_in_order(f, info, at)) == p
        assert int(points["n"].sum()) == len(p)
        for place in (len(f) - 1, len(f) - 3, at + 1):
            bad = bytearray(f)
            bad[place] ^= 1
            with pytest.raises(flac.FlacError):
                flac.decode_many([bytes(bad)])
    assert len(files[5]) < len(wave) / 2
    monkeypatch.setattr(flac, "RUN", 9000)
    assert flac.encode_many(payloads) == files and [b"".join(x for _, x in f) for f in flac.decode_many(files)] == payloads


def bits_frame(samples, order, coefficients=None, shift=0, precision=6, partitions=0, escape=False, k=3):
    """A frame of signed 8-bit samples by a plain bit writer: fixed or LPC, several partitions, escapes."""
    n, out = len(samples), ""
    put = lambda v, w: format(v & ((1 << w) - 1), f"0{w}b") if w else ""
    if coefficients is None:
        r = list(samples)
        for _ in range(order):
            r = [0] + [b - a for a, b in zip(r, r[1:], strict=False)]
        out += "0" + put(8 + order, 6) + "0" + "".join(put(s, 8) for s in samples[:order])
    else:
        r = [0] * order + [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, n)]
        out += "0" + put(31 + order, 6) + "0" + "".join(put(s, 8) for s in samples[:order]) + put(precision - 1, 4) + put(shift, 5) + "".join(put(c, precision) for c in coefficients)
    out += "00" + put(partitions, 4)
    for p in range(1 << partitions):
        part = r[max(order, p * (n >> partitions)) : (p + 1) * (n >> partitions)]
        if escape and p % 2:
            out += "1111" + put(12, 5) + "".join(put(v, 12) for v in part)
        else:
            out += put(k, 4)
            for v in part:
                u = 2 * v if v >= 0 else -2 * v - 1
                out += "0" * (u >> k) + "1" + put(u, k)
    out += "0" * (-len(out) % 8)
    frame = flac._frame_header(0, n) + int(out, 2).to_bytes(len(out) // 8, "big")
    crc = flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    info = b"\x10\x00\x10\x00" + bytes(6) + (flac.RATE << 44 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + int(crc).to_bytes(2, "big")


@pytest.mark.parametrize("options", [{"order": o} for o in range(5)] + [{"order": 2, "partitions": 3}, {"order": 1, "partitions": 2, "escape": True}, {"order": 2, "coefficients": [30, -15], "shift": 4}, {"order": 3, "coefficients": [20, 5, -10], "shift": 4, "partitions": 1}, {"order": 0, "k": 0}])
def test_flac_foreign_frames(options):
    samples = (60 * np.sin(np.arange(256) / 9) + 20 * np.sin(np.arange(256) / 2)).astype(int).tolist()
    blocks = flac.decode_many([bits_frame(samples, **options)])[0]
    assert np.frombuffer(blocks[0][1], np.uint8).astype(int).tolist() == [s + 128 for s in samples]


def test_flac_digest(docs, edge, none):
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    got = Counter()
    for r in flac.media_digest(docs).collect():
        got[r.doc_id] += 1
        text = next(t for i, t in texts if i == r.doc_id).encode()
        p = text + bytes(-len(text) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert sum(got.values()) == docs.count()
    e = rows(flac.media_digest(edge))
    assert len(e) == len(ROWS) and {r["payload_bytes"] for r in e if not r["n_bytes"]} == {64}
    stored = flac.encode_media(edge)
    assert flac.pcm_blocks(stored).groupBy("doc_id").count().count() == 8 and flac.media_digest(none).count() == 0


# 8


def brute_components(texts):
    fps = []
    for _, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[find(i)].append(d)
    return sorted((str(d), f"{fps[i]:016x}", str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(texts))


def test_simhash(spark, docs, edge, none):
    for df in (docs, edge):
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
        assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.near_duplicates(none).count() == 0


def test_spark_hash_is_the_same(spark):
    for t in ("", "a b c", "é" * 40):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(t, 42)


def test_chains_of_fingerprints(spark):
    rng = np.random.default_rng(7)
    values = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(15):
            values.add(x)
            for _ in range(rng.integers(1, 4)):
                x ^= 1 << int(rng.integers(0, 64))
    values = sorted(simhash._signed(v) for v in values)
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == {v: roots.get(v, v) for v in values}


def test_keep_one(docs, edge):
    for df in (docs, edge):
        components = {}
        for d, _, c in brute_components([(r.doc_id, r.text) for r in df.collect()]):
            components[c] = min(components.get(c, d), d, key=lambda x: (x == "None", x))
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(components)


def test_keep_one_with_one_id_for_different_texts(spark):
    texts = ["one two three four", "five six seven eight", "one two three four", None]
    df = spark.createDataFrame([(5, t) for t in texts] + [(7, texts[1]), (None, texts[0])], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one(df).collect())) == sorted(map(str, df.where("doc_id = 5").distinct().collect()))


# 9


def test_packing():
    rng = np.random.default_rng(8)
    for bits in (1, 3, 8, 11, 15, 16, 17, 24, 32):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack(ids, bits)
        assert len(packed) == -(-1000 * bits // 8)
        for a, b in ((0, 1000), (0, 0), (1, 2), (37, 901), (999, 1000)):
            assert token_files.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()
    assert [token_files.bits_for(v) for v in (2, 3, 49_408, 65_536, 65_537)] == [1, 2, 16, 16, 17]


def test_token_files(spark, docs, edge, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for n, df in enumerate((docs, edge, none)):
        token_files.write_token_files(df, path, str(tmp_path / str(n)), block_ids=5000)
        got = sorted(token_files.read_documents(spark, str(tmp_path / str(n))).collect(), key=lambda r: r.start)
        source = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.collect()]
        assert [r.doc_id for r in got] == sorted((d for d, _ in source), key=lambda d: (d is not None, d))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in source)
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        text = f.read()
    ours, theirs = token_files.WordEncoder(text), Tokenizer.from_str(text)
    texts = [*weird_texts(), "it's", "IT'S don't!'s x!!'s", "É'a À.. ß!! ÿ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a.b.c 3.14, x-y", "İstanbul K", "é. e.́", "ab, ab. AB!! ab"]
    assert [x.tolist() for x in ours.encode_batch(texts)] == [theirs.encode(x, add_special_tokens=False).ids for x in texts]


# 10

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def is_valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if is_valid(k, m[0]))


def pii_texts():
    rng = np.random.default_rng(9)
    alphabet = list("0123456789" * 3 + " -.@+()aB%_é\n,")
    fixed = [None, "", "a@b.com_c@d.org", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (234) 567-8901", "x" * 50_000 + "@a.b", "1 " * 30_000, "1" * 20_000, "+1" * 2000, "a." * 10_000 + "@x.y.z é 10.0.0.1", "10.0.0.1 " * 2000]
    return fixed + ["".join(rng.choice(alphabet, rng.integers(5, 80))) for _ in range(1500)]


def test_base_spans(spark, docs, none):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for frame in (df, docs):
        source = {r.doc_id: r.text for r in frame.collect()}
        for r in pii.find_pii(frame).collect():
            spans = brute_spans(source[r.doc_id])
            joined = ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in spans)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
            assert r.n_term or r.spans == joined
    assert pii.find_pii(none).count() == 0 and pii.sanitise(none).count() == 0


def test_disclosing_terms(spark):
    filler = ["alpha beta gamma delta", "river stone cloud", "paper street lamp"]
    data = [(i, f"{filler[i % 3]} the zorblax wrote from zed@corp.org today number {'abcdefgh'[i % 8]}{i}", 1) for i in range(6)]
    data += [(10 + i, f"{filler[i % 3]} the house and today the {i}th", 1) for i in range(60)] + [(99, None, 1), (100, "", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, term int")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i in range(6):
        text = data[i][1]
        s = text.index("zorblax")
        assert f"term:{s}:{s + 7}" in got[i].spans and "email:" in got[i].spans
        t = text.index("the ")
        assert f"term:{t}:{t + 3}" not in got[i].spans
    assert all(got[i].spans == "" for i in got if i >= 10)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblax" not in clean[i] and "zed@" not in clean[i] and "[EMAIL]" in clean[i] and "the " in clean[i] for i in range(6))
    odd = df.selectExpr("doc_id AS _key", "text", "doc_id AS _text", "doc_id AS added", "doc_id AS _spans")
    assert sorted((r._key, r.text) for r in pii.sanitise(odd).collect()) == sorted(clean.items())
    assert clean[99] is None and clean[100] == "" and clean[12] == data[8][1]


def test_sanitise_removes_all_base_spans(spark, docs):
    texts = [t for t in pii_texts() if t and len(t) < 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        spans, out, at = brute_spans(texts[r.doc_id]), "", 0
        merged = []
        for s, k, e in spans:
            if merged and s < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([s, k, e])
        for s, k, e in merged:
            out += texts[r.doc_id][at:s] + f"[{PLAIN[k][0].upper()}]"
            at = e
        assert r.text == out + texts[r.doc_id][at:]
    assert pii.sanitise(docs).columns == docs.columns


def test_broadcast_and_shuffle_forms_agree(spark, docs, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    a, b = key(pii.find_pii(docs)), key(pii.sanitise(docs))
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert key(pii.find_pii(docs)) == a and key(pii.sanitise(docs)) == b
