"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import forest, graph, lines, mixing, neardup, packing, quality, secrets, sharding, urltree, warc
from strandwork.llm.common import shared_dir
from strandwork.llm.queries import public_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, start=0):
    rng = random.Random(seed)
    words = "the of and to in a is that it was for on are as with be by this stone river cloud garden market winter paper".split()
    out = []
    for i in range(n):
        w = rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
        out.append(w.capitalize() if i % 11 == 0 else w + "." if i % 11 == 10 else w)
    return " ".join(out)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names of the operators' own."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a", 1),
        (2, None, "en", "a", 2),
        (3, "", None, "b", None),
        (4, " \n\t ", "xx", None, 0),
        (None, prose(3, 80), "en", "a", 5),
        (5, long, "en", "b", 6),
        (6, prose(2, 120), "en", "a", 1),
        (7, "word", "en", "", 4),
        (7, "word", "en", "", 4),
        (8, "é ü \U0001f600 x y", "de", "c", 9),
        (9, prose(2, 119) + " other", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_with_the_operators_own_names(spark, odd):
    """Names that operators once used inside must not clash."""
    few = odd.selectExpr("*", "1 AS __own", "2 AS __reference", "3 AS __row", "4 AS __lang", "5 AS lang_of_row", "6 AS name")
    judged = quality.judge(few)
    assert judged.columns[: len(few.columns)] == few.columns
    assert judged.select("__own", "lang_of_row", "name").distinct().collect() == [(1, 5, 6)]
    assert judged.count() == odd.count()


# ------------------------------------------------------------------ 1


def vectors(spark, items):
    return spark.createDataFrame(items, "vec_id long, embedding array<float>")


def cosine_top(items, query, k):
    best = []
    q = np.array(query[1], np.float64)
    for i, v in items:
        if i != query[0]:
            x = np.array(v, np.float64)
            best.append((-(float((x * q).sum()) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum()))), i))
    return [i for _, i in sorted(best)[:k]]


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    items = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(900)]
    df = vectors(spark, items)
    found = defaultdict(list)
    for r in forest.nearest(df, df.where("vec_id % 30 = 0"), sample=256).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    hits = 0
    for q in items[::30]:
        rows = found[q[0]]
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in rows} & set(cosine_top(items, q, 5)))
        assert all(a.score > b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(rows, rows[1:]))
    assert hits / (5 * 30) >= 0.9


def test_forest_recall_on_the_table(spark):
    """The registered query with its own parameters."""
    from strandwork.llm.queries import op1_forest

    items = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    good = [(i, v) for i, v in items if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    found = defaultdict(list)
    for r in op1_forest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    hits = []
    for j in np.flatnonzero(ids % 50 == 0):
        score = (x * x[j]).sum(axis=1) / (norm * norm[j])
        order = [o for o in np.lexsort((ids, -score)) if o != j][:5]
        rows = found.pop(int(ids[j]))
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        by_id = dict(zip(ids.tolist(), score.tolist()))
        assert all(r.score == by_id[r.vec_id] for r in rows)
        hits.append(len({r.vec_id for r in rows} & {int(ids[o]) for o in order}) / 5)
    assert not found
    print(len(hits), np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_forest_blocks(spark, monkeypatch):
    """Leaves with many rows and many queries are met block by block, with the same result."""
    rng = np.random.default_rng(4)
    items = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    df = vectors(spark, items)
    plain = rows_of(forest.nearest(df, df, sample=64))
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(forest, "QUERY_ROWS", 30)
    assert rows_of(forest.nearest(df, df, sample=64)) == plain


def test_forest_edges(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 1.0]), (105, []), (None, [1.0, 1.0])]
    same = [(i, [1.0, 0.5]) for i in range(20)]
    df = vectors(spark, [*same, *bad, (3, [1.0, 0.5])])
    rows = forest.nearest(df, df.where("vec_id % 5 = 0")).collect()
    assert {r.query_id for r in rows} == {0, 5, 10, 15}
    by = {q: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 10)}
    assert by == {0: [1, 2, 3, 4, 5], 10: [0, 1, 2, 3, 4]}
    few = vectors(spark, same[:3])
    assert forest.nearest(few, few).count() == 6
    assert forest.nearest(few.limit(0), few.limit(0)).count() == 0
    assert forest.nearest(vectors(spark, bad), vectors(spark, bad)).count() == 0


def test_forest_recall_with_copies(spark):
    """A third of all rows are copies of one vector: they cost the queries near it nothing."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=16)
    points = [centre + rng.normal(size=16) for i in range(1200)]
    points += [points[0]] * 600
    order = rng.permutation(len(points))
    items = [(i, [float(x) for x in points[j].astype(np.float32)]) for i, j in enumerate(order)]
    near = [i for i, j in enumerate(order) if j < 1200 and j % 4 == 1]
    df = vectors(spark, items)
    found = defaultdict(list)
    for r in forest.nearest(df, df.where(F.col("vec_id").isin(near)), sample=512).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    share = [len(set(found[i]) & set(cosine_top(items, items[i], 5))) / 5 for i in near]
    assert np.mean(share) >= 0.95, np.mean(share)
    assert np.mean(sorted(share)[:10]) >= 0.5, sorted(share)[:10]
    copy = next(i for i, j in enumerate(order) if j >= 1200)
    one = forest.nearest(df, df.where(F.col("vec_id") == copy), sample=512).orderBy("rank").collect()
    assert [r.vec_id for r in one] == cosine_top(items, items[copy], 5)


# ------------------------------------------------------------------ 2

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.net/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"),
        ("https://net/x", "net", "/x", "net/"),
        ("http://xnet/x", "xnet", "/x", None),
        ("http://b.net", "b.net", "", None),
        ("http://example.com/de/1#top", "example.com", "/de/1", "example.com/de/"),
        ("http://x.org?y=://z/fr/", "x.org", "", None),
        ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/"),
        ("no scheme/en/", "", "", None),
        ("://h/p", "h", "/p", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://É.net/a\nb?c", "É.net", "/a\nb", "net/"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = urltree.host_and_path(F.col("url"))
    name, _ = urltree.rule_of(h, p, RULES)
    assert tuple(df.select(h, p, name).first()) == (host, path, rule)


def test_templates_reject_a_bad_branch(spark):
    pages, labels = [], []
    for i in range(400):
        kind = ("spam", "news", "blog")[i % 3]
        pages.append((i, f"http://h.example/{kind}/{i * 7}/{'abc'[i % 2]}.html", "x"))
        if i % 2:
            labels.append((i, kind == "spam"))
    pages += [(1000, None, "x"), (None, "http://h.example/spam/5/a.html", "x"), (1001, "http://other.example/q", None), (1001, "http://other.example/q", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, verdict string")
    marks = spark.createDataFrame([*labels, (None, True), (77777, True), (3, None)], "page_id long, bad boolean")
    rows = urltree.judge(df, marks, ()).collect()
    assert len(rows) == len(pages)
    assert {r.verdict for r in rows if r.path.startswith("/spam/")} == {"block"}
    assert {r.verdict for r in rows if not r.path.startswith("/spam/")} == {"allow"}
    assert {r.template for r in rows if r.path.startswith("/spam/")} == {"/spam"}
    assert {r.decided_by for r in rows} == {"method"}
    assert urltree.judge(df.limit(0), marks.limit(0), RULES).count() == 0
    assert urltree.judge(df, marks.limit(0), RULES).where("verdict = 'block'").count() == 0


def plain_differs(b1, n1, b2, n2, z):
    if not n1 or not n2:
        return False
    rate = (b1 + b2) / (n1 + n2)
    return abs(b1 / n1 - b2 / n2) > z * (rate * (1 - rate) * (1 / n1 + 1 / n2)) ** 0.5


def plain_templates(items, min_pages=urltree.MIN_PAGES, min_labels=urltree.MIN_LABELS, z=urltree.Z, smooth=urltree.SMOOTH):
    """{(host, path): (template, purity)} from (host, path, pages, good, bad), by recursion over one host's paths."""
    good, bad = sum(x[3] for x in items), sum(x[4] for x in items)
    prior, out = (bad + 1) / (good + bad + 2), {}

    def node(host, rows, template, above, level):
        good, bad = sum(r[2] for r in rows), sum(r[3] for r in rows)
        purity = (bad + smooth * above) / (good + bad + smooth)
        open_ = good + bad >= 2 * min_labels and good and bad
        for r in rows:
            if not (open_ and len(r[4]) > level):
                out[host, r[0]] = (template, purity)
        children = defaultdict(list)
        for r in rows:
            if open_ and len(r[4]) > level:
                children[r[4][level]].append(r)
        all_g, all_b = sum(r[2] for rs in children.values() for r in rs), sum(r[3] for rs in children.values() for r in rs)
        names, bands = {}, defaultdict(lambda: defaultdict(list))
        for seg, rs in children.items():
            pages, g, b = (sum(r[i] for r in rs) for i in (1, 2, 3))
            if g + b >= min_labels and plain_differs(b, g + b, all_b - b, all_g + all_b - g - b, z):
                names[seg] = seg
            elif re.match(urltree.VARIABLE, seg) or pages < min_pages and g + b < min_labels:
                names[seg] = "*"
            else:
                ends = 2 * sum(r[1] for r in rs if len(r[4]) > level + 1) < pages
                bands[ends][int((b + smooth * purity) / (g + b + smooth) * urltree.BANDS)].append((seg, g, b))
        for ends, held in bands.items():
            groups, last = [], None
            for band in sorted(held):
                g, b = sum(x[1] for x in held[band]), sum(x[2] for x in held[band])
                if last is None or plain_differs(b, g + b, last[1], last[0] + last[1], z):
                    groups.append([])
                groups[-1] += [x[0] for x in held[band]]
                last = (g, b)
            for i, segs in enumerate(groups):
                names.update({x: segs[0] if len(segs) == 1 else "+" + ("" if ends else "/") + str(i) for x in segs})
        below = defaultdict(list)
        for seg, rs in children.items():
            below[names[seg]] += rs
        for name, rs in below.items():
            node(host, rs, f"{template}/{name}", purity, level + 1)

    hosts = defaultdict(list)
    for host, path, pages, g, b in items:
        hosts[host].append((path, pages, g, b, [] if path == "" else path.removeprefix("/").split("/")))
    for host, rows in hosts.items():
        node(host, rows, "", prior, 0)
    return out, prior


def test_templates_against_plain_recursion(spark):
    rng = random.Random(17)
    rates = {"a": 0.05, "b": 0.5, "c": 0.06, "d": 0.3, "e": 0.07, "f": 0.9, "g": 0.5}
    items, seen = [], set()
    for i in range(6000):
        host = rng.choice(["h.net", "h.net", "h.net", "k.org", "small.com", ""])
        parts = [rng.choice("abcdefg") for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            parts.append(rng.choice([str(i), f"p{i}x9", "index.html", "", f"rare{i}"]))
        path = "/" + "/".join(parts) if parts or rng.random() < 0.5 else ""
        if (host, path) not in seen:
            seen.add((host, path))
            n = rng.choice([0, 1, 1, 2, 12])
            bad = sum(rng.random() < (rates[parts[-1]] if parts and parts[-1] in rates else 0.1) for _ in range(n))
            items.append((host, path, max(n, rng.randint(1, 3)), n - bad, bad))
    expected, prior = plain_templates(items)
    found, share = urltree.templates(spark.createDataFrame(items, "host string, path string, pages long, good long, bad long"))
    mine = {(r.host, r.path): (r.template, r.purity) for r in found.collect()}
    assert share == prior
    assert {k: v[0] for k, v in mine.items()} == {k: v[0] for k, v in expected.items()}
    assert {k: v[1] for k, v in mine.items()} == pytest.approx({k: v[1] for k, v in expected.items()})
    assert len({t for t, _ in mine.values()}) > 20
    assert any("+" in t for t, _ in mine.values())


def test_small_bad_branches(spark):
    """A bad branch on a host a hundred times as large, one eight segments down, and siblings that are alike."""
    pages, labels = [], []

    def add(url, n, bad_of=None):
        for i in range(n):
            pages.append((len(pages), url.format(i=i), 0))
            if bad_of is not None and i % bad_of[1] < bad_of[2]:
                labels.append((len(pages) - 1, i % bad_of[1] < bad_of[0]))

    add("http://hot.net/news/{i}", 4000, (0, 4, 1))
    add("http://hot.net/x/{i}", 40, (1, 1, 1))
    add("http://deep.net/a/b/c/d/e/f/g/good/{i}", 100, (0, 2, 1))
    add("http://deep.net/a/b/c/d/e/f/g/bad/{i}", 100, (2, 2, 2))
    for name in ("one", "two"):
        add(f"http://mix.net/{name}/{{i}}", 100, (1, 2, 2))
    for name in ("ten", "six"):
        add(f"http://mix.net/{name}/{{i}}", 100, (0, 2, 2))
    rows = urltree.judge(spark.createDataFrame(pages, "page_id long, url string, host int"), spark.createDataFrame(labels, "page_id long, bad boolean"), (), lift=2.5).collect()
    blocked = Counter(re.sub(r"/\d+$", "", r.path) for r in rows if r.verdict == "block")
    assert blocked == {"/x": 40, "/a/b/c/d/e/f/g/bad": 100, "/one": 100, "/two": 100}
    assert {r.template.count("/") for r in rows if "/bad/" in r.path} == {8}


def test_rejections_need_evidence(spark):
    """A branch is blocked on labels of its own; the tables' few noisy labels block hardly anything."""
    from strandwork.llm.queries import op2_urltree

    rows = [(i, f"http://h.example/{'bad' if i % 10 == 0 else 'few' if i % 100 == 1 else 'good'}/{i}") for i in range(2000)]
    labels = [(i, i % 10 == 0 or i in (1, 101)) for i in range(0, 2000, 1) if i % 100 != 1 or i in (1, 101)]
    df, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    found = {r.page_id: r for r in urltree.judge(df, marks, []).collect()}
    assert {found[i].verdict for i in range(0, 2000, 10)} == {"block"}
    assert {found[i].verdict for i in range(2000) if i % 10} == {"allow"}
    judged = urltree.judge(df, marks, [], evidence=(1, 0.0))
    assert {r.verdict for r in judged.where("page_id % 10 = 0").collect()} == {"block"}
    shares = spark.createDataFrame([(0, 0), (2, 2), (8, 8), (30, 100)], "bad long, labels long").select(urltree.least_share(F.col("bad"), F.col("labels"), 3.0)).collect()
    assert [round(r[0], 3) for r in shares] == [0.0, 0.182, 0.471, 0.184]  # (0.3 + 0.045 - 3 * sqrt(0.21 / 100 + 9 / 40000)) / 1.09
    table = [r for r in op2_urltree(spark, "/root/testdata/sf0.1").collect() if r.decided_by == "method"]
    blocked = [r for r in table if r.verdict == "block"]
    assert len(blocked) < 0.05 * len(table)
    assert all(r.labels >= 8 for r in blocked)


# ------------------------------------------------------------------ 3


def test_archives(spark):
    z = "z" * 2000
    items = [(1, "http://a/x", z), (2, None, z), (3, "u\r\nWARC-Type: x", z), (4, "u", "s"), (5, "u", "s"), (6, "u", None), (None, "u", z), (7, "u", ""), (7, "u", ""), (8, "é", "é" * 700), (9, "u", prose(1, 40_000))]
    df = spark.createDataFrame([(*x, "c") for x in items], "page_id long, url string, html string, file string")
    root = f"{shared_dir(spark)}/test-warc"
    rows = warc.round_trip(df, root).collect()
    assert len(rows) == len(items)
    html = {k: (h or "").encode() for k, _, h in items}
    import hashlib

    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        again = html[r.page_id] == z.encode() and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    assert warc.round_trip(df.limit(0), f"{root}-none").count() == 0


def test_every_record_is_a_member_of_its_own(spark):
    import gzip

    df = spark.createDataFrame([(i, f"http://h/{i}", prose(i, 300)) for i in range(30)] + [(7, None, prose(7, 300)), (None, "u", "x")], "page_id long, url string, html string")
    root = f"{shared_dir(spark)}/test-members"
    rows = warc.round_trip(df, root, date="2024-05-06T07:08:09Z").collect()
    base = root.removeprefix("file://")
    ids = set()
    for r in rows:
        with open(f"{base}/members/{r.file}", "rb") as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = warc._parse(head)
        assert raw.startswith(b"WARC/1.1\r\n")
        assert block.endswith(b"\r\n\r\n")
        assert int(fields["content-length"]) == len(block) - 4
        assert fields["warc-date"] == "2024-05-06T07:08:09Z"
        assert fields["warc-type"] == r.record_type
        ids.add(fields["warc-record-id"])
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        assert f"Content-Length: {r.payload_bytes}".encode() in http
        expected = b"x" if r.page_id is None else prose(r.page_id, 300).encode()
        assert payload == (expected if r.record_type == "response" else b"")
        with open(f"{base}/monolithic/{r.file}", "rb") as f:
            whole = zlib.decompressobj(31).decompress(f.read())
        assert whole == gzip.open(f"{base}/monolithic/{r.file}").read()
        assert payload in whole
    assert len(ids) == len(rows)
    index = spark.read.parquet(f"{root}/index")
    assert index.count() == len(rows)
    assert index.where("warc_type = 'response' AND payload_length < 0").isEmpty()
    refers = {r.refers_to for r in index.where("warc_type = 'revisit'").collect()}
    assert refers <= {r.record_id for r in index.where("warc_type = 'response'").collect()}


def foreign(newline=b"\r\n"):
    """Records of other writers: a warcinfo, metadata without digests, a response, line feeds alone."""
    end = newline * 2
    info = b"software: x" + newline
    http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody"
    out = b"WARC/1.0" + newline + b"WARC-Type: warcinfo" + newline + b"WARC-Record-ID: <urn:a>" + newline + b"Content-Length: %d" % len(info) + end + info + end
    out += b"WARC/1.0" + newline + b"WARC-Type: metadata" + newline + b"content-length: 0" + end + end
    return out + b"WARC/1.0" + newline + b"WARC-Type: response" + newline + b"Content-Type: application/http; msgtype=response" + newline + b"Content-Length: %d" % len(http) + end + http + end


def test_foreign_archives(spark):
    import gzip
    import hashlib
    import os

    root = f"{shared_dir(spark)}/test-foreign"
    base = root.removeprefix("file://")
    os.makedirs(f"{base}/in")
    whole = {"a.warc.gz": gzip.compress(foreign()), "b.warc.gz": gzip.compress(foreign(b"\n")) + gzip.compress(foreign()), "c.warc.gz": gzip.compress(b"")}
    for name, raw in whole.items():
        with open(f"{base}/in/{name}", "wb") as f:
            f.write(raw)
    files = spark.createDataFrame([(n, None) for n in whole], "file string, revisits array<struct<ordinal:long,to_file:string,to_ordinal:long,to_key:string>>")
    index = warc.normalise(files, f"{root}/in", f"{root}/out", 2).cache()
    rows = index.orderBy("file", "offset").collect()
    assert [r.warc_type for r in rows] == ["warcinfo", "metadata", "response"] * 3
    assert {(r.payload_length, r.payload_digest) for r in rows if r.warc_type == "response"} == {(4, hashlib.sha1(b"body").hexdigest())}
    assert rows[1].record_id is None
    back = warc.read_members(index, f"{root}/out", 2).orderBy("file", "offset").collect()
    assert [(r.payload_sha1, r.payload_bytes) for r in back] == [(r.payload_digest, r.payload_length) for r in rows]
    assert gzip.open(f"{base}/out/a.warc.gz").read() == foreign()


def test_inflating_is_bounded():
    import gzip
    import io

    raw = gzip.compress(b"a" * (50 << 20)) + gzip.compress(b"b" * 10)
    sizes = [len(x) for x in warc.inflated(io.BytesIO(raw))]
    assert max(sizes) <= warc.BLOCK
    assert sum(sizes) == (50 << 20) + 10


def test_records_split_over_blocks():
    fields = [warc.response_fields(f"urn:{i}", "2024-01-01T00:00:00Z", "u", str(i), "d") for i in range(5)]
    bodies = [b"x\r\n\r\n" * i for i in range(5)]
    whole = b"".join(warc._head(f, len(b)) + b + b"\r\n\r\n" for f, b in zip(fields, bodies))
    for size in (1, 7, 1000):
        records, found = warc.Records(whole[i : i + size] for i in range(0, len(whole), size)), []
        while (head := records.head()) is not None:
            found.append((head[1]["warc-record-id"], b"".join(records.body())))
        assert found == [(f"<urn:{i}>", b) for i, b in enumerate(bodies)]
    records = warc.Records([whole[:-9]])
    with pytest.raises(ValueError, match="within a record"):
        while records.head() is not None:
            list(records.body())
    with pytest.raises(ValueError, match="not a WARC"):
        warc.Records([b"hello\r\n\r\n"]).head()


# ------------------------------------------------------------------ 4


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (2, 1)])
def test_hilbert_steps_are_unit_steps(spark, dims, bits):
    import itertools

    axes = [f"a{i}" for i in range(dims)]
    df = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{a} int" for a in axes))
    kept = df.select("*", *(F.col(a).alias(f"k{a}") for a in axes))
    rows = sorted(sharding._hilbert(kept, axes, bits, "c").collect(), key=lambda r: r.c)
    assert [r.c for r in rows] == list(range(1 << (bits * dims)))
    assert all(sum(abs(x[f"k{a}"] - y[f"k{a}"]) for a in axes) == 1 for x, y in zip(rows, rows[1:]))


def test_shards(spark, odd, sf_dir):
    for docs, shards in ((odd, 4), (spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)):
        rows = sharding.assign(docs, shards=shards).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == docs.count()
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert sharding.assign(odd.limit(0)).count() == 0


def test_shard_files_prune(spark, sf_dir, tmp_path):
    """For each dimension, the files that a filter must read hold clearly fewer rows than the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"shard": F.lit("x"), "slot": F.lit(1), "curve": F.lit(2)})
    sharding.write_shards(docs, str(tmp_path / "out"), shards=16)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard_").exceptAll(docs).isEmpty()
    assert back.count() == docs.count()
    rows = back.toPandas()
    for dim in ("lang", "source", "n_chars", "doc_id"):
        ends = rows.groupby("shard_")[dim].agg(["min", "max"])
        read = [((ends["min"] <= v) & (v <= ends["max"])).mean() for v in rows[dim].dropna()]
        assert np.mean(read) < 0.8, (dim, np.mean(read))


def test_levels_are_quantiles(spark):
    """A long tail, and strings that share a long prefix, use all levels; copies and nulls are in one."""
    rng = random.Random(3)
    rows = [(int(10 ** rng.uniform(0, 6)), f"https://example.org/source_{rng.randrange(60):02d}") for _ in range(4000)] + [(7, None)] * 2000 + [(None, "https://example.org/source_01")] * 50
    df = spark.createDataFrame(rows, "n long, s string")
    for dim, least in (("n", 6), ("s", 5)):
        levels = Counter(r.c for r in sharding.with_curve(df, [dim], 3, "c").collect())
        assert len(levels) >= least
        assert sorted(levels.values())[-2] < 2200
    assert sharding.with_curve(df.limit(0), ["n", "s"], 3).count() == 0


# ------------------------------------------------------------------ 5


def test_targets_by_plain_water_filling(spark):
    sizes = {"a": 100, "b": 5, "c": 1000, "é": 30, "z": 0, None: 60, "B": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, total, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            total -= target[s]
            left.remove(s)
    target.update(share)
    assert found == pytest.approx(target)


def test_mix_edges(spark, odd):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.copies <= 2 for r in rows)
    words = Counter()
    for r in odd.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert {r.source: r.source_size for r in rows} == dict(words)
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns
    text_of = {r.doc_id: r.text for r in odd.collect()}
    expected = Counter()
    for r in rows:
        expected[r.doc_id, text_of[r.doc_id]] += r.copies
    assert +expected == Counter((r.doc_id, r.text) for r in taken.collect()) == expected
    assert mixing.plan(odd.limit(0)).count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    assert rows_of(mixing.plan(odd.repartition(3))) == rows_of(mixing.plan(odd))


def test_repeated_rows_take_copies_one_by_one(spark):
    """A source of equal rows meets its target, ids or not, and rows that differ elsewhere share the copies."""
    rows = [(7, "w " * 20, "a", i % 3) for i in range(500)] + [(None, "v " * 20, "b", i) for i in range(500)] + [(i, "u " * 10, "c", 0) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    planned = mixing.plan(docs, weights=(1, 1, 1), share=0.5)
    for source in "ab":
        mine = [r for r in planned.collect() if r.source == source]
        assert len(mine) == 500 and sum(r.copies * r.size for r in mine) == pytest.approx(mine[0].target, abs=20)
        assert 0 < sum(r.copies for r in mine) % 500
    taken = Counter((r.source, r.other) for r in mixing.mix(docs, weights=(1, 1, 1), share=0.5).collect())
    wanted = Counter()
    for r in planned.collect():
        wanted[r.source] += r.copies
    found = Counter()
    for (source, _), n in taken.items():
        found[source] += n
    assert found == +wanted
    assert {n for (source, _), n in taken.items() if source == "b"} <= {1, 2}
    assert max(n for (source, _), n in taken.items() if source == "a") - min(n for (source, _), n in taken.items() if source == "a") <= 170


def test_weights_change_inclusion(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s", 4.0 if i % 2 else 0.1) for i in range(400)] + [(1000 + i, "w " * 30, "t", 1.0) for i in range(400)], "doc_id long, text string, source string, q double")
    rows = [r for r in mixing.plan(docs, weight_col="q", weights=(1, 3), share=0.8).collect() if r.source == "s"]
    share = [np.mean([r.copies for r in rows if r.doc_id % 2 == b]) for b in (0, 1)]
    assert share[1] > 3 * share[0]


def test_inclusion_follows_size(spark):
    """Within a source, documents are included in proportion to their weights, and the words taken meet the target."""
    sizes = [10] * 2000 + [40] * 2000 + [100] * 2000
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate(sizes)] + [(10_000 + i, "w " * 100, "t") for i in range(2000)], "doc_id long, text string, source string")
    rows = [r for r in mixing.plan(docs, weights=(1, 1), share=0.5).collect() if r.source == "s"]
    share = {n: np.mean([r.copies for r in rows if r.size == n]) for n in (10, 40, 100)}
    assert share[100] == pytest.approx(2 * share[40], rel=0.15)
    assert share[40] == pytest.approx(2 * share[10], rel=0.25)
    assert sum(r.copies * r.size for r in rows) == pytest.approx(rows[0].target, rel=0.01)


def test_rates_meet_targets(spark):
    classes = [(1, 1.0, 100, 150.0), (1, 0.25, 80, 150.0), (2, 1.0, 10, 60.0), (2, 0.5, 20, 60.0), (3, 0.5, 0, 0.0)]
    rows = mixing.rates(spark.createDataFrame(classes, "source_no int, __w double, class_words long, target double"), 2.0).collect()
    got = {}
    for r in rows:
        got[r.source_no] = got.get(r.source_no, 0) + r["__rate"] * r.class_words
    assert got == pytest.approx({1: 150, 2: 60, 3: 0})
    assert {r["__rate"] for r in rows if r.source_no == 2} == {2.0}


def test_mix_with_names_of_its_own(spark):
    docs = spark.createDataFrame([(i, "w " * 30, "s", "x", 1, "y", "z") for i in range(30)], "doc_id long, text string, source string, __id string, copies int, text_md5 string, held string")
    assert mixing.mix(docs, share=0.5).columns == docs.columns
    assert {(r["__id"], r.copies, r.text_md5, r.held) for r in mixing.mix(docs, share=0.5).collect()} == {("x", 1, "y", "z")}


# ------------------------------------------------------------------ 6

ODD_TEXTS = ["a  b", "a   b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "  ", "\n", " ", "a<|endoftext|> b", "don't    q", "a\xa0 b", "a\x1c b c\x85d 1 2", "é ü\t \tq", "a \n", "a\n ", "x\r\n y  "]


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(public_vocabulary())
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice("ab é.'1 \n\t\xa0 ") for _ in range(rng.randint(1, 40))) for _ in range(400)] + [prose(4, 500)]
    for text in texts:
        assert encoder.encode(text) == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_pieces_cover_documents(spark, odd, sf_dir):
    encoder = packing.Encoder(public_vocabulary())
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)):
        rows = packing.pack(docs, public_vocabulary).collect()
        tokens = Counter((r.doc_id, encoder.encode(r.text) + bytes(4)) for r in docs.collect())
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(r.ids)
            assert len(r.ids) == 4 * r.length > 0
            pieces[r.doc_id, r.doc_tokens].append(r)
            sequences[r.sequence_id].append(r)
        assert sum(r.length for r in rows) == sum(n * len(t) // 4 for (_, t), n in tokens.items())
        unique = [k for k, n in Counter((k, len(t) // 4) for k, t in tokens.elements()).items() if n == 1]
        whole = {(k, len(t) // 4): t for k, t in tokens}
        for key in unique:
            parts = sorted(pieces[key], key=lambda r: r.start)
            assert b"".join(p.ids for p in parts) == whole[key]
            assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        for parts in sequences.values():
            parts.sort(key=lambda r: r.offset)
            assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
            size = sum(p.length for p in parts)
            assert size == parts[0].sequence_tokens <= 1024
            assert size & (size - 1) == 0
        groups, sizes = Counter(), {}
        for parts in sequences.values():
            groups[parts[0].step_group] += parts[0].sequence_tokens
            assert sizes.setdefault(parts[0].step_group, parts[0].sequence_tokens) == parts[0].sequence_tokens
        short = [sizes[g] for g, n in groups.items() if n != 1 << 16]
        assert max(groups.values()) <= 1 << 16
        assert len(short) == len(set(short))  # one short group of a size at most, over all tasks
    assert packing.pack(odd.limit(0), public_vocabulary).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack(odd, public_vocabulary, tiers=(100, 1024))
    with pytest.raises(ValueError, match="whole windows"):
        packing.pack(odd, public_vocabulary, step_tokens=1000)


def test_encoder_on_real_texts(spark):
    encoder = packing.Encoder(public_vocabulary())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encoder.encode(r.text) == array("I", encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids).tobytes()


# ------------------------------------------------------------------ 7


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_secrets(spark):
    rng = random.Random(1)
    texts = []
    for i in range(240):
        token = (f"password={hexes(rng, 18)}", f'token = "{hexes(rng, 40)}"', f"AKIA{hexes(rng, 16).upper()}", f"ab.{i}@mail1.example.com", f"10.0.{i}.117", f"555-{rng.randint(1000, 99999999)}")[i % 6]
        texts.append((i, f"{prose(i, 20)} {token} {prose(i + 500, 20)}", "s"))
    # held out: a secret without a name, a named plain word, a minified pair, a short named value, and no forms at all
    texts += [(300, f"x {hexes(rng, 40)} y", None), (301, "token = correcthorsebattery", "s"), (302, f'{{"user":"x","api_key":"{hexes(rng, 32)}"}}', "s"), (303, "pwd: hunt3r", "s"), (304, None, "s"), (305, "", "s")]
    texts += [(None, f"password={hexes(rng, 18)}", "s"), (306, "ab.9@mail1.example.com### z", "s"), (1, texts[1][1], "s"), (307, "Bearer abcdefghijk", "s"), (308, "QmFzZSBzaXh0eSBmb3Vy+Zm9v/YmFy", "s")]
    df = spark.createDataFrame([(*t, 1, "v") for t in texts], "doc_id long, text string, source string, features int, value string")
    rows = secrets.scan(df, label_share=1.0).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    right = [r.secret == (r.doc_id % 6 < 3) for r in rows if r.doc_id is not None and r.doc_id < 240]
    assert np.mean(right) > 0.98
    assert {*range(240), 300, 301, 302, 303, None, 306, 307, 308} == set(by)
    assert by[300][0].label is None
    assert by[300][0].secret
    assert next(r for r in by[302] if r.name == "api_key").value == texts[242][1].split('"')[-2]
    assert next(r for r in by[302] if r.name == "api_key").secret
    assert by[303][0].value == "hunt3r"
    assert by[306][0].label == 0
    assert not by[306][0].secret
    assert len(by[1]) == 2
    assert by[1][0] == by[1][1]
    assert secrets.scan(df.limit(0)).count() == 0
    assert [r.secret for r in secrets.scan(df.where("doc_id = 0")).collect()] == [True]
    halves = secrets.scan(df.where("doc_id < 240")).collect()
    unseen = [r for r in halves if r.label is None]
    assert 70 < len(unseen) < 170
    assert np.mean([r.secret == (r.doc_id % 6 < 3) for r in unseen]) > 0.95
    given = spark.createDataFrame([(r.doc_id, r.word_at, int(r.doc_id % 6 == 3)) for r in rows if r.doc_id is not None and r.doc_id < 240], "doc_id long, word_at int, label int")
    flipped = secrets.scan(df, given).where("doc_id < 240").collect()
    assert np.mean([r.secret == (r.doc_id % 6 == 3) for r in flipped]) > 0.98


def held_out(spark, **options):
    """Of candidates of a known format without a label: right verdicts on secrets and on others, each of how many."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    told = secrets.formats(secrets.scan(docs, **options)).where("label IS NULL AND format IS NOT NULL").groupBy("format", "format_label", "secret").count().collect()
    out = defaultdict(lambda: [0, 0])
    for r in told:
        out[r.format][0] += r["count"] * (r.secret == (r.format_label == 1))
        out[r.format][1] += r["count"]
    return dict(out)


def test_forest_judges_what_it_did_not_see(spark):
    """Half of each format's values are unlabelled; then a whole format is."""
    found = held_out(spark)
    assert sum(n for _, n in found.values()) > 300 and found["named"][1] > 50
    assert all(right >= 0.95 * n for right, n in found.values())
    right, n = held_out(spark, without=("mail",))["mail"]
    assert n > 150 and right >= 0.8 * n


def test_secret_candidates_and_features(spark, sf_dir):
    """Against plain Python: parts, names, neighbours, and the features of values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, expected = Counter(), Counter()
    for r in docs.collect():
        counts.update(re.findall(r"(?<![A-Za-z0-9])[a-z]{3,}(?![A-Za-z0-9])", r.text or ""))
        words = [w for w in re.split(secrets.BREAKS, r.text or "") if w]
        for i, w in enumerate(words):
            b1, b2, b3 = (words[i - j] if i >= j else "" for j in (1, 2, 3))
            m = re.match(r"^([A-Za-z][\w.-]*)[=:]+(.+)$", w, re.ASCII)
            if m:
                name, value, before = m[1], m[2], b1
            elif b1 in ("=", ":", ":="):
                name, value, before = b2, w, b3
            elif re.search(".[=:]$", b1):
                name, value, before = b1.rstrip("=:"), w, b2
            else:
                name, value, before = "", w, b1
            value = re.sub(r"^[.!?]+|[.!?*#%$]+$", "", value)
            named = re.search(secrets.CREDENTIAL, name)
            if len(value) >= 8 and re.search("[0-9]", value) or len(value) >= 16 and re.search(secrets.MIXED, value) or len(value) >= 4 and named or len(value) >= 8 and b1.lower() == "bearer":
                expected[r.doc_id, i, name, value, before, words[i + 1] if i + 1 < len(words) else ""] += 1
    found = secrets.candidates(docs).collect()
    assert Counter((r.doc_id, r.word_at, r.name, r.value, r.before, r.after) for r in found) == expected
    assert expected
    total = sum(counts.values())
    known = {w for w, n in counts.items() if n >= max(2, total * 1e-4)}
    dictionary = secrets.dictionary(docs, min_share=1e-4)
    assert {r.run for r in dictionary.collect()} == known
    values = spark.createDataFrame([(v,) for v in {r.value for r in found} | {"abcTheof", "the.and.1"}], "value string")
    for r in secrets.value_features(values, dictionary).collect():
        v = r.value
        assert r.f_covered == pytest.approx(sum(len(x) for x in re.findall("[a-z]{3,}", v.lower()) if x in known) / len(v))
        assert r.f_digits == pytest.approx(sum(c in "0123456789" for c in v) / len(v))
        assert r.f_distinct == pytest.approx(len(set(v)) / len(v))


def test_log_odds(spark):
    df = spark.createDataFrame([(["a", "b"], 1), (["a"], 1), (["b", ""], 0)], "w array<string>, label int")
    found = {r.key: r.weight for r in secrets.log_odds(df, F.col("w"), kinds=2).collect()}
    assert found == pytest.approx({"a": np.log(3 / 5) - np.log(1 / 3), "b": np.log(2 / 5) - np.log(2 / 3)})


# ------------------------------------------------------------------ 8


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, cover, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            cover.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(x) for x in quality.SYMBOLS), dup, len(cover)


def test_quality(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (docs, odd):
        judged = quality.judge(df, prefix="q_")
        assert judged.columns[: len(df.columns)] == df.columns
        rows = judged.collect()
        assert len(rows) == df.count()
        for r in rows:
            n, *rest = plain_counts(r.text)
            assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (n, *rest)
            assert r.q_base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
            assert not (r.q_base_failed and r.q_kept)
    assert quality.judge(odd).columns[-1] == "kept_"
    assert quality.judge(odd.limit(0)).count() == 0


CLASSES = [("abcdefghijklmnopqrstuvwxyz",), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ",), ("0123456789",), (" \t\n\v\f\r",), (".,",), ("!?;:'\"()-",), (quality.SYMBOLS,)]


def plain_histograms(text):
    """Shares of the character classes (other ASCII and wide letters last), and the forms of the words."""
    counts = [sum(text.count(c) for c in chars) for (chars,) in CLASSES]
    wide = sum(ord(c) > 127 for c in text)
    counts += [len(text) - wide - sum(counts), wide]
    return counts, [w.strip(quality.AROUND.decode()).lower() for w in WORD.findall(text)]


def plain_distance(p, q):
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        out += (a * np.log2(a / m) if a > 0 else 0) / 2 + (b * np.log2(b / m) if b > 0 else 0) / 2
    return max(out, 0) ** 0.5


def plain_verdicts(items, common, blend_with, min_chars=200, min_words=50, most=0.3, joint=(0.12, 0.35)):
    refs, out = {}, []
    for lang, text in items:
        counts = plain_counts(text)
        chars, forms = plain_histograms(text or "")
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        if not failed and counts[0] >= min_words:
            r = refs.setdefault(lang, [0, Counter(), Counter()])
            r[0] += 1
            r[1].update(dict(enumerate(chars)))
            r[2].update(forms)
    top = {}
    for lang, (n, chars, forms) in refs.items():
        words = sorted((w for w in forms if w), key=lambda w: (-forms[w], w.encode()))[:common]
        top[lang] = ([chars[i] / sum(chars.values()) for i in range(9)], {w: forms[w] / sum(forms.values()) for w in words})
    largest = sorted(refs, key=lambda x: (-refs[x][0], x is not None, x or ""))[:blend_with]
    for lang, text in items:
        counts = plain_counts(text)
        chars, forms = plain_histograms(text or "")
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        js = (None, None)
        if lang in top:
            own, far = top[lang], [[], []]
            share = [c / max(sum(chars), 1) for c in chars]
            for other in dict.fromkeys([lang, *largest]):
                blend = top[other]
                far[0].append(plain_distance(share, [(a + b) / 2 for a, b in zip(own[0], blend[0])]))
                both = sorted({*own[1], *blend[1]})
                mine = [forms.count(w) / max(len(forms), 1) for w in both]
                refs_of = [[x[1].get(w, 0) for w in both] for x in (own, blend)]
                mix = [(a + b) / 2 for a, b in zip(*refs_of)]
                far[1].append(plain_distance([*mine, 1 - sum(mine)], [*mix, 1 - sum(mix)]))
            js = (min(far[0]) if counts[1] >= min_chars else None, min(far[1]) if counts[0] >= min_words else None)
        bad = js[0] is not None and js[0] > most or js[1] is not None and min(far[0]) > joint[0] and js[1] > joint[1]
        out.append((lang, text, js, not failed and not bad))
    return out


@pytest.mark.parametrize("blend_with", [1, 8])
def test_verdicts_against_plain_python(spark, odd, sf_dir, blend_with):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").union(odd.select("lang", "text"))
    docs = docs.union(spark.createDataFrame([(None, prose(70 + i, 90)) for i in range(3)] + [("", prose(90, 90))], "lang string, text string"))
    rows = quality.judge(docs, common=30, blend_with=blend_with).collect()
    expected = plain_verdicts([(r.lang, r.text) for r in docs.collect()], 30, blend_with)
    key = lambda x: (str(x[0]), str(x[1]))
    mine = sorted(((r.lang, r.text, (r.js_chars, r.js_words), r.kept) for r in rows), key=key)
    for a, b in zip(mine, sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2]
        assert a[3] == b[3]
        assert a[2] == pytest.approx(b[2], abs=1e-9)
    assert {r.js_words is None for r in rows if r.lang is None} == {True, False}


def test_divergence_rejects_odd_text_only(spark):
    good = [(i, prose(i, 150), "en") for i in range(150)]
    odd = [(1000, prose(1, 150).upper(), "en"), (1001, " ".join(w + "%%%" for w in prose(2, 150).split()), "en"), (1002, " | ".join("".join(random.Random(i).choice("abcdefgh") for _ in range(7)) for i in range(150)), "en"), (1003, "A | B", "en")]
    rows = quality.judge(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {1000, 1001, 1002, 1003}
    assert next(r for r in rows if r.doc_id == 1003).js_words is None


def test_js_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0], [0.2, 0.3, 0.5]]), np.array([[0.5, 0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    found = quality.js_distance(p, q)
    assert found[0] == 0
    assert found[1] == pytest.approx(1.0)


# ------------------------------------------------------------------ 9


def plain_groups(items, percent=75):
    sets = []
    for _, text in items:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset())
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [items[i][0] for i in members if items[i][0] is not None]
        for i in members:
            low = min(ids) if ids else None
            out.append((items[i][0], len(sets[i]), low, items[i][0] is None or items[i][0] == low))
    return sorted(out, key=str)


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"e{rng.randint(0, 10**6)}" for w in text.split(" "))


def test_near_duplicates(spark, odd):
    base = [prose(i, 140) for i in range(6)]
    items = [(i, base[i]) for i in range(6)]
    items += [(100 + i, edited(base[0], 0.02, i)) for i in range(60)]
    items += [(200 + i, edited(base[1], 0.05, i)) for i in range(30)]
    items += [(300, base[2].upper()), (301, base[2] + " tail"), (302, "one two three"), (303, "ONE  two\nthree"), (304, "one two three four"), (305, None), (306, ""), (307, " \n")]
    df = spark.createDataFrame(items, "doc_id long, text string")
    found = neardup.near_duplicates(df)
    assert rows_of(found.drop("text_key", "group_key")) == plain_groups(items)
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    expected = plain_groups(pairs)
    mine = rows_of(neardup.near_duplicates(odd).drop("text_key", "group_key"))
    assert [r for r in mine if r[0] is not None] == [r for r in expected if r[0] is not None]
    assert len(mine) == len(expected)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_give_the_same_groups(spark, monkeypatch):
    """Hot regions, with tiny limits: divided regions and pairs of blocks lose no link."""
    base = prose(9, 100)
    items = [(i, edited(base, 0.04, i)) for i in range(80)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    monkeypatch.setattr(neardup, "REGION", 2)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4000)
    assert rows_of(neardup.near_duplicates(df).drop("text_key", "group_key")) == plain_groups(items)


def test_the_exact_way_finds_what_a_forest_loses(spark, odd, monkeypatch):
    """One tree of four values loses most links at the threshold; shared rare shingles give every one, in small blocks too,
    behind a passage that all texts share."""
    shared = prose(99, 60)
    items = [(100 * i + j, edited(prose(i, 120), 0.02, j) + " " + shared) for i in range(25) for j in range(3)]
    items += [(9000 + i, f"a b c d e{i // 2} f g h"[: 15 + i % 2]) for i in range(12)]
    items += [(9100, None), (9101, ""), (9102, "one two"), (9103, "ONE two"), (9104, items[0][1])]
    df = spark.createDataFrame(items, "doc_id long, text string")
    expected = plain_groups(items)
    assert rows_of(neardup.near_duplicates(df, trees=1).drop("text_key", "group_key")) != expected
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    with monkeypatch.context() as few:
        few.setattr(neardup, "COUNTERS", 2)
        assert rows_of(neardup.near_duplicates(df, trees=1, exact=True).drop("text_key", "group_key")) == expected
    assert neardup.near_duplicates(df.limit(0), exact=True).count() == 0
    mine = rows_of(neardup.near_duplicates(odd, exact=True).drop("text_key", "group_key"))
    pairs = plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert [r for r in mine if r[0] is not None] == [r for r in pairs if r[0] is not None]


def test_links_go_round_once(spark, monkeypatch):
    """Links found within regions are merged among components: what made a component is not looked up again."""
    base = prose(9, 100)
    items = [(i, edited(base, 0.04, i)) for i in range(80)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    rounds = []

    def seen(edges):
        found = graph.components(edges)
        rounds.append((edges.select("a", "b").collect(), found.collect()))
        return found

    monkeypatch.setattr(neardup, "components", seen)
    found = rows_of(neardup.near_duplicates(df, trees=2, exact=True).drop("text_key", "group_key"))
    assert found == plain_groups(items)
    assert len(rounds) == 3 and rounds[0][0] and rounds[1][0]
    label = {}
    for edges, named in rounds:
        assert all(a == label.get(a, a) and b == label.get(b, b) and a != b for a, b in edges)
        up = dict(named)
        label = {x: up.get(y, y) for x, y in (label | {x: label.get(x, x) for x in up}).items()}


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for rows in (1000, 2):  # with few hubs and with many
        monkeypatch.setattr(graph, "HUB_ROWS", rows)
        monkeypatch.setattr(graph, "HUBS", 20)
        found = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 10


def units_of(text, wrap):
    """The words of each line, and its span in bytes."""
    raw = (text or "").encode()
    spans = lines.line_spans(text or "", wrap)
    return raw, spans, [b" ".join(raw[s:e].split()) for s, e in spans]


def plain_lines(items, wrap=0):
    """Line dedup with a set of the windows seen, document by document."""
    first, done, out = {}, {}, []
    for key, text in sorted(set(items), key=lambda x: (x[0] is not None, x[0] or 0, text_hash[x[1]])):
        raw, spans, units = units_of(text, wrap)
        for j in range(len(units) - 2):
            first.setdefault(tuple(units[j : j + 3]), (key, text, j))
    for key, text in items:
        if (key, text) not in done:
            raw, spans, units = units_of(text, wrap)
            cover = set()
            for j in range(len(units) - 2):
                k, t, at = first[tuple(units[j : j + 3])]
                if (k, t, at) != (key, text, j):
                    own = {at, at + 1, at + 2} if (k, t) == (key, text) else set()
                    cover.update({j, j + 1, j + 2} - own)
            kept = raw[: spans[0][0]] if spans else raw
            kept += b"".join(raw[s:e] for j, (s, e) in enumerate(spans) if j not in cover)
            done[key, text] = (key, None if text is None else kept.decode(), len(raw) - len(kept))
        out.append(done[key, text])
    return sorted(out, key=str)


text_hash = {}


def hashes(spark, items):
    """The operator's order of texts of one id."""
    distinct = list({t for _, t in items})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(distinct)], "i int, t string")
    text_hash.update({distinct[r.i]: r.h for r in df.select("i", F.xxhash64("t").alias("h")).collect()})


@pytest.mark.parametrize("wrap", [0, lines.WRAP])
def test_lines(spark, odd, wrap):
    rng = random.Random(7)
    passage = [prose(50 + i, 14) for i in range(6)]
    items = []
    for i in range(60):
        own = [prose(1000 + 10 * i + j, 9) for j in range(rng.randint(0, 5))]
        at = rng.randint(0, len(own))
        part = passage[rng.randint(0, 2) : rng.randint(3, 6)] if i % 2 else []
        items.append((i, rng.choice(["\n", " "]).join(own[:at] + part + own[at:]) if i % 7 else "\n".join(own[:1] * 6)))
    items += [(100, None), (101, ""), (102, "\n\n"), (103, "a\nb\nc"), (104, " a \n\n  b\nc\n"), (None, "\n".join(passage)), (5, items[5][1]), (7, "a\nb\nc")]
    items += [(110, "x\nx\nx\nx\nx"), (111, "x\nx\nx"), (112, "é 你好\n世界\n\U0001f600\nk"), (113, "1\né 你好\n世界\n\U0001f600")]
    df = spark.createDataFrame([(*x, 1) for x in items], "doc_id long, text string, removed_bytes int")
    hashes(spark, items)
    found = lines.remove_repeated(df, wrap=wrap)
    assert found.columns == ["doc_id", "text", "removed_bytes", "removed_parts", "removed_bytes_"]
    assert rows_of(found.select("doc_id", "text", "removed_bytes_")) == plain_lines(items, wrap)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    hashes(spark, rows)
    assert rows_of(lines.remove_repeated(odd.select("doc_id", "text"), wrap=wrap).drop("removed_parts")) == plain_lines(rows, wrap)
    assert lines.remove_repeated(df.limit(0)).count() == 0


def test_lines_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = [(r.doc_id, r.text) for r in docs.collect()]
    hashes(spark, items)
    assert rows_of(lines.remove_repeated(docs, wrap=lines.WRAP).drop("removed_parts")) == plain_lines(items, lines.WRAP)


def test_lines_with_names_of_their_own(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc", "k", 1, "c") for i in range(3)], "doc_id long, text string, __id string, __key int, __cuts string")
    rows = lines.remove_repeated(docs).orderBy("doc_id").collect()
    assert [(r.text, r["__id"], r["__key"], r["__cuts"]) for r in rows] == [("a\nb\nc", "k", 1, "c"), ("", "k", 1, "c"), ("", "k", 1, "c")]


def test_hot_windows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    items = [(i, f"a\nb\nc\n{prose(i, 6)}") for i in range(200)]
    hashes(spark, items)
    found = lines.remove_repeated(spark.createDataFrame(items, "doc_id long, text string"))
    assert rows_of(found.drop("removed_parts")) == plain_lines(items)


def test_line_spans_cover_the_text():
    for text in ("", "a", "a. b! c?\nd", "\n\n a\n\n b. ", " x.  y\t\nz", prose(3, 200)):
        for wrap in (0, lines.WRAP):
            spans, raw = lines.line_spans(text, wrap), text.encode()
            assert b"".join(raw[s:e] for s, e in spans) == raw[spans[0][0] if spans else len(raw) :]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert not wrap or all(len(raw[s:e].split()) <= wrap for s, e in spans)


def test_passages_within_paragraphs(spark):
    """Passages of over 50 words, planted mid-sentence in texts without sentence ends or line feeds."""
    def plain(seed, n):
        return prose(seed, n).replace(".", "").lower()

    passages = [plain(5000 + i, 51 + i % 5) for i in range(300)]
    items = [(2 * i + k, f"{plain(6000 + 2 * i + k, 17 + 3 * k + i % 9)} {p} {plain(8000 + 2 * i + k, 23 - 5 * k)}") for i, p in enumerate(passages) for k in (0, 1)]
    rows = {r.doc_id: r for r in lines.remove_repeated(spark.createDataFrame(items, "doc_id long, text string"), wrap=lines.WRAP).collect()}
    assert all(rows[2 * i].text == items[2 * i][1] for i in range(300))
    left = [len(WORD.findall(rows[2 * i + 1].text)) - (len(WORD.findall(items[2 * i + 1][1])) - len(WORD.findall(p))) for i, p in enumerate(passages)]
    assert all(rows[2 * i + 1].removed_parts >= 1 for i in range(300))
    print(np.mean(left), max(left))
    assert np.mean(left) < 18


def test_menus_and_short_lines(spark):
    """Three short lines are a passage, in scripts without blanks too."""
    parts = {"menu": "Home\nShop\nFAQ", "chinese": "\u9996\u9875\n\u65b0\u95fb\n\u8054\u7cfb", "tabs": "one\ttwo\nthree\tfour\nfive\tsix", "same": "next\nnext\nnext", "letters": "a\nb\nc"}
    items = [(10 * i + j, f"{prose(300 + 10 * i + j, 9)}\n{part}\n{prose(700 + 10 * i + j, 9)}") for i, part in enumerate(parts.values()) for j in range(3)]
    rows = {r.doc_id: r for r in lines.remove_repeated(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    for i, part in enumerate(parts.values()):
        assert [rows[10 * i + j].removed_bytes for j in range(3)] == [0, len(part.encode()) + 1, len(part.encode()) + 1]
