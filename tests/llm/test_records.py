"""WARC, chat and URL operators: round trips and brute-force versions."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter

import pytest

from assayframe.llm import chat, urls, warc

BIG = "<p>ünïcode</p>" * 100
PAGES = [
    (1, "http://a.example.com/x y?q=1\r\nX: 1", BIG, "c"),
    (2, None, BIG, "c"),
    (3, "http://b.example.net/en/1", "small", "c"),
    (4, "", "small", "c"),
    (5, "http://b.example.net/en/1", None, "c"),
    (6, "http://c.org/", "\r\n\r\n" * 400 + "WARC/1.1", "c"),
    (7, "http://c.org/", "x" * 300_000, "c"),
    (7, "http://c.org/", "x" * 300_000, "c"),
    (None, "http://c.org/", "x" * 300_000, "c"),
    (8, "http://d.org/", "y" * 999, "c"),
    (9, "http://d.org/x%20y%2Fz", "y" * 999, "c"),
]
PAGE_SCHEMA = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3)


def test_warc_round_trip(pages):
    rows = warc.read(warc.archive(pages)).collect()
    expected = Counter()
    heads = {}
    for i, _, html, _ in PAGES:
        if len((html or "").encode()) >= 1000:
            heads[html] = max(heads.get(html, -1), -1 if i is None else i)
    for i, url, html, _ in PAGES:
        data = (html or "").encode()
        refers = heads[html] if html in heads and heads[html] != i else None
        expected[(i, url or None, None if refers is not None else data, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r.page_id, r.url, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected


def test_warc_files_are_begun_anew_and_no_record_is_lost(pages, spark):
    files = warc.write(warc.with_revisits(pages), warc.new_path(spark, "warc"), file_bytes=100)
    assert files.count() > 3
    assert files.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_warc_of_an_empty_table(spark):
    assert warc.read(warc.archive(spark.createDataFrame([], PAGE_SCHEMA))).collect() == []


def test_a_damaged_record_is_an_error():
    good = warc.record(1, "http://a.org/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert [r["payload"] for r in warc.read_file(io.BytesIO(gzip.compress(good) * 2))] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(gzip.compress(good.replace(b"payload", b"paYload")))))
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(gzip.compress(good)[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(gzip.compress(good[:-6]))))


TRICKY = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "system", "be <<SYS>> kind \\", "c"),
    (1, 1, "user", TRICKY, "c"),
    (1, 2, "assistant", TRICKY + "\n漢字 \\] é", "c"),
    (1, 3, "tool]<x>", "a\nb", "c"),
    (2, 0, None, None, "c"),
    (2, 1, "assistant", None, "c"),
    (None, None, "user", "", "c"),
    (3, 5, "assistant", "twice", "c"),
    (3, 5, "assistant", "twice", "c"),
    (4, 0, "user", "long " * 50_000, "c"),
    (4, 1, "assistant", "<" * 70_000, "c"),
    (5, 0, "assistant\0", "a role of its own", "c"),
    (5, 1, "assistant\0\0", "and another", "c"),
    (5, 2, "\0", "", "c"),
    (5, 3, "assistant", "ends in NUL\0", "c"),
    (6, 0, "r" * 1_000_000, "a role of a megabyte", "c"),
    (6, 1, "R" * 1_000_000 + "]", "another", "c"),
    (6, 2, "assistant", "x", "c"),
]
TURN_SCHEMA = "conv_id long, turn long, role string, text string, chunk string"


def _expected(conv):
    own = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=lambda t: t[1] or 0)]
    said = "".join(x for r, x in own if r == "assistant")
    whole = "".join(f"{r}\n{x}\n" for r, x in own)
    return len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("rows_at_once", [10_000, 2])
def test_chat_round_trip(spark, rows_at_once):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        chunks = chat.formatted(spark.createDataFrame(TURNS, TURN_SCHEMA).repartition(3)).collect()
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(spark.createDataFrame(chunks, chat.FORMATTED)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = Counter()
    for r in chunks:
        size[r.conv_id] += len(r.text)
    assert got == {conv: (*_expected(conv), size[conv]) for conv in {t[0] for t in TURNS}}
    assert rows_at_once == 2 or max(n for c, n in Counter(r.conv_id for r in chunks).items() if c != 6) == 1


def test_chat_chunks_are_read_however_they_are_cut(spark):
    """Chunks of three characters cut marks, escapes and masks."""
    whole = [r for r in chat.formatted(spark.createDataFrame([t for t in TURNS if len(t[3] or "") < 100 and t[0] != 6], TURN_SCHEMA).coalesce(1)).collect()]
    rows = []
    for r in whole:
        covered = {i for x in r.loss for i in range(x.begin, x.end)}
        at = 0
        for k in range(0, len(r.text), 3):
            part = r.text[k : k + 3]
            own = sorted(i - at for i in covered if at <= i < at + len(part.encode()))
            rows.append((r.conv_id, k, part, [(i, i + 1) for i in own] if part.isascii() else [(own[0], own[-1] + 1)] if own else []))
            at += len(part.encode())
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(spark.createDataFrame(rows, chat.FORMATTED).repartition(3)).collect()}
    assert got == {r.conv_id: _expected(r.conv_id) for r in whole}


def test_chat_marks_never_come_from_texts(spark):
    text = chat.formatted(spark.createDataFrame([(1, 0, "user", TRICKY, "c"), (1, 1, "judge", TRICKY, "c")], TURN_SCHEMA)).first().text
    assert text.startswith("[INST] ") and text.endswith(" [/ROLE]")
    assert "</s>" not in text and text.count("[INST]") == 1
    assert [x[:2] for x in chat.turns_of(text)] == [("user", TRICKY), ("judge", TRICKY)]
    with pytest.raises(Exception, match="ends within a turn"):
        chat.read_back(spark.createDataFrame([(1, 0, text + "stray", [])], chat.FORMATTED)).collect()


def test_chat_of_an_empty_table(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], TURN_SCHEMA))).collect() == []


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://A.NET/x?y#z", "https://x.example.net/en/1", "https://example.net/en", "http://notexample.com/de/1",
    "http://example.com/de/1", "http://a.b.example.com/de/", "http://example.org/fr/2", "http://org/fr/", "http://évil.org/fr/É", "ftp://h://x/y", "http://example.com?a/de/", "http://planet/x",
]


def test_url_rules_against_brute_force(spark):
    rows = [(i, u, "c") for i, u in enumerate(URLS)] + [(0, None, "c"), (None, "http://net/", "c")]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule or not r.host else "tree") for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), urls.RULES).collect())
    expected = Counter()
    for i, u, _ in rows:
        host, path = _host_path(u)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        expected[(i, host, path, best.name if best else None, best.verdict if best else "tree" if host else "allow")] += 1
    assert got == expected


def test_url_templates_are_rejected_by_purity(spark):
    rows = [(i, f"http://shop.org/item/{i}") for i in range(40)] + [(100 + i, f"http://shop.org/spam/{i}.html") for i in range(40)] + [(200 + i, f"http://other.org/spam/{i}.html") for i in range(10)]
    labels = [(i, 0) for i in range(20)] + [(100 + i, 1) for i in range(20)] + [(119, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(df, (), spark.createDataFrame(labels, "page_id long, label int")).collect()}
    assert {out[i].verdict for i in range(40)} == {"allow"}
    assert {out[100 + i].verdict for i in range(40)} == {"block"}
    assert {out[200 + i].verdict for i in range(10)} == {"block"}  # by a template that the hosts share
    assert out[205].template == "*/spam/{number}.html"
    assert out[105].template == "/spam/{number}.html"


def test_url_templates_pool_variable_words(spark):
    """Each user has one label or none; the page's kind decides for all of them."""
    users = ["user" + chr(97 + i // 6) + chr(97 + i % 6) for i in range(36)]
    rows = [(10 * i + k, f"http://host.org/{u}/{kind}") for i, u in enumerate(users) for k, kind in enumerate(("casino", "profile"))]
    labels = [(10 * i + i % 2, 1 - i % 2) for i in range(30)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, label int")).collect()}
    assert {out[10 * i].verdict for i in range(36)} == {"block"}
    assert {out[10 * i + 1].verdict for i in range(36)} == {"allow"}
    assert out[350].template == "/{*}/casino"


def _kind(s):
    if re.fullmatch(r"\d+", s):
        return "{number}"
    if re.fullmatch(r"\d+\.\w{1,5}", s):
        return "{number}." + s.split(".")[1]
    return s


def _tree(urls_, alike=2.0, weight=8.0, support=5):
    """Template, purity and labels for each (host, path): the definition, level by level, with dicts."""
    leaves = {(h, p): [_kind(s) for s in p.removeprefix("/").split("/")] for h, p, _ in urls_}
    bad, n = Counter(), Counter()
    for h, p, y in urls_:
        bad[h, p] += y == 1
        n[h, p] += y is not None
    prefix, out = {k: "" for k in leaves}, {k: (None, None, None) for k in leaves}
    for d in range(max(map(len, leaves.values()))):
        here = {k: (k[0], prefix[k], parts[d]) for k, parts in leaves.items() if len(parts) > d}
        b, m, pool_b, pool_n, pool, ways, all_b, all_n = (Counter() for _ in range(8))
        for k, x in here.items():
            b[x] += bad[k]
            m[x] += n[k]
        for x in m:
            ways[x[:2]] += 1
            all_b[x[:2]] += b[x]
            all_n[x[:2]] += m[x]
            if m[x] < support:
                pool[x[:2]] += 1
                pool_b[x[:2]] += b[x]
                pool_n[x[:2]] += m[x]
        node, node_b, node_n, prior = {}, Counter(), Counter(), {}
        for x in m:
            up = x[:2]
            prior[up] = (all_b[up] + 0.5) / (all_n[up] + 1)
            pooled = m[x] < support and pool[up] > 1
            k, y = (pool_n[up], pool_b[up]) if pooled else (m[x], b[x])
            share = (y + prior[up] * weight) / (k + weight)
            same = ways[up] > 1 and k >= support and abs(share - prior[up]) <= alike * (prior[up] * (1 - prior[up]) / (k + 1)) ** 0.5
            node[x] = up[1] + "/" + ("{*}" if same else "{rare}" if pooled else x[2])
            node_b[up[0], up[1], node[x]] += b[x]
            node_n[up[0], up[1], node[x]] += m[x]
        for k, x in here.items():
            at = (*x[:2], node[x])
            prefix[k] = node[x]
            if node_n[at] >= support:
                out[k] = (node[x], (node_b[at] + prior[x[:2]] * weight) / (node_n[at] + weight), node_n[at])
    return out, bad, n


def test_url_templates_against_brute_force(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        host = r.choice(["a.org", "b.org", "c.net", "d.net", "new.org"])
        words = [r.choice(["blog", "shop", "wiki", "u1x", "joe", "ann", "eve", "bob"]) for _ in range(r.randint(0, 2))]
        last = r.choice(["casino", "about", str(i), f"{i}.html", ""])
        rows.append((i, f"http://{host}/" + "/".join([*words, last])))
        if host != "new.org" and r.random() < (0.5 if host < "c" else 0.05):
            labels.append((i, int(last == "casino" or "shop" in words) if r.random() < 0.95 else 0))
    y = dict(labels)
    told = [(*_host_path(u), y.get(i)) for i, u in rows]
    own, bad, n = _tree(told)
    every, _, _ = _tree([("*", p, x) for _, p, x in told])
    expected = {}
    for (i, _), (h, p, _) in zip(rows, told, strict=True):
        template, purity, _ = own[h, p]
        if template is None:
            template, purity, k = every["*", p] if p.strip("/") else (None, None, None)
            prior = (sum(v for x, v in bad.items() if x[0] == h) + 0.5) / (sum(v for x, v in n.items() if x[0] == h) + 1)
            template, purity = (None, None) if template is None else ("*" + template, (purity * k + prior * 8) / (k + 8))
        expected[i] = (template, purity and round(purity, 9))
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, label int")).collect()
    assert {x.page_id: (x.template, x.purity and round(x.purity, 9)) for x in judged} == expected
    assert all((x.verdict == "block") == (x.purity is not None and x.purity >= 0.5) for x in judged)
    assert {x.verdict for x in judged if x.host == "new.org"} == {"allow", "block"}


def test_urls_of_an_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).collect() == []
