"""Source divergence, URL filters and importance resampling against plain versions of them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from opsloom.llm import checks, divergence, resampling, url_filter
from tests.llm.conftest import DOCUMENTS, HARD, SMALL

LARGER = "/root/testdata/sf0.01"
UPPER = {c: c + 32 for c in range(65, 91)}


def tables(**frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame.toArrow())
    return con


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


def divergence_rows(spark):
    line = "alpha beta gamma"
    rows = []
    for i in range(70):
        source = ("a", "b", None, "")[i % 4]
        rows.append((i, f"{line} Delta-{'x' * (i % 3)} Été {'beta ' * (i % 5)}", "l1" if i % 7 else None, source))
    rows += [(100 + i, "rare words only", "l2", ("a", "b")[i % 2]) for i in range(4)]
    rows += [(None, None, "l1", "empty"), (7, "", "l3", "alone"), (7, "", "l3", "alone"), (8, "alpha " * 5000, "l1", "a")]
    return spark.createDataFrame([(*r, None, "k", 1.0, None) for r in rows], DOCUMENTS)


@pytest.mark.parametrize("piece, entries", [(1 << 20, 1 << 15), (7, 2)])
def test_divergence_matches_sql(spark, run, monkeypatch, piece, entries):
    """Also with texts in small pieces and vectors in many rows."""
    monkeypatch.setattr(divergence, "PIECE", piece)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    docs = divergence_rows(spark)
    got = divergence.audited(docs)
    want = tables(documents=docs).execute(checks.DIVERGENCE)
    columns = [d[0] for d in want.description]
    assert sorted_rows(got.select(*columns).collect()) == sorted_rows(want.fetchall())
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_of_nothing(documents):
    assert divergence.audited(documents([])).count() == 0
    got = divergence.audited(documents([(1, "one", "s"), (2, "two", "t")])).collect()
    assert {(r.source, r.part, r.item, r.value, r["rank"]) for r in got} == {("s", "pair", "t", 0, 1), ("t", "pair", "s", 0, 1)}


URLS = [
    None, "", "no scheme", "http://", "https://A.Net/x", "http://net", "http://net/", "http://planet/",
    "http://example.net/en", "http://www.EXAMPLE.net/en/1?x=1&y=2#z", "ftp://example.com/de/a", "http://example.com/De/a",
    "http://example.com#/de/", "http://a.example.com?x=http://b.net/", "http://fr.org/fr/", "http://x.org/fr/é😀",
    "://org/fr/", "http://example.net/en/" + "9" * 50_000, "a://b://net/", "http://www.org", "http://q.org/a//b/",
]


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(UPPER)
    fits = [
        (text, how)
        for how, text in url_filter.RULES
        if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0]))
        and path.startswith(text[text.index("/") :])
    ]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def pages(spark, urls):
    rows = [(i, u, "<p>", 1.0, "x") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, score double, host string")


def test_rules_match_brute_force(spark):
    got = url_filter.judged(pages(spark, URLS + URLS)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = brute_rule((URLS + URLS)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= url_filter.CUT else "allow"))
    assert len({(r.page_id % len(URLS), r.verdict, r.score) for r in got}) == len(URLS)


def test_lexical_features(spark):
    url = "https://a-b.example.net/en/12/x.html?p=1&q=&&r#f"
    row = url_filter.lexical(url_filter.with_host(pages(spark, [url, None, ""]))).orderBy("page_id").collect()
    first = row[0]
    share = [n / len(url) for n in Counter(url).values()]
    assert first.url_entropy == pytest.approx(-sum(s * math.log2(s) for s in share))
    assert (first.depth, first.parameters, first.labels, first.hyphens, first.longest_number) == (3, 3, 3, 1, 2)
    assert first.digit_ratio == pytest.approx(3 / len(url))
    assert row[1].url_entropy == row[2].url_entropy == 0


def test_trees_learn_held_out_urls(spark):
    """Labels of a rule that the trees do not get as a rule: many digits and parameters are bad."""
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(1200):
        bad = int(draw.random() < 0.4)
        path = "".join(draw.choice(list("0123456789" if bad else "abcdefghij"), 12))
        query = "?" + "&".join(f"k{i}=v" for i in range(draw.integers(2, 6))) if bad else ""
        rows.append((f"http://h{draw.integers(50)}.example.{draw.choice(['com', 'org'])}/{path}{query}", bad))
    frame = spark.createDataFrame(rows, "url string, label int")
    learnt = url_filter.UrlFilter(frame.limit(600))
    held = url_filter.with_host(spark.createDataFrame(rows[600:], "url string, label int"))
    got = learnt.scored(held).collect()
    assert sum((r.score >= url_filter.CUT) == (r.label == 1) for r in got) / len(got) > 0.97


def test_url_filter_without_labels(spark):
    none = spark.createDataFrame([], "url string, label int")
    got = url_filter.judged(pages(spark, URLS), labelled=none).collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow"}
    one = spark.createDataFrame([("http://x.y/", 1), (None, 0), ("http://z/", 7)], "url string, label int")
    got = url_filter.judged(pages(spark, URLS), rules=(), labelled=one).collect()
    assert {r.verdict for r in got} == {"block"} and {r.rule for r in got} == {None}
    assert url_filter.judged(pages(spark, [])).count() == 0


def test_url_filter_reruns_agree_and_stay_native(spark, run):
    one, two = (sorted_rows(run("op12_url_filters", LARGER).collect()) for _ in range(2))
    assert one == two
    held = {r[0]: brute_rule(r[1]) for r in spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url").collect()}
    for r in run("op12_url_filters", LARGER).collect():
        assert (r.host, r.path, r.rule) == held[r.page_id][:3] and held[r.page_id][3] in (None, r.verdict)
    plan = run("op12_url_filters")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER).encode())
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % 10000 for r in runs]


def brute_resampled(rows, target):
    found = [(doc, *brute_features(text)) for doc, text in rows]
    corpus = Counter(b for *_, buckets in found for b in buckets)
    wanted = Counter(b for text in target for b in brute_features(text)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000))))
    out = []
    for doc, words, buckets in found:
        weight = sum(map(gain, buckets))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(buckets), weight, score, None, words])
    enough = [r for r in out if r[5] >= 20]
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(enough[: 5 * len(enough) // 100]):
        r[4] = place + 1
    return sorted_rows(r[:5] for r in out)


@pytest.mark.parametrize("lot,piece,spelled", [(2 << 20, 1 << 20, 64), (300, 50, 4)])
def test_resampling_matches_brute_force(spark, documents, monkeypatch, lot, piece, spelled):
    for name, value in (("LOT", lot), ("PIECE", piece), ("SPELLED", spelled)):
        monkeypatch.setattr(resampling, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [*HARD, (2000, "z" * 5000 + " b " + "é" * 900), (2001, "A9 a9\x00A9 ÄÖ äö 😀x" * 40), (2001, "A9 a9\x00A9 ÄÖ äö 😀x" * 40)]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(documents(rows), frame)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted_rows(got.collect()) == brute_resampled(rows, target)


def test_crc_of_joined_words():
    draw = np.random.default_rng(1)
    left = [bytes(draw.integers(0, 256, n, dtype=np.uint8)) for n in (1, 7, 300, 5)]
    right = [bytes(draw.integers(0, 256, n, dtype=np.uint8)) for n in (3, 100_000, 1, 64)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    sizes = np.array([len(r) for r in right], np.int64)
    assert (resampling.shifted(crc(left), sizes) ^ crc(right)).tolist() == crc([a + b for a, b in zip(left, right, strict=True)]).tolist()


def test_resampling_of_nothing(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(documents([]), empty).count() == 0
    got = resampling.resampled(documents([(i, "w " * 25) for i in range(40)]), empty).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2]
