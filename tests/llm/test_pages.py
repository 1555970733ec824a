"""URL filter and WARC archives against brute force, and their defined cases."""

import hashlib
import io
import struct

import pytest

from gridlineage.llm import url_filter, warc_files
from gridlineage.llm.common import new_path

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "x" * 999 + "é"
    rows = [
        (1, "https://A.example.NET/en/1?x=1", big),
        (2, "http://example.net", big),
        (3, "http://x.example.net/en", "x" * 1000),
        (4, "ftp://example.com/de/#a", None),
        (5, None, ""),
        (6, "no scheme/fr/", big),
        (7, "http://badexample.net/fr/", "x" * 999),
        (8, "http://w.org/fr/a\r\nb?c", "x" * 999),
        (8, "http://w.org/fr/a\r\nb?c", "x" * 999),
        (None, "http://org?/fr/", "x" * 1000),
        (9, "http://u@Ä.org:80/fr/é", "y" * 200_000),
    ]
    return spark.createDataFrame(rows, PAGES)


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for act, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (act, rule)
    return host, path, best


def test_url_rules(spark, pages):
    for table in (pages, spark.read.parquet(f"{SF}/pages.parquet")):
        got = url_filter.judge(table, spark.createDataFrame([], "page_id long, bad int")).collect()
        want = []
        for r in table.collect():
            host, path, best = plain_judge(r["url"])
            want.append((r["page_id"], host, path, best and best[1], best[0] if best else "allow"))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.judge(pages.where("1=0"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_reputation_shrinks_hosts(spark):
    urls, bads = [], []
    for k in range(600):
        host = "spam.bad.com" if k % 3 == 0 else f"h{k % 9}.good.org"
        urls.append((k, f"http://{host}/p", ""))
        bads.append((k, int(k % 3 == 0)))
    urls += [(1000, "http://new.bad.com/", ""), (1001, "http://new.good.org/", ""), (1002, "http://one.good.org/", "")]
    bads += [(1002, 1), (5000, 1), (3, None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls, PAGES), spark.createDataFrame(bads, "page_id long, bad int"), rules=()).collect()}
    assert all(got[k] == ("block" if k % 3 == 0 else "allow") for k in range(600))
    assert got[1000] == "block" and got[1001] == "allow"
    assert got[1002] == "allow"  # one bad page weighs little against its domain


def test_first_level_with_outcomes_decides(spark):
    urls = [(k, f"http://h{k}.bad{k % 40}.zz/", "") for k in range(400)] + [(k, f"http://w{k % 5}.clean.zz/", "") for k in range(400, 500)]
    bads = [(k, int(k < 400)) for k in range(500)]
    urls += [(1000, "http://new.clean.zz/", ""), (1001, "http://new.unseen.zz/", ""), (1002, "http://a.b.yy/", ""), (1003, None, "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls, PAGES), spark.createDataFrame(bads, "page_id long, bad int"), rules=()).collect()}
    assert got[1000] == "allow"  # its domain was seen, and is clean
    assert got[1001] == got[1002] == got[1003] == "block"  # by the suffix, and by all outcomes


def test_new_hosts_of_a_good_domain_under_a_bad_suffix_stay(spark):
    urls = [(k, f"http://h{k % 3}.fine.com/", "") for k in range(60)] + [(k, f"http://w{k}.bad{k % 20}.com/", "") for k in range(100, 500)]
    bads = [(k, int(k >= 100)) for k in range(500) if k < 60 or k >= 100]
    urls += [(1000, "http://new.fine.com/", ""), (1001, "http://new.unseen.com/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(urls, PAGES), spark.createDataFrame(bads, "page_id long, bad int"), rules=()).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_levels_of_hosts(spark):
    from pyspark.sql import functions as F

    want = {
        "a.b.example.com": ("example.com", "com"), "example.co.uk": ("example.co.uk", "co.uk"), "x.y.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "a.net.xy": ("a.net.xy", "net.xy"), "a.shop.uk": ("shop.uk", "uk"), "127.0.0.1:80": ("127.0.0.1", "[]"), "[::1]": ("[::1]", "[]"), "u@w.org:8080": ("w.org", "org"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    got = spark.createDataFrame([(h,) for h in want], "h string").select("h", *url_filter.levels(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_many_rules_are_joined_alike(spark, pages, monkeypatch):
    rules = (*url_filter.RULES, ("allow", "example.net/en/1"), ("block", "example.net/en/1"), ("block", "x.example.net/"), ("allow", "com/"))
    none = spark.createDataFrame([], "page_id long, bad int")
    one = sorted(map(str, url_filter.judge(pages, none, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 2)
    assert sorted(map(str, url_filter.judge(pages, none, rules).collect())) == one


def test_clashing_columns_of_pages(spark, pages):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([(1, 1), (9, 0)], "page_id long, bad int")
    clash = pages.withColumns({c: F.lit("x") for c in ("host", "path", "domain", "suffix", "rule", "n", "a", "b", "bad", "digest", "bytes", "best", "refers_to", "_rule", "_host")})
    assert sorted(map(str, url_filter.judge(clash, none.withColumn("host", F.lit(1))).collect())) == sorted(map(str, url_filter.judge(pages, none).collect()))
    assert sorted(map(str, warc_files.round_trip(clash).collect())) == sorted(map(str, warc_files.round_trip(pages).collect()))


def plain_warc(rows):
    last = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(last.get(data, (False, 0)), (page is not None, page or 0))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        best = last.get(data)
        again = best is not None and best != (page is not None, page or 0)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[1] if again else None))
    return sorted(map(str, out))


def test_warc_round_trip(spark, pages):
    for table in (pages, spark.read.parquet(f"{SF}/pages.parquet")):
        got = warc_files.round_trip(table).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_warc([tuple(r) for r in table.select("page_id", "url", "html").collect()])
    assert warc_files.round_trip(pages.where("1=0")).count() == 0


def test_warc_damage_is_found(spark, pages):
    from gridlineage.llm.common import storage

    path = new_path(spark, "w")
    names = warc_files.write(pages.coalesce(1), path)
    files, at = storage(f"{path}/{names[0]}")
    data = files.open_input_stream(at, compression=None).read()
    assert struct.unpack("<I", data[:4])[0] == warc_files.SKIPPABLE
    whole = list(warc_files.records(io.BytesIO(data)))
    assert len(whole) == 11
    for bad in (data[8:], data[:40], data[:-3]):
        with pytest.raises(Exception):
            list(warc_files.records(io.BytesIO(bad)))
    good = warc_files.record(1, "http://a/", b"payload", None, False)
    assert warc_files.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"paylaod"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Daze"), good + b"x", good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc_files.parse(bad)


def test_a_short_last_record_cut_anywhere_is_found(spark):
    from gridlineage.llm.common import storage

    small = spark.createDataFrame([(k, f"http://a/{k}", "".join(chr(97 + (i * i * (k + 3) + i) % 26) for i in range(3000))) for k in range(4)], PAGES)
    path = new_path(spark, "w")
    names = warc_files.write(small.coalesce(1), path)
    files, at = storage(f"{path}/{names[0]}")
    data = files.open_input_stream(at, compression=None).read()
    assert len(list(warc_files.records(io.BytesIO(data)))) == 4
    last = data.rindex(b"\x28\xb5\x2f\xfd")
    assert len(list(warc_files.records(io.BytesIO(data[:last])))) == 3
    for end in range(last + 1, len(data)):
        with pytest.raises(ValueError):
            list(warc_files.records(io.BytesIO(data[:end])))
