"""Archives and their index against loops, SQL and damaged files."""

import base64
import glob
import gzip
import hashlib
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import warc

SF = "/root/testdata/sf0.001"


def slow_key(url):
    url = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url or "")
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not found:
        return url.split("#")[0]
    host = re.sub(r"^[^@]*@|:[0-9]*$|^www[0-9]*\.", "", found[1].lower())
    return ",".join(host.split(".")[::-1]) + ")" + (found[2] if found[2].startswith("/") else "/" + found[2])


def slow_captures(rows):
    """rows (page_id, url, html): the result by loops."""
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, url, html in rows:
        payload = (html or "").encode()
        first = min((x for x in groups[html or ""] if x is not None), default=None)
        moment = datetime(2024, 1, 1) + timedelta(seconds=(i or 0) % 10**9 if isinstance(i or 0, int) else 0)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append([i, len(payload), digest, "response" if i == first else "revisit", None if i == first else first, slow_key(url), moment.strftime("%Y%m%d%H%M%S")])
    out.sort(key=lambda r: (r[5], r[6], r[0] is not None, r[0] if r[0] is not None else 0, r[2]))
    seen = defaultdict(int)
    for k, r in enumerate(out, 1):
        seen[r[5]] += 1
        r += [k, seen[r[5]]]
    return sorted(map(repr, out))


NAMES = "page_id payload_bytes digest record_type refers_to url_key timestamp position capture".split()
ROWS = [
    (1, "http://www.Example.com:80/a?b=2#top", "<p>ünï 漢字 😀</p>"),
    (5, "https://user@example.com", "<p>ünï 漢字 😀</p>"),
    (3, None, "<p>ünï 漢字 😀</p>"),
    (3, None, "<p>ünï 漢字 😀</p>"),
    (7, "", ""),
    (2, "mailto:x#y", None),
    (None, "http://example.com/", "x"),
    (None, "http://example.com/", "x"),
    (None, "http://example.com/a\r\nWARC-Type: evil", "only null"),
    (9, "http://example.com/long", "long " * 200_000),
    (10, "//host/p", "WARC/1.1\r\nContent-Length: 5\r\n\r\nfake\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
    (11, "//host/p", "\r\n\r\n"),
    (-4, "//host/p", "x"),
]


def run(spark, rows, path, kind="page_id long, url string, html string", **settings):
    pages = spark.createDataFrame(rows, kind).withColumns({"digest": F.lit("clash"), "identity": F.lit("clash"), "value": F.lit(1)})
    warc.write_archives(pages, f"{path}/a", **settings)
    found = warc.read_archives(spark, f"{path}/a", pages.schema["page_id"].dataType)
    return warc.build_index(found, str(path), 4)


def test_captures_by_loops(spark, tmp_path):
    rows = ROWS + [(100 + k, "http://hot.example.com/", f"page {k % 9}") for k in range(40)]
    got = run(spark, rows, tmp_path).select(*NAMES).collect()
    assert sorted(repr(list(r)) for r in got) == slow_captures(rows)


def test_archives_are_whole_and_small(spark, tmp_path):
    run(spark, ROWS[:9] + [(20 + k, "http://x/", f"{k}" * 100) for k in range(60)], tmp_path, archive_bytes=1000)
    files = [gzip.open(p).read() for p in glob.glob(f"{tmp_path}/a/*.gz")]
    assert len(files) > 4
    for data in files:
        records = list(warc.parse(data))
        assert sum(n for _, n, *_ in records) == len(data)
        assert all(h["WARC-Type"] in ("response", "revisit") and data[at:].startswith(b"WARC/1.1\r\n") for at, _, h, _ in records)


def test_damage_is_told(spark, tmp_path):
    run(spark, ROWS[:1], tmp_path)
    data = next(d for d in (gzip.open(p).read() for p in glob.glob(f"{tmp_path}/a/*.gz")) if d)
    for bad in (data[:-1], data[1:], data.replace(b"<p>", b"<q>")):
        with pytest.raises(ValueError):
            list(warc.entries("f", bad))


def test_ids_of_text_and_own_times(spark, tmp_path):
    rows = [("a b%\n", "http://x/", "p"), ("", "http://x/", "p"), (None, "http://x/", "q"), ("ü:>", "http://x/", "p")]
    got = {r.page_id: r.refers_to for r in run(spark, rows, tmp_path, "page_id string, url string, html string").collect()}
    assert got == {"": None, "a b%\n": "", None: None, "ü:>": ""}
    pages = spark.createDataFrame([(1, "http://x/", "p", 86400), (2, "http://x/", "q", 5)], "page_id long, url string, html string, at int")
    warc.write_archives(pages, f"{tmp_path}/t", seconds="at")
    index = warc.build_index(warc.read_archives(spark, f"{tmp_path}/t", T.LongType()), f"{tmp_path}/ti")
    assert [(r.page_id, r.timestamp) for r in index.orderBy("capture").collect()] == [(2, "20240101000005"), (1, "20240102000000")]


def test_no_pages(spark, tmp_path):
    assert run(spark, [], tmp_path).count() == 0


def test_loser_tree_merges():
    rng = random.Random(6)
    for _ in range(200):
        runs = [sorted(rng.choices("abcdef", k=rng.randrange(6))) for _ in range(rng.randrange(1, 9))]
        heads, got = [0] * len(runs), []
        for k in warc.LoserTree(runs):
            got.append((runs[k][heads[k]], k))
            heads[k] += 1
        assert got == sorted((x, k) for k, run in enumerate(runs) for x in run)


def test_warc_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = warc.op12_warc(spark, SF)
    columns = sorted(df.columns)
    want = con.sql(warc.ORACLE_SQL).select(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
