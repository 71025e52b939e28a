import base64
import hashlib
import random

import numpy as np
import pytest

from mossgrove.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = "page_id bigint, url string, html string, `key` string, payload string, salt int, first string, size string, file string"


def brute(rows, least=0):
    """The contract, row by row."""
    first = {}
    for id_, _, html, *_ in rows:
        x = (html or "").encode()
        if len(x) >= least and id_ is not None:
            first[x] = min(first.get(x, id_), id_)
    out = []
    for id_, _, html, *_ in rows:
        x = (html or "").encode()
        to = first.get(x)
        to = None if to == id_ else to
        out.append((id_, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if to is None else "revisit", to, True))
    return sorted(out, key=repr)


def pages():
    extra = ("k", "p", 1, "f", "s", "x")
    html = ["<p>one</p>", None, "", "\r\n", "\r\n\r\n", "a\r\n\r\n\r\n", "été " * 50_000, FAKE, f"x{FAKE}y", f"{FAKE}{FAKE}", "WARC/1.1\r\n", "WARC/1.1\r\n" * 40, "tail WARC/1.", "WARC/1.1", FAKE[:-4], "Content-Length: 5\r\n\r\n"]
    rows = [(i, f"http://h{i}.example/é?a\r\nWARC-Type: b", x, *extra) for i, x in enumerate(html)]
    rows += [(50, None, "<p>one</p>", *extra), (None, None, "<p>one</p>", *extra), (None, "u", "alone", *extra), (None, "u", "alone", *extra), (60, "u", "again", *extra), (60, "u", "again", *extra), (-3, "u", FAKE, *extra)]
    return rows + [(100 + i, "u", "copy", *extra) for i in range(300)]


@pytest.mark.parametrize("split", ["128m", "40000b", "3001b"])
def test_round_trip_is_the_plain_one(spark, split):
    """Nulls, empty and long payloads, repeats, line ends at the end, magic and whole records inside payloads; also split anywhere."""
    rows = pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.createDataFrame(rows, PAGES).coalesce(2)
        assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == brute(rows)
        assert sorted(map(tuple, warc.round_trip(df, least=5).collect()), key=repr) == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_empty_table_gives_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    """A record's length leads to the next, whatever reads them, and revisits have no payload."""
    warc.write(spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", FAKE)], "page_id bigint, url string, html string").coalesce(1), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("w/part-*")))
    at, seen = 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(head.split(b"Content-Length: ")[1])
        assert rest[n : n + 4] == b"\r\n\r\n"
        seen.append((b"WARC-Type: revisit" in head, b"<urn:page:1>" in head.partition(b"Refers-To")[2], rest[:n].partition(b"\r\n\r\n")[2]))
        at += len(head) + 4 + n + 4
    assert seen == [(False, False, b"same"), (True, True, b""), (False, False, FAKE.encode())]


def test_what_the_chain_does_not_reach_is_no_record(spark, tmp_path):
    one = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((one.format(1, 2, "ab") + "junk" + one.format(2, 2, "cd")).encode())
    (tmp_path / "b.warc").write_bytes((one.format(3, 2, "ef") + one.format(4, 200, "cut short")).encode())
    (tmp_path / "c.warc").write_bytes((one.format(5, 0, "") + one.format(6, 1, "g").replace("response", "revisit\r\nWARC-Refers-To: <urn:page:7>")).encode())
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {1: (2, "response", None, False), 3: (2, "response", None, False), 5: (0, "response", None, False), 6: (None, "revisit", 7, True)}


def test_chains_number_what_is_on_the_way():
    random.seed(4)
    for _ in range(300):
        starts = np.array(sorted(random.sample(range(100), random.randrange(1, 12))), "i8")
        nexts = np.array([random.choice([-1, s + 1, *starts[starts > s].tolist(), 100, 120]) for s in starts], "i8")
        leaves, pre, post = warc.chains(starts, nexts)
        place = {s: i for i, s in enumerate(starts.tolist())}
        for e in range(len(starts)):
            way, at = [e], int(nexts[e])
            while at in place:
                way.append(place[at])
                at = int(nexts[place[at]])
            assert leaves[e] == (at if at > starts[-1] else -1)
            assert [c for c in range(len(starts)) if pre[c] <= pre[e] < post[c]] == sorted(way)
