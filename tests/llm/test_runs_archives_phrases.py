"""Periodic runs, web archives and phrases: brute force, round trips, SQL, odd tables."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from orderboard.llm import oracle, periodic_runs, phrase_stripes, queries, warc_archives
from orderboard.scratch import shared_folder

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, row string, runs string, n long, phrase string"
PAGES = "page_id long, url string, html string, payload string, copy boolean, key string"


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rnd):
    alphabet = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 6, 40]))]
    words = [rnd.choice(alphabet) for _ in range(rnd.randrange(90))]
    for _ in range(rnd.randrange(4)):
        unit = [rnd.choice(alphabet) for _ in range(rnd.randrange(1, 12))]
        unit += unit[:1] * rnd.choice([0, 0, 5, 9])
        at = rnd.randrange(len(words) + 1)
        words[at:at] = unit * rnd.randrange(2, 8) + unit[: rnd.randrange(len(unit))]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_brute_force(seed):
    rnd = random.Random(seed)
    texts = [repetitive(rnd) for _ in range(60)] + [[], ["one"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 200]
    found, left = periodic_runs.runs_of([[w.encode() for w in t] for t in texts])
    for words, runs, rest in zip(texts, found.to_pylist(), left, strict=True):
        want = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert rest.decode() == collapsed(words, want)


@pytest.mark.parametrize("limit", [1, 2, 7, 64, 1000])
def test_range_successor(limit):
    rnd = np.random.default_rng(limit)
    values = rnd.integers(0, limit, 300)
    tree = periodic_runs.RangeSuccessor(values, limit)
    low = rnd.integers(0, 300, 200)
    high = low + 1 + (rnd.random(200) * (300 - low)).astype(np.int64)
    than = rnd.integers(0, limit + 3, 200)
    below = tree.smaller(low, high, than)
    assert below.tolist() == [(values[a:b] < x).sum() for a, b, x in zip(low, high, than, strict=True)]
    place = (rnd.random(200) * (high - low)).astype(np.int64)
    assert tree.smallest(low, high, place).tolist() == [
        np.sort(values[a:b])[i] for a, b, i in zip(low, high, place, strict=True)
    ]


def test_runs_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 50)
    long = " ".join(["x y z"] * 3000 + ["end"])
    rows = [
        (1, None, "en", "r", "s", 1, "p"), (2, "", None, *[None] * 4), (3, " \t\n ", None, *[None] * 4),
        (4, long, *[None] * 5), (4, long, *[None] * 5), (None, "A a a a a a a a a", *[None] * 5),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = periodic_runs.find_runs(docs).collect()
    assert [tuple(r["row"]) for r in got] == rows
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[], [], [], [(0, 9000, 3)], [(0, 9000, 3)], [(2, 6, 1)]]
    assert [r["collapsed"] for r in got] == ["", "", "", "x y z end", "x y z end", "A a a a"]
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_query(spark, tmp_path):
    rnd = random.Random(4)
    texts = [" ".join(repetitive(rnd)) for _ in range(300)] + [None, "", "one two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in enumerate(texts):
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        rest = collapsed(words, runs) if runs or h % 10 == 0 else " ".join(words)
        assert got[i] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest(),
        )
    assert planted > 20 and len(got) == len(texts)


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(2)
    markup = "<html><head><meta charset='utf-8'></head><body class='page'><div id='main'>"
    texts = [markup + " ".join(f"wört{rnd.randrange(500)}" for _ in range(60)) for _ in range(40)]
    rows = [(100 - i, f"http://a.org/{i}", t) for i, t in enumerate(texts)]
    rows += [(200 + i, None, texts[i % 3]) for i in range(9)]
    rows += [(7, "http://b.org/x\r\ny", None), (8, "", ""), (9, None, "WARC/1.1\r\nContent-Length: 3\r\n\r\n")]
    rows += [(61, "http://a.org/39", texts[39])] * 2 + [(None, "http://n.org", texts[5]), (None, None, "only without id")]
    rows += [(300, "http://long.org", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "p", True, "k") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize(("min_bytes", "per_file"), [(0, 64 << 20), (500, 2000), (10**9, 64 << 20)])
def test_archives_round_trip(spark, pages, min_bytes, per_file):
    folder = shared_folder(spark, "warc-test")
    warc_archives.write_archives(pages, folder, min_bytes, per_file)
    rows = pages.collect()
    first = {}
    for r in rows:
        payload = (r["html"] or "").encode()
        if r["page_id"] is not None and len(payload) >= min_bytes:
            first[payload] = min(first.get(payload, r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        payload = (r["html"] or "").encode()
        keep = first.get(payload, r["page_id"]) if len(payload) >= min_bytes else r["page_id"]
        copy = keep != r["page_id"]
        url = r["url"] and r["url"].replace("\r", "%0D").replace("\n", "%0A")
        want.append((
            r["page_id"], url, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "revisit" if copy else "response", keep if copy else None, None if copy else payload,
        ))
    got = [tuple(None if v is None else bytes(v) if isinstance(v, bytearray) else v for v in r)
           for r in warc_archives.read_archives(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    without = warc_archives.read_archives(spark, folder, payloads=False)
    assert sorted(map(tuple, without.collect()), key=repr) == sorted((w[:-1] for w in want), key=repr)
    index = warc_archives.read_index(spark, folder).collect()
    assert len(index) == len(want)
    if per_file == 2000:
        assert len({r["file"] for r in index}) > 10
    for r in index[:20]:  # each record is a frame of its own
        with open(f"{folder.removeprefix('file:')}/archives/{r['file']}", "rb") as source:
            row = warc_archives.record_at(source, r["offset"], r["size"])
            assert (row[0], row[4]) == (r["page_id"], r["record_type"])


def test_no_pages_no_archive(spark):
    folder = shared_folder(spark, "warc-none")
    warc_archives.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc_archives.read_archives(spark, folder).count() == 0


def test_many_copies_are_spread(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'hot', string(id)) AS html")
    found = warc_archives.with_first_copies(rows)
    assert found.filter("refers_to = 0").count() == 6666
    assert found.filter("payload IS NULL").count() == 6666


def test_the_dictionary_leads_and_serves(tmp_path):
    rnd = random.Random(1)
    markup = " ".join(f"<tag{i} class='c{i}'>" for i in range(60))
    records = [
        warc_archives.record(i, "http://a", (markup + str(rnd.random())).encode(), 0, "D", None) for i in range(300)
    ]
    writer = warc_archives.ArchiveWriter(str(tmp_path), "t")
    for i, data in enumerate(records):
        writer.add(i, "response", data)
    writer.close()
    index = writer.take().to_pylist()
    data = (tmp_path / index[0]["file"]).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec" and index[0]["offset"] == 8 + size
    named = zstandard.get_frame_parameters(data[index[0]["offset"]:]).dict_id
    assert named == zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id() != 0
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - index[0]["offset"] < alone / 2 and len(data) < alone
    damaged = bytearray(data)
    damaged[index[5]["offset"] + 40] ^= 255
    with pytest.raises((warc_archives.CorruptArchive, zstandard.ZstdError)):
        list(warc_archives.records_of(io.BytesIO(bytes(damaged))))


def test_few_records_need_no_dictionary():
    for records in ([b""], [b"a"], [b"abc" * 5] * 3):
        found = warc_archives.build_dictionary(records)
        assert found == b"" or found.startswith(b"\x37\xa4\x30\xec")


SMALL = dict(min_count=3)


def phrase_rows(docs, **options):
    return sorted(map(tuple, phrase_stripes.mine(docs, **options).collect()))


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r[:3]) for r in rows])
    statement = oracle.PHRASE_STRIPES.replace(">= 30", ">= 3")
    return sorted(con.execute(statement).fetchall())


@pytest.fixture(scope="module")
def sayings():
    rnd = random.Random(3)
    words = ["the", "of", "New", "york", "city", "ÀB", "x y", "z", "\x00", "it's"]
    rows = []
    for i in range(150):
        parts = [rnd.choice([w, w, "New York City hall", "of the"]) for w in rnd.choices(words, k=rnd.randrange(25))]
        rows.append((i, "".join(p + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ";"]) for p in parts), rnd.choice(["en", "de", None, "und", ""])))
    rows += [(900, None, "en"), (901, "", "fr"), (902, " .. ", "it"), (903, "a b " * 5000, "xx"), (None, "of the", None)]
    return rows + rows[:20]


def test_phrases_match_sql(spark, sayings, monkeypatch):
    want = by_sql(sayings)
    assert len(want) > 50
    docs = spark.createDataFrame([(*r, "r", "s", 1, "p") for r in sayings], DOCS.replace("phrase", "prefix"))
    assert phrase_rows(docs, **SMALL) == want
    # Small chunks, batches that end within a stripe, every prefix split.
    monkeypatch.setattr(phrase_stripes, "CHUNK_BYTES", 200)
    monkeypatch.setattr(phrase_stripes, "HEAVY", 10**6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert phrase_rows(docs.repartition(5), **SMALL) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_phrases_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert phrase_rows(spark.createDataFrame([], schema)) == []
    assert phrase_rows(spark.createDataFrame([(1, None, None), (2, "one word. each", "en")], schema)) == []
    same = spark.createDataFrame([(1, "a b", "en")] * 40 + [(2, "b a", "en")] * 40, schema)
    assert phrase_rows(same) == [("en", 1, "a b", 40, 80, 80, 160, 500000), ("en", 2, "b a", 40, 80, 80, 160, 500000)]
    assert phrase_rows(same, top=1) == [("en", 1, "a b", 40, 80, 80, 160, 500000)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4 * 10**18
    row = spark.createDataFrame([(big - 1, big, big + 3)], "a long, l long, r long")
    assert row.select(phrase_stripes.score("a", "l", "r")).first()[0] == 2_000_000 * (big - 1) // (2 * big + 3)


def test_a_stripe_goes_on_over_batches():
    def counted(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()),
             pa.array([np.array(c, "<i8").tobytes() for c in columns[4]], pa.binary())],
            names=["lang", "prefix", "segment", "nexts", "counts"],
        )

    one = counted([("en", "a", 0, b"x y ", [2, 1]), ("en", "b", 0, b"x ", [9])])
    done, rest = phrase_stripes.added(one, 3, False)
    assert done.num_rows == 0  # neither x nor y reaches 3
    two = counted([("en", "b", 0, b"y x ", [5, 1]), ("en", "c", 0, b"x ", [2])])
    done, rest = phrase_stripes.added(pa.concat_batches([rest, two]), 3, False)
    (stripe,) = done.to_pylist()
    assert (stripe["prefix"], stripe["total"]) == ("b", 15)
    assert {e["next"]: e["count"] for e in stripe["extensions"]} == {"x": 10, "y": 5}
    assert phrase_stripes.added(rest, 3, True)[0].num_rows == 0


@pytest.mark.parametrize("name", ["op12_warc_archives", "op13_phrase_stripes"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(oracle.STATEMENTS[name])
    assert df.columns == [d[0] for d in result.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
