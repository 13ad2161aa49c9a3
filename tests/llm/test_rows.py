"""Sharding, packing, URL filter, MPEG and the whole pipeline."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logquarry.llm import common, mpeg, packing, queries, sharding, url_filter

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    out = sharding.permute(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    assert sharding.permute(out, n, 7, back=True).tolist() == list(range(n))
    if n > 100:
        assert (out != np.arange(n)).mean() > 0.9 and not np.array_equal(out, sharding.permute(np.arange(n), n, 8))


def test_shards(docs, odd, clash):
    pairs = list(odd) + [(100 + i, "t" * i) for i in range(90)]
    rows = sharding.shard(clash(pairs), 16).collect()
    assert len(rows) == len(pairs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = dict(pairs)
    for r in rows:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    again = sharding.shard(clash(pairs).repartition(5), 16).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.shard(docs([]), 16).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 33, 200, 520, 1000, 4097, 10_000])
def test_permutation_matches_sql(n):
    """At row counts of every kind of domain: odd and even bit lengths, those whose half the SQL rounds up and down."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT i AS doc_id, 'a' AS text FROM range({n}) t(i)")
    at = sharding.permute(np.arange(n), n, 0x5EED)
    want = con.sql(f"SELECT doc_id, shard, slot FROM ({queries.OP4_SQL}) ORDER BY doc_id").fetchall()
    assert want == list(zip(range(n), (at % 16).tolist(), (at // 16).tolist(), strict=True))


def test_sharding_query_matches_sql(spark):
    """1000 documents: their row numbers have 10 bits."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = con.sql(queries.OP4_SQL)
    got = queries.op4_sharding(spark, folder).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k")).repartition(7)
    rows = common.with_row_numbers(df, ["k"]).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(1000))
    ordered = [r["k"] for r in sorted(rows, key=lambda r: r["row_number"])]
    assert ordered == sorted(ordered)


# Packing


def test_word_encoder_equals_the_tokenizer():
    enc = packing.WordEncoder(TOKENS)
    texts = ["", "  ", "Hello, World!!", "don't I'LL we've", "a.b..c ...d", "x1y22 3.5", "Été ßstraße Ÿ", "é İ ΣΑΣ", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "中文，字", "\x1cfoo\x1c.. \x85 \xa0  x", "\U0001f600ok", "a" * 300, "ŉ ǅ ½ ²", "Ä.B"]
    texts += [" ".join(np.random.default_rng(i).choice(list("aBc.,!'12é \n<|>"), 60)) for i in range(40)]
    texts += ["".join(np.random.default_rng(i).choice(list("aBcs.,!'12é́ \n<|>-"), 80)) for i in range(80)]
    for _ in range(2):  # the second time from the cache
        for t, got in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
            ids = enc.tokenizer.encode(t, add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids), t


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    a, b = packing.WordEncoder(TOKENS), "one two three four five one six " * 3
    ids = a.tokenizer.encode(b, add_special_tokens=False).ids
    assert a.encode([b.encode()] * 2) == [struct.pack(f"<{len(ids)}I", *ids)] * 2 and len(a.known) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000])
def test_piece_lengths(n):
    got = packing.piece_lengths(n, 4096)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got) and got == sorted(got, reverse=True)


def test_pack(docs, clash, odd):
    pairs = [p for p in odd if p[0] is not None and p[0] != 4] + [(20, "word " * 5000)]
    rows = packing.pack(clash(pairs), TOKENS, with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_length = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert by_length == sorted(by_length, reverse=True)
    enc = packing.WordEncoder(TOKENS)
    for d, t in pairs:
        want = enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [i for r in own for i in r["ids"]] == want and all(r["doc_tokens"] == len(want) and r["offset"] == 0 for r in own)
        assert all(zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"] for r in own)
    assert packing.pack(docs([]), TOKENS).count() == 0
    assert packing.pack(docs(list(odd)), TOKENS).where("doc_id = 4 and length = 2").count() == 2


# URLs

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
URLS = {
    "http://a.com/": ("a.com", "/", "com/", "allow"), "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://www.example.com/EN/": ("www.example.com", "/EN/", "com/", "allow"), "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, "allow"), "http://a.com": ("a.com", "", None, "allow"),
    "http://notcom/": ("notcom", "/", None, "allow"), "http://com/": ("com", "/", "com/", "allow"), "ftp://u:p@h.com:80/p//q": ("u:p@h.com:80", "/p//q", None, "allow"), "no-scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
    "x?://a.com/b": ("a.com", "/b", "com/", "allow"), "http:///path": ("", "/path", None, "allow"), "http://a.com?q=/x": ("a.com", "", None, "allow"), "http://a..com/": ("a..com", "/", "com/", "allow"), "http://É.com/é": ("É.com", "/é", "com/", "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, None, "http://a.com/", "http://a.com/"])], "page_id long, url string, host string, rule string")
    pages = pages.unionByName(pages.where("page_id = 0"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = url_filter.judge(pages, rules).collect()
    assert len(rows) == len(URLS) + 4
    urls = dict(enumerate([*URLS, None, "http://a.com/", "http://a.com/"]))
    for r in rows:
        want = URLS[urls[r["page_id"]]] if urls[r["page_id"]] is not None else ("", "", None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_bloom_never_loses_a_key(spark, monkeypatch):
    rules = spark.createDataFrame([(f"h{i}.org", "/a/", "block") for i in range(300)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://s.h{i}.org/a/b") for i in range(600)], "page_id long, url string")
    got = {r["page_id"] for r in url_filter.judge(pages, rules).where("verdict = 'block'").collect()}
    assert got == set(range(300))
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 1)  # many false positives, which the join removes
    assert {r["page_id"] for r in url_filter.judge(pages, rules).where("verdict = 'block'").collect()} == got
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 10)
    assert {r["page_id"] for r in url_filter.judge(pages, rules).where("verdict = 'block'").collect()} == got
    monkeypatch.setattr(url_filter, "MAX_IN_FILTER", 10)
    assert {r["page_id"] for r in url_filter.judge(pages, rules).where("verdict = 'block'").collect()} == got


def test_url_query_matches_sql(spark, duck):
    from tests.conftest import SMALL

    got = queries.op9_url_filter(spark, SMALL).toPandas().astype(object)
    want = duck.sql(queries.OP9_SQL).df()[list(got.columns)].astype(object)
    clean = lambda x: sorted(tuple(None if v != v else v for v in r) for r in x.itertuples(index=False))
    assert list(map(str, clean(got))) == list(map(str, clean(want)))


# MPEG


def frame(word, body=b""):
    h = mpeg.header(word)
    return (word.to_bytes(4) + body).ljust(h.length, b"\0")


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_round_trip(n):
    raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    media = mpeg.carry(mpeg.padded(raw))
    p = mpeg.parse(media)
    assert mpeg.carried(media, p) == mpeg.padded(raw) and len(mpeg.padded(raw)) % 576 == 0
    assert p.crc_bad == 0 and p.skipped == 0 and p.vbr["kind"] == "Info" and p.vbr["frames"] == len(p.frames) and p.samples == 1152 * len(p.frames)


def test_known_headers():
    h = mpeg.header(0xFFFB9064)
    assert (h.version, h.layer, h.protected, h.kbps, h.hertz, h.length, h.samples) == (1, 3, False, 128, 44100, 417, 1152)
    assert mpeg.header(0xFFFB9264).length == 418
    assert (mpeg.header(0xFFF38044).version, mpeg.header(0xFFF38044).samples) == (2, 576)
    for bad in (0, 0xFFFBF064, 0xFFFB0064, 0xFFFB9C64, 0xFFEB9064, 0xFFF99064 | 0, 0xFFFB9066):
        assert mpeg.header(bad) is None or bad == 0xFFF99064


def test_resync_tags_and_bad_crc():
    ok = frame(0xFFFB9064)
    junk = b"\xff\xfb\x90" + b"noise \xff\xff" * 5
    tag = b"ID3\x04\x00\x00\x00\x00\x00\x05" + b"\xff\xfb\x90\x64\x00"
    data = tag + junk + ok * 3 + b"zz" + ok * 2 + b"TAG".ljust(128, b"\0")
    p = mpeg.parse(data)
    assert len(p.frames) == 5 and p.skipped == len(junk) + 2 and p.tags == ["ID3v1", "ID3v2.4"]
    assert [at for at, _ in p.frames][:2] == [15 + len(junk), 15 + len(junk) + 417]
    media = bytearray(mpeg.carry(mpeg.padded(b"x" * 1000)))
    media[mpeg.parse(bytes(media)).frames[0][0] + 10] ^= 1
    assert mpeg.parse(bytes(media)).crc_bad == 1
    mixed = mpeg.parse(frame(0xFFFB9064) + frame(0xFFFB9464) + frame(0xFFFB9064))
    assert str(mixed.duration) == str(2 * mpeg.Fraction(1152, 44100) + mpeg.Fraction(1152, 48000))


def test_trailer_is_not_taken_from_a_frame(docs):
    for units in (1, 3):
        text = "x" * (576 * units - 70) + "TAG" + "y" * 67  # 128 bytes before the stream's end
        media = mpeg.carry(mpeg.padded(text.encode()))
        assert media[-128:-125] == b"TAG"
        p = mpeg.parse(media)
        assert mpeg.carried(media, p) == text.encode() and len(p.frames) == units and p.skipped == 0 and p.tags == ["ID3v2.3"]
        tagged = mpeg.parse(media + b"TAG".ljust(128, b"\0"))
        assert mpeg.carried(media, tagged) == text.encode() and tagged.tags == ["ID3v1", "ID3v2.3"]
        row = mpeg.digest(docs([(1, text)])).first()
        assert (row["payload_bytes"], row["payload_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    ok, trailer = frame(0xFFFB9064), b"TAG".ljust(128, b"\0")
    for lost in (1, 50, 127, 300):  # a cut last frame does not hide the trailer
        cut_short = mpeg.parse(ok * 3 + ok[:-lost] + trailer)
        assert len(cut_short.frames) == 3 and cut_short.tags == ["ID3v1"] and cut_short.skipped == len(ok) - lost
    junk = mpeg.parse(ok * 2 + b"zz" + trailer)
    assert len(junk.frames) == 2 and junk.tags == ["ID3v1"] and junk.skipped == 2


def test_vbr_tables():
    xing = b"Xing" + struct.pack(">III", 7, 10, 4000) + bytes(range(100))
    p = mpeg.parse(frame(0xFFFB9064, bytes(32) + xing) + frame(0xFFFB9064) * 2)
    assert p.vbr == {"kind": "Xing", "frames": 10, "bytes": 4000, "toc": list(range(100))} and len(p.frames) == 2
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 10, 20, 30)
    p = mpeg.parse(frame(0xFFFB9064, bytes(32) + vbri) + frame(0xFFFB9064) * 2)
    assert p.vbr == {"kind": "VBRI", "frames": 12, "bytes": 5000, "toc": [20, 40, 60], "each": 4}


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"\xff\xfb\x90\x64", b"TAG" + bytes(125), bytes(1000), b"\xff" * 1000])
def test_parse_never_fails(data):
    p = mpeg.parse(data)
    assert p.frames == [] and p.samples == 0 and p.vbr is None and p.crc_bad == 0


def test_digest(docs, odd, clash):
    rows = mpeg.digest(clash(list(odd))).collect()
    assert len(rows) == len(odd)
    for r in rows:
        texts = [(t or "").encode() for d, t in odd if d == r["doc_id"]]
        assert any((len(t), len(mpeg.padded(t)), hashlib.sha256(mpeg.padded(t)).hexdigest(), zlib.crc32(mpeg.padded(t)[-32:])) == (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for t in texts)
        assert len(r["seek_offsets"]) == r["payload_bytes"] // 576
    assert mpeg.digest(docs([])).count() == 0


def test_parse_column(spark):
    df = spark.createDataFrame([(1, bytearray(mpeg.carry(mpeg.padded(b"abc")))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    got = {r["id"]: r["mpeg"] for r in mpeg.parse_column(df).collect()}
    assert (got[1]["frames"], got[1]["samples"], got[1]["vbr"]) == (1, 1152, "Info") and got[2]["frames"] == got[3]["frames"] == 0


# The pipeline


def test_pipeline(spark):
    from tests.conftest import SMALL

    docs = common.documents(spark, SMALL)
    before, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SMALL))
        if name != "packing":
            assert docs.columns == names and 0 < docs.count() <= before
            before = docs.count()
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).drop("sequence_id").collect())) == sorted(map(str, docs.drop("sequence_id").collect()))


def test_pipeline_takes_odd_rows(spark, docs, odd):
    from tests.conftest import SMALL

    frame = docs(list(odd))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (frame, frame.limit(0)):
            assert stage(spark, rows, SMALL).count() >= 0, name


def test_every_operator_has_a_query():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
