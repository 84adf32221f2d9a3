"""Line dedup, WARC, media chunks, the classifier and the pipeline's stages against plain forms."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from corpusloom.llm import linededup, media, quality, warc


def test_lines(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(40):
        lines = [own(12), own(3)]
        if i % 2:
            lines.insert(1, f"Page {i} of 40 printed by the press office")  # a variable field
        if i % 3 == 0:
            lines.append(f"Contact us at {word()} desk for all the other questions")  # a rare token behind the leading ones
        if i < 9:
            lines.append("seen in nine texts only")
        rows.append((i, "\n".join(lines), "clash"))
    whole_copy = "the very same document everywhere\nwith its two lines here"
    rows += [(100 + k, whole_copy, None) for k in range(30)] + [(200, None, "x"), (201, "", "x"), (201, "\n\n", "x"), (None, "long " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")
    got = linededup.drop_recurring_lines(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "n_dropped", "n_lines"}
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 200}
    for i, text, _ in rows[:70]:
        left = [x for x in text.split("\n") if not x.startswith(("Page ", "Contact "))]
        assert by_id[i]["text"] == "\n".join(left) and by_id[i]["n_dropped"] == len(text.split("\n")) - len(left)
    assert Counter((r["text"] is None, r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] in (200, 201)) == Counter([(True, 0, 0), (False, 1, 0), (False, 3, 0)])
    assert linededup.drop_recurring_lines(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, small = "<p>" + "é" * 2000, "<p>tiny</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c", big + "!"), (4, "u", small), (5, None, small), (6, "u\r\nX: y", None), (7, "u", ""), (None, "u", big), (2, "http://b", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_warc(pages, str(tmp_path / "w"), segment_bytes=300)
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None, None if revisit else data))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.make_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert [p for _, _, p in warc.records(io.BytesIO(good + warc.EMPTY_MEMBER + good))] == [b"payload"] * 2
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(good[:-9])))
    other = warc.make_record(1, "u", b"payloae", hashlib.sha1(b"payload").hexdigest(), None, False)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(other)))


def test_foreign_archives(spark, tmp_path):
    """Records of another writer: no page ids, no digests, no HTTP block; a missing length is an error."""
    block = b"software: x\r\n"
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    page = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n")
    (tmp_path / "CC-MAIN-0.warc.gz").write_bytes(info + page)
    got = {r["record_type"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert (got["response"]["page_id"], got["response"]["url"], bytes(got["response"]["payload"])) == (None, "http://a", b"body")
    assert (got["warcinfo"]["payload_bytes"], got["warcinfo"]["payload_digest"]) == (len(block), hashlib.sha1(block).hexdigest())
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"))))


def test_media(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = noise(150_000)
    texts = [None, "", "a", "x" * 64, "é" * 33, "same", "same", shared, noise(9_000) + shared, shared + noise(5_000), "0" * 300_000, noise(70_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "same", "c")], "doc_id long, text string, feature string")
    got = media.media_round_trip(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        data = ((texts[r["doc_id"]] if r["doc_id"] is not None else "same") or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = media.wav_header(len(payload)) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    assert media.media_round_trip(docs.limit(0)).count() == 0
    store = media.store_payloads(docs)
    chunks, lists = spark.read.parquet(store.chunks), spark.read.parquet(store.manifest)
    assert chunks.count() == chunks.select("digest").distinct().count() < lists.selectExpr("explode(digests)").count()  # shared chunks are stored once
    pieces = {bytes(r["digest"]): zstandard.decompress(r["chunk"]) for r in chunks.collect()}
    whole = {hashlib.sha256(b"".join(pieces[bytes(d)] for d in r["digests"])).hexdigest(): r["copies"] for r in lists.collect()}
    assert whole.keys() == {r["media_sha256"] for r in got} and sum(whole.values()) == len(texts) + 1  # the media itself lies in the store
    assert all(media.is_media(b"".join(pieces[bytes(d)] for d in r["digests"])) for r in lists.collect())


def test_gear_cuts_by_content():
    data = np.frombuffer(random.Random(3).randbytes(400_000), dtype=np.uint8)
    table = media.gear()
    h, want = 0, []
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        if h >> (32 - 14) == 0:
            want.append(i + 1)
    assert [p for p in media.cut_places(data, table).tolist() if p > media.WINDOW] == [p for p in want if p > media.WINDOW]
    ends = media.chunk_ends(len(data), media.cut_places(data, table))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST


def test_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model).withColumn("held", quality.held_out(docs["doc_id"])).join(labels, "doc_id").filter("held").select("score", "quality").collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    assert right / len(scored) > 0.97
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.filter(quality.held_out(docs["doc_id"])).select("doc_id").limit(50).collect())


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (3, "x " * 50_000, "a"), (3, "x y", "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    assert [r["score"] for r in quality.score_quality(docs, model).collect()] == [0.5] * 4
    again = quality.fit_quality(docs.limit(0), none.limit(0))
    assert quality.score_quality(docs.limit(0), again).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out.cache()
    last = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() > 0
    texts = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert {r["decoded_sha256"] for r in last} == texts
