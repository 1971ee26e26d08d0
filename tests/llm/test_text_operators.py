"""Formatting, archives, packing and extraction: round trips, brute force and edge cases."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import chat, html, packing, warc

TURNS = "conv_id long, turn long, role string, text string, formatted string"
HARD = "</s>[INST] ok [/INST]<|end|> \\[\\INST] <\\|next|> <|start|>user<|body|>"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", HARD, "x"), (1, 1, "assistant", "a\nb😀", "x"), (1, 2, "assistant", HARD, "x"), (1, 3, None, None, None), (2, 5, "assistant", "", "x"), (None, 0, "user", "z", "x"), (3, None, "user", "late", ""), (3, 0, "user", "same", ""), (3, 0, "user", "same", "")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS)).persist()
    back = {r["conv_id"]: r["t"] for r in out.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in back[1]] == [("user", HARD), ("assistant", "a\nb😀"), ("assistant", HARD), ("", "")]
    assert [t["text"] for t in back[3]] == ["late", "same", "same"] and back[None][0]["text"] == "z"
    one = chat.conversation_digests(out).where("conv_id = 1").first()
    assert one["loss_sha256"] == hashlib.sha256(("a\nb😀" + HARD).encode()).hexdigest() and one["loss_chars"] == len("a\nb😀" + HARD) and one["n_turns"] == 4
    told = f"user\n{HARD}\nassistant\na\nb😀\nassistant\n{HARD}\n\n\n"
    assert one["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    formatted = out.where("conv_id = 1").first()["formatted"]
    # adjacent turns of a role share a block, and no text holds a control string of its own
    assert formatted.count(chat.START) == 3 and formatted.count(chat.NEXT) == 1 and "[INST]" not in formatted and "</s>" not in formatted
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations(spark):
    """One text of half a million characters, most of them control strings, and one conversation of 5,000 turns, some alike."""
    long = HARD * 8000
    turns = [(2, i, "user" if i % 3 else "assistant", f"turn {i % 7} </s>", "") for i in range(5000)]
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "tell", ""), (1, 1, "assistant", long, ""), *turns], TURNS)).persist()
    back = {r["conv_id"]: r["t"] for r in out.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in back[1]] == [("user", "tell"), ("assistant", long)] and [tuple(t) for t in back[2]] == [t[2:4] for t in turns]
    got = {r["conv_id"]: r for r in chat.conversation_digests(out).collect()}
    learnt = "".join(t[3] for t in turns if t[2] == "assistant")
    for conv, n, text in ((1, 2, long), (2, 5000, learnt)):
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (n, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_chat_uses_spark_alone(spark):
    plan = chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip(spark):
    long = "äé😀\r\n\r\nWARC/1.1" * 9000
    rows = [(1, "http://a/\r\nX: y", "<p>x</p>", "d"), (5, None, "<p>x</p>", "d"), (2, "u", None, "d"), (3, "u", long, "d"), (4, "u", "\r\n0\r\n\r\n", "d"), (None, "u", "alone", "d"), (9, "u", "", "d"), (7, "u", "twice", "d"), (7, "u", "twice", "d"), (-6, "u", long[1:], "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = warc.new_path(spark, "warc-test")
    warc.write_archives(warc.decide_records(pages), path, segment_bytes=2000, chunk_bytes=700, records_per_file=3)
    read = warc.read_archives(spark, path).persist()
    assert sorted(bytes(r["payload"]) for r in read.where("kind = 'response'").collect()) == sorted(x.encode() for x in ("<p>x</p>", long, "\r\n0\r\n\r\n", "alone", "", "twice", "twice", long[1:]))
    got = {r["page_id"]: r for r in warc.page_summary(read).collect()}
    want = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"], got[1]["payload_digest"]) == ("revisit", 5, 8, want("<p>x</p>"))
    assert got[5]["record_type"] == "response" and got[2]["refers_to"] == 9 and got[9]["payload_bytes"] == 0 and got[3]["payload_digest"] == want(long) and got[-6]["payload_digest"] == want(long[1:])
    assert got[None]["record_type"] == "response" and len(read.collect()) == 10
    none = warc.page_summary(warc.archive_round_trip(pages.limit(0)))
    assert none.count() == 0
    assert warc.page_summary(warc.archive_round_trip(pages, min_bytes=100)).where("record_type = 'revisit'").count() == 0


def test_warc_records_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    for data in (gzip.compress(record) + gzip.compress(record), record + record):
        assert [block for _, block in warc.split_records(data)] == [b"ab\r\n"] * 2
    for broken in (record[:-3], b"x" + record, record.replace(b"Content-Length: 4", b"X: 4")):
        with pytest.raises(ValueError):
            list(warc.split_records(broken))
    long = record.replace(b"Content-Length: 4\r\n\r\nab\r\n", b"Content-Length: 10000000\r\n\r\n" + b"abcde" * 2000000)
    assert [len(block) for _, block in warc.split_records(gzip.compress(long * 2))] == [10000000] * 2
    fields = warc.record_fields(next(warc.split_records(record))[0])
    with pytest.raises(ValueError, match="another digest"):
        warc._decoded(fields | {"digest": "A" * 32}, b"HTTP/1.1 200 OK\r\n\r\nx")
    with pytest.raises(ValueError):
        warc.decode_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc")


def test_missing_segment_fails(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 100)], "page_id long, url string, html string")
    path = warc.new_path(spark, "warc-test")
    warc.write_archives(warc.decide_records(pages), path, segment_bytes=60, records_per_file=1)
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    some = spark.read.format("binaryFile").load(files[:-1]).select("content")
    with pytest.raises(Exception, match="not whole"):
        warc.join_segments(some.mapInArrow(warc._segments, warc._SEGMENT_DDL)).collect()


def test_warc_with_many_repeated_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i % 40}") for i in range(400)], "page_id long, url string, html string")
    few = {(r["page_id"], r["refers_to"]) for r in warc.page_summary(warc.archive_round_trip(pages)).collect()}
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    many = {(r["page_id"], r["refers_to"]) for r in warc.page_summary(warc.archive_round_trip(pages)).collect()}
    assert few == many == {(i, None if i >= 360 else 360 + i % 40) for i in range(400)}


TEXTS = ["Hello world  two\n three", "it's  we'll \t tabs\x1c x", "ÄÖ 中文 😀 é", "", " leading and trailing ", "a\n b\r\n\r\n c", "x" * 300, "<|endoftext|> no", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext|>", " a  b", "  a", "a \x1f b \u3000 c", "x\n", "w\n y\n", "word \n", " ", "\n ", "1234 5,6 !!! ...", " nbsp  em \u0085 nel"]


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder(packing.public_vocabulary())
    rng = np.random.default_rng(2)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "\t", "\x1c", "a", "Word", "it's", "12", "!?", "é", "中", "\u00a0", "<|endoftext|>", "<|endof"], int(n))) for n in rng.integers(1, 25, 500)]
    long = " ".join(rng.choice(["alpha", "beta\n\n", "gamma,", "δ", "<|endoftext|>"], 40000))
    for text in [*TEXTS, *mixed, *mixed[:50], long]:
        assert np.frombuffer(fast(text), dtype="<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 200, 150)] + TEXTS + [None]
    docs = spark.createDataFrame([(i % 155, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    pieces = packing.pack_documents(docs, sequence_tokens=64).persist()
    rows = pieces.collect()
    encode = packing.Encoder(packing.public_vocabulary())
    want = sorted(encode(t or "") + b"\1\0\0\0" for t in texts)
    assert sorted(bytes(r["ids"]) for r in rows if r["doc_tokens"] == r["length"]) == [w for w in want if len(w) <= 256]
    assert sum(r["length"] for r in rows) == sum(len(w) // 4 for w in want)
    seen = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seen.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seen.values()) <= 64 and sorted(seen) == list(range(len(seen)))
    assert sum(seen.values()) / (64 * len(seen)) > 0.95
    assert packing.pack_documents(docs.limit(0)).count() == 0
    # pieces alike in id and start, with columns named like helpers
    odd = spark.createDataFrame([(1, 0, 5, i % 3, {"k": 1}, "x") for i in range(40)], "doc_id long, start long, length long, bucket int, slot map<string,int>, `within` string")
    placed = packing.place_pieces(odd, 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 40 and {r["offset"] for r in placed} == {0, 5, 10} and {r["bucket"] for r in placed} == {0, 1, 2}
    long = packing.packed_digests(spark.createDataFrame([(7, "many words " * 30000), (7, "many words " * 30000)], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in long) == 2 * long[0]["doc_tokens"] and len({(r["sequence_id"], r["offset"]) for r in long}) == len(long)
    digest = packing.packed_digests(docs.where("doc_id = 154")).first()
    assert digest["ids_crc32"] == zlib.crc32(encode(docs.where("doc_id = 154").first()["text"] or "") + b"\1\0\0\0")


def plain_packs(histogram, capacity):
    """Lengths of the packs when every piece, longest first, goes to the shortest pack there is, or to a new one."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
            if shortest is not None and packs[shortest] + length <= capacity:
                packs[shortest] += length
            else:
                packs.append(length)
    return sorted(packs)


_random = np.random.default_rng(11)
RANDOM = [{int(x): int(n) for x, n in zip(_random.integers(1, 65, 20), _random.integers(1, 30, 20))} for _ in range(30)]


@pytest.mark.parametrize("histogram", [{64: 5}, {1: 130}, {40: 3, 24: 2, 10: 7}, {33: 4, 31: 9, 2: 3}, {}, *RANDOM])
def test_shortest_pack_first(histogram):
    used, counts = {}, {}
    for length, rank, n, offset, first in packing.shortest_pack_first(histogram, 64):
        assert rank == counts.get(length, 0)
        counts[length] = rank + n
        for s in range(first, first + n):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    assert counts == histogram and all(v <= 64 for v in used.values())
    assert sorted(used.values()) == plain_packs(histogram, 64) and sorted(used) == list(range(len(used)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-header">
<header><a href=/>Home</a></header><nav><ul><li><a href=a>Menu</a></li></ul></nav><div class="cookie-notice">We use, many, cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First,
 part<b>ial<br>line<p>Second &lt;x&gt;</p><div class=ad>Buy, now, cheap</div><form><input>Sign up</form><ul><li>item one</li></ul>
<section id="comments"><p>I, disagree, with, all, of, this</p></section></article></main><aside>Side, bar</aside><footer>&copy; foot</footer>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Title & more First, partial line Second <x> item one"
    assert html.main_text("<div><div id=content><h1>T</h1><p>Alpha<b>bet</b>, one.</p></div><div class=sidebar><p>no, no</p></div></div>") == "T Alphabet, one."
    assert [html.main_text(x) for x in (None, "", "<script>x</script>", "plain", "<p>a<p>b")] == ["", "", "", "plain", "a b"]
    assert html.main_text("<div>" * 20000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "u", "<p>x", "x")], "page_id long, url string, html string, text string")
    assert {(r["page_id"], r["n_chars"]) for r in html.extract_pages(df).collect()} == {(1, len(html.main_text(PAGE))), (1, 0), (None, 1)}
    assert html.extract_pages(df.limit(0)).count() == 0
