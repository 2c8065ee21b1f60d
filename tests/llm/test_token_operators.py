import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlens.llm import pieces as pieces_module
from eventlens.llm.packing import CAPACITY, assign_sequences, pack_documents, pack_histogram, sequences
from eventlens.llm.pieces import PieceCodec, codec, piece_digests, piece_ids, piece_texts
from eventlens.llm.queries import QUERIES
from eventlens.llm.tokens import PieceCache, TextEncoder, tokenizer_file
from eventlens.llm.units import buffers
from eventlens.llm.wavelet import WaveletMatrix, stored_digests, token_lookup, write_token_shards

from .data import AWKWARD, SF, documents

BYTE, WORD, PIECE = map(tokenizer_file, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library_ids(path, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefgé ▁ \n\t中🙂012.,-'ing the an\xa0<|>") for _ in range(pick.randint(0, 90))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_cached_encoding_equals_library(path, spaced):
    own = TextEncoder(path, spaced, folded=not spaced)
    texts = [t or "" for t in AWKWARD] + random_texts(400) + ["Foo,bar.\nBaz\n\nQux <|endoftext|>,x FOO*** fOo|", "ÀÉ,ß.Ü\nx don't,it's"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == library_ids(path, texts)


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_unit_table_equals_library(path, spaced):
    own = TextEncoder(path, spaced, folded=not spaced)
    pick = random.Random(8)
    plain = ["".join(pick.choice("abcABCéÉßÿÑ  .,\n19#*-(x)the ") for _ in range(pick.randint(0, 80))) for _ in range(600)]
    words = [" ".join(pick.choice(["Foo", "élan", "12", "a1b2", "x,", "(y)", "ÀB.", "z\nw", "--"]) for _ in range(9)) for _ in range(200)]
    texts = pa.array([t or "" for t in AWKWARD] + plain + words + random_texts(200), pa.large_string())
    expect = library_ids(path, texts.to_pylist())
    for part in (texts, texts.slice(3, 500), texts.slice(300, 1)):
        first = 0 if part is texts else 3 if len(part) == 500 else 300
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_array(part)] == expect[first : first + len(part)]
    data, start = buffers(texts)
    assert own.units.plain(data, start).sum() > 150


def test_cache_drops_old_pieces_but_stays_right():
    cache = PieceCache(lambda ws: [w.encode() for w in ws], size=3)
    for words in (["a", "b", "c", "d"], ["a", "e"], ["f", "g", "h"], ["a"]):
        held = cache.prepare(set(words))
        assert all(held[w] == w.encode() for w in words)
        assert len(cache.new) <= 7


def test_histogram_packing_places_every_piece_once():
    pick = random.Random(1)
    counts = Counter(pick.randint(1, CAPACITY) for _ in range(5000))
    counts[700] += 2000
    found = Counter()
    for lengths, n in pack_histogram(dict(counts)):
        assert sum(lengths) <= CAPACITY
        for x in lengths:
            found[x] += n
    assert found == counts
    assert pack_histogram({}) == [] and pack_histogram({5: 0}) == []
    assert pack_histogram({600: 3, 400: 3}) == [((600, 400), 3)]


def check_packing(rows, docs):
    expect = {d.doc_id: ids + [0] for d, ids in zip(docs, library_ids(BYTE, [d.text for d in docs]), strict=True)}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    assert set(pieces) == set(expect)
    for doc, parts in pieces.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(expect[doc])
            assert p.ids_crc32 == crc(expect[doc][at : at + p.length])
            at += p.length
        assert at == len(expect[doc])
    assert set(places) == set(range(len(places)))
    for parts in places.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= CAPACITY
    return places


def test_packing_query_is_whole_and_dense(spark):
    rows = QUERIES["op2_shortest_pack_first"](spark, SF).collect()
    places = check_packing(rows, spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sum(r.length for r in rows) > 0.98 * CAPACITY * len(places)


def test_packing_awkward_repeated_and_empty(spark):
    docs = documents(spark, AWKWARD + ["same text here"] * 50).withColumn("length", F.lit("clash"))
    check_packing(pack_documents(docs, BYTE).collect(), docs.collect())
    assert pack_documents(docs.limit(0), BYTE).count() == 0
    twice = docs.limit(3).union(docs.limit(3)).withColumn("text", F.lit("twin"))
    places = {(r.sequence_id, r.offset) for r in pack_documents(twice, BYTE).collect()}
    assert len(places) == 6


def test_hot_length_is_ranked_over_blocks(spark):
    pieces = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"))
    rows = assign_sequences(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 9000 and len({r.sequence_id for r in rows}) == 3000


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, ["a b c", "word " * 700, None, "x"])
    ids = dict(enumerate(library_ids(BYTE, [d.text for d in docs.collect()])))
    for s in sequences(pack_documents(docs, BYTE, with_ids=True)).collect():
        assert len(s.ids) in (CAPACITY, s.n_tokens) and (len(s.ids) == CAPACITY or s.n_tokens & (s.n_tokens - 1) == 0)
        for p in s.documents:
            part = s.ids[p.offset : p.offset + p.length]
            whole = ids[p.doc_id] + [0]
            assert any(whole[i : i + len(part)] == part for i in range(len(whole)))


def piece_expect(text):
    library = codec(PIECE).merges.library
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_agenda_by_heap_and_in_steps_equal_the_library():
    own = codec(PIECE).merges
    segments = sorted({"▁" + s for t in random_texts(200, 9) for s in t.replace("▁", "").split(" ") if s})
    theirs = [tuple(own.library.encode(s[1:])) for s in segments]
    assert own.together(segments) == theirs
    assert [own.by_heap(s) for s in segments] == theirs


def test_piece_codec_keeps_segments_as_ranges_and_forgets_in_time(monkeypatch):
    monkeypatch.setattr(pieces_module, "_CACHED", 40)
    own = PieceCodec(PIECE)
    texts = [t or "" for t in AWKWARD] + random_texts(120, 4)
    for part in (texts[:50], texts[50:], texts[:50], ["the cat " * 30, "", " ", "▁▁ ▁", "🙂🙂 é"]):
        ids, lo, hi, replaced = own.encode(pa.array(part, pa.large_string()))
        assert ids.dtype == np.int32 and not replaced.any()
        theirs = own.merges.library.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(lo, hi, strict=True)] == theirs
        assert own.decode(ids, lo, hi) == [own.merges.library.decode(x).encode() for x in theirs]
        assert own.digits_of(ids, lo, hi) == [",".join(map(str, x)).encode() for x in theirs]
        assert len(own.rows) == len(own.starts) == len(own.again)
    own.encode(pa.array(["a"], pa.large_string()))
    assert len(own.rows) <= 41


def test_piece_codec_takes_the_library_where_it_differs():
    own = PieceCodec(PIECE)
    flat = own.merges.flat
    own.merges.flat = lambda segments: flat([s if s != "▁cat" else "▁dog" for s in segments])
    ids, lo, hi, replaced = own.encode(pa.array(["the cat sat", "a dog", "cat"], pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(lo, hi, strict=True)] == own.merges.library.encode(["the cat sat", "a dog", "cat"])
    assert replaced.tolist() == [1, 0, 1]


def test_piece_digests_equal_library(spark):
    docs = documents(spark, AWKWARD + random_texts(150) + ["ab " * 40000])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(docs, PIECE).collect()}
    assert got == {r.doc_id: piece_expect(r.text) for r in docs.collect()}
    assert piece_digests(docs.limit(0), PIECE).count() == 0


def test_piece_query_and_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_merge_agenda"](spark, SF).collect()}
    assert got == {r.doc_id: piece_expect(r.text) for r in docs.collect()}
    back = docs.select("text", piece_texts(PIECE)(piece_ids(PIECE)("text")).alias("back"))
    assert back.where("text <> back").count() == 0


def shard_expect(docs):
    out, start = {}, 0
    rows = sorted(docs, key=lambda r: r.doc_id)
    for r, ids in zip(rows, library_ids(WORD, [r.text for r in rows]), strict=True):
        out[r.doc_id] = (start, len(ids) + 1, crc(ids + [1]))
        start += len(ids) + 1
    return out


def test_shard_query_equals_library(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_wavelet_shards"](spark, SF).collect()}
    assert got == shard_expect(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_small_shards_awkward_texts_and_lookup(spark, tmp_path):
    docs = documents(spark, AWKWARD + random_texts(60)).withColumn("part", F.lit("clash"))
    out = str(tmp_path / "shards")
    write_token_shards(docs, WORD, out, shard_tokens=64)
    stored = spark.read.parquet(out)
    assert stored.count() > 10
    assert len(list((tmp_path / "shards").glob("part-*"))) == stored.count()  # one file per shard
    from eventlens.llm.wavelet import read_token_shards

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_shards(spark, out).collect()}
    rows = docs.collect()
    assert got == shard_expect(rows)
    ids = dict(zip([r.doc_id for r in rows], library_ids(WORD, [r.text for r in rows]), strict=True))
    token = Counter(t for x in ids.values() for t in x).most_common(1)[0][0]
    expect = {(d, i) for d, x in ids.items() for i, t in enumerate(x) if t == token}
    assert {(r.doc_id, r.position) for r in token_lookup(stored, token).collect()} == expect


def test_empty_null_and_repeated_ids_in_shards(spark):
    docs = documents(spark, ["b", "a", None])
    assert stored_digests(docs.limit(0), WORD).count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, 7))
    rows = stored_digests(odd, WORD).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (7, 2, 1), (7, 3, 2)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_wavelet_matrix_rank_select(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.5, n).clip(1, 49000).astype(np.uint32)
    data = WaveletMatrix.build(ids, 16).dump([None, 5], [n // 2, n - n // 2])
    matrix, docs, lengths = WaveletMatrix.load(data)
    assert docs == [None, 5] and lengths.tolist() == [n // 2, n - n // 2]
    assert np.array_equal(matrix.tokens(), ids) and np.array_equal(matrix.access(np.arange(n)), ids)
    for token in {0, 1, 2, 77777, *ids[:5].tolist()}:
        assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert matrix.count(token, n // 3, n) == int((ids[n // 3 :] == token).sum())


def test_wavelet_reads_inflate_only_what_they_touch():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 1 << 19).astype(np.uint32)
    data = WaveletMatrix.build(ids, 16).dump([1], [len(ids)])
    matrix, _, _ = WaveletMatrix.load(data)
    assert matrix.inflated == 0 and matrix.access([70_001]).tolist() == [ids[70_001]] and matrix.inflated <= 16
    assert matrix.count(int(ids[9])) == (ids == ids[9]).sum() and matrix.inflated < 0.5 * matrix._ready.size
    assert matrix.directory.nbytes < 0.07 * len(ids) * 2
    assert np.array_equal(matrix.tokens(), ids)
