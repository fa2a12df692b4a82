"""Token ids, packing and id files against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import idfiles, packing
from threadlens.llm.tokens import Encoder
from threadlens.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    list("ab'sT1 .,\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b éß你🙂_-<|>") + ["<|endoftext|>", "  ", "'ll", " é "]),
    max_size=40).map("".join), max_size=4))
def test_parts_give_the_same_ids(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def docs_of(spark, which):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if which == "table" else odd_documents(spark)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_packing_holds_every_id_once(spark, which):
    docs = docs_of(spark, which).repartition(5)
    rows = packing.pack_ids(docs, PATH, open_windows=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for d in docs.collect():
        want[d["doc_id"]].append(ids_of(d["text"]) + [1])
    assert by_doc.keys() == want.keys()
    for k, pieces in by_doc.items():
        if len(want[k]) == 1:
            pieces.sort(key=lambda r: r["start"])
            at = 0
            for r in pieces:
                assert r["start"] == at and r["doc_tokens"] == len(want[k][0])
                at += r["length"]
            assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == want[k][0]
        else:
            assert sum(r["length"] for r in pieces) == sum(map(len, want[k]))
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
    assert max(lengths) <= 2048 and sum(n != 2048 for n in lengths) <= 1


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_FAN_IN", 3)
    docs = docs_of(spark, "table").select("doc_id", "text").repartition(11)
    got = packing.pack_ids(docs, PATH, length=512, open_windows=2)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert per.where("n <> m or n > 512").count() == 0 and per.where("n < 512").count() <= 1
    assert got.agg(F.sum("length")).first()[0] == sum(len(ids_of(r["text"])) + 1 for r in docs.collect())


def test_best_fit_takes_the_least_room():
    w = packing.Windows(100, 3)
    for n in (60, 70, 50):
        assert list(w.place((n, 0, n, bytes(4 * n)))) == []
    assert [room for room, _ in w.free] == [30, 40, 50]
    assert list(w.place((1, 0, 35, bytes(140)))) == []      # the window with 40 left
    assert [room for room, _ in w.free] == [5, 30, 50]
    full = list(w.place((2, 0, 80, bytes(320))))            # fits none: tops up the fullest
    assert [sum(len(p[3]) // 4 for p in x) for x in full] == [100]


def test_packing_nothing(spark):
    assert packing.pack_ids(empty_documents(spark), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.data())
def test_bits_round_trip(width, n, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), min_size=n, max_size=n)), np.uint32)
    packed = idfiles.pack(ids, width)
    assert len(packed) == -(-n // 8) * width
    assert (idfiles.unpack(packed, width, 0, n) == ids).all()
    lo = data.draw(st.integers(0, n))
    hi = data.draw(st.integers(lo, n))
    assert (idfiles.unpack(packed, width, lo, hi - lo) == ids[lo:hi]).all()


@pytest.mark.parametrize("which", ["table", "odd"])
def test_id_files_round_trip(spark, which):
    docs = docs_of(spark, which)
    path = scratch_path(spark, "test-ids")
    idfiles.write_ids(docs, path, PATH, block_ids=1000)
    got = idfiles.read_documents(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == docs.count()
    at, stream, crcs = 0, [], defaultdict(list)
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
        stream += np.frombuffer(r["ids"], "<u4").tolist()
        crcs[r["doc_id"]].append(zlib.crc32(r["ids"]))
    want = defaultdict(list)
    for d in docs.collect():
        want[d["doc_id"]].append(zlib.crc32(np.array(ids_of(d["text"]) + [0], "<u4").tobytes()))
    assert {k: sorted(v) for k, v in crcs.items()} == {k: sorted(v) for k, v in want.items()}
    lo, n = at // 3, min(2500, at // 2)
    parts = idfiles.read_range(spark, path, lo, n).orderBy("start").collect()
    assert parts[0]["start"] == lo
    assert np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() == stream[lo:lo + n]


def test_id_files_of_nothing(spark):
    path = scratch_path(spark, "test-ids")
    idfiles.write_ids(empty_documents(spark), path, PATH)
    assert idfiles.read_documents(spark, path).count() == 0
