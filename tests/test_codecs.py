"""Codecs, packing, sizes."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.engine import Collection
from quillgrid.functions.codecs import decode_delta_vb, decode_vb, decoded_deltas, encode_delta_vb, encode_vb, vb_hex, vb_size
from quillgrid.operators import frontpack, indexes, sizes


def test_known_bytes():
    assert [encode_vb(n).hex() for n in (0, 127, 128, 300, 16384)] == ["80", "ff", "0081", "2c82", "000081"]
    assert encode_delta_vb([200, 3, 5]).hex() == "83824381" and encode_delta_vb([]) == b"" and decode_vb(b"") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), unique=True))
def test_round_trip(ids):
    assert decode_delta_vb(encode_delta_vb(ids)) == sorted(ids)
    assert decode_vb(b"".join(map(encode_vb, ids))) == ids


def test_expressions_agree(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**32 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for r in df.select("n", vb_hex(F.col("n")).alias("h"), vb_size(F.col("n")).alias("s")).collect():
        assert r.h.lower() == encode_vb(r.n).hex() and r.s == len(encode_vb(r.n))
    coded = spark.createDataFrame([(bytearray(encode_delta_vb([3, 5, 200])),), (None,)], "b binary")
    assert [r.ids for r in coded.select(decoded_deltas(F.col("b")).alias("ids")).collect()] == [[3, 5, 200], None]


def test_blocks_join_to_the_whole_list(spark):
    rng = random.Random(4)
    ids = sorted(rng.sample(range(3000), 200))
    rows = spark.createDataFrame([("t", i) for i in ids], "term string, id long")
    parts = indexes.compressed_postings(indexes.posting_deltas(rows, block=256)).orderBy("block").collect()
    assert len(parts) > 5 and b"".join(bytes(p.data) for p in parts) == encode_delta_vb(ids)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abаб", min_size=1, max_size=6), max_size=40))
def test_packing_restores_terms(terms):
    rows = frontpack.pack(sorted(terms, key=lambda t: t.encode()))
    blob = b"".join(r[5] for r in rows)
    assert [frontpack.unpack(blob, *r[1:5]) for r in rows] == [r[0] for r in rows]
    assert len(blob) <= sum(len(t.encode()) for t in terms)


def test_packing_by_first_character_is_packing(spark):
    terms = [f"term{i:04}" for i in range(300)] + ["computer", "computing", "computational", "привіт", "при", "a"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((tuple(r) for r in frontpack.front_pack(df).collect()), key=lambda r: r[0].encode())
    assert [(t, a, b, c, d, bytes(s)) for t, a, b, c, d, s in got] == frontpack.pack(sorted(terms, key=lambda t: t.encode()))
    stats = sizes.packing_stats(frontpack.front_pack(df)).head()
    assert stats.packed_bytes < stats.original_bytes
    assert sizes.packing_stats(frontpack.front_pack(df.limit(0))).head().ratio == 1.0


def test_size_report_by_hand(spark):
    c = Collection(spark.createDataFrame([("d1", ["cat", "dog", "cat"]), ("d2", ["cat"])], "doc string, words array<string>"))
    got = {r.structure: r.bytes for r in c.size_report().collect()}
    costs = sizes.Costs()
    assert got["inverted"] == (3 + 48 + 4) + (3 + 48 + 2) + 4
    assert got["coordinate"] == 3 + 24 + (2 + 24 + 16) + (2 + 24 + 8) + 3 + 24 + (2 + 24 + 8) + 4
    assert got["matrix"] == 6 + 4 + 2 * 8
    assert got["compressed_inverted"] == (3 + 2) + (3 + 1) + 2 * (2 * 2 + 4)
    assert got["bigram"] == (7 + 24 + 2) + (7 + 24 + 2) + 4
    assert got["trigram"] == 6 * (24 + 3 + 48) + 6 * (24 + 3)
    assert got["rotation"] == 8 * (24 + 4 + 48 + 24 + 3)
    nodes = {"c", "ca", "cat", "a", "at", "t", "d", "do", "dog", "o", "og", "g"}
    assert got["suffix"] == costs.node + len(nodes) * (costs.node + costs.child + 24 + 3)
