"""Queries as registered, over the smallest tables, against plain recomputation."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from citeweave.llm import queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, documents):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = queries.op1_bpe(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        ids = plain.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(documents[r.doc_id].encode()).hexdigest())


def test_op2(spark, documents):
    rows = queries.op2_shards(spark, SF).collect()
    assert len(rows) == len(documents)
    loads = [0] * 24
    for r in rows:
        text = documents[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
        loads[r.shard] += r["size"]
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    # A text of more than a shard's share can't be cut; else shards are even.
    assert max(loads) - min(loads) <= max(max(len(t.encode()) for t in documents.values()), 0.01 * sum(loads) / 24)


def test_op5(spark, documents):
    kinds = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"assign": 8, "access": 16, "hex": 32}
    for r in queries.op5_secrets(spark, SF).collect():
        spans = []
        for order, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, documents[r.doc_id], re.ASCII):
                if len(m[1] if kind == "assign" else m[0]) >= least[kind]:
                    spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        said = [s for *_, s in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in said) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(",")) | {""}


def test_op6(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in documents.items()}
    rows = queries.op6_packing(spark, SF).collect()
    held, places = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == held[r.doc_id] and 0 < r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        held[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == {d: len(x) for d, x in ids.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_op8(spark, documents):
    feature = {}
    for r in queries.op8_tiff(spark, SF).collect():
        raw = documents[r.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert feature.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
