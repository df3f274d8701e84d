"""Token ids, packing and token files against the tokenizer library itself."""

import io
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimwise.llm import arrow, packing, registry, token_files, tokens

from .conftest import CLASH, SF, random_docs

ODD = ["", "a<|endoftext|>b c", "it's  don't x y é ́z ...,. é. É, 12.5, İI. ǅ, ", " \t", "ﬁ.", "ÄÖß, Ünd. ÿŸ Šš. µª ſ Ĳ", "x" * 3000, "a\u00a0b\u2003c\u0085d", "日本語。 текст, Σίσυφος."]


def ids_of(text):
    return Tokenizer.from_file(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_the_library():
    texts = ODD + [t for _, t in random_docs(60, 1)]
    tk = tokens.WordTokenizer(Tokenizer.from_file(tokens.default_tokenizer()))
    for _ in range(2):  # the second time from the table
        ids, n = tk.encode(*arrow.buffers(pa.array(texts)))
        assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == [2]
        assert ids.tolist() == [i for t in texts for i in ids_of(t)]


def test_table_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 50)
    tk = tokens.WordTokenizer(Tokenizer.from_file(tokens.default_tokenizer()))
    for _, t in random_docs(40, 2):
        ids, _ = tk.encode(*arrow.buffers(pa.array([t or "", "again and again"])))
        assert ids.tolist() == ids_of(t) + ids_of("again and again")


def other_tokenizers(tmp_path):
    """Files whose words cannot be encoded one by one, and the default one."""
    import public_tokenizers

    default = json.loads(open(tokens.default_tokenizer(), encoding="utf-8").read())
    out = {"default": tokens.default_tokenizer(), "bytes": public_tokenizers.path("byte_bpe_50k.json")}
    for name, change in {
        "cased": {"normalizer": None},
        "added": {"added_tokens": default["added_tokens"] + [{"id": 49408, "content": "the", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]},
        "padded": {"truncation": {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}, "padding": {"strategy": {"Fixed": 8}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "x"}},
    }.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(default | change), encoding="utf-8")
        out[name] = str(path)
    return out


def test_other_tokenizers_give_their_own_ids(tmp_path):
    texts = ["The other the. bathe", "Two  spaces\n and\tCASE", "b"] + ODD + [t or "" for _, t in random_docs(30, 7)]
    kinds = {}
    for name, path in other_tokenizers(tmp_path).items():
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        for end in (2, None):
            tk = tokens.tokenizer(path, end)
            ids, n = tk.encode(*arrow.buffers(pa.array(texts)))
            want = [library.encode(t, add_special_tokens=False).ids + [2] * (end is not None) for t in texts]
            assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want], name
            assert tk.encode(*arrow.buffers(pa.array([], pa.string())))[0].tolist() == []
        kinds[name] = type(tk).__name__
    assert [k for k, v in kinds.items() if v == "WordTokenizer"] == ["default", "padded"]


def test_packing_and_files_with_another_tokenizer(spark, make_docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = [(k, t) for k, t in random_docs(20, 8) if k is not None]
    want = {k: crc(library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in docs}
    rows = token_files.read_token_files(token_files.write_token_files(make_docs(docs), tokenizer=path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == want
    pieces = packing.pack_documents(make_docs(docs), tokenizer=path, with_ids=True).orderBy("doc_id", "start").collect()
    ids = {}
    for r in pieces:
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert {k: crc(v) for k, v in ids.items()} == want


def check_packing(rows, texts, capacity=4096):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    for k, t in texts:
        ids, at = ids_of(t), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    return len(seqs)


def test_packing(spark, make_docs):
    texts = random_docs(80, 3) + [(900, "word, " * 9000)]
    rows = packing.pack_documents(make_docs(texts, CLASH)).collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows, texts) <= -(-total // 4096) + 1


def test_packing_small_groups(spark, make_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_WINDOWS", 2)
    texts = random_docs(60, 4)
    rows = packing.pack_documents(make_docs(texts), capacity=64, piece=16).collect()
    check_packing(rows, texts, 64)


def test_packing_repeated_rows_null_keys_and_empty(spark, make_docs):
    rows = packing.pack_documents(make_docs([(7, "a b c")] * 5 + [(None, "x")])).collect()
    assert sorted((r.doc_id is None, r.start) for r in rows) == [(False, 0)] * 5 + [(True, 0)]
    assert sorted(r.offset for r in rows)[0] == 0 and sum(r.length for r in rows) == 5 * 4 + 2
    assert packing.pack_documents(make_docs([])).count() == 0


def test_sequences_hold_the_ids(spark, make_docs):
    texts = random_docs(30, 5)
    packed = packing.pack_documents(make_docs(texts), with_ids=True)
    got = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in got) == sum(len(ids_of(t)) for _, t in texts)
    assert all(sum(r.lengths) == len(r.ids) for r in got)


@pytest.mark.parametrize("sizes,k", [([8, 7, 6, 5, 4], 2), ([5] * 9, 3), ([1], 4), (list(range(1, 60)), 7)])
def test_differencing(sizes, k):
    window, most = packing.differencing(np.array(sizes), k)
    sums = np.bincount(window, np.array(sizes), k)
    assert sums.max() == most and sums.sum() == sum(sizes) and window.max() < k
    assert most - sums.min() <= max(sizes)


def test_windows_rise_until_all_fit():
    assert len(set(packing.windows(np.array([7, 7, 7]), 10).tolist())) == 3


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32, 2**59, 2**64 - 1])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    x = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
    x[rng.random(n) < 0.3] = 0
    words, per_block = token_files.encode_blocks(x)
    assert (token_files.decode_blocks(words, per_block, n) == x).all()
    if high <= 50_000 and n > 1000:
        assert len(words) * 8 < 4 * n


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "READ_BLOCKS", 2)
    sink, rng = io.BytesIO(), np.random.default_rng(0)
    w = token_files.ShardWriter(sink)
    docs = [rng.integers(0, 49_000, int(rng.integers(0, 3000))) for _ in range(40)] + [np.zeros(0, int)] * 2
    for k in range(0, len(docs), 5):
        some = docs[k : k + 5]
        w.add(np.arange(k, k + len(some)), np.zeros(len(some)), np.concatenate(some), np.array([len(x) for x in some]))
    w.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    got = []
    for keys, nulls, ids, n in token_files.read_shard(Source(sink.getvalue())):
        assert not nulls.any()
        got += list(zip(keys.tolist(), np.split(ids, np.cumsum(n)[:-1])))
    assert [k for k, _ in got] == list(range(len(docs)))
    assert all((a == b).all() for (_, a), b in zip(got, docs))
    with pytest.raises(ValueError):
        list(token_files.read_shard(Source(sink.getvalue()[:-9])))


def test_token_files(spark, make_docs):
    texts = random_docs(60, 6)[::-1] + [(900, "word, " * 9000)]
    rows = token_files.read_token_files(token_files.write_token_files(make_docs(texts, CLASH))).collect()
    at = 0
    for (k, t), r in zip(sorted(texts), sorted(rows, key=lambda r: r.doc_id)):
        ids = ids_of(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files_null_and_repeated_keys_and_empty(spark, make_docs):
    made = token_files.write_token_files(make_docs([(3, "b"), (None, "a"), (3, "b"), (1, None)]))
    rows = sorted(token_files.read_token_files(made).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3] and [r.n_tokens for r in rows] == [2, 1, 2, 2]
    assert token_files.read_token_files(token_files.write_token_files(make_docs([]))).count() == 0


def test_query_op1_and_op6(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(registry.op1_packing(spark, SF).collect(), texts)
    rows = {r.doc_id: r for r in registry.op6_token_files(spark, SF).collect()}
    at = 0
    for k, t in sorted(texts):
        ids = ids_of(t)
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
