import random
import zlib

import numpy as np
import pytest

from lakemill.llm.huffman import canonical, code_lengths, pack_bits, read_ids, round_trip, unpack_bits, write_ids
from lakemill.llm.store import fresh_path
from lakemill.llm.token_counts import count_tokens
from lakemill.llm.tokens import Encoder, public_path

RND = random.Random(3)
ODD = ["", "  \n\t a", "It's <|endoftext|> here", "<|startoftext|>x", "ΑΣ ΟΔΟΣ", "école É", "日本語 text", "\x00\x1f​", "12 345,6", "ÇÀ ñ ß ß's we'll", "İstanbul", "a" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    own = Encoder(public_path(name))
    assert own.fast
    texts = ODD + ["".join(RND.choices("abcdeÉñß ,.'s0123-|\n", k=RND.randrange(200))) for _ in range(500)]
    for t in texts:
        assert own.ids(t).tolist() == own.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_token_and_every_merge_is_encoded_as_by_the_library(name):
    import json

    own = Encoder(public_path(name))
    with open(public_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    plain = own.library.decode
    vocab = own.library.get_vocab()
    texts = [plain([k], skip_special_tokens=False) for k in vocab.values()]
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        texts.append(plain([vocab[a], vocab[b]], skip_special_tokens=False))
        texts.append(plain([vocab[b], vocab[a]], skip_special_tokens=False))
    for t, found in zip(texts, own.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(t).tolist() == found.ids, t


def test_shared_texts_travel_once_and_others_never(spark, monkeypatch):
    import lakemill.llm.token_counts as T

    made = {}

    def materialise(df, name, old=T.materialise):
        made[name] = old(df, name)
        return made[name]

    monkeypatch.setattr(T, "materialise", materialise)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)] + [(k, "the same") for k in range(300)], "doc_id long, text string").repartition(3)
    assert T.count_tokens(docs).count() == 500
    sent = [r.text for r in made["sifted"].where("text is not null").collect()]
    assert set(sent) == {"the same"} and len(sent) <= 3 and made["sifted"].where("text is null").count() == 200


def test_ids_beyond_sixteen_bits_are_refused(spark, tmp_path):
    import json

    path = tmp_path / "wide.json"
    vocab = {f"w{k}": k for k in range(5)} | {"big": 70_000, "[UNK]": 9}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}))
    docs = spark.createDataFrame([(1, "w1 big")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        round_trip(docs, tokenizer=str(path)).collect()
    assert count_tokens(docs, tokenizer=str(path)).first().n_tokens == 2


def test_counts_use_and_extend_the_cache(spark):
    rows = [(k, t, 7) for k, t in enumerate([*ODD, None, "copy"] + ["copy"] * 30)] + [(None, "copy", 0), (3, "other", 0), (3, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path, library = fresh_path(spark, "cache"), Encoder(public_path("byte_bpe_50k.json")).library

    def want(t):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        return len((t or "").encode()), n, n > 512

    expected = sorted((str(d), *want(t)) for d, t, _ in rows)
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, cache_path=path).collect()) == expected
        assert spark.read.parquet(path).count() == len({t or "" for _, t, _ in rows})
    more = spark.createDataFrame([(1, "copy"), (2, "new text")], "doc_id long, text string")
    assert count_tokens(more, cache_path=path).count() == 2
    assert spark.read.parquet(path).count() == len({t or "" for _, t, _ in rows}) + 1
    assert count_tokens(docs.limit(0)).collect() == []


def test_stored_counts_are_used(spark):
    from lakemill.llm.tokens import version_digest

    path = fresh_path(spark, "cache")
    spark.sql(f"select '{version_digest(public_path('byte_bpe_50k.json'))}' tokenizer, unhex(sha2('abc', 256)) digest, 99L n_tokens union all select 'other', unhex(sha2('abcd', 256)), 98L").write.parquet(path)
    docs = spark.createDataFrame([(1, "abc"), (2, "abcd")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, cache_path=path).collect()} == {1: 99, 2: 2}


def slow_lengths(counts, longest):
    coins = []
    for _ in range(longest):
        packs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(coins[::2], coins[1::2], strict=False)]
        coins = sorted([(c, [k]) for k, c in enumerate(counts) if c] + packs, key=lambda x: x[0])
    n = sum(1 for c in counts if c)
    out = [0] * len(counts)
    for _, ks in coins[: 2 * n - 2]:
        for k in ks:
            out[k] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_optimal_and_limited(seed):
    rnd = np.random.default_rng(seed)
    counts = (1.6 ** rnd.integers(0, 30, 40)).astype(np.int64) * (rnd.random(40) < 0.9)
    own, slow = code_lengths(counts, 7).astype(int), np.array(slow_lengths(counts.tolist(), 7))
    assert own.max() <= 7 and sum(2.0**-k for k in own if k) == 1
    assert (own * counts).sum() == (slow * counts).sum()


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 70_000])
def test_bits_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.2, n), 49_999).astype(np.uint16)
    lengths = code_lengths(np.bincount(ids, minlength=65536))
    codes, by_window, length = canonical(lengths)
    payload, marks = pack_bits(ids, lengths, codes)
    (got, again) = unpack_bits([payload, payload], [marks, marks], [n, n], by_window, length)
    assert (got == ids).all() and (again == ids).all()


def test_files_hold_every_document(spark):
    rows = [(RND.randrange(-50, 10_000), t, k) for k, t in enumerate([*ODD, None, "x y " * 40_000, "same", "same"] + ["w " * RND.randrange(900) for _ in range(60)])]
    rows += [(None, "no id", 1), (7, "twice", 1), (7, "twice", 1), (7, "thrice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    library, path = Encoder(public_path("word_bpe_49k.json")).library, fresh_path(spark, "files")
    write_ids(docs, path)
    got = sorted(read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), i) for d, i in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert round_trip(docs.limit(0)).collect() == []
