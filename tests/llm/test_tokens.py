"""Chunked encoding, packing and ORC output against the tokenizers library applied to whole texts."""

import itertools
import random
import zlib

import numpy as np
import pytest

from framerank.llm import orctokens, packing, tokens
from framerank.llm.common import shared_path

ALPHABET = "ab Ab'sS.,\n\t   ééİßſKK  12٣½|\x1c\x85\xa0\u2003ñ漢字\U0001f600#_-'ll I'm ="
PARTS = ["the", "The.", "  ", "\n", "\n\n", " \n", "\t", "a.b", "||", "é.", "don't", "12,", "\xa0", "\u2003", "é", "ZU.\nGE!!", "<|endoftext|>", "<|", "some text"]


@pytest.fixture
def plain():
    """The library's own reader of a vocabulary file, fresh and unaltered."""
    return pytest.importorskip("tokenizers").Tokenizer.from_file


@pytest.mark.parametrize("which", ["word_bpe", "byte_bpe"])
def test_chunks_give_the_ids_of_whole_texts(which, request, plain, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 400)  # so that generations change
    path = request.getfixturevalue(which)
    c, want, rng = tokens.Chunks(path), plain(path), random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(6000)]
    texts += ["".join(rng.choice(PARTS) + rng.choice([" ", "", " "]) for _ in range(rng.randint(0, 9))) for _ in range(6000)]
    texts += [" ", "  a", "a  ", "a \n b", "x" * 300, "Word. Word, word!? Word.", "some text <|endoftext|> more", "long " * 5000 + "  \n" + "more\n" * 5000]
    for t in texts:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == want.encode(t, add_special_tokens=False).ids, repr(t[:100])


def expected(path, text, end, capacity=None):
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")
    return [ids[k : k + (capacity or len(ids))] for k in range(0, len(ids), capacity or len(ids))]


def test_packing_holds_every_piece_once(docs, empty, word_bpe):
    rows = packing.pack(docs, word_bpe, capacity=64).toPandas()
    want = sorted((-1 if d.doc_id is None else d.doc_id, k, k * 64, len(p), zlib.crc32(p.tobytes())) for d in docs.collect() for k, p in enumerate(expected(word_bpe, d.text, 1, 64)))
    got = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    assert packing.pack(empty, word_bpe).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_the_index_of_sums_finds_what_is_there(seed):
    """While lengths are used up, a sum has an entry if and only if a look at all combinations finds one."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(31, dtype=np.int64)
    for x in rng.choice(np.arange(1, 30), 9, replace=False):
        counts[x] = rng.integers(1, 4)
    sums = packing.Sums(counts)
    while counts.sum() > 2:
        gap = int(rng.integers(3, 31))
        for k, found in ((1, sums.single(gap)), (2, sums.pair(gap)), (3, sums.triple(gap))):
            there = [c for c in itertools.combinations_with_replacement(np.flatnonzero(counts).tolist(), k) if sum(c) == gap and all(counts[x] >= c.count(x) for x in c)]
            assert (tuple(sorted(found)) in there) if found else not there, (gap, k)
        used = sums.triple(gap) or sums.pair(gap) or (int(rng.choice(np.flatnonzero(counts))),)
        for x in used:
            counts[x] -= 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 257, 3000) if seed % 2 else rng.choice([5, 64, 100, 129, 256], 3000)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    made, used = packing.plan(counts, 256), {}
    for times, kinds in made:
        assert times > 0 and sum(x * m for x, m in kinds) <= 256
        for x, m in kinds:
            used[x] = used.get(x, 0) + times * m
    assert used == counts and len(made) <= 3 * 256
    if seed % 2:
        assert sum(t for t, _ in made) <= 1.015 * lengths.sum() / 256 + 1


def test_orc_round_trip(spark, docs, empty, byte_bpe):
    path = shared_path(spark, "test-orc")
    orctokens.write(docs, path, byte_bpe)
    got = orctokens.digest(spark, path).toPandas().sort_values("start")
    want, at = [], 0
    for d in sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0)):
        ids = expected(byte_bpe, d.text, 2)[0]
        want.append((-1 if d.doc_id is None else d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()] == want
    assert orctokens.look_up(spark, path, [4]).count() == 1
    assert orctokens.round_trip(empty, byte_bpe).count() == 0


def _rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_files_are_pruned_and_hold_bloom_filters(spark, byte_bpe, monkeypatch):
    monkeypatch.setattr(orctokens, "FILE_ROWS", 9000)
    ids = spark.range(0, 40_000, 2, 1)
    path = shared_path(spark, "test-orc")
    orctokens.write(ids.selectExpr("id AS doc_id", "concat('text number ', id) AS text").coalesce(1), path, byte_bpe)
    found = orctokens.look_up(spark, path, [20_000])
    assert [r.doc_id for r in found.collect()] == [20_000] and _rows_scanned(found) <= 1000
    # An odd id lies within the bounds of a row group; only the Bloom filter tells that it isn't there (but for one in a hundred).
    assert sum(_rows_scanned(orctokens.look_up(spark, path, [k])) > 0 for k in range(10_001, 10_041, 2)) <= 3
    files = sorted(f for f in spark.read.orc(path).inputFiles())
    sizes = [orctokens.read(spark, f).count() for f in files]
    assert sum(sizes) == 20_000 and max(sizes) <= 9000
    firsts = [orctokens.read(spark, f).agg({"doc_id": "min"}).first()[0] for f in files]
    assert firsts == sorted(firsts)


def test_words_after_a_blank_are_encoded_once():
    chunks = tokens.Chunks(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    made, make = [], chunks.after_blank.make
    chunks.after_blank.make = lambda chunk: made.append(chunk) or make(chunk)
    text = "a " + " ".join(str(i) for i in range(500_000))
    first = chunks.encode(text)
    assert len(made) == 500_000 and chunks.encode(text) == first and len(made) == 500_000
