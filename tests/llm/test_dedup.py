"""Near copies and repeated passages against brute force, with odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillbase.llm import near_dedup, substring_dedup
from quillbase.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(key, len(sets[i]), least[find(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)]


def mutated(seed, n=260):
    """Groups of near copies around the bound: edits, cuts, shared passages and chains."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, bases = [], [[r.choice(vocab) for _ in range(r.choice([6, 30, 80, 150]))] for _ in range(8)]
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(words))
            kind = r.random()
            if kind < 0.4:
                words[at] = r.choice(vocab)
            elif kind < 0.7:
                del words[at]
            else:
                words[at:at] = r.sample(vocab, 2)
            words = words or ["w0"]
        if r.random() < 0.2:
            bases.append(words)
        if r.random() < 0.2:
            words = words[: max(1, int(len(words) * r.uniform(0.6, 1)))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equals_brute_force(spark, seed):
    rows = mutated(seed)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    have = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert have == {k: (n, c, k == c) for k, n, c in brute_components(rows)}


def test_near_odd(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(odd).collect()), key=str)
    assert got == sorted(brute_components([(r.doc_id, r.text) for r in odd.collect()]), key=str)
    assert near_dedup.near_dedup(none).count() == 0
    kept = near_dedup.keep_documents(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([k for k, _, c in brute_components([(r.doc_id, r.text) for r in odd.collect()]) if k is None or k == c], key=str)


@pytest.mark.parametrize("slab", [1_000_000, 7])
def test_components(spark, monkeypatch, slab):
    monkeypatch.setattr("quillbase.llm.components.SLAB_ROWS", slab)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (7, 7), (None, 3), (99, 70), (70, 80)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 99: 70, 70: 70, 80: 70}
    assert components(edges.limit(0), "a", "b").count() == 0


def brute_strip(rows, length=13):
    first = {}
    for key, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - length + 1):
            s = tuple(w[i : i + length])
            if key is not None:
                first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if key is not None and first[tuple(w[i : i + length])] < key:
                gone.update(range(i, i + length))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    common = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(r.randrange(4)):
            words += [r.choice(vocab) for _ in range(r.randrange(30))]
            if r.random() < 0.6:
                p = r.choice(common)
                words += p[r.randrange(5) :]
        rows.append((r.randrange(150), r.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    rows = passages(seed)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._kept_text) for r in got), key=key) == sorted(brute_strip(rows), key=key)
    for r in got:
        assert r._n_removed == sum(s.end - s.start for s in r._spans) and all(s.end - s.start >= 13 for s in r._spans)


def test_substrings_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = substring_dedup.substring_dedup(odd, keep=("kept", "key"))
    assert got.columns[:3] == ["doc_id", "kept", "key"]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._kept_text) for r in got.collect()), key=key) == sorted(brute_strip(rows), key=key)
    assert substring_dedup.substring_dedup(none).count() == 0
    out = substring_dedup.dedup_documents(odd)
    assert out.dtypes == odd.dtypes and out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_least_length(odd):
    with pytest.raises(ValueError, match="length"):
        substring_dedup.substring_dedup(odd, length=5)


def test_working_memory_is_bounded():
    """A large batch of texts is worked on in pieces: the memory it takes beside the batch doesn't grow with it (some 40 bytes a character before)."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(1500)]
    part = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["id", "text"])
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        described = sum(x.num_rows for x in near_dedup._describe(near_dedup.Settings())(iter([part])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert described == 1500 and size > 4_000_000 and most < 90_000_000


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_in_pieces(monkeypatch, piece):
    """Hashes of words don't depend on where the pieces of a batch end."""
    from quillbase.llm import common

    texts = ["a bb  CCC\n日本 é", None, "", " x ", "bb " * 9 + "y" * 40, "CCC a"]
    want = common.words_of(texts, lower_ascii=True)
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    got = common.words_of(texts, lower_ascii=True)
    assert got.hashes.tolist() == want.hashes.tolist() and got.offsets.tolist() == want.offsets.tolist() == [0, 5, 5, 5, 6, 16, 18]
    assert want.hashes[0] == want.hashes[17] and want.hashes[1] == want.hashes[6] and want.hashes[2] == want.hashes[16] and len(set(want.hashes.tolist())) == 7
