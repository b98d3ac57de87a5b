"""Importance resampling, filter audit and language-model scores, with odd rows and brute force."""

import hashlib
import math
import mmap
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quillbase.llm import filter_audit, importance, lm_scoring, lm_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_features_are_crcs_of_runs(ngrams, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
    texts = ["The CAT's  cat\tünïx 日本語 x1", None, "", "...", "a" * 1000 + " " + "é" * 200 + "-b", "one", "ZZ\x7f{k}" * 9]
    got = defaultdict(list)
    for rows, crc in importance.features(pa.array(texts), ngrams):
        for r, c in zip(rows.tolist(), crc.tolist(), strict=True):
            got[r].append(c)
    for i, text in enumerate(texts):
        words = FEATURE.findall((text or "").translate(UPPER))
        runs = [" ".join(words[a : a + k]) for k in range(1, ngrams + 1) for a in range(len(words) - k + 1)]
        assert sorted(got[i]) == sorted(zlib.crc32(x.encode()) for x in runs)


def test_features_of_a_slice():
    texts = pa.array(["xx yy", "zz", "q r s"])[1:]
    [(rows, crc)] = list(importance.features(texts, 1))
    assert rows.tolist() == [0, 1, 1, 1] and crc.tolist() == [zlib.crc32(x) for x in (b"zz", b"q", b"r", b"s")]


def brute_resample(rows, target, percent=10):
    buckets = lambda t: [zlib.crc32(w.encode()) % 10000 for w in FEATURE.findall((t or "").translate(UPPER))]
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in rows:
        own = buckets(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return out


def test_resample_equals_brute_force(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, importance.resample(docs, target).collect()))
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == sorted(map(tuple, want))


def test_resample_odd(spark, odd, none):
    half = importance.Settings(percent=60, least_words=3)
    target = spark.createDataFrame([("three four",), (None,), ("",)], "text string")
    got = importance.resample(odd, target, settings=half)
    want = brute_resample([(r.doc_id, r.text) for r in odd.collect()], ["three four", None, ""])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(lambda r: tuple(r)[:4], got.collect()), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    ranks = [r["rank"] for r in got.where("rank is not null").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) == 60 * got.where("n_features >= 3").count() // 100
    assert importance.resample(none, target).count() == 0 and importance.resample(odd, target.limit(0)).count() == odd.count()
    drawn = importance.draw_documents(odd, target, settings=half)
    assert drawn.columns == odd.columns and 0 < drawn.count() < odd.count()


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts[part or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                all_fails = sum(f in d[1] for d in docs)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_fails - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                sums[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_audit_equals_brute_force(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(250))
    more = [(20, long, "en"), (21, long, "de"), (22, long, None), (20, long, "en"), (None, long, "en"), (23, long + " A" * 40, "en"), (24, "x y " * 150, ""), (25, long + "#", "de"), (26, long + "#", "de")]
    docs = odd.select("doc_id", "text", "lang", "kept", "_kept_id").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = [(1, 1, 0), (20, 0, 1), (20, 1, None), (21, 1, 1), (26, 1, 0), (None, 1, 1), (7, 0, 1), (99, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = {(r["part"], r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(docs, frame).collect()}
    want = brute_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [x for x in labels if x[0] is not None])
    assert got == want and len(got) == 600 * 3
    assert filter_audit.filter_audit(none, frame).count() == 0
    assert filter_audit.filter_audit(docs, frame.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.audit_orders(docs, "ABCDEFGHI")


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (3000, 10**12), (700_000, 2**40), (1000, 1000)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        packed, _ = lm_trie.EliasFano.read(memoryview(lm_trie.EliasFano.packed(values)), 0)
        assert (packed.values() == values).all()
        asked = np.sort(np.concatenate([rng.integers(0, top + 5, 1000).astype(np.uint64), values[:500]]))
        place, equal = packed.successors(asked)
        assert (equal == np.isin(asked, values)).all() and (not n or (place == np.searchsorted(values, asked)).all())
        at = np.sort(rng.integers(0, n, 100)) if n else np.empty(0, np.int64)
        assert (packed.access(at) == values[at]).all()
    keys = np.unique(rng.integers(0, 3000, 200_000) * 2**32 + rng.integers(0, 10**6, 200_000))
    first, second = keys >> 32, keys & (2**32 - 1)
    contexts, shares = np.unique(first), rng.random(len(keys))
    rest = rng.random(len(contexts))
    (tmp_path / "levels").write_bytes(lm_trie.Trie.build(first, second, shares, contexts, rest))
    with (tmp_path / "levels").open("rb") as f:
        trie = lm_trie.Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))  # the levels are read in place
    a, b = np.concatenate([first[::3], rng.integers(0, 3500, 50_000)]), np.concatenate([second[::3], rng.integers(0, 10**6, 50_000)])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    got, left = trie.find(a, b)
    known, of = dict(zip(keys.tolist(), lm_trie.quantise(shares).tolist(), strict=True)), dict(zip(contexts.tolist(), lm_trie.quantise(rest).tolist(), strict=True))
    assert got.tolist() == [known.get(x * 2**32 + y, 0) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert left.tolist() == [of.get(x, 0) for x in a.tolist()]
    assert np.abs(np.log10(lm_trie.restore(lm_trie.quantise(shares))) - np.log10(shares)).max() <= 0.5 / lm_trie.STEPS + 1e-9


def brute_model(rows):
    """The same model with plain dictionaries and no quantisation; what is learned, single counts, their sum, probabilities."""
    end = "\n"
    seen = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*WORD.findall((t or "").translate(UPPER)), end]) for i, t in rows]
    one = Counter(w for _, out, ws in seen if not out for w in ws)
    two = Counter(p for _, out, ws in seen if not out for p in zip([end, *ws], ws, strict=False))

    def three(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        return (0, *lm_scoring.discounts(*n))

    d1, d2, total = three(one), three(two), sum(one.values())
    free = sum(d1[min(c, 3)] for c in one.values()) / total if total else 1.0
    after, left = Counter(), Counter()
    for (a, _), c in two.items():
        after[a] += c
        left[a] += d2[min(c, 3)]

    def p(a, b):
        single = (one[b] - d1[min(one[b], 3)]) / total if one[b] else free
        return ((two[a, b] - d2[min(two[a, b], 3)]) + left[a] * single) / after[a] if after[a] else single

    return seen, one, total, p


def brute_scores(rows):
    seen, one, total, p = brute_model(rows)
    for i, out, ws in seen:
        base = sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in ws)
        yield i, out, len(ws), sum(w in one for w in ws), total, base, sum(math.log10(p(a, b)) for a, b in zip(["\n", *ws], ws, strict=False))


def assert_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], abs=w[2] / lm_trie.STEPS)


def test_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, tries = lm_scoring.score_documents(docs)
    rows = got.collect()
    assert_scores(rows, brute_scores([(r.doc_id, r.text) for r in docs.collect()]))
    new = [r for r in rows if r.held_out]
    assert new and sum(r.score for r in new) > 1.05 * sum(r.base_score for r in new)  # better than single words where nothing was learned
    [row] = tries.collect()
    trie = lm_trie.Trie(row.trie)
    assert trie.words.n > 100 and trie.pointers.values()[-1] == trie.level.n == len(trie.shares)


def test_probabilities_sum_to_one():
    rows = [(k, f"a {w} a") for k, w in enumerate("b b c d e e e f g h i".split() * 2)]
    _, one, _, p = brute_model(rows)
    for context in ["a", "b", "\n", "zz"]:
        assert sum(p(context, b) for b in [*one, "unknown"]) == pytest.approx(1)


def test_scores_over_many_shards_and_spread_words(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    plain = sorted(map(tuple, lm_scoring.score_documents(docs)[0].collect()))
    for name, value in (("SHARD_BYTES", 40_000), ("HOT_TOKENS", 200), ("CHUNK_TOKENS", 3_000), ("SLICE_BYTES", 2_500)):
        monkeypatch.setattr(lm_scoring, name, value)
    got, tries = lm_scoring.score_documents(docs)
    assert tries.count() > 4
    for a, b in zip(sorted(map(tuple, got.collect())), plain, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_odd(spark, odd, none):
    got, _ = lm_scoring.score_documents(odd)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert_scores(got.collect(), brute_scores([(r.doc_id, r.text) for r in odd.collect()]))
    scores, tries = lm_scoring.score_documents(none)
    assert scores.count() == 0 and tries.count() == 0
    [out] = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    alone = spark.createDataFrame([(out, "no text to learn from"), (out, None)], "doc_id long, text string")
    rows = lm_scoring.score_documents(alone)[0].collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(0, 0, 0.0, 0.0)] * 2
