"""Rules, classifier, licences, chats and media, with odd rows and brute force."""

import hashlib
import io
import math
import re
import struct
import textwrap
import time
import wave
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillbase.llm import chat, license_texts, licenses, media, quality_classifier, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w, seen, repeats = WORD.findall(text), Counter(), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])] += 1
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            repeats.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeats)


def test_rules_odd(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    for r, (text,) in zip(got, odd.select("text").collect(), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.keep_documents(odd).columns == odd.columns


def test_rules_keep_prose_and_drop_junk(spark):
    words = "The quick brown fox jumps over a lazy dog while it was raining in the old town and nobody saw that cat".split()
    prose = " ".join(words) + ".\n" + " ".join(reversed(words)) + "."
    rows = [(1, prose), (2, " | ".join(words)), (3, "%% ".join(words)), (4, (" ".join(words) + "!! ").upper()), (5, "Der " * 60), (6, "xq zv " * 3 + " ".join(f"w{i}" for i in range(60)))]
    kept = quality_rules.keep_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1]
    other = " ".join(f"slovo{i}{'abcdefghij'[i % 10]}" for i in range(80))  # no stop words: judged only where there is a list
    rows = [(1, other, "cs"), (2, other, "en"), (3, other, None)]
    assert [r.doc_id for r in quality_rules.keep_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()] == [1, 3]


def brute_kneser_ney(texts, order):
    start = quality_classifier.START * (order - 1)
    counts = [None] * (order + 1)
    counts[order] = Counter(s[i : i + order] for s in (start + (t or "") for t in texts) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1] and n[2]):
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(r, 0.1 * k), 0.95 * k) for k, r in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]), 1))

    tables = []
    for k in range(1, order + 1):
        d, after = discounts(counts[k]), defaultdict(list)
        for g, n in counts[k].items():
            after[g[:-1]].append(n)
        tables.append((d, counts[k], after))

    def p(g):
        d, c, after = tables[len(g) - 1]
        ns = after.get(g[:-1])
        if len(g) == 1:
            low = sum(d[min(n, 3) - 1] for n in ns) / sum(ns) / (len(ns) + 1) if ns else 1.0
            return (max(c[g] - d[min(c[g], 3) - 1], 0) / sum(ns) if g in c else 0) + low
        if not ns:
            return p(g[1:])
        return (max(c[g] - d[min(c[g], 3) - 1], 0) if g in c else 0) / sum(ns) + sum(d[min(n, 3) - 1] for n in ns) / sum(ns) * p(g[1:])

    return lambda t: sum(math.log(p((start + t)[i : i + order])) for i in range(len(t)))


def test_classifier_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = docs.collect()
    score = brute_kneser_ney([r.text for r in rows if r.doc_id in good], 4)
    got = {r.id: r for r in quality_classifier.perplexities(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows[:25]:
        assert got[r.doc_id].n == len(r.text) and got[r.doc_id].trusted == (r.doc_id in good)
        assert got[r.doc_id].log_p == pytest.approx(score(r.text), rel=1e-5)


def test_probabilities_sum_to_one(spark):
    counts = Counter("the cat sat on the mat and the cat ran"[i : i + 3] for i in range(36))
    c = spark.createDataFrame(list(counts.items()), "g string, n long")
    letters = sorted(set("".join(counts)))
    wanted = spark.createDataFrame([(h + x,) for h in ("th", "at", "zz") for x in [*letters, "\x01"]], "g string")
    sums = quality_classifier.probabilities(wanted, c, 3).groupBy(F.substring("g", 1, 2).alias("h")).agg(F.sum(F.exp("log_p")).alias("p")).collect()
    seen = {g[2] for g in counts}
    assert seen <= set(letters)
    for r in sums:
        assert r.p == pytest.approx(1, abs=0.02 + (len(letters) - len(seen)) * 0.05)


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (8, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(odd, labels).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.kept for r in got}[3] is False and {r.doc_id: r.perplexity for r in got}[4] is None
    assert quality_classifier.quality_classifier(none, labels).count() == 0
    free = quality_classifier.quality_classifier(odd, labels.limit(0)).collect()
    assert all(r.kept == (r.n_scored > 0) for r in free)
    assert quality_classifier.keep_documents(odd, labels).columns == odd.columns


def test_long_text_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcab " * 50, "en"), (2, "bca", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    whole = {r.id: r.log_p for r in quality_classifier.perplexities(docs, labels).collect()}
    monkeypatch.setattr(quality_classifier, "CHUNK_CHARS", 17)
    monkeypatch.setattr(quality_classifier, "SLAB_CHARS", 17 // 3)
    cut = {r.id: r.log_p for r in quality_classifier.perplexities(docs, labels).collect()}
    assert cut == pytest.approx(whole, rel=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trained = labels.where("doc_id % 2 = 0")
    out = quality_classifier.quality_classifier(docs, trained).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rate = {x.quality: x.kept for x in r}
    assert rate[1] >= 0.97 and rate[0] <= 0.25


def test_copies_of_a_trusted_text_leave_limits_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang").dropDuplicates(["text"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    copies = spark.range(1_000_000, 1_000_060).select(F.col("id").alias("doc_id"), F.lit("All words of this one are well known by now. " * 9).alias("text"), F.lit("en").alias("lang"))
    one = docs.unionByName(copies.limit(1))
    many = docs.unionByName(copies).unionByName(copies.limit(20))
    trusted = labels.unionByName(copies.select("doc_id", F.lit(1).alias("quality")))
    limits = lambda d: quality_classifier.quality_classifier(d, trusted).select("low", "high").first()
    assert tuple(limits(many)) == pytest.approx(tuple(limits(one)))


def test_limits_come_from_texts_that_were_not_learned(spark):
    scores = [("en", True, i, -200.0 - i / 10 if i % 5 == 0 else -100.0, 100) for i in range(200)]
    got = quality_classifier.language_limits(spark.createDataFrame(scores, "lang string, trusted boolean, key long, log_p double, n long"), quality_classifier.Settings())
    assert got.first().middle == pytest.approx(2.095, abs=0.01)


def test_held_out_texts_are_not_learned(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = docs.where(F.pmod(F.xxhash64("text"), F.lit(5)) == 0).select("doc_id")
    some = quality_classifier.perplexities(docs, labels, once=True, held=5).select("id", "log_p")
    less = quality_classifier.perplexities(docs, labels.join(held, "doc_id", "left_anti"), once=True).select("id", "log_p")
    assert {r.id: r.log_p for r in some.collect()} == pytest.approx({r.id: r.log_p for r in less.collect()})


def test_few_trusted_texts_have_the_usual_distance(spark):
    scores = [("en", True, i, -100.0 - i, 100) for i in range(40)] + [("fr", True, 99, -200.0, 100)]
    got = quality_classifier.language_limits(spark.createDataFrame(scores, "lang string, trusted boolean, key long, log_p double, n long"), quality_classifier.Settings())
    by = {r._lang: r for r in got.collect()}
    assert by["fr"].low < by["fr"].middle - 0.5 and by["fr"].high > by["fr"].middle + 0.5


def test_licenses(spark, none):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/x.py", "import os"), ("r/a/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 40), ("r/a/b/z.py", ""),
        ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("q/w.py", "license to drive"), ("top.py", None), (None, "All rights reserved."), ("r/a/x.py", "import sys"),
    ]
    got = {r.path: (r.license, r.origin, r.from_path) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "r/LICENSE": ("MIT", "own", "r/LICENSE"), "r/a/x.py": ("MIT", "inherited", "r/LICENSE"), "r/a/y.py": ("Apache-2.0", "own", "r/a/y.py"), "r/a/b/z.py": ("GPL-3.0", "inherited", "r/a/b/COPYING"),
        "r/a/b/COPYING": ("GPL-3.0", "own", "r/a/b/COPYING"), "q/w.py": ("Proprietary", "inherited", ""), "top.py": ("Proprietary", "inherited", ""), "": ("Proprietary", "own", ""),
    }
    assert licenses.scan(none.withColumn("path", F.col("source"))).count() == 0


def test_headers_over_several_lines(spark):
    def comment(text, mark, first="", last=""):
        lines = textwrap.wrap(text, 70)
        return first + "\n".join([f"{mark} Copyright (C) 2020 Some One", mark, *(f"{mark} {x}" for x in lines[:3]), mark, *(f"{mark} {x}" for x in lines[3:])]) + last + "\nimport os\n" + "code = 1\n" * 50

    rows, want = [], {}
    for k, (name, text) in enumerate(license_texts.HEADERS):
        mark, first, last = [("#", "", ""), ("//", "", ""), (" *", "/*\n", "\n */")][k % 3]
        rows.append((f"all/{name}-{k}.py", comment(text, mark, first, last)))  # beside each other
        want[f"all/{name}-{k}.py"] = (name, "own")
    rows += [("all/plain.py", "x = 1"), ("all/mit.py", "# Released under the MIT License.\nx = 1")]
    want |= {"all/plain.py": (None, "none"), "all/mit.py": ("MIT", "own")}
    # code never declares, whatever it says and is called
    rows += [("z/tiny.py", "# Licensed under the Apache License, Version 2.0.\nx = 1"), ("z/__init__.py", "# SPDX-License-Identifier: MIT"), ("z/license.py", "# Released under the MIT License."), ("z/other.py", "y = 2")]
    want |= {"z/tiny.py": ("Apache-2.0", "own"), "z/__init__.py": ("MIT", "own"), "z/license.py": ("MIT", "own"), "z/other.py": (None, "none")}
    # a licence behind other notices declares, wherever it begins
    texts = dict(license_texts.TEXTS)
    for n in (40, 150, 333):
        rows += [(f"n{n}/LICENSE", "This product bundles third party parts with notices of their own. " * (n // 11) + texts["MIT"] + " And some words after it." * 3), (f"n{n}/a.py", "z = 3")]
        want |= {f"n{n}/LICENSE": ("MIT", "own"), f"n{n}/a.py": ("MIT", "inherited")}
    for name in ("AGPL-3.0", "GPL-3.0"):
        rows += [(f"{name}/COPYING", texts[name] + " and so on for many more words" * 200), (f"{name}/a.py", "")]
        want |= {f"{name}/COPYING": (name, "own"), f"{name}/a.py": (name, "inherited")}
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "MPL-2.0", "AGPL-3.0"])
def test_license_texts_are_unlike_each_other(name):
    texts = dict(license_texts.TEXTS)
    rows, idf, _ = licenses.idf_weights(license_texts.TEXTS)
    vectors = defaultdict(dict)
    for _, n, t, w in rows:
        vectors[n][t] = w
    assert max(sum(w * vectors[other].get(t, 0) for t, w in vectors[name].items()) for other in texts if other != name) < 0.95  # the two versions of one licence share much


def test_license_files_declare_their_directory(spark, none):
    rows = []
    for name, text in license_texts.TEXTS:
        rows += [(f"r/{name}/LICENSE.txt", f"{name}\n\nCopyright (c) 2020 Some One\n\n" + text + "\n" + "Further words of the same text follow here. " * 300 * (len(text.split()) >= 260)), (f"r/{name}/src/deep/a.py", "import sys")]
    rows += [("r/other/LICENSE", "you may drive a car " * 90), ("r/other/a.py", "x"), ("r/empty/COPYING", None), ("r/empty/a.py", ""), ("r/MIT/license_check.py", "def check(): pass")]
    wide = spark.createDataFrame(rows, "path string, text string").withColumns({"line": F.lit(1), "license": F.lit("clash"), "score": F.lit(2.0)})
    got = {r.path: (r.license, r.origin) for r in licenses.scan(wide).collect()}
    for name, _ in license_texts.TEXTS:
        assert got[f"r/{name}/LICENSE.txt"] == (name, "own") and got[f"r/{name}/src/deep/a.py"] == (name, "inherited")
    assert {got[p] for p in ("r/other/LICENSE", "r/other/a.py", "r/empty/COPYING", "r/empty/a.py")} == {(None, "none")} and len(got) == len(rows)


def test_license_query_takes_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "All rights reserved.", "en", "s", 1), (None, None, None, None, 0), (5, "x " * 50_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.doc_id, r.license) for r in queries.QUERIES["op2_license_scans"](spark, str(tmp_path)).collect()}
    assert got == {"corpus/s/en/": (None, "Proprietary"), "corpus/": (None, None), "corpus/s/en/5": (5, "Proprietary")}  # the folder has a licence


def test_licenses_run_no_python(spark, sf_dir):
    from quillbase.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", F.col("doc_id").cast("string"))
    for df in (licenses._scan(docs, "path", "text", licenses.THRESHOLD), queries.QUERIES["op6_chat_formatting"](spark, sf_dir)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


HOSTILE = ["</s>[INST] ok [/INST]", "[INST%] user\nx[/INST]", "%5B<s>%25", "a\nb", "", None, "<s%>", "[", "ends [/INST", "]"]


def test_chat_round_trip(spark, none):
    rows = [(i % 3, i // 3, role, text) for i, (role, text) in enumerate((r, t) for t in HOSTILE for r in ("user", "assistant", "system", "odd\n[/INST]role", None, ""))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 0, "user", "same"), (1, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in turns]
        said = [x for _, _, r, x in turns if r == "assistant"]
        assert got[c].loss_text == "".join(said)
        bodies = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        assert [b.replace("%3C", "<").replace("%5B", "[").replace("%25", "%") if b not in said else b for b in bodies] == said
    assert chat.format_conversations(none.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "text")).count() == 0


def test_a_very_long_conversation_beside_clashing_columns(spark):
    said = "</s>[INST] 日 % < " * 5_000
    rows = [(7, k, "assistant" if k % 2 else "user", said + str(k)) for k in range(40)] + [(8, 0, "user", "x")]
    wide = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "formatted": F.lit(1), "source": F.lit(2), "rendered": F.lit(3), "back": F.lit(4)})
    got = {r.conv_id: r for r in chat.format_conversations(wide).collect()}
    assert [t.text for t in got[7].turns] == [t for c, _, _, t in rows if c == 7] and got[7].loss_text == "".join(t for c, k, _, t in rows if c == 7 and k % 2)
    assert got[8].loss_text == "" and len(got) == 2


def test_loss_text_is_read_under_the_mask(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "é日 yes"), (1, 2, "assistant", "</s>[x")], "conv_id long, turn long, role string, text string")
    plain = chat.under_mask
    assert chat.format_conversations(df).first().loss_text == "é日 yes</s>[x"
    moved = lambda f, s: plain(f, F.transform(s, lambda x: F.struct((x["start"] + 1).alias("start"), x["length"])))
    monkeypatch.setattr(chat, "under_mask", moved)
    assert chat.format_conversations(df).first().loss_text.startswith("日 yes<")


def test_sniffing():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IDAT", b"x"), (b"IEND", b"")))
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0\x02\x01\x44\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02\x01\xff\0\x02\xff\xd9"
    bmp = b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + b"\1\0\0\0\1\0\0\0\1\0\x18\0" + b"\0" * 28
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", "hello")
    gz = zlib.compressobj(wbits=31)
    midi = b"MThd\0\0\0\6\0\0\0\1\0\x60MTrk\0\0\0\4\0\xff\x2f\0"
    ogg = b"OggS\0\4" + b"\0" * 20 + b"\1\3abc"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    parts = [("image/png", png), ("image/gif", gif), ("image/jpeg", jpeg), ("image/bmp", bmp), ("application/zip", zipped.getvalue()), ("application/gzip", gz.compress(b"abc" * 99) + gz.flush()), ("audio/midi", midi), ("audio/ogg", ogg), ("application/pdf", pdf), ("audio/wav", media.wav(b"abcd" * 16))]
    machine, data, want = media.automaton(), b"BM RIFF PK\x03\x04 GIF89a ", []
    for kind, body in parts:
        want.append((kind, len(data), len(body)))
        data += body + b" -- "
    assert media.sniff(data, machine) == want
    for kind, body in parts:  # cut short or altered, nothing is valid
        assert not [f for f in media.sniff(body[:-1], machine) if f[0] == kind]
    broken = bytearray(png)
    broken[20] ^= 1
    assert media.sniff(bytes(broken), machine) == []


HOSTILE = {
    "ogg": b"OggS\0\0" + bytes(20) + b"\0",
    "ogg with bodies": b"OggS\0\0" + bytes(20) + b"\1\7OggS\0\0\0",
    "pdf": b"%PDF-1 ",
    "pdf without table": b"%PDF-1 %%EOF",
    "zip": b"PK\x03\x04",
    "gif": b"GIF89a" + bytes(7) + b"\x21\xf9\0",
    "gif blocks": b"GIF89a" + bytes(7) + b"\x21\xff\x03abc",
    "jpeg": b"\xff\xd8\xff\xda\0\2",
    "jpeg segments": b"\xff\xd8\xff\xe0\0\4",
    "riff": b"RIFF\xff\xff\0\0WAVE" + bytes(8),
    "midi": b"MThd\0\0\0\6\0\0\xff\xff\0\0" + b"MTrk\0\0\0\0" * 3,
    "png": b"\x89PNG\r\n\x1a\n\0\0\0\0IHDR" + struct.pack(">I", zlib.crc32(b"IHDR")),
    "bmp": b"BM",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_sniffing_takes_time_in_proportion(name):
    machine, seconds = media.automaton(), []
    for size in (250_000, 1_000_000):
        data = HOSTILE[name] * (size // len(HOSTILE[name]))
        began = time.process_time()
        media.sniff(data, machine)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.1)


def test_media_round_trip(spark, odd, none, tmp_path):
    media.store_texts(odd, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    got = media.read_features(stored).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in got) == sorted((len(b), max(64, -(-len(b) // 64) * 64)) for b in ((t or "").encode() for (t,) in odd.select("text").collect()))
    want = []
    for key, text in odd.select("doc_id", "text").collect():
        raw = (text or "").encode()
        body = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        whole = media.wav(body)
        with wave.open(io.BytesIO(whole)) as reader:  # the standard library reads the same samples
            assert (reader.getnchannels(), reader.getsampwidth()) == (1, 1) and reader.readframes(reader.getnframes()) == body
        sha = lambda b: hashlib.sha256(b).hexdigest()
        feature = f"audio/wav 8000 Hz, {len(body)} samples, mean {sum(body) // len(body)}, embedded: none"
        want.append((key, len(raw), len(body), sha(body), zlib.crc32(body[-64:]), len(whole), sha(whole), feature, media.UNKNOWN, "audio/wav"))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    typed = media.correct_types(stored)
    assert {r.corrected for r in typed.collect()} == {"audio/wav"}
    inner = spark.createDataFrame([(1, "image/png", bytearray(media.wav(media.wav(b"z" * 64)))), (2, "text/x", None), (3, "text/x", bytearray(b""))], "detected int, declared string, media binary")
    rows = media.correct_types(inner).orderBy("corrected").collect()
    assert [(r.corrected, len(r.embedded)) for r in rows] == [("audio/wav", 1), ("text/x", 0), ("text/x", 0)] and rows[0].embedded[0].start == 44
    media.store_texts(none, str(tmp_path / "n"))
    assert media.read_features(spark.read.parquet(str(tmp_path / "n"))).count() == 0


def test_filter_repeats_no_measure(spark):
    """A filter on the verdict stays above the measures, which would else be computed anew for each use of each."""
    docs = spark.createDataFrame([(1, "a b c " * 30, "en")], "doc_id long, text string, lang string")
    uses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64")
    out = quality_rules.quality_rules(docs)
    assert uses(out.where("kept")) == uses(out) and uses(out.where("NOT kept AND n_words > 3")) == uses(out)
    assert uses(quality_rules.keep_documents(docs)) == uses(out)
