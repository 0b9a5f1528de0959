"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from prosegauge.llm import bpe, components, decontaminate, language, ledger, licenses, lm, simhash, simhash_similar, suffix_dedup, urls, winnow
from prosegauge.llm.common import slices, spans_union, utf8, words

lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
DOCS = "doc_id bigint, text string"
#: Names that the operators use themselves.
CLASH = ["key", "bucket", "spans", "__doc", "fp", "batch"]


def frame(spark, rows, schema=DOCS):
    df = spark.createDataFrame(rows, schema).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def passages(seed, n=50):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(400)) for _ in range(3)]
    out = []
    for i in range(n):
        r = rng.random()
        if r < 0.1:
            t = None
        elif r < 0.2:
            t = "x" * rng.randint(0, 400)
        elif r < 0.3:
            t = ("abcde" * 80)[rng.randint(0, 5) : rng.randint(90, 400)]
        else:
            x, a = rng.choice(base), rng.randint(0, 300)
            t = "".join(rng.choice("qrst") for _ in range(rng.randint(0, 50))) + x[a : a + rng.randint(50, 300)] + rng.choice(base)[: rng.randint(0, 200)]
        out.append((3 * i + 1, t))
    return [*out, (1000, out[5][1]), (1000, out[5][1]), (None, base[0][50:260])]


# ---- shared kernels ----------------------------------------------------------------------------------------------------------


def test_slices_and_words():
    data, offs = utf8(pa.array(["Ab c", None, "", "é  x", "y"], pa.string()))
    assert [(i, j) for i, j in slices(offs, 3)] and sum(j - i for i, j in slices(offs, 3)) == 5
    from prosegauge.llm.common import NON_SPACE

    s, e, first = words(data, offs, NON_SPACE)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["Ab", "c", "é", "x", "y"] and first.tolist() == [0, 2, 2, 2, 4, 5]


def test_spans_union():
    s, e = spans_union(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 12]))
    assert list(zip(s, e)) == [(0, 4), (5, 7), (9, 12)]


# ---- 1 -----------------------------------------------------------------------------------------------------------------------


def brute_dedup(docs, length=100):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen.setdefault(b[j : j + length], (i, j)) != (i, j):
                gone[j : j + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    docs = passages(seed)
    out = suffix_dedup.dedup(frame(spark, docs))
    got = {(r.doc_id): (r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in out.collect()}
    assert got == brute_dedup(docs) and out.count() == len(docs)


def test_suffix_dedup_over_many_buckets(spark):
    """One passage in every document: its suffixes straddle the buckets."""
    rng = random.Random(4)
    hot = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = [(i, "".join(rng.choice("ijkl ") for _ in range(rng.randint(20, 80))) + hot + "".join(rng.choice("mnop ") for _ in range(rng.randint(20, 80)))) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute_dedup(docs)


def test_multikey_quicksort():
    w = np.random.default_rng(1).integers(0, 3, (2000, 5)).astype(np.uint64)
    assert (w[suffix_dedup.multikey_quicksort(w)] == w[np.lexsort(w.T[::-1])]).all()


def test_kept_text_drops_cut_characters(spark):
    t = "é" * 120
    out = {r.doc_id: r["__kept"] for r in suffix_dedup.kept_text(frame(spark, [(1, t), (2, "a" + t + "b"), (3, None)])).collect()}
    assert out[1].kept.replace("é", "") == "" and out[2].kept == "ab" and out[3].kept is None and out[3].n_removed == 0


# ---- 2 -----------------------------------------------------------------------------------------------------------------------


def wrapped(paragraphs, mark, width=70):
    """Paragraphs as a comment of wrapped lines, parted by empty ones."""
    return f"\n{mark}\n".join("\n".join(f"{mark} {x}" for x in textwrap.wrap(p, width)) for p in paragraphs)


def brute_licenses(files):
    """What scan() gives, from plain counters of words: rows of (key, license, cosine, origin, from_dir)."""
    find = re.compile(r"[0-9a-z\x80-\U0010ffff]+").findall
    words = lambda t: find(lower(t))
    templates = [(n, kind, collections.Counter(words(t))) for n, kind, t in licenses.TEMPLATES]
    vocabulary = {w for _, _, c in templates for w in c}
    seen = collections.Counter(w for _, _, t in files for w in set(words(t)) & vocabulary)
    idf = {w: math.log((1 + len(files)) / (1 + seen[w])) + 1 for w in vocabulary}
    rarest = max(idf.values())
    norm = lambda c: math.sqrt(sum((n * idf.get(w, rarest)) ** 2 for w, n in c.items()))
    sizes = [norm(c) for _, _, c in templates]

    def best(texts, kind):
        out = (0.0, 0, None)
        for t in texts:
            c = collections.Counter(words(t))
            for i, ((name, k, v), size) in enumerate(zip(templates, sizes)):
                if c and (k == "whole") == (kind == "whole"):
                    x = round(sum(n * c[w] * idf[w] ** 2 for w, n in v.items()) / size / norm(c) * (licenses.CLAIM if k == "claim" else 1), 9)
                    if x >= licenses.LEAST:
                        out = max(out, (x, -i, name))
        return out[0], out[2]

    units, of_dir = {}, {}
    for i, (key, path, text) in enumerate(files):
        t = text or ""
        line, block = best(re.split(r"\n|\.(?= )", t), "part"), best(re.split(r"\n(?:[^0-9a-zA-Z\x80-\U0010ffff\n]*\n)+", t), "part")
        own = line if line[0] >= licenses.SENTENCE and (line[0] >= block[0] or block[0] < licenses.BLOCK) else block if block[0] >= licenses.BLOCK else (0, None)
        units[i] = (own[1], max(line[0], block[0]) or None)
        whole, unit = best([t], "whole"), line if line[0] >= block[0] else block
        given = whole if whole[0] >= licenses.WHOLE else unit if path and re.search(licenses.NAMED, path) and unit[0] >= licenses.NAMED_FROM else None
        if path is not None and given:
            at = path.rpartition("/")[0]
            of_dir[at] = min(of_dir.get(at, (0, "", "")), (-given[0], path, given[1]))
    out = []
    for i, (key, path, _) in enumerate(files):
        at = path.rpartition("/")[0].split("/") if path is not None else None
        above = ["/".join(at[:n]) for n in range(len(at), -1, -1)] if at is not None else []
        near = next((x for x in above if x in of_dir), None)
        own, cosine = units[i]
        out.append((key, own or (of_dir[near][2] if near is not None else None), cosine and round(cosine, 6), "own" if own else "inherited" if near is not None else "none", None if own else near))
    return sorted(out, key=repr)


def test_licenses_are_those_of_brute_force(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("parse the tree of nodes and return a list in order".split()) + rng.choice(["", "x", "ing"]) for _ in range(n))
    pieces = [t for _, t in licenses.STATEMENTS + licenses.CLAIMS * 8] + ["SPDX-License-Identifier: " + t for _, t in licenses.SPDX] + [wrapped([t], m) for _, t in licenses.PARAGRAPHS for m in ("#", " *", "//", "")]
    files = [(1, "a/LICENSE", "Released under the MIT License."), (4, "d/z.py", None), (5, "d/z.py", ""), (6, None, "Licensed under CC BY-NC 4.0."), (8, "a/q.py", "words " * 5000), (9, "e/one.py", licenses.STATEMENTS[4][1]), (10, "e/two.py", "code"), (10, "e/two.py", "code"), (None, "e/three", "x")]
    for i in range(120):
        path = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        name = rng.choice(["LICENSE", "COPYING.txt", "x.py", "y.c", "notes"])
        text = "\n\n".join(rng.choice(pieces) if rng.random() < 0.4 else filler(rng.randint(1, 40)) for _ in range(rng.randint(0, 4)))
        files.append((100 + i, f"{path}/{name}" if path else name, text))
    files += [(300 + i, f"whole{i}/{'LICENSE' if i % 2 else 'terms.txt'}", f"Copyright (c) 20{i} A. Holder\n\n" + wrapped(t.split(": "), "", 80)) for i, (_, t) in enumerate((n, t) for n, t in licenses.WHOLES)]
    files += [(400 + i, f"whole{i}/src/deep/x.py", "nothing here") for i in range(len(licenses.WHOLES))]
    got = sorted(((r.doc_id, r.license, r.cosine and round(r.cosine, 6), r.origin, r.from_dir) for r in licenses.scan(frame(spark, files, "doc_id bigint, path string, text string")).collect()), key=repr)
    assert got == brute_licenses(files)
    by_key = {x[0]: x for x in got}
    assert [by_key[400 + i][1] for i in range(len(licenses.WHOLES))] == [n for n, _ in licenses.WHOLES]
    assert by_key[9][3] == "own" and by_key[10][4] != "e" and by_key[8][1:] == ("MIT", None, "inherited", "a")
    assert licenses.scan(frame(spark, [], "doc_id bigint, path string, text string")).count() == 0


@pytest.mark.parametrize("mark", ["#", " *", "//"])
def test_usual_headers_are_found(spark, mark):
    """In a corpus whose words are all frequent, with names and years around them."""
    around = f"{mark} Copyright 2021 Some Holder and the authors of this project\n{mark} All rights reserved.\n{mark}\n"
    gpl = licenses.GNU_HEADER
    headers = [("Apache-2.0", licenses.APACHE_HEADER), ("MIT", licenses.MIT_TEXT), ("BSD-3-Clause", [licenses.BSD_START, licenses.BSD_ONE, licenses.BSD_TWO, licenses.BSD_THREE, licenses.BSD_END]), ("GPL-3.0", [gpl.format("General Public License", "3")]), ("Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"])]
    rows = [(i, f"p{i}/x", around + wrapped(t, mark, 60) + "\n\nint main() { return 0; }") for i, (_, t) in enumerate(headers)]
    rows += [(100 + i, "q/x", "the software is provided under a license of its own and any use of it is free for all who copy the source code") for i in range(100)]
    out = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows, "doc_id bigint, path string, text string")).collect()}
    assert [out[i] for i in range(len(headers))] == [n for n, _ in headers]
    assert all(out[100 + i] is None for i in range(100))


def test_directories_beyond_the_broadcast(spark, monkeypatch):
    files = [(i, f"r{i % 3}/{'LICENSE' if i < 3 else f's/{i}.py'}", "Released under the MIT License." if i < 3 else "code") for i in range(60)]
    rows = lambda: sorted((r.doc_id, r.license, r.origin, r.from_dir) for r in licenses.scan(frame(spark, files, "doc_id bigint, path string, text string")).collect())
    plain = rows()
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    assert rows() == plain and {x[2] for x in plain} == {"own", "inherited"}


def test_licence_cosine_is_that_of_plain_vectors():
    t = licenses.Templates()
    rng = np.random.default_rng(0)
    t.weigh(100, rng.integers(0, 100, len(t.words)).astype(float))
    text = "Licensed under the MIT License, the License of others"
    data, offs = utf8(pa.array([text], pa.string()))
    h, _, _, row = licenses.tokens(data, offs)
    _, top, cosine = t.best(t.keys(h), row)
    tf = collections.Counter(h.tolist())
    weight = {k: n * (t.idf[np.searchsorted(t.words, k)] if k in t.words else t.other) for k, n in tf.items()}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    want = [0 if t.whole[i] else sum(w * t.vectors[i][np.searchsorted(t.words, k)] for k, w in weight.items() if k in t.words) / norm for i in range(len(t.names))]
    assert cosine[0] == pytest.approx(max(want)) and top[0] == int(np.argmax(want))


# ---- 3 -----------------------------------------------------------------------------------------------------------------------


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(2)
    shared = [f"w{rng.randint(0, 10**6)}" for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
    rows = [(i, " ".join([f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))] + shared + [f"y{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))])) for i in range(20)]
    got = [{int(x, 16) >> 24 for x in r.fingerprint.split()} for r in winnow.fingerprints(frame(spark, rows)).collect()]
    assert all(a & b for a, b in itertools.combinations(got, 2))


def brute_entries(text):
    """The chosen entries, gram by gram and window by window."""
    mask = (1 << 64) - 1
    words_ = [w for w in re.split("[ \t-\r]+", re.sub("([\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", lower(text))) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_]
    if not hashes:
        return []
    if len(hashes) < winnow.GRAM:
        x = 42
        for h in hashes:
            x = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), x)
        grams = [x]
    else:
        turned = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n else x
        grams = []
        for i in range(len(hashes) - winnow.GRAM + 1):
            x = 0
            for j in range(winnow.GRAM):
                x ^= turned(hashes[i + j], winnow.GRAM - 1 - j)
            grams.append(x)
    packed = [(g >> 25) << 24 | ((1 << 24) - 1 - i) for i, g in enumerate(grams)]
    n = max(1, len(packed) - winnow.WINDOW + 1)
    return list(dict.fromkeys(min(packed[i : i + winnow.WINDOW]) for i in range(n)))


def brute_likeness(a, b):
    a, b = {x >> 24 for x in a}, {x >> 24 for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_runs_of_any_size(spark):
    rng = random.Random(0)
    rows = [(i, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20)]) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, h array<bigint>")
    for size in (1, 2, 3, 6, 7, 8, 13):
        for r in df.select("h", winnow.rolled(F.col("h"), size).alias("r"), winnow.minima(F.col("h"), size).alias("m")).collect():
            assert r.m == [min(r.h[i : i + size]) for i in range(21 - size)] and len(r.r) == 21 - size
            # rolled on: the hash of the next run from this one's, its first word and the word after it
            turn = lambda x, n: ((x << n % 64) | ((x & (1 << 64) - 1) >> (64 - n % 64))) & (1 << 64) - 1 if n % 64 else x & (1 << 64) - 1
            for i in range(20 - size):
                assert turn(r.r[i], 1) ^ turn(r.h[i], size) ^ r.h[i + size] & (1 << 64) - 1 == r.r[i + 1] & (1 << 64) - 1


def test_winnowing_of_scripts_without_spaces(spark):
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(300))
    rows = [(1, text), (2, text[:-1] + "一"), (3, "ไทย" * 40), (4, "mixed 漢字 and かな words " + text)]
    got = {r.doc_id: [int(x, 16) for x in r.fingerprint.split()] for r in winnow.fingerprints(frame(spark, rows)).collect()}
    assert got == {d: brute_entries(t) for d, t in rows}
    assert brute_likeness(got[1], got[2]) > 0.9 and brute_likeness(got[1], got[4]) > 0.8


def test_winnowing_chooses_the_rightmost_least(spark):
    rows = [(1, "a a a a a a a a a a a a"), (2, None), (3, ""), (4, " \t"), (5, "One"), (6, "one")]
    out = {r.doc_id: r for r in winnow.fingerprints(frame(spark, rows)).collect()}
    places = [((1 << 24) - 1) - (int(x, 16) & ((1 << 24) - 1)) for x in out[1].fingerprint.split()]
    assert places == [5, 6, 7]  # eight equal grams in three windows: the last of each
    assert out[2].fingerprint == out[3].fingerprint == out[4].fingerprint == "" and out[5].fingerprint == out[6].fingerprint != ""


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_next_in_descending_order(spark, n):
    rng = random.Random(n)
    docs = [(i * i + rng.randint(0, 3) * 10**9, "t" * rng.randint(0, 5) + str(i)) for i in range(n)]
    order = sorted(docs, key=lambda d: -d[0])
    for edges in (winnow.EDGES, 3):  # three ranges, each cut into even parts
        got = {r.doc_id: r.next.text for r in winnow.with_next(frame(spark, docs), lambda k, t: [k, t], edges=edges).collect()}
        assert got == {d: order[(i + 1) % n][1] for i, (d, _) in enumerate(order)}


def test_next_of_null_and_repeated_keys(spark):
    docs = [(None, "none"), (3, "b"), (3, "a"), (9, "x"), (-(1 << 62), "low"), ((1 << 62), "high")]
    for edges in (winnow.EDGES, 2):
        got = sorted(((r.doc_id, r.text, r.next.text) for r in winnow.with_next(frame(spark, docs), lambda k, t: [k, t], edges=edges).collect()), key=str)
        assert got == sorted([(1 << 62, "high", "x"), (9, "x", "a"), (3, "a", "b"), (3, "b", "low"), (-(1 << 62), "low", "none"), (None, "none", "high")], key=str)


def test_edited_text(spark, tmp_path):
    rng = random.Random(4)
    docs = [(5, "abcdé"), (9, None), (7, "xy"), (2, "long " * 3000), (11, "one two three four five six seven eight nine ten")]
    docs += [(20 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in winnow.op3_winnow(spark, str(tmp_path)).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (out[d].n_chars, out[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, new, other = brute_entries(t), brute_entries(edited), brute_entries(nxt)
        assert [int(x, 16) for x in out[d].fingerprint.split()] == own and [int(x, 16) for x in out[d].edited_fingerprint.split()] == new
        assert (out[d].near_edited, out[d].near_next) == (pytest.approx(brute_likeness(own, new)), pytest.approx(brute_likeness(own, other)))
    assert out[9].near_edited == 1.0


# ---- 4 -----------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, None), (2, "x"), (3, "http://"), (4, "HTTP://A.NET/es/?x"), (5, "http://net#/es/"), (None, "a://www.EXAMPLE.com/en/é\n/x"), (7, "http://m.example.com/en/1"), (8, "http://m.example.com/fr/1"),
        (9, "https://sub.www.example.com/en/"), (10, "http://badexample.com/en/1"), (11, "http://x.com"), (12, "http://internet/es/1"), (12, "http://internet/es/1"),
    ]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(frame(spark, rows, "page_id bigint, url string"), urls.RULES).collect()}
    assert out[1] == out[2] == ("", "", None, "allow") and out[3] == ("", "", None, "allow")
    assert out[4] == ("a.net", "/es/", "net/es/", "block") and out[5] == ("net", "", None, "allow")
    assert out[None] == ("www.example.com", "/en/é\n/x", "www.example.com/en/", "allow") and out[7][2:] == ("example.com/en/", "block") and out[8][2:] == ("com/", "allow")
    assert out[9][2] == "www.example.com/en/" and out[10][2:] == ("com/", "allow") and out[11][2] is None and out[12][2] is None


def brute_templates(rows, rules):
    """page -> (verdict, template, purity) by plain Python: a tree of one host after the other, level by level."""
    parse = lambda u: (lower(re.match("[^/?#]*", u.partition("://")[2])[0]), re.match("[^/?#]*([^?#]*)", u.partition("://")[2])[1]) if u and "://" in u else ("", "")
    pages = []
    for key, url in rows:
        host, path = parse(url)
        fits = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        segs = re.sub("[0-9]+", "*", path.removeprefix("/")).split("/") if path else []
        if len(segs) > urls.DEEPEST:
            segs = [*segs[: urls.DEEPEST - 1], "/".join(segs[urls.DEEPEST - 1 :])]
        pages.append({"key": key, "host": host, "segs": segs, "label": max(fits)[1] if fits else None})
    tally = lambda x: (len(x), sum(p["label"] == "block" for p in x), sum(p["label"] is not None for p in x))
    smooth = lambda b, n, to: (b + urls.WEIGHT * to) / (n + urls.WEIGHT)
    form = lambda p, d: re.sub("[^/.*]+", "a", "/".join(p["segs"][d + 1 :]))
    _, b, n = tally(pages)
    top = smooth(b, n, urls.PRIOR)
    pools = {(): top}
    for d in range(urls.DEEPEST):
        groups = collections.defaultdict(list)
        for p in pages:
            if len(p["segs"]) > d:
                groups[tuple(p["segs"][: d + 1])].append(p)
        for k, x in groups.items():
            _, b, n = tally(x)
            pools[k] = smooth(b, n, pools[k[:-1]])
    out = {}

    def grow(host, node, d, members, purity, known):
        for p in members:
            if len(p["segs"]) == d:
                out[p["key"]] = (p["label"] or ("block" if purity >= urls.REJECT else "allow"), host + node, purity)
        kids = collections.defaultdict(list)
        for p in members:
            if len(p["segs"]) > d:
                kids[p["segs"][d]].append(p)
        live = [p for x in kids.values() for p in x]
        all_n, all_b, all_l = tally(live)
        pooled = collections.Counter(form(p, d) for p in live)
        general = {}
        for k, x in kids.items():
            n, b, l = tally(x)
            others, side = all_l - l, ""
            if l and others:
                gap, share = b / l - (all_b - b) / others, all_b / all_l
                if abs(gap) > urls.DEVIATIONS * math.sqrt(share * (1 - share) * (1 / l + 1 / others)) + 1e-9:
                    side = "+" if gap > 0 else "-"
            own = collections.Counter(form(p, d) for p in x)
            apart = sum(abs(own[f] / n - c / all_n) for f, c in pooled.items()) / 2
            if n * urls.MOST_CHILDREN <= all_n or l and apart <= urls.VARIATION + 1e-9:
                general[k] = "*" + side
        count = collections.Counter(general.values())
        named = collections.defaultdict(list)
        for k, x in kids.items():
            named[general[k] if k in general and count[general[k]] > 1 else k] += x
        for name, x in named.items():
            n, b, l = tally(x)
            pool = sum(round(pools[tuple(p["segs"][: d + 1])] * urls.UNIT) for p in x) / urls.UNIT / n
            k = min(known, urls.WEIGHT)
            grow(host, f"{node}/{name}", d + 1, x, (b + k * purity + urls.WEIGHT * pool) / (l + k + urls.WEIGHT), l)

    hosts = collections.defaultdict(list)
    for p in pages:
        hosts[p["host"]].append(p)
    for host, x in hosts.items():
        _, b, l = tally(x)
        grow(host, "", 0, x, smooth(b, l, top), l)
    return out


def test_url_templates_are_those_of_brute_force(spark):
    rng = random.Random(11)
    rules = [("a.org", "/spam/", "block"), ("a.org", "/ok/", "allow"), ("net", "/buy/", "block"), ("net", "/", "allow"), ("c.org", "/x/y/", "block")]
    rows = [(1, None), (2, "no host"), (3, "http://a.org"), (4, "http://a.org/"), (5, "http://a.org//"), (6, "http://deep.org/" + "/".join("abcdefghijklmnopqrstuvwxyz")), (7, "http://deep.org/" + "/".join("abcdefghijklmnopqrstuvwyyy"))]
    for i in range(900):
        host = rng.choice(["a.org", "b.org", "m.net", "shop.net", "c.org", "d.com"])
        first = rng.choice(["spam", "ok", "buy", "x", "blog", "en", "de"])
        rest = rng.choice([f"/{rng.randint(1, 999)}", f"/y/{rng.choice('abcdef')}", f"/slug{rng.choice('abcdefghij')}{rng.choice('klmnopqrs')}/p{rng.randint(1, 9)}.html", "/", ""])
        rows.append((100 + i, f"http://{host}/{first}{rest}?q={i}"))
    rows += [(2000 + i, f"http://wide.org/w{rng.choice('abcdefghijklm')}{rng.choice('nopqrstuvw')}{rng.choice('xyz')}/view") for i in range(600)]
    out = {r.page_id: (r.verdict, r.template, r.purity) for r in urls.judged(frame(spark, rows, "page_id bigint, url string"), rules).collect()}
    want = brute_templates(rows, rules)
    assert set(out) == set(want)
    for k, (verdict, template, purity) in want.items():
        assert out[k][:2] == (verdict, template) and out[k][2] == pytest.approx(purity, abs=2e-6), (k, out[k], want[k])
    assert any(v[1] == "wide.org/*/view" for v in out.values()) and {v for v, _, _ in out.values()} == {"allow", "block"}


def test_url_templates(spark):
    """Labels reach pages without any: through a wildcard, the parent, and the same path of other hosts. Other shares stay apart."""
    rules = [("a.org", "/spam/x", "block"), ("a.org", "/ok/", "allow"), ("c.org", "/buy/", "block"), ("c.org", "/", "allow")]
    rows = [(i, f"http://a.org/spam/{'x' if i % 2 else 'y'}{i}") for i in range(80)] + [(100 + i, f"http://a.org/ok/{i}") for i in range(40)]
    rows += [(200 + i, f"http://{h}.org/{x}/{i}") for i, (h, x) in enumerate((h, x) for h in "cd" for x in ("buy", "read") for _ in range(60))]
    out = {r.page_id: r for r in urls.judged(frame(spark, rows, "page_id bigint, url string"), rules).collect()}
    assert out[1].verdict == out[0].verdict == "block" and out[0].rule is None and out[0].template == "a.org/spam/y*"
    assert out[100].verdict == "allow" and out[100].template == "a.org/ok/*"
    by_template = {r.template: r.verdict for r in out.values() if r.template[0] == "d"}
    assert by_template == {"d.org/buy/*": "block", "d.org/read/*": "allow"}


# ---- 5 -----------------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    known = {}
    for i, t in items:
        w = find(lower(t))
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, of = find(lower(t)), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if found := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    of |= found
        out[d] = (len(w), len(hit), of)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_decontamination(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(["a", "B", "c,", "é", "X"]) for _ in range(rng.randint(0, n)))
    for _ in range(20):
        docs = [(i, rng.choice([None, "", make(60), make(60)])) for i in range(6)]
        items = [(i, rng.choice([make(14), make(6), None, ".."])) for i in range(rng.randint(0, 4))]
        block = decontaminate.Block(items)
        data, offs = utf8(pa.array([t for _, t in docs], pa.string()))
        got = [x for i, j in slices(offs, 100) for x in decontaminate.scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], block)]
        assert {d: (n, h, {m["item_id"] for m in ms}) for (d, _), (n, h, ms) in zip(docs, got)} == brute_leaks(docs, items)


def test_decontamination_in_blocks(spark, monkeypatch):
    words_ = [f"w{i}" for i in range(40)]
    items = frame(spark, [(1, " ".join(words_[:15])), (2, " ".join(words_[20:32])), (3, None), (4, "short one")], "item_id bigint, text string")
    docs = frame(spark, [(1, "x " + " ".join(words_[:33])), (2, "SHORT, one!"), (3, None), (4, "clean"), (4, "clean"), (None, "clean too")])
    rows = lambda: sorted(((r.doc_id or 0, r.n_words, r.n_hit, sorted(map(tuple, r.matches))) for r in decontaminate.matches(docs, items).collect()))
    one = rows()
    by_id = {r[0]: (r[1], r[2], len(r[3])) for r in one}
    assert by_id[1] == (34, 27, 2) and by_id[2] == (2, 2, 1) and by_id[3] == (0, 0, 0) and len(one) == 6
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [None, 3, 4, 4]
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (20,))
    assert rows() == one
    assert decontaminate.matches(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_judges_each_row_and_every_item(spark, monkeypatch):
    items = frame(spark, [(1, "one two three"), (None, "four five six"), (3, "seven eight nine")], "item_id bigint, text string")
    docs = frame(spark, [(1, "one two three x"), (1, "clean"), (None, "clean too"), (None, "four five six"), (2, "clean"), (2, "clean")])
    want = [(None, 2, 0, []), (None, 3, 3, [None]), (1, 1, 0, []), (1, 4, 3, [1]), (2, 1, 0, []), (2, 1, 0, [])]
    for size in (4 << 20, 20):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (size,))
        got = [(r.doc_id, r.n_words, r.n_hit, [m.item_id for m in r.matches]) for r in decontaminate.matches(docs, items).collect()]
        assert sorted(got, key=lambda r: (r[0] or 0, r[1])) == want
        assert sorted((r.doc_id or 0) for r in decontaminate.clean(docs, items).collect()) == [0, 1, 2, 2]


# ---- 6 -----------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "A B", "x\ty\x0bz é"] + [" ".join(rng.choice(["On", "é", "the", "of"]) for _ in range(rng.randint(0, 700))) for _ in range(30)]
    data, offs = utf8(pa.array(texts, pa.string()))
    got = [x for i, j in slices(offs, 500) for x in simhash.fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
    assert got == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 3])
def test_covering_masks_miss_no_pair(radius):
    rng = random.Random(radius)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(1, radius)))
        assert any(d & m == 0 for m in masks)


def brute_components(fps, radius=3):
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {d: root(d) for d in fps}


@pytest.mark.parametrize("hot", [4, 2000])
def test_links_join_all_pairs_within_the_radius(spark, hot):
    rng = random.Random(hot)
    fps = {}
    for g in range(12):
        x = rng.getrandbits(64)
        for _ in range(20):
            fps[len(fps)] = x
            x ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5)))
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in set(fps.values())], "fp bigint")
    groups = components.components(simhash.links(nodes, 3, hot), nodes)
    named = {r.node: r.component for r in groups.collect()}
    want = brute_components(fps)
    got = {d: named.get(simhash.signed(x), simhash.signed(x)) for d, x in fps.items()}
    assert {frozenset(d for d in fps if got[d] == g) for g in got.values()} == {frozenset(d for d in fps if want[d] == g) for g in want.values()}


def test_near_duplicates(spark):
    docs = [(9, "same text here"), (3, "Same text here"), (4, None), (8, ""), (6, " "), (7, "other"), (7, "other"), (1, "w " * 20000), (None, "alone"), (None, "OTHER")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {(9, 3), (3, 3), (4, 4), (8, 4), (6, 4), (7, 7), (1, 1), (None, None), (None, 7)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_of_each(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = []
    for g in range(15):
        w = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(4):
            x = list(w)
            if c:
                x[rng.randrange(300)] = "edited"
            docs.append((10 * g + c, " ".join(x)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (502, docs[0][1]), (None, "alone here")]
    out = simhash_similar.one_of_each(frame(spark, docs))
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == [*range(0, 150, 10), 500] and out.count() == 17
    assert set(CLASH) <= set(out.columns)


def test_one_of_each_text_of_repeated_ids(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue white black " * 9)
    rows = lambda docs: sorted((r.doc_id or 0, r.text) for r in simhash_similar.one_of_each(frame(spark, docs)).collect())
    assert rows([(3, a), (7, a), (7, b)]) == [(3, a), (7, b)]
    assert rows([(3, a), (None, a), (None, b), (None, b), (None, c)]) == sorted([(3, a), (0, b), (0, c)])
    assert rows([(5, a), (5, a.upper()), (5, c)]) in ([(5, a), (5, c)], [(5, a.upper()), (5, c)])


def brute_similar(docs, shingle=5, similarity=0.8):
    """doc -> the least doc reachable over pairs of at least the Jaccard similarity."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if not either or both >= similarity * either - 1e-9:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {d: root(d) for d in sets}


def test_near_duplicates_are_those_of_exact_similarity(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(25)]
    docs = [(0, None), (1, " "), (2, "one two"), (3, "One  TWO"), (4, "one two three four five"), (5, "one two three four five six")]
    for g in range(70):  # a common line in all; copies on both sides of 0.8
        w = [word() for _ in range(rng.choice([20, 60, 150, 400]))]
        for c in range(4):
            x = list(w)
            for _ in range(c and rng.randint(1, max(1, len(w) // 30))):
                x[rng.randrange(len(x))] = word()
            docs.append((len(docs), " ".join(x + line)))
    original = [word() for _ in range(150)]
    for c in range(50):  # a star of copies, which are on both sides of 0.8 from it and further from each other
        x = list(original)
        for _ in range(rng.randint(1, 6) if c else 0):
            x[rng.randrange(150)] = word()
        docs.append((len(docs), " ".join(x)))
    w = [word() for _ in range(80)]
    for c in range(60):  # a chain of many copies
        w[rng.randrange(80)] = word()
        docs.append((len(docs), " ".join(w)))
    want = brute_similar(docs)
    for seen, share, rows in ((24, 1 / 16, 200_000), (3, 1.0, 0)):  # with frequent shingles, and beyond the broadcast
        for name, value in (("SEEN", seen), ("SHARE", share), ("BROADCAST", rows)):
            monkeypatch.setattr(simhash_similar, name, value)
        got = {r.doc: r.component_id for r in simhash_similar.groups(frame(spark, docs)).collect()}
        assert got == want
    assert 100 < len(set(want.values())) < len(docs) - 100


def test_near_copies_are_linked_by_covering_lsh(spark, monkeypatch):
    rng = random.Random(5)
    docs = []
    for g in range(30):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        docs += [(10 * g + c, " ".join(w[: 300 - c])) for c in range(4)] + [(10 * g + 5, " ".join(w[:270] + w[:30]))]
    sets = {d: simhash_similar.shingles_of(*simhash_similar.utf8(pa.array([t])), 5)[0] for d, t in docs}
    one = {d: simhash_similar.fingerprint(x) for d, x in sets.items()}
    want = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if (one[a] ^ one[b]).bit_count() <= simhash_similar.RADIUS and simhash_similar.jaccard(sets[a], sets[b]) >= 0.8:
            want = {d: min(want[a], want[b]) if x in (want[a], want[b]) else x for d, x in want.items()}
    # no candidate comes from prefixes
    monkeypatch.setattr(simhash_similar, "enough", lambda *x: F.lit(False))
    assert {r.doc: r.component_id for r in simhash_similar.groups(frame(spark, docs)).collect()} == want
    assert 30 <= len(set(want.values())) < 90


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges, edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# ---- 7 -----------------------------------------------------------------------------------------------------------------------


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5, 4), ("a", "en", 7, 7), (None, None, 3, 1)], "source string, lang string, n bigint, m bigint")
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    assert book.totals().count() == 0
    assert book.commit("1", ledger.inserted(rows, "t1", F.col("n"))) and not book.commit("1", ledger.inserted(rows, "t1", F.col("n")))
    assert book.commit("2", ledger.revised(rows.where("source = 'a'"), "t1", F.col("n"), F.col("m")))
    gone = ledger.deleted(rows.where("source IS NULL"), "t1", F.col("n"))
    assert book.commit("3", gone) and not ledger.Ledger(spark, str(tmp_path / "book")).commit("3", gone)
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "t1", 2, 11)]


def test_rollups_of_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5), ("a", None, 7)], "source string, lang string, n bigint")
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    totals = lambda: sorted(map(tuple, book.totals().collect()), key=str)
    book.compact()
    assert totals() == []
    for i in range(3):
        book.commit(str(i), ledger.inserted(rows, "t", F.col("n")))
    want = sorted([("a", "en", "t", 3, 15), ("a", None, "t", 3, 21)], key=str)
    assert totals() == want
    book.compact()
    book.compact()
    assert totals() == want and not book.commit("1", ledger.inserted(rows, "t", F.col("n"))) and totals() == want
    assert book.commit("3", ledger.deleted(rows.where("lang IS NULL"), "t", F.col("n")))
    want = sorted([("a", "en", "t", 3, 15), ("a", None, "t", 2, 14)], key=str)
    assert totals() == want
    # a rollup whose list of batches is half-written doesn't count
    book.compact()
    (tmp_path / "book" / "rollup=3" / "_SUCCESS").unlink()
    assert totals() == want


def test_ledger_of_tokens_of_a_vocabulary(spark, tmp_path):
    """Counts of the encoder, null and empty texts, a null group."""
    docs = spark.createDataFrame([(1, "the cat", "s", "en"), (2, None, "s", "en"), (3, "", None, None)], "doc_id bigint, text string, source string, lang string")
    counted = bpe.with_tokens(docs, bpe.vocabulary_text(bpe.default_path()))
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    book.commit("1", ledger.inserted(counted, "word-49k", F.col("bpe.n_tokens")))
    assert sorted(map(tuple, book.totals().collect()), key=str) == sorted([("s", "en", "word-49k", 2, 2), (None, None, "word-49k", 1, 0)], key=str)


def test_ledger_query_with_nulls(spark, tmp_path):
    docs = [(1, "a b,c", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, "gone", "en", "s"), (5, "x-y z", "de", "s"), (None, "one", "de", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 1, None), (None, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(map(tuple, ledger.op7_ledger(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("s", "en", "spaced-1", 2, 2), ("s", "en", "plain-2", 2, 3), (None, None, "spaced-1", 1, 0), (None, None, "plain-2", 1, 0), ("s", "de", "spaced-1", 2, 4), ("s", "de", "plain-2", 2, 4)], key=str)


def test_half_written_batch_is_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n bigint")
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    book.commit("1", ledger.inserted(rows, "t", F.col("n")))
    (tmp_path / "book" / "batch=1" / "_SUCCESS").unlink()
    assert not book.committed("1") and book.totals().count() == 0
    assert book.commit("1", ledger.inserted(rows, "t", F.col("n"))) and book.totals().first().n_docs == 1


# ---- 8 -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path())))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def same(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), text


def test_bpe_is_the_library(encoder, library):
    rng = random.Random(1)
    letters = "abc'sdtll ΣσΑİȩ\u0301 <|endoftext|> 12½\n\x1c\x85_%$漢字🙂"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.2:
            t = t[:5] + "<|endoftext|>" + t[5:] + "<|startoftext|>"
        same(encoder, library, t)
    for c in range(0, 0x1C00):  # beyond, some code points are letters in Unicode 16 only
        same(encoder, library, "a" + chr(c) + "b " + chr(c) * 2)


def test_bpe_of_long_words(encoder, library):
    rng = random.Random(2)
    for t in ("a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20000)), " ".join("word" for _ in range(9000))):
        same(encoder, library, t)


def test_words_merged_together_are_those_merged_alone(encoder):
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 25):
        ids = np.array([[rng.choice(encoder.v.inner[97:110]) for _ in range(n - 1)] + [encoder.v.last[rng.randint(97, 110)]] for _ in range(300)])
        assert bpe.merge_rows(ids, encoder.ranks) == [bpe.merge(x, encoder.v.pairs, encoder.v.made) for x in ids.tolist()]
    a, b = np.array([rng.randrange(49_000) for _ in range(5000)]), np.array([rng.randrange(49_000) for _ in range(5000)])
    known = list(encoder.v.pairs)[:5000]
    a, b = np.append(a, [k >> 20 for k in known]), np.append(b, [k & (1 << 20) - 1 for k in known])
    assert encoder.ranks(a, b).tolist() == [encoder.v.pairs.get(x << 20 | y, bpe.INF) for x, y in zip(a.tolist(), b.tolist())]


def test_learnt_texts_are_encoded_alike(library):
    encoder, rng = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path())), 500), random.Random(4)
    make = lambda: "".join(rng.choice("abcdeéßΣ'.,3 \n\x1c漢<|") for _ in range(rng.randint(0, 400)))
    texts = [make() for _ in range(60)] + ["", "word " * 500, "x" * 3000, "<|endoftext|> a <|endoftext|>b"]
    for some in (texts[:30], texts[30:], texts):
        encoder.learn(some)
        for t in some:
            same(encoder, library, t)


def test_bpe_table_sizes_do_not_matter(library):
    v = bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path()))
    small, rng = bpe.Encoder(v, 3), random.Random(3)
    for _ in range(200):
        same(small, library, " ".join(rng.choice(["the", "The,", "of", "it's", "naïve", "retitioning"]) for _ in range(40)))


def test_bpe_frames(spark, library):
    docs = frame(spark, [(1, None), (2, ""), (3, " \n"), (4, "The the"), (4, "The the"), (None, "x")])
    out = {r.doc_id: (r.n_tokens, r.ids_text, r.decoded) for r in bpe.encode_decode(docs, bpe.vocabulary_text(bpe.default_path())).collect()}
    assert out[1] == out[2] == out[3] == (0, "", "") and out[4][0] == 2 and out[4][2] == "the</w> the</w>"
    more = bpe.with_tokens(docs, bpe.vocabulary_text(bpe.default_path()))
    assert {r.doc_id: tuple(r.bpe) for r in more.collect()} == out and set(CLASH) <= set(more.columns)


# ---- 9 -----------------------------------------------------------------------------------------------------------------------


def fold(d):
    return zlib.crc32(str(d).encode()) % 10


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_lm(spark, size):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["a", "B", "c", "é", "d" * 9]) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "unseen words"), (203, "a b"), (203, "a b")]
    learn, held = F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = lm.scores(frame(spark, docs), learn, held, filter_bytes=size).collect()
    assert len(rows) == len(docs)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</s>"]
    counts, pairs = collections.Counter(), collections.Counter()
    for d, t in docs:
        if fold(d):
            counts.update(tokens(t))
            pairs.update(zip(["</s>"] + tokens(t), tokens(t)))
    n, v = sum(counts.values()), len(counts)
    text = dict(docs)
    for r in rows:
        t = tokens(text[r.doc_id])
        share = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, fold(r.doc_id) == 0)
        assert r.base_score == pytest.approx(sum(math.log10(share(w)) for w in t), abs=1e-9)
        want = 0.0
        for u, w in zip(["</s>"] + t, t):
            c = pairs[u, w]
            c = 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 if c else 0
            want += math.log10((min(c, counts[u]) + lm.WEIGHT * share(w)) / (counts[u] + lm.WEIGHT))
        assert r.score == pytest.approx(want, abs=0.6)  # but for false answers of the filter
    if size > 1000:
        beyond = lm.scores(frame(spark, docs), learn, held, filter_bytes=0).collect()
        assert sorted(map(str, beyond)) == sorted(map(str, rows))  # the way beyond the broadcast gives the very same scores


def test_lm_sums_to_one(spark):
    """Over all words that training has, and an unseen one, after a context; counts of one or two are exact."""
    docs = [(i, t) for i, t in enumerate(["a b", "a c", "b a", "c c d"] * 2)]
    words_ = ["a", "b", "c", "d", "unseen"]
    asked = [(100 + i, f"a {w}") for i, w in enumerate(words_)] + [(200, "a")]
    score = {r.doc_id: r.score for r in lm.scores(frame(spark, docs + asked), F.col("doc_id") < 100, F.col("doc_id") >= 100).collect()}
    counts = collections.Counter(w for _, t in docs for w in [*t.split(), "</s>"])
    pairs = collections.Counter(x for _, t in docs for x in zip(["</s>", *t.split()], [*t.split(), "</s>"]))
    n, v = sum(counts.values()), len(counts)
    p = lambda u, w: (min(1.5 * 2 ** math.floor(math.log2(pairs[u, w])) - 0.5 if pairs[u, w] else 0, counts[u]) + lm.WEIGHT * (counts[w] + 0.1) / (n + 0.1 * (v + 1))) / (counts[u] + lm.WEIGHT)
    for i, w in enumerate(words_):
        want = math.log10(p("</s>", "a")) + math.log10(p("a", w)) + math.log10(p(w, "</s>"))
        assert score[100 + i] == pytest.approx(want, abs=1e-6)
    assert sum(p("a", w) for w in ["a", "b", "c", "d", "</s>", "unseen"]) == pytest.approx(1, abs=0.2)  # counts are known by their level only


def test_lm_filter():
    rng = np.random.default_rng(0)
    g = np.unique(rng.integers(0, 1 << 63, 40000).astype(np.uint64))
    counts = rng.integers(1, 200, len(g))
    table = pa.table({"bucket": pa.array([0] * 2, pa.int32()), "batch": pa.array([0, 1], pa.int64()), "hashes": pa.array([g[::2].tobytes(), g[1::2].tobytes()], pa.binary()), "counts": pa.array([lm.pack(counts[::2]), lm.pack(counts[1::2])], pa.binary())})
    f = lm.Filter(1, [(0, lm._segment(table).column("bits")[0].as_py())])
    exact = 1.5 * 2 ** np.floor(np.log2(counts)) - 0.5
    got = f.counts(g)
    assert (got >= exact).all() and (got == exact).mean() > 0.97
    assert (f.counts(rng.integers(0, 1 << 63, 40000).astype(np.uint64)) > 0).mean() < 0.03


def test_lm_of_nothing(spark):
    assert lm.scores(frame(spark, []), F.lit(True), F.lit(False)).count() == 0
    r = lm.scores(frame(spark, [(1, "a b")]), F.lit(False), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# ---- 10 ----------------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then runs away from the house with the others",
    "fr": "le renard brun saute par dessus le chien paresseux et puis il part de la maison avec les autres",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann mit den anderen weg",
}


def samples(seed, n):
    rng = random.Random(seed)
    return {k: [" ".join(rng.choice(t.split()) for _ in range(rng.randint(3, 30))) for _ in range(n)] for k, t in SAMPLES.items()}


@pytest.fixture(scope="module")
def model():
    m = language.Model(samples(1, 60))
    m.calibrate(samples(2, 60))
    return m


def brute_cross_entropy(samples_, text, order=language.ORDER, discount=language.DISCOUNT):
    """Nats for each character by language, from counters of strings."""
    plain = lambda t: re.sub(r"[^a-zäöüß]+", " ", t.lower()).lstrip(" ").rstrip(" ") + " "
    shorter = lambda t: plain(t) if plain(t) != " " else " "
    grams = lambda t, n: [(" " * n + shorter(t))[i + 1 : i + 1 + n] for i in range(len(shorter(t)))]
    size = max(2, len({c for ts in samples_.values() for t in ts for c in shorter(t)}) + 1)
    out = []
    for lang in sorted(samples_):
        counts = {order: collections.Counter(g for t in samples_[lang] for g in grams(t, order))}
        for n in range(order - 1, 0, -1):
            counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
        total = {n: collections.Counter() for n in counts}
        kinds = {n: collections.Counter() for n in counts}
        for n, c in counts.items():
            for g, k in c.items():
                total[n][g[:-1]] += k
                kinds[n][g[:-1]] += 1

        def p(g):
            if not g:
                return 1 / (4 * size)
            n, head = len(g), g[:-1]
            if not total[n][head]:
                return p(g[1:])
            return (max(counts[n][g] - discount, 0) + discount * kinds[n][head] * p(g[1:])) / total[n][head]

        out.append(-sum(math.log(p(g)) for g in grams(text, order)) / len(grams(text, order)))
    return out


def test_cross_entropy_is_that_of_plain_counters():
    rng = random.Random(8)
    fitted = {k: [t + rng.choice(["", ".", "!", " 12 ", " Äh"]) for t in ts] for k, ts in samples(6, 12).items()}
    model = language.Model(fitted)
    asked = [t for ts in samples(7, 4).values() for t in ts] + ["zzz", "a", "x y z", "The, the; THE...", "ß" * 30]
    got, n = model.score(asked)
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(brute_cross_entropy(fitted, t), abs=2e-4), t


def test_kneser_ney_sums_to_one(model):
    """Over all characters that follow a context, with the floor for those never seen."""
    for l, _ in enumerate(model.langs):
        for context in ("th", "le ", "zzz", ""):
            chars = sorted({c for ts in samples(1, 60).values() for t in ts for c in t} | {" "})
            total = 0.0
            for c in chars:
                text = context + c if c != " " else context
                arr, doc = np.array([ord(x) for x in context + c], np.uint32), np.zeros(len(context) + 1, np.int64)
                g, ctx = language.grams(arr, doc, model.order), language.contexts(arr, doc, model.order)
                p, n = 0.0, model.order
                while n:
                    at = language._lookup(model.p[n - 1][0], g[n][-1:])[0]
                    if at >= 0:
                        p += model.p[n - 1][1][at, l]
                        break
                    at = language._lookup(model.gamma[n - 1][0], ctx[n - 1][-1:])[0]
                    p += model.gamma[n - 1][1][at, l] if at >= 0 else 0
                    n -= 1
                else:
                    p += model.floor
                total += math.exp(p)
                del text
            assert 0.75 < total <= 1.001, (model.langs[l], context, total)


def test_language(model):
    held = [(k, t) for k, ts in samples(3, 40).items() for t in ts]
    got = model.predict([t for _, t in held])
    assert np.mean([k == g[0] for (k, _), g in zip(held, got)]) > 0.97 and all(0 <= g[1] <= 1 for g in got) and not any(g[3] for g in got)
    assert [g[:2] for g in model.predict([None, "", "12 ..."])] == [("und", 0.0)] * 3
    assert model.predict(["漢字仮名交じり文を書いてみるとどうなるのか" * 3])[0][3]
    long = "the fox " * 20000
    assert model.predict([long, "x"])[0][0] == "en"


def test_stream_of_letters():
    c, d = language.stream(["Ab, c!! ", "", "x", "..", "é 1", "a . . "])
    assert "".join(map(chr, c)) == "ab c  x  é a " and d.tolist() == [0, 0, 0, 0, 0, 1, 2, 2, 3, 4, 4, 5, 5]


def test_language_frames(spark):
    rows = [(i, t, k) for k, ts in samples(4, 40).items() for i, t in enumerate(ts, 1000 * ord(k[0]))]
    df = spark.createDataFrame([*rows, (10**6, None, "en"), (None, "x", None)], "doc_id bigint, text string, lang string").withColumn("key", F.lit(1))
    m = language.learned(df)
    assert m.langs == ["de", "en", "fr"]
    out = language.predict(df, m)
    assert out.count() == len(rows) + 2 and set(df.columns) <= set(out.columns)
    assert out.where("doc_id = 1000000").first()["__language"].lang == "und"
    assert language.predict(df, language.learned(df.where("false"))).where("__language.lang <> 'und'").count() == 0
