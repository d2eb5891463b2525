"""The operators on documents against brute force, on small frames with every awkward row."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from platewise.llm import bpe, common, exact, jaccard, licenses, lines, mixing, passages, suffixes, toxicity
from platewise.llm.common import prepare
from platewise.llm.union import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tid int, size int, place string, block int, root int"
WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "ka ke ki lo lu ma mo nu pa".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=4):
    """Copies, near copies, shared passages, short, blank, null and long texts, repeated rows and null ids."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    texts += texts[:5] + texts[:3]
    for t in texts[5:12]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(5)]
    texts += [None, "", "   ", "one", "Two words", "two WORDS", "ünïcode Ünïcode 漢字 <|endoftext|> x", "a" * 700, "\n\n\nline\n\nline"]
    texts += [prose(rng, 4000), ("ab " * 300).strip(), "CC BY; General\tPublic--License. All rights\nreserved, cc-by-nc 4.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another text of this id"), (None, "no id"), (None, texts[7])]
    extra = lambda i: ("en", None if i % 7 == 0 else f"s{i % 4}", 1, "x", 7, 8, "y", 9, 5)
    return [(d, t, *extra(i)) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


OPERATORS = {
    "licenses": licenses.detections, "jaccard": jaccard.similarity_groups, "mixture": mixing.mixture, "mixed": mixing.mixed,
    "suffixes": suffixes.without_repeats, "exact": exact.exact_duplicates, "passages": passages.passage_report,
    "bpe": bpe.digests, "lines": lines.line_report, "edited": lines.without_repeated_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_licenses(docs, rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    expected = []
    for d, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        expected.append((d, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    found = licenses.detections(docs)
    assert table(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules_resolve():
    made = licenses.rules()
    assert len(made) > 200
    scanner = licenses.Scanner(made)
    scan = lambda text: [r.label for _, _, r in scanner.scan(text.lower())[1]]
    assert scan("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert scan("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3.0-or-later"]
    assert scan("GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert scan("the MIT License and the BSD 3-Clause License") == ["mit", "bsd-3-clause"]
    assert scan("plain prose about licensing a car") == []
    for rule in made:  # a rule's keyword stands in all it matches, or the automaton would miss it
        assert re.sub(r"\\", "", rule.keyword) in re.sub(r"\\", "", rule.pattern.replace("licen[cs]e", "license")) or rule.keyword in ("(c)", "\xa9")


def samples(tree, most=3000):
    """Strings that a parsed expression matches: every branch, and options both left out and taken."""
    made = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            own = [chr(value)]
        elif name == "IN":
            negated = str(value[0][0]) == "NEGATE"
            of = {"LITERAL": chr, "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " "}.get(str(v), "a")}
            own = [" "] if negated else [of[str(k)](v) for k, v in value]
        elif name == "BRANCH":
            own = [x for branch in value[1] for x in samples(branch, most)]
        elif name == "SUBPATTERN":
            own = samples(value[3], most)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            own = [x * n for n in {low, max(low, min(high, 1))} for x in samples(inner, most)]
        else:
            assert name in ("ANY", "ASSERT", "ASSERT_NOT", "AT", "NOT_LITERAL", "CATEGORY"), name
            own = ["z" if name in ("ANY", "NOT_LITERAL") else ""]
        made = [x + y for x in made for y in own]
        assert len(made) <= most
    return made


def test_license_keywords_stand_in_every_branch():
    import re._parser as parser

    made = licenses.rules()
    for rule in made:
        expression, tried = re.compile(rule.pattern, re.DOTALL), 0
        for text in samples(parser.parse(rule.pattern, re.DOTALL), 200_000):
            if expression.search(text):
                tried += 1
                assert rule.keyword in text, (rule, text)
        assert tried, rule
    scanner = licenses.Scanner(made)
    for text in ("for academic use only", "for academic and educational purposes only", "for academic and research use only", "for research purposes only"):
        assert [r.label for _, _, r in scanner.scan(text)[1]] == ["research-only"]
    assert [r.label for _, _, r in scanner.scan("the png reference library license")[1]] == ["libpng"]


def sets_of(rows, n):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def grouped(rows, sets, least):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least_of = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), least_of[root(i)]) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "least", "rare"), [(3, 90, 16), (5, 80, 16), (3, 90, 2), (3, 50, 1)])
def test_jaccard(docs, rows, n, least, rare, monkeypatch):
    """Also with hardly any shingle counted as rare, so that combinations do the work."""
    monkeypatch.setattr(jaccard, "RARE", rare)
    expected = grouped(rows, sets_of(rows, n), least)
    found = jaccard.similarity_groups(docs, n, least)
    assert table(found, "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)


def test_near_copies_below_the_threshold_are_no_candidates(spark):
    """Of texts that share most of their combinations, only those become pairs that can be similar."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(120), 6):
            words[at] = f"x{rng.random()}"
        texts += [" ".join(words), " ".join([*words, "end"])]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    links = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert len(links) < 60
    pack = jaccard.zstandard.ZstdCompressor()
    frame = [(i, len(s), i, pack.compress(t.encode())) for i, (t, s) in enumerate(zip(texts, sets, strict=True))]
    frame = spark.createDataFrame(frame, "th long, n long, node long, ztext binary")
    names = ["signature", "th", "n", "node", *getattr(jaccard, "PARITIES", [])]
    combos = prepare(spark) and frame.mapInArrow(jaccard._combined(3, 90), ", ".join(f"{c} long" for c in names))
    found = set(table(jaccard._across(combos, 90), "a", "b"))
    assert links <= found
    assert len(found) <= 2 * len(links)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (5, None)], "a long, b long")
    assert dict(table(components(edges), "node", "root")) == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_mixing(docs, rows):
    found = mixing.mixture(docs, block_words=16).collect()
    again = mixing.mixture(docs.repartition(5), block_words=16).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = (want - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    assert sorted({r["target"] for r in found}) == pytest.approx(sorted(set(target.values())))
    taken = collections.Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] += r["taken"]
    for t, words in taken.items():
        assert abs(words - t) <= 0.15 * t + 64
    texts = mixing.mixed(docs, block_words=16).collect()
    assert sum(len((r["text"]).split()) for r in texts) == sum(r["taken"] for r in found)
    assert {r["row"] for r in texts} == {"x"}


def repeats(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, *_), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [6_000_000, 600])
def test_suffixes(docs, rows, hot, monkeypatch):
    """Also where anchors count as hot from two segments on, so that they are narrowed."""
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 4000)
    found = suffixes.without_repeats(docs)
    assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(rows, 200)


def test_suffixes_of_a_very_long_text():
    """A text of more than 4 MiB that shares its slice with short ones is routed by the anchors of its own bytes."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    long = rng.integers(97, 123, (1 << 22) + 300_000).astype(np.uint8)
    again = long[-50_000:-20_000].tobytes()
    batch = pa.RecordBatch.from_pydict({"tid": pa.array([1, 2, 3]), "text": pa.array([long.tobytes().decode(), again.decode(), "short"])})
    rows = [r for part in suffixes._segments(200, 64)(iter([batch])) for r in part.to_pylist()]
    mine = {(r["h"], r["off"], r["seg"]) for r in rows if r["tid"] == 1 and r["start"] >= len(long) - 50_000}
    other = [(r["h"], r["off"], r["seg"]) for r in rows if r["tid"] == 2]
    # Segments within the shared string are the same, but for those cut off at its ends.
    assert len(other) > 100 and sum(x not in mine for x in other) <= 2
    # Each string of the long text is in a segment.
    assert {r["tid"] for r in rows} == {1, 2}
    covered = np.zeros(len(long), bool)
    for r in rows:
        if r["tid"] == 1:
            covered[r["start"] : r["start"] + r["n"]] = True
            assert r["start"] + r["n"] + 199 <= len(long)
    assert covered[: len(long) - 199].all()


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = np.append(rng.integers(1, rng.integers(2, 7), rng.integers(1, 300)), 0)
        expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffixes.suffix_array(text, 8, 10**6).tolist() == expected


def expected_copies(rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    out = []
    for d, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d is not None and d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(docs, rows):
    found = exact.exact_duplicates(docs, least=16, most=64)
    assert table(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected_copies(rows)


def test_exact_when_hashes_clash(docs, rows, monkeypatch):
    """With hashes of three bits, identifiers must come from the comparison of chunks."""
    real = exact._chunks

    def clashing(column, least, most):
        import pyarrow as pa
        import pyarrow.compute as pc

        hashes, chunks = real(column, least, most)
        return pa.ListArray.from_arrays(hashes.offsets, pc.bit_wise_and(hashes.values, 7)), chunks

    monkeypatch.setattr(exact, "_chunks", clashing)
    found = exact.exact_duplicates(docs, least=16, most=64)
    assert table(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected_copies(rows)


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    odd = "".join(chr(c) for c in range(1, 0x3000, 7)) + " 𝒳 \u0085   \r\n\t x'll 12½"
    frame = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(900, odd)], "doc_id long, text string"))
    expected = []
    for d, t in [*((d, t) for d, t, *_ in rows), (900, odd)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert table(bpe.digests(frame), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    back = bpe.decoded(bpe.encoded(frame))
    assert table(back, "doc_id", "text") == sorted(((d, t or "") for d, t in [*((d, t) for d, t, *_ in rows), (900, odd)]), key=repr)


def shingled(line, n=5):
    return {line} if len(line) <= n else {line[i : i + n] for i in range(len(line) - n + 1)}


def test_lines(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(8, 30)) for _ in range(150)]
    docs = []
    for d in range(120):
        picked = [rng.choice(base) for _ in range(rng.randint(0, 5))]
        docs.append((d, "\n".join(x if rng.random() < 0.6 else x.replace(" ", f" {rng.choice(WORDS)} ", 1) for x in picked)))
    docs += [(500, None), (501, "\n \n"), (502, "x\ny\r\nX"), (None, base[0]), (503, "z" * 5000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, gone int")
    flat = [(d, i, x.rstrip("\r").strip(" ").lower()) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    flat = [f for f in flat if f[2]]
    distinct = sorted({x for *_, x in flat})
    sets, links = [shingled(x) for x in distinct], set()
    for i in range(len(distinct)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links.add(frozenset((distinct[i], distinct[j])))
    decided = lines.decided(frame).collect()
    kept = {(r["doc_id"], r["at"]) for r in decided if r["kept"]}
    # One line of each text stays at most, the earliest of its group, and blank lines all stay.
    assert len({x for d, i, x in flat if (d, i) in kept}) == sum((d, i) in kept for d, i, _ in flat)
    assert all((r["doc_id"], r["at"]) in kept for r in decided if not any(f[:2] == (r["doc_id"], r["at"]) for f in flat))
    stay = {x for d, i, x in flat if (d, i) in kept}
    missed = [p for p in links if p <= stay]
    assert len(missed) <= 0.03 * len(links)
    # Nothing goes but what is linked, over other lines, to one that stays.
    near = collections.defaultdict(set)
    for p in links:
        for x in p:
            near[x] |= p
    reach, edge = set(stay), set(stay)
    while edge:
        edge = {y for x in edge for y in near[x]} - reach
        reach |= edge
    assert set(distinct) <= reach
    edited = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(frame).collect()}
    for d, t in docs:
        if t is not None and d is not None:
            assert edited[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in kept)


@pytest.mark.parametrize("few", [0, 64])
def test_lines_of_a_frequent_band(spark, monkeypatch, few):
    """Near copies are found also if they are neither the first of their band nor neighbours in length."""
    monkeypatch.setattr(lines, "FEW", few)
    rng = random.Random(11)
    template = "please read the terms of use "
    other = ["".join(rng.choice("bcdfghjkl") for _ in range(100)) for _ in range(30)]
    near = [(template + x, template + x[:40] + "#" + x[41:]) for x in other]
    near += [(template + x[:50] + y, template + x[:50] + "." + y) for x, y in zip(other, other[1:], strict=False)]
    frame = spark.createDataFrame([(i, x) for i, p in enumerate(near) for x in ["\n".join(p)]], "doc_id long, text string")
    # Every band holds all lines.
    monkeypatch.setattr(lines, "bands", lambda kept, *_: lines.F.array(lines.F.lit(1).cast("long")))
    sets = {x: shingled(x) for p in near for x in p}
    assert all(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for x, y in near)
    kept = [sum(r["kept"] for r in rs) for rs in _by_doc(lines.decided(frame).collect())]
    assert kept == [1] * len(near)


def _by_doc(rows):
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    return [found[d] for d in sorted(found)]


def test_lines_of_few_words(spark):
    """Lines of one word, also unspaced and repeated ones, are held to brute force."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghij0123456789/_") for _ in range(n))
    texts = ["=" * 40, "=" * 80, "all day long " * 5, "all day long " * 10, "abc", "abcd", "abcde"]
    for n in [200] * 20 + list(range(6, 60)):
        x = letters(n)
        texts += [x, x[:2] + "#" + x[3:], x + "#", x[: n // 2] + "#" + x[n // 2 :], "#" + x]
    texts = sorted({x.strip() for x in texts})
    found = spark.createDataFrame(list(enumerate(texts)), "lid long, norm string")
    found = {(r["a"], r["b"]) for r in lines.similar(found).collect()}
    sets, links = [shingled(x) for x in texts], set()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links.add((j, i))
    assert found <= links
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in found:
            root[i] = root[j] = min(root[i], root[j])
    missed = {p for p in links if root[p[0]] != root[p[1]]}
    assert len(missed) <= 0.01 * len(links)
    short = {p for p in links if min(len(sets[i]) for i in p) < lines.SHORT}
    assert len(short) > 20 and not short & missed
    assert not {(texts.index(x * 5), texts.index(x * 10)) for x in ("=" * 8,)} & missed
    assert not {(texts.index((x * 5).strip()), texts.index((x * 10).strip())) for x in ("all day long ",)} & missed


def test_rare_shingles_of_lines(spark, monkeypatch):
    """Similar lines share one also where many shingles are counted together, and only lines are moved for it."""
    monkeypatch.setattr(lines, "CELLS", 64, raising=False)
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(8, 30)) for _ in range(40)]
    texts = sorted({y for x in texts for y in (x, x[:30] + "#" + x[31:], x + " #")})
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, norm string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rare = lines.prefixes(frame)
        assert not re.search(r"hashpartitioning\((s|cell|lid#\d+L?, m)#", rare._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = collections.defaultdict(set)
    for r in rare.collect():
        keys[r["lid"]].add(r["s"])
    sets = [shingled(x) for x in texts]
    links = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(links) >= 40 and all(keys[i] & keys[j] for i, j in links)
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    assert links <= (near := set(table(lines.likely(pairs, frame), "a", "b")))
    assert len(near) <= 2 * len(links)


def test_open_bands_in_passes(spark, monkeypatch):
    """Rows of large open bands are compared a part at a time, and the parts find all links."""
    written, stored = [], lines.stored

    def counted(df, name):
        written.append(name)
        return stored(df, name)

    monkeypatch.setattr(lines, "stored", counted)
    rng = random.Random(17)
    texts = ["please read the terms of use " + "".join(rng.choice("bcdfghjkl") for _ in range(100)) for _ in range(40)]
    texts += [x[:60] + "#" + x[61:] for x in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, norm string")
    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(lines, "bands", lambda kept, *_: lines.F.array(lines.F.lit(1).cast("long")))
    found = {(r["a"], r["b"]) for r in lines.similar(frame).collect()}
    assert {(i, i + 40) for i in range(40)} <= found
    assert written.count("pairs") > 4


def test_shuffles_of_stored_frames_go(spark):
    """Shuffle files are deleted with the end of the write, and the session option stays as it was."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, option = files(), spark.conf.get(common.CLEANUP, None)
    made = common.stored(spark.range(10000).groupBy((lines.F.col("id") % 97).alias("k")).count(), "counts")
    assert made.count() == 97 and made.agg({"count": "sum"}).first()[0] == 10000
    assert spark.conf.get(common.CLEANUP, None) == option
    for _ in range(50):
        left = {f for f in files() - before if f.endswith(".data")}
        if len(left) <= 2:  # of the two counts above
            break
        time.sleep(0.2)
    assert len(left) <= 2


def test_lines_stay_in_the_jvm(docs):
    plan = lines.similar(lines.split(docs).where("lid is not null").groupBy("lid").agg({"norm": "first"}).toDF("lid", "norm"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def test_compact_windows():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 40, 300).astype(np.uint64) << np.uint64(22)
    values[50:60] = values[50]
    bounds, least = np.asarray([0, 0, 120, 140, 300]), 8
    found = set(zip(*(x.tolist() for x in passages.compact_windows(values, bounds, least)[1:]), strict=True))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b):
            for j in range(i + least - 1, b):
                c = i + int(np.argmin(values[i : j + 1]))
                assert sum(le <= i <= m == c <= j <= r for le, m, r in found) == 1


def test_shared_passages():
    """Shingles that also stand elsewhere, and worse surroundings, do not hide a passage."""
    x = np.arange(100, 160).astype(np.uint64)
    noise = np.arange(1000, 1080).astype(np.uint64)
    y = np.concatenate([x[20:21], noise, x])
    assert passages.shared_passages(x, y, 46, 0.8, 81) == [(0, 60, 81, 141)]
    # An exact part of the least length in a run that is less similar as a whole.
    long = x.copy()
    long = np.concatenate([long, np.arange(200, 320).astype(np.uint64)])
    other = long.copy()
    other[60:] = np.where(np.arange(120) % 9 < 8, long[60:], long[60:] + np.uint64(5000))
    other = np.concatenate([other[:100], noise, other[100:]])
    found = passages.shared_passages(long, other, 46, 0.8)
    assert any(a == 0 and b >= 60 and (c, d) == (a, b) for a, b, c, d in found)


def test_passages_with_shifts_across_lanes(spark):
    rng = random.Random(21)
    rows, n = [], 0
    for k in range(20):
        own = [f"w{k}x{i}" for i in range(60)]
        lead = lambda m: [f"q{rng.random()}" for _ in range(m)]  # noqa: E731, B023
        rows += [(n, " ".join(lead(3) + own + lead(5))), (n + 1, " ".join(lead(18) + own[:30] + ["new"] + own[30:] + lead(5)))]
        n += 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passage_report(frame).collect()
    assert sum(r["n_covered"] >= 50 for r in found) >= 36


@pytest.mark.parametrize("few", [0, 64])
def test_passages_beside_a_text_that_shares_less(spark, monkeypatch, few):
    """Two texts share a passage, whichever texts share only its middle words."""
    monkeypatch.setattr(passages, "FEW", few)
    rng = random.Random(31)
    rows = []
    for k in range(30):
        own, lead = [f"w{k}x{i}" for i in range(60)], lambda m: [f"q{rng.random()}" for _ in range(m)]
        parts = [own, own, *(own[i : i + 40] for i in range(0, 21, 2))]
        rows += [(100 * k + j, " ".join(lead(60) + part + lead(60))) for j, part in enumerate(parts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {r["doc_id"]: r["n_covered"] for r in passages.passage_report(frame).collect()}
    assert all(n == 0 for d, n in covered.items() if d % 100 > 1)
    assert sum(n >= 60 for d, n in covered.items() if d % 100 < 2) >= 58


def test_passages_longer_than_those_of_the_smallest_text(spark):
    """Two texts share 90 words, of which ten others have the first 60: all 90 are covered, not only what the others have."""
    rng = random.Random(41)
    rows = []
    for k in range(20):
        own, lead = [f"w{k}x{i}" for i in range(90)], lambda m: [f"q{rng.random()}" for _ in range(m)]
        rows += [(100 * k + j, " ".join(lead(60) + part + lead(60))) for j, part in enumerate([own, own, *[own[:60]] * 10])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {r["doc_id"]: r["n_covered"] for r in passages.passage_report(frame).collect()}
    assert all(n >= 60 for n in covered.values())
    assert all(n == 90 for d, n in covered.items() if d % 100 < 2)


def test_passages_store_no_row_for_each_shingle(spark, monkeypatch):
    monkeypatch.setattr(passages, "FEW", 0)
    written, stored = {}, passages.stored

    def counted(df, name):
        made = stored(df, name)
        written[name] = max(written.get(name, 0), made.count())
        return made

    monkeypatch.setattr(passages, "stored", counted)
    rng = random.Random(43)
    own, lead = [f"w{i}" for i in range(60)], lambda m: [f"q{rng.random()}" for _ in range(m)]
    rows = [(j, " ".join(lead(200) + part + lead(200))) for j, part in enumerate([own, own, *(own[i : i + 40] for i in range(0, 21, 2))])]
    passages.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(written.values()) < 100 * len(rows)


def test_passages(docs, rows):
    """Every passage of 50 words that stands in two different texts is found, and texts that share nothing are left alone."""
    low = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t, *_ in rows]
    owners = collections.defaultdict(set)
    for i, w in enumerate(low):
        for j in range(len(w) - 49):
            owners[tuple(w[j : j + 50])].add(i)
    near = collections.defaultdict(set)
    for i, w in enumerate(low):
        for j in range(len(w) - 4):
            near[tuple(w[j : j + 5])].add(i)
    found = collections.defaultdict(list)
    for r in passages.passage_report(docs).collect():
        found[(r["doc_id"], r["n_words"])].append(r)
    total = hit = 0
    for i, w in enumerate(low):
        covered = set().union(*(range(j, j + 50) for j in range(len(w) - 49) if len(owners[tuple(w[j : j + 50])]) > 1)) if len(w) >= 50 else set()
        most = max(r["n_covered"] for r in found[(rows[i][0], len(w))])
        total, hit = total + len(covered), hit + min(most, len(covered))
        if not any(len(near[tuple(w[j : j + 5])]) > 1 for j in range(len(w) - 4)):
            assert most == 0
    assert hit >= 0.97 * total


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["scumword", "trashword", "idiotword"]
    docs, marks = [], []
    for d in range(600):
        toxic = d % 5 == 0
        text = prose(rng, rng.randint(20, 80)) + (" " + " ".join(rng.choice(bad) for _ in range(3)) if toxic else "")
        docs.append((d, text))
        if d % 2 == 0:
            marks.append((d, int(toxic), None))
    docs += [(900, None), (901, ""), (None, bad[0]), (902, bad[0]), (902, bad[0])]
    marks += [(902, None, 1), (None, 1, 1), (77777, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    limits = toxicity.Limits(toxic=40, clean=100, features=32)
    found = toxicity.scored(frame, labels, limits).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)
    # Labels of held-out rows change nothing.
    turned = [(d, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 4 == 2 else t, q) for d, t, q in marks]
    again = toxicity.scored(frame, spark.createDataFrame(turned, "doc_id long, toxic int, quality int"), limits).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    nothing = toxicity.scored(frame, labels.limit(0), limits).collect()
    assert {r["score"] for r in nothing} == {0.0}
    assert toxicity.scored(frame.limit(0), labels, limits).count() == 0


def test_block_index_is_exact():
    rng = np.random.default_rng(5)
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    dense[dense.sum(axis=1) == 0, 0] = 1
    rows, at = np.nonzero(dense)
    index = toxicity.Index(np.arange(500), np.zeros(500, int), np.ones(500), rows, at, dense[rows, at], 40, 16)
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    for _ in range(50):
        q = rng.random(40) * (rng.random(40) < 0.2)
        f = np.flatnonzero(q)
        if len(f):
            cosine, near = index.nearest(f, q[f], 10)
            assert np.allclose(cosine, np.sort(unit @ q / np.linalg.norm(q))[::-1][: len(cosine)])
            assert len(near) == min(10, int((unit @ q > 1e-12).sum()))
