"""Chat formatting, the manifest and the trie against brute force, on small frames with every awkward row."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from platewise.llm import chat, manifest, trie
from platewise.llm.common import prepare
from platewise.llm.ranks import ranked

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, place string, ids string, size int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, leaf string, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- places ---------------------------------------------------------------------


def test_places_of_a_group_over_many_tasks(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = [("big", rng.randint(0, 50)) for _ in range(3000)] + [(f"g{i % 40}", None if i % 9 == 0 else i % 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, o long").repartition(7)
    found = collections.defaultdict(list)
    for r in ranked(frame, "g", ["o"], "test").collect():
        found[r["g"]].append((r["place"], -1 if r["o"] is None else r["o"]))
    for g, places in found.items():
        places.sort()
        assert [p for p, _ in places] == list(range(sum(r[0] == g for r in rows)))
        assert [o for _, o in places] == sorted(o for _, o in places)


# ---- manifest -------------------------------------------------------------------


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out.append((level[first:at], level[at + 1 : first + fanout]))
        at //= fanout
    return out


def brute_manifest(rows, fanout):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        made = sorted((r[0] is not None, r[0] or 0, leaf(*r[:5]), r) for r in by[g])
        trees[g] = ([m[3] for m in made], levels([m[2] for m in made], fanout))
    top = levels([trees[g][1][-1][0] for g in order], fanout)
    root, out = top[-1][0], []
    for n, g in enumerate(order):
        docs, tree = trees[g]
        for at, r in enumerate(docs):
            steps = siblings(tree, at, fanout) + siblings(top, n, fanout)
            now = tree[0][at]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4] + 1)
            for left, right in steps:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join(x for left, right in steps for x in [*left, *right]))
            out.append((r[0], tree[0][at], tree[-1][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def documents(seed, n, langs):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "one", "ünï 漢字 😀", "a" * 300, f"text {i}"])
        rows.append((i * 3, text, rng.choice(langs), rng.choice([None, "web", ""]), rng.choice([None, 0, 41])))
    rows += [rows[0], rows[0], (rows[1][0], "another text", *rows[1][2:])]  # repeated rows, one id twice
    rows += [(None, "no id", "en", "web", 3), (None, None, None, None, None), (10**15, "long " * 40000, langs[0], "w", 200000)]
    return [(*r, "x", 1, "y", 2) for r in rows]


@pytest.mark.parametrize(("n", "fanout", "deep"), [(2, 2, 3), (130, 2, 3), (130, 2, 1), (70, 3, 2)])
def test_manifest(spark, n, fanout, deep):
    prepare(spark)
    rows = documents(n, n, ["en", "de", None, "", "fr", "é"])
    rng = random.Random(3)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = manifest.proofs(frame, fanout, deep)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == columns
    made = table(found, *columns)
    assert made == brute_manifest(rows, fanout)
    # A row fails if and only if something was changed.
    hit = {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert all(m[6] for m in made if m[0] not in hit)


def test_manifest_of_one_and_no_row(spark):
    prepare(spark)
    row = (1, "t", "en", "s", 1, "x", 1, "y", 2)
    frame = spark.createDataFrame([row], DOCUMENTS)
    only = manifest.proofs(frame).first()
    assert only["leaf"] == only["subroot"] == only["root"] == leaf(*row[:5])
    assert only["proof_sha256"] == sha("") and only["verified"]
    assert manifest.proofs(frame.limit(0)).count() == 0


def test_paths_lead_to_the_root(spark):
    """The operator's own output: any other leaf on the same path leads elsewhere."""
    prepare(spark)
    frame = spark.createDataFrame([(i, "en" if i % 3 else "de", sha(str(i))) for i in range(40)], "doc_id long, lang string, leaf string")
    for r in manifest.manifest(frame, ["doc_id"]).collect():
        for start, right in ((r["leaf"], True), (sha("other"), False)):
            now = start
            for step in r["path"]:
                now = sha(step["left"] + now + step["right"])
            assert (now == r["root"]) is right


# ---- chat -----------------------------------------------------------------------


def conversations(seed=2):
    rng = random.Random(seed)
    odd = ["", None, "<|im_end|>", "<\\|im_end|>", "<\\\\|x<|", "a<", "|>", "\n\n", "  two  ", "漢字 😀 é", "<|endoftext|> x", "it's <<|", "\\"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "<|im_end|>", "a\nb"]), rng.choice([*odd, "plain words " * rng.randint(1, 9)])))
    rows += [(50, 0, "assistant", "word " * 30000), (50, 1, "user", "x" * 5000), (50, 2, "assistant", "😀 ok " * 20000), (50, 3, "assistant", "<|" * 9000)]
    rows += [(60, None, "user", "first"), (60, 0, "assistant", "second"), (60, 0, "assistant", "second"), (None, 1, "assistant", "no id")]
    rows += [(70, i, "user" if i % 2 else "assistant", f"hot {i}") for i in range(1500)]
    rng.shuffle(rows)
    return [(*r, 1, "p", "i", 9) for r in rows]


def by_conversation(rows):
    out = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in out.items()}


@pytest.mark.parametrize("limit", [chat.PIECE, 3000])
def test_chat(spark, limit):
    prepare(spark)
    rows = conversations()
    frame = chat.with_intruder(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    turns = by_conversation(rows) | {-1: [("user", chat.INTRUDER), ("assistant", chat.INTRUDER)]}
    expected = []
    for c, said in turns.items():
        trained = "".join(text for role, text in said if role == "assistant")
        length = sum(32 + len(chat.escape(role)) + len(chat.escape(text)) for role, text in said)
        expected.append((c, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(trained), sha(trained), length))
    found = chat.digests(chat.formatted(frame, limit=limit))
    assert table(found, *found.columns) == sorted(expected, key=repr)


def test_parts_are_those_of_the_whole(spark):
    """Texts, ids and mask of a conversation's parts, joined, equal those of the conversation encoded at once."""
    prepare(spark)
    rows = [r for r in conversations() if r[0] in (3, 4, 50)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    made = collections.defaultdict(list)
    for r in chat.formatted(frame, limit=2000).orderBy("conv_id", "part").collect():
        made[r["conv_id"]].append(r)
    tokenizer = chat.encoder(chat.default_path(), chat.CHAT)
    assert len(made[50]) > 20
    for c, said in by_conversation(rows).items():
        text, spans = "", []
        for role, words in said:
            text += f"<|im_start|>{chat.escape(role)}<|im_sep|>"
            if role == "assistant":
                spans.append((len(text), len(text) + len(chat.escape(words))))
            text += chat.escape(words) + "<|im_end|>"
        whole = tokenizer.encode(text, add_special_tokens=False)
        under = [any(a < e and b > s for s, e in spans) for a, b in whole.offsets]
        assert "".join(r["text"] for r in made[c]) == text
        assert [i for r in made[c] for i in r["ids"]] == whole.ids
        assert [m for r in made[c] for m in r["loss"]] == under
        # No mark is trained on, and what is trained on decodes to the texts.
        own = [tokenizer.token_to_id(m) for m in chat.CHAT.marks]
        trained = [i for r in made[c] for i, m in zip(r["ids"], r["loss"], strict=True) if m]
        assert not set(own) & set(trained)
        assert chat.unescape(tokenizer.decode(trained, skip_special_tokens=False)) == "".join(t for role, t in said if role == "assistant")


def test_escaping_is_reversible():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>a") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)


def test_masks_by_binary_search():
    rng = np.random.default_rng(4)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 15))
        starts, stops = cuts[:-1], cuts[1:]
        edges = np.unique(rng.integers(0, 60, 6))
        spans = [(int(a), int(b)) for a, b in edges[: len(edges) // 2 * 2].reshape(-1, 2)] + [(59, 59)]
        expected = [any(a < e and b > s for s, e in spans if s < e) for a, b in zip(starts, stops, strict=True)]
        assert chat.aligned(starts, stops, spans).tolist() == expected


def test_no_conversations(spark):
    prepare(spark)
    frame = spark.createDataFrame([], CONVERSATIONS)
    assert chat.digests(chat.formatted(frame)).count() == 0
    assert [r["conv_id"] for r in chat.digests(chat.formatted(chat.with_intruder(frame))).collect()] == [-1]
    assert trie.trie(frame).count() == 0


# ---- trie -----------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), children[p], leaves[p], saved[p], sha(ends)))
    return sorted(out, key=repr)


def dialogues(seed):
    rng = random.Random(seed)
    words = ["hi", "", None, "how are you", "漢字 😀", "a:b"]
    rows = []
    for c in [*range(0, 260), 300, 405, 407, 512, 10**12 + 100, 10**12 + 107]:
        n = rng.randint(1, 9)
        start = 5 if c % 17 == 0 else 0  # turns need not begin at 0
        rows += [(c, start + t, rng.choice(["user", "assistant", None]), rng.choice(words if t > 1 else words[:2])) for t in range(n)]
    rows += [(301, t, "user", f"turn {t % 3}") for t in range(300)] + [(302, t, "user", f"turn {t % 3}") for t in range(300)]
    rows += [(303, None, "user", "unnumbered"), (303, 0, "user", "first"), (303, 0, "user", "first"), (303, 1, "user", "x" * 100000)]
    rows += [(304, 1, "user", "tie a"), (304, 1, "user", "tie b"), (None, 0, "user", "no id")]
    rng.shuffle(rows)
    return [(*r, 1, "p", "i", 9) for r in rows]


@pytest.mark.parametrize("run", [trie.RUN, 16])
def test_trie(spark, monkeypatch, run):
    prepare(spark)
    monkeypatch.setattr(trie, "RUN", run)
    rows = dialogues(run)
    found = trie.trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    assert table(found, *found.columns) == brute_trie(rows)


def test_trie_when_the_sketch_is_crowded(spark, monkeypatch):
    """Estimates above one prove nothing, so a sketch that is too small changes no result."""
    prepare(spark)
    rows = dialogues(5)
    monkeypatch.setattr(trie, "LEAST_CELLS", 256)
    monkeypatch.setattr(trie, "MOST_CELLS", 256)
    monkeypatch.setattr(trie, "SEGMENT", 64)
    found = trie.trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert table(found, *found.columns) == brute_trie(rows)


def test_trie_of_one_conversation(spark):
    prepare(spark)
    rows = [(3, 0, "user", "hello", 1, "p", "i", 9)]
    found = trie.trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert table(found, *found.columns) == brute_trie(rows)


def test_sketch_never_underestimates(spark):
    prepare(spark)
    rng = random.Random(6)
    pairs = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(4000)]
    rows = pairs + pairs[:1000] + pairs[:300]
    frame = spark.createDataFrame([(*p, *p) for p in rows], "p1 long, p2 long, q1 long, q2 long").repartition(5)
    seen = collections.Counter(rows)
    wrong = 0
    for r in trie.screened(frame, 1 << 16).collect():
        many = seen[(r["p1"], r["p2"])] > 1
        assert r["shared"] == r["parent_shared"] and (r["shared"] or not many)
        wrong += r["shared"] and not many
    assert wrong < 10
