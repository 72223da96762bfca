"""Conversation trie, source divergence and fingerprints against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import SMALL, frame, odd_rows, rows_of, small_documents, with_clashes, words
from pyspark.sql import types as T

from kickoff.llm import fingerprints, prefix_trie, source_divergence

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_id(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, turn_id(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        key = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(key) + 1):
            members[key[:d]].append(c)
        ends[key].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, found in members.items():
        count = (len(found) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += count
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=repr)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), 150):  # many share first turns, many are equal, a few are long
        rows += [(c, t, "user" if t % 2 == 0 else None, f"say {rng.randrange(1 + t % 3)} again") for t in range(rng.choice([1, 2, 3, 5, 5, 5, 40]))]
    rows += [(1000 + i, 0, "user", f"only {i}") for i in range(400)]  # nodes of all layouts
    rows += [(7, None, "user", None), (7, None, None, ""), (None, 1, "user", "no conversation"), (7, 3, "a", "b"), (7, 3, "a", "b"), (2000, 0, "", " \t"), (2001, 0, "one", "turn")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_prefix_trie(spark, ranges):
    for rows in (talks(3), [(5, 0, "user", "hi there")], [(20, 0, "a", "b"), (25, 0, "c", "d"), (25, 1, "e", "f")]):
        got = rows_of(prefix_trie.prefix_trie(with_clashes(spark.createDataFrame(rows, TURNS)).repartition(5), ranges), *NODE)
        assert got == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], TURNS)).collect() == []


def test_equal_conversations_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [(c, 0, "user", "hello") for c in random.Random(1).sample(range(5000), 300)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(6)), *NODE) == brute_trie(rows)


def test_radix_tree_layouts():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice((rng.randrange(256), 7)) for _ in range(2 * rng.randrange(9))) for _ in range(3000)} - {b""})
    rng.shuffle(keys)
    tree = prefix_trie.Tree()
    for i, key in enumerate(keys):
        tree.add(key, i)
    seen, path = {}, []
    for depth, parent, some, end in tree.turns(2):
        path.append(keys[some][:2 * depth])
        assert parent < 0 or path[-1][:-2] == path[parent]
        if end is not None:
            seen[path[-1]] = end
    assert {keys[i]: i for i in seen.values()} == {k: i for i, k in enumerate(keys)} and all(keys[i] == k for k, i in seen.items())
    assert len(path) == len(set(path)) == len({k[:2 * d] for k in keys for d in range(len(k) // 2 + 1)})
    rooms, left = set(), [tree.root]
    while left:
        node = left.pop()
        rooms.add(node.room)
        left += [c for _, c in node.children()]
        assert all(node.child(b) is c for b, c in node.children())
    assert rooms == {4, 16, 48, 256}


def brute_divergence(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for lang, source, text in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for lang, source, found in rows:
        docs.update((lang, w) for w in set(found))
        counts.update((lang, source, w) for w in found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        total = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        share = lambda n, t: 1 + 10 ** 9 * (n + 1) // (t + len(kept))  # noqa: E731, B023
        p = {(s, w): share(counts[lang, s, w], total[s]) for s in sources for w in kept}
        q = {w: share(sum(counts[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(t, sum(f(p[s, w], p[t, w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(p[s, w], q[w])) for w in kept if counts[lang, s, w] and p[s, w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def sourced():
    rng = random.Random(5)
    texts = [" ".join(f"W{rng.choice('abcé')}{rng.choice('xyzß')}" for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]), t) for t in texts]
    return rows + [("en", "none", None), ("xx", "lone", "few words"), ("xx", "other", "12 34"), ("en", "a", "İK ſ K" * 40), ("yy", "only", "one one one")] + rows[:3]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # blocks, chunks and pieces of a few terms
        for name, value in (("BLOCK", 20), ("CHUNK", 2), ("PIECE", 5), ("PAIRS", 7)):
            monkeypatch.setattr(source_divergence, name, value)
    schema = "lang string, source string, text string"
    for rows in (sourced(), [("en", "s", "a b c")], []):
        docs = spark.createDataFrame(rows, schema)
        for c in ("n", "term", "gid", "base", "total", "terms", "shard", "first", "doc_id"):
            docs = docs.withColumn(c, docs.lang)
        assert rows_of(source_divergence.divergence(docs.repartition(4), 3, 4), *AUDIT) == brute_divergence(rows, 3, 4)


def test_divergence_of_odd_and_given_documents(spark):
    for docs in (frame(spark, odd_rows()), small_documents(spark)):
        rows = [(r.lang, r.source, r.text) for r in docs.collect()]
        assert rows_of(source_divergence.divergence(docs), *AUDIT) == brute_divergence(rows, 3, 200)


def brute_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        same = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), same(t, e), same(t, u), t, e, u))
    return out


def spans(t, k=fingerprints.SPAN):
    return {t[i:i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t} - {""}


@pytest.mark.parametrize("group", [1 << 20, 300])
def test_edited_fingerprints(spark, monkeypatch, group):
    monkeypatch.setattr(fingerprints, "GROUP", group)
    for rows in (odd_rows(), [(3, "alone here")], [(i % 7, " ".join(words(40, i % 11))) for i in range(90)], [(r.doc_id, r.text) for r in small_documents(spark).collect()], []):
        got = fingerprints.edited_fingerprints(with_clashes(frame(spark, rows)).repartition(3)).collect()
        want = brute_edits(rows)
        key = lambda r: repr((r[0], r[1], r[2], r[3], r[4]))
        assert sorted(key((r.doc_id, r.n_chars, r.edited_sha256, r.common_edited, r.common_next)) for r in got) == sorted(map(key, want))
        made = fingerprints.Prefixes([t for *_, t, _, _ in want] + [e for *_, e, _ in want]) if want else None
        prints = made.fingerprints(made.sketches()) if want else []
        n = len(want)
        expected = sorted((w[0] is None, w[0] or 0, prints[i], prints[n + i], fingerprints.likeness(prints[i], prints[n + i]), fingerprints.likeness(prints[i], prints[(i + 1) % n])) for i, w in enumerate(want))
        assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == expected


def test_likeness_estimates_the_shared_spans():
    errors = []
    for cut in range(0, 2400, 40):
        base = " ".join(words(400, cut + 1, 5000))
        other = base[:cut] + " ".join(words(400, cut + 2, 5000))[cut:]
        made = fingerprints.Prefixes([base, other, base])
        a, b, c = made.fingerprints(made.sketches())
        assert a == c and fingerprints.likeness(a, c) == 1
        errors.append(fingerprints.likeness(a, b) - len(spans(base) & spans(other)) / len(spans(base) | spans(other)))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_spans_and_extensions():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé漢\0") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "x" * 50]
    made, whole = fingerprints.Prefixes(texts), "".join(texts)
    i, j = (np.array([rng.randrange(len(whole)) for _ in range(2000)]) for _ in range(2))
    limit = np.minimum(20, len(whole) - np.maximum(i, j))
    want = [next((n for n in range(m) if whole[a + n] != whole[b + n]), m) for a, b, m in zip(i, j, limit)]
    assert made.extension(i, j, limit).tolist() == want
    assert made.equal(i, j, limit).tolist() == [whole[a:a + m] == whole[b:b + m] for a, b, m in zip(i, j, limit)]
    a, b = (np.array([rng.randrange(2 ** 61 - 1) for _ in range(500)], dtype=np.uint64) for _ in range(2))
    assert fingerprints.times(a, b).tolist() == [int(x) * int(y) % (2 ** 61 - 1) for x, y in zip(a, b)]
