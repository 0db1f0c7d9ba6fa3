"""Document fingerprints, the prefix trie of conversations and the source audit, each against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from batchwatch.llm import prefix_hashes as P
from batchwatch.llm import source_audit as A
from batchwatch.llm import zfast_trie as Z
from batchwatch.llm.perfect_hash import PerfectHash

from .frames import PROSE, awkward, documents


# --- prefix hashes


def test_spans_and_extensions_equal_plain_comparison():
    rng = random.Random(3)
    text = "".join(rng.choice("abé😀 ") for _ in range(300))
    prefixes = P.PrefixHashes(P.code_points(text))
    for _ in range(800):
        i, j = rng.randrange(300), rng.randrange(300)
        n = rng.randrange(min(4, 301 - max(i, j)))
        assert prefixes.same(i, prefixes, j, n) == (text[i:i + n] == text[j:j + n])
        longest = 0
        while max(i, j) + longest < 300 and text[i + longest] == text[j + longest]:
            longest += 1
        assert prefixes.common_extension(i, prefixes, j) == longest


def plain_likeness(a, b):
    one, two = ({t[max(0, k - P.SPAN):k] for k in range(1, len(t) + 1)} for t in (a, b))
    return 1.0 if a == b else len(one & two) / len(one | two)


def test_short_texts_have_exact_likeness_and_long_ones_an_estimate():
    rng = random.Random(4)
    for n, off in ((0, 1e-9), (1, 1e-9), (5, 1e-9), (30, 1e-9), (48, 1e-9), (700, 0.2), (5000, 0.2)):
        text = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for cut in (0, n // 4, n // 2, n):
            other = text[:n - cut] + "".join(rng.choice("abcdefgh ") for _ in range(cut))
            prints = [P.PrefixHashes(P.code_points(t)).fingerprint() for t in (text, other)]
            assert (prints[0] == prints[1]) == (text == other)
            assert abs(P.likeness(*prints) - plain_likeness(text, other)) <= off
    assert len(P.PrefixHashes(P.code_points("ab" * 4000)).fingerprint()) == 16 + 4 * (P.SPAN + 1)


def expected_fingerprints(rows):
    """Rows in the order of ids; ties are not distinguished."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(rows)]
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    P.PrefixHashes(P.code_points(text)).fingerprint().hex(),
                    P.PrefixHashes(P.code_points(edited)).fingerprint().hex()))
    return out


@pytest.mark.parametrize("range_bytes", [64_000_000, 3_000])
def test_fingerprints_of_awkward_rows(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(P, "RANGE_BYTES", range_bytes)
    rows = [r for r in awkward() if r != (2, PROSE)] + [(2, PROSE), (2, PROSE), (40, "abcdefgh"), (41, None), (42, "zyxw")]
    got = P.fingerprint_documents(documents(spark, rows)).collect()
    want = expected_fingerprints(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.common_start >= r.n_chars - r.n_chars // 4
    assert {r.near_next for r in got if r.doc_id == 1} == {1.0}
    assert P.fingerprint_documents(documents(spark, [])).count() == 0
    alone = P.fingerprint_documents(documents(spark, [(7, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


# --- z-fast trie


def plain_trie(turns):
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for own in by_conv.values():
        own.sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    rebuilt = {}
    for conv, own in by_conv.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        rebuilt[conv] = tuple(t[2:] for t in by_conv.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for conv, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    out = []
    for node, convs in members.items():
        children = [n for n in members if len(n) == len(node) + 1 and n[:len(node)] == node]
        subtree = [n for n in members if n[:len(node)] == node]
        leaves = [n for n in subtree if not any(m[:len(n)] == n and len(m) > len(n) for m in subtree)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n)
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    """With extra columns of names used inside."""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("pos", "depth", "seq", "key", "slice", "row_no", "node", "position", "size"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def some_turns(rng, n):
    rows = []
    for conv in rng.sample(range(-30, 400), n):
        shared = rng.random() < 0.5  # many conversations begin alike
        for turn in range(rng.choice((0, 1, 2, 3, 7, 12))):
            text = "same start" if shared and turn < 4 else rng.choice(("yes", "no", "", None, "w" * turn))
            rows.append((conv, rng.choice((turn, turn, None)), rng.choice(("user", "assistant", None)) if turn > 3 else "user", text))
    return rows


def test_trie_of_small_batches_and_groups_equals_brute_force(spark):
    rng = random.Random(5)
    rows = some_turns(rng, 70)
    rows += rows[:9] + [(None, 0, "user", "nobody"), (100, 0, "user", None), (500, None, None, None)]
    rows += [(k, t, "user", "copy") for k in range(600, 640) for t in range(3)]  # copies of one conversation
    rows += [(700, t, "user", "long") for t in range(40)] + [(800 + k, t, "user", "long") for k in range(12) for t in range(3 * k)]
    want = plain_trie(rows)
    for batch, group in ((4, 3), (4000, 2000)):
        got = sorted((tuple(r) for r in Z.prefix_trie(conversations(spark, rows), batch, group).collect()), key=str)
        assert got == want


def test_trie_of_nothing(spark):
    assert Z.prefix_trie(conversations(spark, [])).count() == 0
    assert Z.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    got = [tuple(r) for r in Z.prefix_trie(conversations(spark, [(7, None, None, None)])).collect()]
    assert sorted(got) == plain_trie([(7, None, None, None)])


def test_exits_equal_longest_common_prefixes():
    rng = random.Random(6)
    for _ in range(60):
        words = {tuple(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(30)}
        coded = {}
        for w in words:
            data, last = b"", Z.ROOT
            for c in w:
                last = hashlib.md5(last + c.encode()).digest()
                data += last
            coded[w] = Z.Prefixes(data)
        trie, inside = Z.ZFastTrie(), []
        for w in words:
            longest = max((len([1 for k in range(min(len(w), len(o))) if w[:k + 1] == o[:k + 1]]) for o in inside), default=0)
            assert trie.locate(coded[w])[1] == longest
            trie.insert(coded[w])
            inside.append(w)
        assert len(trie.handles) == len(trie.depth) - 1
        for w in words:
            node, depth = trie.locate(coded[w])
            assert depth == len(w) == trie.depth[node] and trie.path(node)[-1] == len(w)


# --- source audit


def test_perfect_hash_gives_each_term_a_slot_and_refuses_others():
    for n in (0, 1, 2, 100, 5000):
        words = [b"w%d" % k for k in range(n)]
        made = PerfectHash(words)
        slots = made.slots(words).tolist()
        assert sorted(slots) == list(range(n)) and [made.term(s) for s in slots] == words
        assert (made.slots([b"x%d" % k for k in range(3000)]) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def plain_audit(rows, least=3, top=200):
    found = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(
        "[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in found}:
        documents_of = Counter(t for g, _, terms in found if g == lang for t in set(terms))
        kept = {t for t, n in documents_of.items() if n >= least}
        counts = defaultdict(Counter)
        for g, source, terms in found:
            if g == lang:
                counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())

        def share(of, t):
            return 1 + A.WHOLE * (of[t] + 1) // (sum(of.values()) + len(kept))

        for source, own in counts.items():
            parts = {"pair": [], "term": []}
            for other, theirs in counts.items():
                if other != source:
                    parts["pair"].append((-sum((share(own, t) - share(theirs, t)) ** 2 // share(theirs, t) for t in kept), other))
            for t in kept:
                p, q = share(own, t), share(whole, t)
                if own[t] and p > q:
                    parts["term"].append((-((p - q) ** 2 // q), t))
            for part, values in parts.items():
                ranked = sorted(values, key=lambda v: (v[0], v[1].encode()))
                out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def sourced(spark, rows):
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    for name in ("term", "n", "gid", "slot", "part", "block", "value"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def test_audit_equals_brute_force_with_many_small_shards_rounds_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Über", "ÉTÉ", "straße", "語"]
    rows = []
    for k in range(160):
        words = [rng.choice(vocabulary[:rng.choice((5, 40, 124))]) for _ in range(rng.choice((0, 3, 60)))]
        rows.append((rng.choice(("en", "en", "en", "de", None)), rng.choice(("a", "a", "a", "b", "c", None)), "1,".join(words)))
    rows += [("fr", "only", "never twice"), ("it", "a", "solo"), ("it", "b", None), ("en", "hot", "spam " * 900)] + rows[:5]
    want = plain_audit(rows)
    got = A.audit_sources(sourced(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == want
    for name, value in (("SHARD_TERMS", 9), ("ROUND_BYTES", 6_000), ("HELD", 50), ("BLOCK_COUNTS", 60)):
        monkeypatch.setattr(A, name, value)
    assert sorted(tuple(r) for r in A.audit_sources(sourced(spark, rows), top=7).collect()) == plain_audit(rows, top=7)


def test_audit_of_nothing_and_of_counts_beyond_64_bits(spark):
    assert A.audit_sources(sourced(spark, [])).count() == 0
    import numpy as np

    counts = np.array([0, 10**12, 7 * 10**12], np.int64)
    assert A.shares(counts, 9 * 10**12).tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**12) for c in counts]
