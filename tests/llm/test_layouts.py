"""Operators that lay rows out: archives, packing, chat, shards, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchwatch.llm import chat, label_shards, slack_packing, warc
from batchwatch.llm.catalog import QUERIES
from batchwatch.llm.tokens import codec, default_vocabulary
from batchwatch.storage import scratch

from .frames import PROSE, awkward, documents


# ── archives ──
def page_rows():
    big = "<p>ä" * 60_000  # several chunks, characters across their edges
    same = "x" * 1000
    return [(1, "http://a/1", same), (2, "http://a/2", same), (3, "http://a/3", same[:-1]), (4, "http://a/4", same[:-1]),
            (5, None, big), (6, "http://a b\r\n/6", big), (7, "http://a/7", None), (8, "", ""), (None, "http://a/9", same),
            (2, "http://a/2", same), (10, "http://a/10", "\r\n\r\nWARC/1.1\r\n\r\n" * 3)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumns(
        {"record_id": F.lit("clash"), "chunk_no": F.lit(1), "data": F.lit(None).cast("string")})
    chunks = warc.stored(warc.chunk_records(pages))
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == warc.CHUNK
    back = warc.read_archives(warc.write_archives(chunks, scratch(spark, "warc"))).collect()
    whole = defaultdict(list)
    for r in sorted(back, key=lambda r: r.chunk_no):
        whole[r.page_id, r.record_type, r.url].append(r)
    payload = {p: (h or "").encode() for p, _, h in page_rows()}
    last = [r for r in back if r.last]
    assert Counter(r.page_id for r in last) == Counter(p for p, _, _ in page_rows())
    for r in last:
        assert (r.payload_bytes, r.payload_digest) == (len(payload[r.page_id]), hashlib.sha1(payload[r.page_id]).hexdigest())
    types = {(r.page_id, r.record_type, r.refers_to) for r in last}
    assert types == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None),
                     (5, "revisit", 6), (6, "response", None), (7, "response", None), (8, "response", None),
                     (None, "revisit", 2), (10, "response", None)}
    for (page, kind, _), rows in whole.items():
        if kind == "response" and page != 2:
            assert b"".join(r.data for r in rows) == payload[page]
            digest = hashlib.sha1()
            for r in rows:
                digest.update(r.data)
                assert r.payload_digest == digest.hexdigest()


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chunks = warc.stored(warc.chunk_records(pages))
    assert warc.read_archives(warc.write_archives(chunks, scratch(spark, "warc"))).count() == 0


# ── tokens and packing ──
def reference_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text_become_their_ids_as_by_default(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = codec(default_vocabulary(), added=True)[0]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "<|endoftext", "plain words", ""]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for text in texts:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    rows = slack_packing.pieces(documents(spark, list(enumerate(texts)))).collect()
    for r in rows:
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_ids_are_those_of_the_library():
    encode, decode, free = codec(default_vocabulary())
    plain = reference_ids()
    texts = [t or "" for _, t in awkward()] + ["<|endoftext|> don't  'll\t\n  x", "  two  spaces \n b", "ñandú—¿qué? 12345 ##"]
    for text in texts:
        ids = encode(text)
        assert list(ids) == plain(text) and decode(list(ids)).decode() == text
    assert free == 50257


def test_fullest_equals_all_combinations():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randrange(1, 60)
        lengths = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        sums = {0}
        for n, c in lengths.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        chosen = slack_packing.fullest(lengths, room)
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < c <= lengths[n] for n, c in chosen.items())


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 101) for _ in range(3000))
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, first, last, bin_, copies, offset in slack_packing.plan(counts, 100):
        for rank in range(first, last):
            nth = rank - first
            bins[bin_ + nth // copies].append((offset + nth % copies * length, length))
            ranks[length].add(rank)
    assert {n: len(r) for n, r in ranks.items()} == counts
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert sorted(bins) == list(range(len(bins)))
    # no bin can hold two pieces of more than half its room
    large = sum(c for n, c in counts.items() if n > 50) + -(-counts[50] // 2)
    assert len(bins) <= max(large, -(-sum(n * c for n, c in counts.items()) // 100)) + 2


def test_packing_of_awkward_documents(spark):
    rows = awkward()
    got = slack_packing.pack(slack_packing.pieces(documents(spark, rows), with_ids=True)).collect()
    plain = reference_ids()
    want = Counter()
    for key, text in rows:
        ids = np.array([*plain(text or ""), 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) == -(-sum(r.length for r in got) // 1024)
    assert slack_packing.pack(slack_packing.pieces(documents(spark, []))).count() == 0


# ── chat ──
@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "</s>[INST] ok [/INST]", "<<s>s>", "a\\\\[INST]\\", "[/[INST]INST]"])
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "</s>[INST] ok \\ [/INST]"), (2, 5, None, None), (2, 5, "user", "b"),
             (2, 5, "user", "a"), (2, None, "assistant", "first 😀"), (None, 1, "assistant", PROSE), (3, 0, "assistant", "same"),
             (3, 0, "assistant", "same"), (4, 0, "</s>", "odd role")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns(
        {"ids": F.lit(1), "loss": F.lit("clash"), "turn_no": F.lit(9)})
    formatted = chat.format_turns(frame)
    assert formatted.where("turn_no = 0").selectExpr("ids[0] AS b").distinct().collect()[0].b == 50257 + chat.BEGIN
    got = {r.conv_id: r for r in chat.digests(chat.read_turns(formatted)).collect()}
    order = {1: turns[:2], 2: [turns[5], turns[2], turns[4], turns[3]], None: [turns[6]], 3: turns[7:9], 4: turns[9:]}
    assert set(got) == set(order)
    for key, rows in order.items():
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        written = len("<s>") + sum(len("[INST][/INST]</s>") + len(chat.escape(r or "")) + len(chat.escape(t or "")) for _, _, r, t in rows)
        assert got[key][1:] == (len(rows), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                                hashlib.sha256(loss.encode()).hexdigest(), written)
    assert chat.digests(chat.read_turns(chat.format_turns(frame.limit(0)))).count() == 0


# ── shards ──
@pytest.mark.parametrize("copies", [0, 3, 400])
def test_shards_are_even_and_keep_groups_that_fit(spark, copies):
    rows = awkward() + [(100 + k, f"text {k // 4}") for k in range(100)] + [(1000 + k, "hot") for k in range(copies)] + [
        (5000 + k, f"alone {k}") for k in range(600)]
    got = label_shards.shard_documents(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    text_of = dict(rows)
    shards, groups = defaultdict(list), defaultdict(Counter)
    for r in got:
        body = (text_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "rows", None)
        shards[r.shard].append(r.slot)
        if text_of[r.doc_id] is not None:
            groups[text_of[r.doc_id]][r.shard] += 1
    assert set(shards) <= set(range(8))
    sizes = [len(shards[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    split = [t for t, g in groups.items() if len(g) > 1]
    if copies < 400:
        assert not split
    else:  # more copies than a shard holds: most fill whole shards, and few other groups suffer
        assert sum(n for _, n in groups["hot"].most_common(3)) >= 0.8 * copies and len(split) <= 4


@pytest.mark.parametrize("copies,blocks", [(0, 2000), (500, 2000), (500, 40)])
def test_groups_stay_whole_where_every_row_has_copies(spark, monkeypatch, copies, blocks):
    monkeypatch.setattr(label_shards, "TOGETHER", blocks, raising=False)
    rows = [(k, f"text {k // 4}") for k in range(1200)] + [(5000 + k, "hot") for k in range(copies)]
    got = label_shards.shard_documents(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    slots, groups = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[dict(rows)[r.doc_id]][r.shard] += 1
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    # fewer cuts than shards, besides the group that no shard can hold
    assert sum(len(g) > 1 for t, g in groups.items() if t != "hot") < 8
    if copies:
        assert max(groups["hot"].values()) in (min(sizes), max(sizes))  # it fills a whole shard


def test_moves_are_admitted_within_room_and_full_shards_swap():
    assert label_shards.admitted([[0, 9], [9, 0]], [0, 0]) == [[0, 9], [9, 0]]
    assert label_shards.admitted([[0, 9], [4, 0]], [0, 0]) == [[0, 4], [4, 0]]
    assert label_shards.admitted([[0, 9], [4, 0]], [0, 2]) == [[0, 6], [4, 0]]
    assert label_shards.admitted([[0, 5, 0], [0, 0, 5], [5, 0, 0]], [0, 0, 0]) == [[0, 5, 0], [0, 0, 5], [5, 0, 0]]
    assert label_shards.admitted([[0, 9], [4, 0]], [3, -3]) == [[0, 4], [4, 0]]
    rng = random.Random(2)
    for _ in range(200):
        wanted = [[0 if a == b else rng.randrange(50) for b in range(5)] for a in range(5)]
        room = [rng.randrange(-5, 20) for _ in range(5)]
        flow = label_shards.admitted(wanted, room)
        for k in range(5):
            gain = sum(flow[s][k] for s in range(5)) - sum(flow[k])
            assert gain <= max(room[k], 0) and all(0 <= f <= w for f, w in zip(flow[k], wanted[k]))


# shares of the links that may be left cut: 8 shards of 75 hold 8 whole groups of 50, and none of 400
@pytest.mark.parametrize("groups,size,single,apart", [(150, 4, 0, 0.1), (12, 50, 0, 0.4), (150, 4, 600, 0.0), (3, 400, 0, 0.95)])
def test_rounds_move_rows_and_cut_fewer_links_each(spark, groups, size, single, apart):
    links = spark.range(groups * size).selectExpr("id AS node", f"concat('g', id div {size}) AS key")
    labels = links.selectExpr("node", "cast(pmod(node, 8) AS int) AS label")
    total = groups * size + single
    quotas = [total // 8 + (s < total % 8) for s in range(8)]
    cut = [label_shards.cut_links(links, labels, 8)]
    plain = defaultdict(list)
    for r in links.join(labels, "node").collect():
        plain[r.key].append(r.label)
    assert cut[0] == sum(a != b for g in plain.values() for k, a in enumerate(g) for b in g[k + 1:])
    for _ in range(5):
        moved = label_shards.propagate(links, labels, quotas, rounds=1, first=len(cut) - 1)
        assert moved.count() == groups * size
        loads = Counter(r.label for r in moved.collect())
        assert all(loads[s] <= quotas[s] * (1 + 1 / label_shards.SLACK) for s in range(8))
        cut.append(label_shards.cut_links(links, moved, 8))
        labels = moved
    assert cut[-1] <= apart * cut[0]
    assert cut[1] < cut[0] and max(cut) == cut[0]
    if size == 4:
        assert all(b <= a for a, b in zip(cut, cut[1:]))


def test_empty_table_has_no_shards(spark):
    assert label_shards.shard_documents(documents(spark, [])).count() == 0


# ── pipeline and contract ──
def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "quality", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    leaked = {r.doc_id for r in QUERIES["op2_decontamination"](spark, sf).collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in QUERIES["op8_near_dedup"](spark, sf).where("kept").collect()}
    assert not packed & leaked and len({texts[d] for d in packed}) == len(packed)
    clean = (good & kept) - leaked
    assert len(clean - packed) <= 0.05 * len(clean)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_awkward_rows_and_of_none(spark, tmp_path, empty):
    import corpus_pipeline

    rows = [] if empty else [*awkward(), *[(50 + k, f"{PROSE} again {k}") for k in range(12)]]
    docs = documents(spark, rows).withColumn("_key", F.lit("k")).withColumn("_score", F.lit(0)).withColumn("_language", F.lit(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [] if empty else [(k, k % 2, 0) for k in range(50, 62)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind stands here, nor anywhere else in these rows")],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {d for d, t in rows if t}


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries()
