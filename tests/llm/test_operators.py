"""The operators against brute-force versions, round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from findloom.llm import common, decontamination, graph, language, media, packing, quality, simhash, substring, urls, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- simhash ----------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one TWO", "A b c", "a b c d e a b c", "Äöü É x y z", "x y z a b", "w " * 500):
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [50_000, 30])
def test_trie_join_finds_every_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SUBTRIE_ROWS", limit)
    rng = random.Random(1)
    values = {0, (1 << 64) - 1, 1, 3, 7, 15}
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    base = rng.getrandbits(64)
    values |= {base ^ (1 << a) ^ (1 << b) for a in range(48, 64) for b in range(16)}  # many in few subtries
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    linked = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    found = {r["node"]: r["component"] for r in graph.connected_components(simhash.trie_edges(fps)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == components(len(values), linked)


def test_near_duplicates_and_keeping(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(300)) for _ in range(3)]
    texts = [base[0], base[1], base[0] + " end", base[1], None, "", base[2], "short"]
    df = docs_of(spark, texts).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    linked = [(i, j) for i in range(8) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got == dict(enumerate(zip(fps, components(8, linked), strict=True)))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(8, linked)))


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " ", "one two", "One  TWO", "one three"]
    for n in (6, 25, 60, 120, 300):
        for _ in range(8):
            base = [word() for _ in range(n)]
            for edits in range(0, 1 + n // 20):
                copy = list(base)
                for k in rng.sample(range(n), edits):
                    copy[k] = word()
                texts.append(" ".join(copy))
    common = " ".join(word() for _ in range(40))  # a passage of many texts, which are no copies
    texts += [common + " " + " ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(60)]
    rng.shuffle(texts)
    sets = [slow_shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    apart = [(i, j) for i, j in linked if (slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).bit_count() > 3]
    assert len(apart) > 100  # op3's links would not find them
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs_of(spark, texts)).collect())
    assert kept == sorted(set(components(len(texts), linked)))


@pytest.mark.parametrize("limit,hub", [(50_000, 1_000), (50_000, 10), (30, 10)])
def test_trie_cells_join_every_link_of_a_block(spark, monkeypatch, limit, hub):
    monkeypatch.setattr(simhash, "SUBTRIE_ROWS", limit)
    monkeypatch.setattr(simhash, "HUB_ROWS", hub)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    monkeypatch.setattr(simhash, "ONE_IN", 1)
    rng = random.Random(7)
    flip = lambda x, share: x ^ sum(1 << b for b in range(64) if rng.random() < share)
    rows = [[rng.getrandbits(64) for _ in range(2)] for _ in range(20)]
    rows += [[flip(x, share) for x in base] for base in rows[:3] for share in (0.03, 0.1, 0.2) for _ in range(20)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([([signed(x) for x in row], i) for i, row in enumerate(rows)], "prints array<long>, rep long")
    met = defaultdict(set)
    for r in simhash.trie_cells(df).collect():
        met[r["cell"]].add(r["rep"])
    assert all(len(reps) > 1 for reps in met.values())
    together = {pair for reps in met.values() for pair in combinations(sorted(reps), 2)}
    linked, near = set(), defaultdict(list)
    for i, j in combinations(range(len(rows)), 2):
        for k in range(2):
            x = rows[i][k] ^ rows[j][k]
            for block in range(4):
                if x.bit_count() <= simhash.NEAR_BUDGET and not x >> 16 * block & 0xFFFF:
                    linked.add((i, j))
                    near[k, block].append((i, j))
    assert len(linked) > 300 and linked <= together
    if limit > 30:  # an undivided subtrie has whole components, and nothing else is in its cells
        want = set()
        for pairs in near.values():
            label = components(len(rows), pairs)
            want |= {(i, j) for i, j in combinations(range(len(rows)), 2) if label[i] == label[j]}
        assert together == want


def test_near_copies_come_by_fingerprints_and_trie(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "x", *words[101:]]), "q w e r t y u i", "q w e r t y u i o"]
    assert [r["doc_id"] for r in simhash.keep_one_of_each(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 2]
    found = simhash.trie_cells
    monkeypatch.setattr(simhash, "trie_cells", lambda prints: found(prints).limit(0))
    assert [r["doc_id"] for r in simhash.keep_one_of_each(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 2]


def test_fingerprints_miss_few_near_copies():
    rng = np.random.default_rng(9)
    missed = 0
    for common, own in ((5, (0, 1)), (16, (2, 2)), (80, (10, 10)), (80, (0, 20)), (400, (50, 50))):
        sets = [rng.integers(0, 1 << 63, common + sum(own), dtype=np.uint64) * np.uint64(2) for _ in range(1000)]
        sets = [s ^ (s >> np.uint64(31)) for s in sets]
        a = simhash.fingerprints([s[: common + own[0]] for s in sets])
        x = a ^ simhash.fingerprints([np.concatenate((s[:common], s[common + own[0] :])) for s in sets])
        agree = sum((x >> np.uint64(16 * r)) & np.uint64(0xFFFF) == 0 for r in range(4))
        missed += int((np.sum(agree * (np.bitwise_count(x) <= simhash.NEAR_BUDGET), axis=1) == 0).sum())
    assert missed <= 3


def semi_join_rows(spark, run):
    """The most rows that a left semi join of ``run`` makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    made = [0]
    executions = store.executionsList(before, 10_000)
    for execution in map(executions.apply, range(executions.size())):
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and "LeftSemi" in node.desc():
                metrics = map(node.metrics().apply, range(node.metrics().size()))
                told = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                made += [int(x.get().replace(",", "")) for x in told if x.isDefined()]
    return max(made)


def test_cells_of_a_family_are_joined_by_components(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = []
    for edits in [0] + [1] * 150 + [5] * 6:
        copy = list(base)
        for k in rng.sample(range(5, 195), edits):
            copy[k] = f"w{rng.randrange(3000)}"
        texts.append(" ".join(copy))
    sets = [slow_shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    kept = []
    rows = semi_join_rows(spark, lambda: kept.extend(simhash.keep_one_of_each(docs_of(spark, texts)).collect()))
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components(len(texts), linked)))
    assert len(kept) > 1
    assert 0 < rows < 20 * len(texts)  # it was 4,868 by members


def test_near_copies_of_one_id_with_other_texts(spark):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "m n o p q r"]
    rows = spark.createDataFrame(list(zip([1, 1, 2, None], texts, strict=True)), "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one_of_each(rows.unionByName(rows.limit(1))).collect()) == [texts[0], texts[1], texts[3]]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, None)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


# --- substring --------------------------------------------------------------


def slow_repeats(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size,seed,vocabulary", [(35, 8, 400), (5, 3, 4), (6, 2, 2), (4, 4, 3)])
def test_substring_removal(spark, size, seed, vocabulary):
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randint(size - 2, 3 * size))] for _ in range(4)]
    texts = [None, "", " ", "one"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[-1]] * 3 + [" ".join(["same"] * 200)]
    got = substring.removal_report(docs_of(spark, texts), repeat=size, seed=seed).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == slow_repeats(texts, size)


def test_documents_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of three bits, every document shares it with others, and none loses their words."""
    monkeypatch.setattr(common, "_hashes", lambda row_id, text: (F.pmod(F.xxhash64(row_id, text), F.lit(8)), F.xxhash64(F.lit(1), text, row_id)))
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(40)]
    texts = [" ".join([f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 9))] + (shared if k % 3 == 0 else []) + [f"v{rng.randrange(50)}" for _ in range(9)]) for k in range(60)]
    docs = docs_of(spark, texts)
    got = substring.removal_report(docs).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == slow_repeats(texts, 35)
    items = spark.createDataFrame([(1, " ".join(shared[:12]))], "item_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, items).collect()}
    assert all((clean[k] == t) == (k % 3 > 0) and not set(clean[k].split()) & set(shared[:12]) for k, t in enumerate(texts))


def test_maximal_repeats(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(60)}"
    shared = [[word() for _ in range(rng.randint(4, 15))] for _ in range(4)]
    texts = [" ".join(w for _ in range(4) for w in (rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 9))])) for _ in range(40)]
    size = 5
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    want = {}
    for t, w in zip(texts, words, strict=True):
        runs = []
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                if runs and runs[-1][1] == i + size - 1:
                    runs[-1][1] += 1
                else:
                    runs.append([i, i + size])
        if runs:
            want[t] = [tuple(r) for r in runs]
    df = docs_of(spark, texts)
    keys = {r["k"]: r["text"] for r in df.select(F.xxhash64("doc_id", "text").alias("k"), "text").collect()}
    got = {keys[r["row_key"]]: [tuple(s) for s in r["spans"]] for r in substring.repeated_spans(df, repeat=size, seed=3).collect()}
    assert got == want and max(b - a for runs in want.values() for a, b in runs) > size


# --- decontamination --------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(texts, items, size=10):
    windows = defaultdict(set)
    for item, t in items:
        w = words_of(t)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for t in texts:
        w = words_of(t)
        hit, found = set(), set()
        for win, its in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= its
        out.append((w, hit, found))
    return out


@pytest.mark.parametrize("literal,broadcast", [(50_000, 500_000), (0, 0)])
def test_decontamination(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(decontamination, "LITERAL_SEEDS", literal)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "e"]) + rng.choice("xyz")
    items = [(i, rng.choice(["; ", " "]).join(word() for _ in range(n))) for i, n in enumerate([1, 2, 9, 10, 11, 30, 30, 40])]
    items += [(20, None), (21, "!?"), (22, items[5][1]), (5, items[5][1])]
    texts = [None, "", "...", "q"]
    for _ in range(40):
        parts = [word() for _ in range(rng.randint(0, 30))]
        parts += re.split("[; ]+", rng.choice(items[:8])[1].upper())
        texts.append(" ".join(parts + [word() for _ in range(rng.randint(0, 9))]) + rng.choice(["", ".", "\n"]))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, texts)
    want = slow_hits(texts, items)
    got = decontamination.report(df, items_df).orderBy("doc_id").collect()
    for r, (w, hit, found) in zip(got, want, strict=True):
        ids = ",".join(sorted(map(str, found)))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    extra = df.withColumn("row_key", F.lit(1)).withColumn("places", F.lit("p")).withColumn("w", F.lit(2)).withColumn("own", F.lit(3))
    clean = decontamination.remove_spans(extra, items_df)
    assert clean.columns == extra.columns
    for r, (w, hit, _) in zip(clean.orderBy("doc_id").collect(), want, strict=True):
        assert words_of(r["text"]) == [x for k, x in enumerate(w) if k not in hit]
        assert (r["row_key"], r["places"], r["w"], r["own"]) == (1, "p", 2, 3)
        if not hit:
            assert r["text"] == texts[r["doc_id"]]
    left = decontamination.remove_documents(extra, items_df)
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, (_, hit, _) in enumerate(want) if not hit]


# --- packing ----------------------------------------------------------------


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    encode = packing.Encoder(TOKENIZER)
    texts = ["", " ", "Hello, World!", "don't we'll it's", "x1y2 3.14 ...end", "ÄÖÜ ß ẞ İstanbul é é Å", "日本語 テスト", "<|endoftext|> a<|startoftext|>b", "a b c​d", "'s 'S ’s", "🙂🙂 text", "a\x00b \x1c c"]
    texts += [" ".join(random.Random(k).choices(["The", "quick-brown", "fox's", "(x)", "«été»", "ñandú,", "1,000"], k=50)) for k in range(5)]
    for text in texts:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text


def test_encoder_of_another_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert not encode.by_word and packing.Encoder(TOKENIZER).by_word
    for text in ("", " ", "Hello  World\n it's", "ÄÖÜ é", "a b"):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_best_fill_is_exact():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        cap = rng.randint(1, 60)
        sums = {0}
        for n, k in counts.items():
            for _ in range(k):
                sums |= {s + n for s in sums if s + n <= cap}
        used = packing.best_fill(counts, cap)
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= counts[n] for n, k in used.items())


def test_packing_round_trip(spark):
    rng = random.Random(5)
    texts = [None, "", "word"] + [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([3, 50, 700, 5000]))) for _ in range(40)]
    df = docs_of(spark, texts).repartition(3).withColumn("length", F.lit("x"))
    rows = packing.pack(df, TOKENIZER).collect()
    encode = packing.Encoder(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids, at = encode((text or "").encode()), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4 and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


# --- warc -------------------------------------------------------------------


def test_warc_round_trip_with_segments(spark, tmp_path):
    rng = random.Random(6)
    bodies = [None, "", "a", "a", "é" * 70_000, "x" * 200_000, "x" * 200_000, None] + ["".join(rng.choices("\r\n0abc ", k=rng.randint(0, 400))) for _ in range(30)]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i % 3 else None, b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages.select("page_id", "url", payload.alias("payload")).repartition(2), path, archive_bytes=3000)
    got = {int(re.search(r":page:(\d+):", r["record_id"])[1]): r for r in warc.read_archives(spark, path).collect()}
    digests = {r["record_id"]: r for r in warc.read_archives(spark, path, digests=True).collect()}
    for r in got.values():
        other = digests.pop(r["record_id"])
        if r["payload"] is not None:
            assert (other["payload_bytes"], other["payload_digest"]) == (len(r["payload"]), r["stated_digest"])
    assert not digests
    first = {}
    for i, b in enumerate(bodies):
        r, b = got.pop(i), (b or "").encode()
        assert r["error"] is None
        if b in first:
            assert r["record_type"] == "revisit" and r["refers_to"].startswith(f"<urn:page:{first[b]}:")
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == b
            first[b] = i
    assert not got


def test_warc_of_repeated_ids_and_a_missing_response(spark, tmp_path, monkeypatch):
    bodies = ["a" * 6000, "b" * 6000, "a" * 6000, "a" * 6000, "c", "c"]
    pages = spark.createDataFrame(list(zip([1, 1, 1, 2, None, 3], ["http://h/"] * 6, bodies, strict=True)), "page_id long, url string, html string")
    payload = F.col("html").cast("binary")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages.select("page_id", "url", payload.alias("payload")), path, archive_bytes=3000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 6 and all(r["error"] is None for r in got)
    assert sorted(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response") == sorted([bodies[0], bodies[1], bodies[2], "c", "c"])
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: whole(*a, **k).filter("record_id not like '%:page:1:%'"))
    (lone,) = [r for r in warc.round_trip(pages).collect() if r["page_id"] == 2]
    assert lone["payload_bytes"] is None and lone["error"] == "revisit: its response is missing"


def test_warc_of_ids_with_several_payloads(spark):
    """Each payload of an id is told by itself: a response here, a revisit there."""
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "a"), (4, "b"), (4, "c"), (4, "c"), (5, "c" * 9000), (5, "d" * 9000), (6, "d" * 9000)]
    pages = spark.createDataFrame([(i, "http://h/", b) for i, b in rows], "page_id long, url string, html string")
    sha = {b: base64.b32encode(hashlib.sha1(b.encode()).digest()).decode() for _, b in rows}
    want = []
    for i, b in rows:
        least = min(k for k, c in rows if c == b)
        want.append((i, len(b), sha[b], "response" if i == least else "revisit", None if i == least else least, None))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_warc_damage():
    parts = [(2, b"cd"), (1, b"ab"), (3, b"e")]
    assert warc.reassemble(parts, [5]) == (b"abcde", None)
    assert warc.reassemble(parts, [6])[1] == "segments: 5 bytes, 6 stated"
    assert warc.reassemble(parts[:1], [2])[1].startswith("segments: numbers")
    assert warc.reassemble(parts, [])[1] == "segments: the last one is missing"
    assert warc.unchunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.http_payload(b"plain") == b"plain"


# --- media ------------------------------------------------------------------


def test_media_round_trip():
    for n in (0, 1, 63, 64, 65, 64 * 8, 64 * 8 + 1, 64 * 16 * 3 + 5, 100_000):
        data = media.pad(random.Random(n).randbytes(n))
        box = media.mux(data)
        (track,) = media.demux(box)
        assert media.samples(box, track) == data and len(data) % 64 == 0 and len(data) >= 64
        assert track["duration"] == len(data) and track["codec"] == "raw "
        assert track["sync"].tolist() == list(range(0, len(data) // 64, 16))


def test_media_of_broken_containers(spark):
    good = media.mux(media.pad(b"x" * 200))
    rows = spark.createDataFrame([(0, good), (1, None), (2, b""), (3, good[:50]), (4, good.replace(b"stsz", b"skip")), (5, struct.pack(">I4s", 7, b"moov"))], "id int, media binary")
    got = {r["id"]: r for r in media.media_columns(rows.withColumn("b", F.lit(1)), "media").collect()}
    assert got[0]["error"] is None and got[0]["codec"] == "raw " and [tuple(k) for k in got[0]["keyframes"]] == [(good.index(b"x" * 200), 64)]
    assert all(got[i]["error"] and got[i]["codec"] is None for i in range(1, 6))


def test_media_query_by_value(spark):
    texts = [None, "", "a", "a", "é" * 31, "x" * 64, "\u0000", "long " * 9000]
    df = docs_of(spark, texts).withColumn("codec", F.lit("clash"))
    for r in media.store_and_read(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        box = media.mux(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(box), hashlib.sha256(box).hexdigest())
        assert (r["codec"], r["duration"], r["n_samples"]) == ("raw", len(padded), len(padded) // 64)
        kept = [padded[k : k + 64] for k in range(0, len(padded), 64 * 16)]
        assert [box[k["offset"] : k["offset"] + k["length"]] for k in r["keyframes"]] == kept


# --- language ---------------------------------------------------------------


def slow_phrases(sample, text):
    """Longest matches one after another, each by looking through the whole sample."""
    texts = ["".join(map(chr, language.joined(t))) for t in sample]
    s, at, n = "".join(map(chr, language.joined(text))), 0, 0
    while at < len(s):
        k = 0
        while at + k < len(s) and any(s[at : at + k + 1] in t for t in texts):
            k += 1
        at, n = at + max(k, 1), n + 1
    return n


@pytest.mark.parametrize("lane,cells", [(512, 48_000_000), (7, 48_000_000), (3, 0), (16, 0)])
def test_cross_parsing_counts_phrases(monkeypatch, lane, cells):
    monkeypatch.setattr(language, "LANE", lane)
    monkeypatch.setattr(language, "DENSE_CELLS", cells)
    rng = random.Random(lane)
    many = [chr(0x4E00 + i) for i in range(300)]
    for _ in range(4):
        sample = {"a": ["".join(rng.choices("abc, ", k=300)) for _ in range(3)], "b": ["".join(rng.choices("bcdé ", k=200))], "c": ["".join(rng.choices(many, k=500))]}
        model = language.build(sample)
        texts = ["", "a", "zzz", "ABCabc", sample["a"][0] * 2, sample["c"][0][100:400]] + ["".join(rng.choices("abcdé ,z", k=rng.randint(1, 900))) for _ in range(8)]
        counts, lacking, size = model.phrases(texts)
        assert size.tolist() == [len(language.joined(t)) for t in texts]
        known = [{" "} | set("".join("".join(map(chr, language.joined(t))) for t in sample[name])) for name in model.languages]
        assert lacking.tolist() == [[sum(chr(c) not in k for c in language.joined(t)) for k in known] for t in texts]
        assert counts.tolist() == [[slow_phrases(sample[name], t) for name in model.languages] for t in texts]


def test_rare_letters_tell_scripts_apart():
    greek, cyrillic = "".join(chr(c) for c in range(0x3B1, 0x3C9)), "".join(chr(c) for c in range(0x430, 0x450))
    rng = random.Random(8)
    sample = {"latin": ["".join(rng.choices("etaoin shrdlu", k=20_000))] * 3}
    sample |= {name: [" ".join("".join(rng.choices(letters, k=5)) for _ in range(60))] for name, letters in (("el", greek), ("ru", cyrillic))}
    names, scores = language.build(sample).predict([greek[:9], cyrillic[:9], "the rest", None, "12"])
    assert names == ["el", "ru", "latin", "und", "und"] and scores[3] == scores[4] == 0


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(0, None, "en"), (1, "", "en"), (2, "123 !?", None), (None, "the", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(odd).filter("doc_id is not null").collect()} == {"und"}


def words_of(rng, letters):
    return " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))


def test_every_language_is_learnt_however_many(spark):
    """260 languages, the rarest with one text: each has a block of letters, and none goes without a symbol budget."""
    rng = random.Random(6)
    blocks = [[chr(0x4E00 + 20 * k + i) for i in range(20)] for k in range(260)]
    rows = [(4 * k + j, words_of(rng, b), f"l{k:03}") for k, b in enumerate(blocks) for j in range(1 if k == 7 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r["lang"] for r in docs.filter(~(common.crc_bucket(F.col("doc_id"), 4) == 2)).select("lang").distinct().collect()}
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(rows) and len(learnt) > 200
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] in learnt)
    assert language.symbols_each(4) == 30_000 and language.symbols_each(260) == 23_076 and language.symbols_each(10**6) == 300


def test_language_sample_is_bounded_whatever_repeats(spark):
    """A row repeated a thousand times counts once, an id of many texts does not stand for all, and texts end where their letters suffice."""
    rng = random.Random(7)
    rows = [(1, "one text again and again", "en")] * 1000 + [(3, words_of(rng, "abcdefgh"), "en") for _ in range(300)] + [(4, "eins", "de")]
    docs = spark.createDataFrame(rows, "id long, t string, l string").repartition(5)
    sample = language.training_sample(docs, "id", "t", "l", 4, 99, texts=40)
    assert set(sample) == {"en", "de"} and sample["de"] == ["eins"]
    assert len(sample["en"]) == len(set(sample["en"])) and 20 <= len(sample["en"]) <= 40
    small = language.training_sample(docs, "id", "t", "l", 4, 99, texts=40, limit=500)
    assert small["en"] == sample["en"][: len(small["en"])] and 2 <= len(small["en"]) <= 22
    assert language.training_sample(docs.limit(0), "id", "t", "l", 4, 99) == {}


def test_language_of_odd_rows_by_value(spark):
    rows = [(4, "the cat and the dog", "en"), (5, "der hund und die katze", "de"), (None, "the dog", None), (5, "der hund", "de"), (5, "der hund", "de"), (9, None, "en"), (9, "", None), (9, "12 -", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("x"), "score": F.lit(7)})
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], r["score"] > 0) for r in language.identify(docs, held_out=7).collect())
    assert got == {(4, False, "en", True): 1, (5, False, "de", True): 3, (None, False, "en", True): 1, (9, False, "und", False): 3}


# --- quality ----------------------------------------------------------------


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(8)
    k = len(quality.FEATURES)
    covariance = [np.eye(k) * 2, np.eye(k) + 0.1]
    means = [np.zeros(k), np.ones(k)]
    whiten = [np.linalg.inv(np.linalg.cholesky(c)) for c in covariance]
    constants = [-0.5 * np.linalg.slogdet(c)[1] for c in covariance]
    x = rng.normal(size=(20, k))
    want = []
    for row in x:
        d = [-0.5 * (row - m) @ np.linalg.inv(c) @ (row - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, covariance, strict=True)]
        want.append(1 / (1 + np.exp(d[0] - d[1])))
    assert np.allclose(quality.Model(means, whiten, constants).score(x), want)


def plain_statistics(text):
    """The statistics word by word, as FEATURES names them."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    sign = lambda c: chr(c) in "!#$%&*+/<=>?@[\\]^_`{|}~"
    share = lambda k, total: math.sqrt(k / total)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    lines = raw.split(b"\n")
    pairs = list(zip(words, words[1:], strict=False))
    return [
        math.log(n + 1),
        share(sum(map(sign, raw)), len(raw) + 100),
        share(upper, upper + lower + 100),
        share(sum(a == b for a, b in pairs), n + 20),
        math.log(len(set(words)) + 1) / math.log(n + 1),
        math.log(len(set(pairs)) + 1) / math.log(max(n - 1, 1) + 1),
        min(1.2, len(zlib.compress(raw, 1)) / (len(raw) + 100)),
        math.log(len(raw) / n),
        share(len(lines) - len(set(lines)), len(lines) + 5),
        share(sum(sign(w[-1]) for w in words), n + 20),
        share(sum(all(map(sign, w)) for w in words), n + 20),
    ]


def test_statistics_word_by_word():
    rng = random.Random(10)
    texts = ["one", "a a a", "A!? #b\nA!? #b\n", "é È | | ~", "x\x0by z"] + [" ".join(rng.choices(["The", "fox,", "<b>", "||", "\n", "é", "a-b", "END."], k=rng.randint(1, 80))) + "q" for _ in range(40)]
    for text in texts:
        assert np.allclose(quality.statistics(text.encode()), plain_statistics(text)), text
    assert quality.statistics(b"") == quality.statistics(b" \n") == [0.0] * len(quality.FEATURES)


def test_fit_is_the_moments_of_each_class(spark):
    rng = np.random.default_rng(11)
    k = len(quality.FEATURES)
    rows = [(int(c), *(rng.normal(size=k) * (1 + c) + c).tolist()) for c in rng.integers(0, 2, 300)]
    model = quality.fit(spark.createDataFrame(rows, "label int, " + ", ".join(f"{f} double" for f in quality.FEATURES)).repartition(3))
    for c in (0, 1):
        x = np.array([r[1:] for r in rows if r[0] == c])
        cov = np.cov(x.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-3 * np.eye(k)
        assert np.allclose(model.means[c], x.mean(axis=0))
        assert np.allclose(np.linalg.inv(model.whiten[c].T @ model.whiten[c]), cov)
        assert np.isclose(model.constants[c], np.log((len(x) + 1) / (len(rows) + 2)) - 0.5 * np.linalg.slogdet(cov)[1])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, la = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(d, la).join(la, "doc_id").filter("held_out and quality is not null").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    kept = {r["doc_id"] for r in quality.keep_good(d, la).select("doc_id").collect()}
    scored = quality.score_documents(d, la).filter("predicted = 1").select("doc_id").collect()
    assert kept == {r["doc_id"] for r in scored}


# --- urls -------------------------------------------------------------------


def tokens_by_url(spark, given):
    df = spark.createDataFrame([(u,) for u in set(given)], "u string")
    return {r["u"]: frozenset(r["t"]) for r in df.select("u", urls.tokens_of(F.col("u")).alias("t")).collect()}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_INDEX", limit)
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8")]
    mined = spark.createDataFrame([("r1", ["host0=org", "path=spam"], 0.9, 0.1), ("r2", ["query=ref"], 0.8, 0.1)], "rule_id string, antecedent array<string>, confidence double, support double")
    cases = {
        "http://WWW.Example.COM/en/71?x": ("www.example.com", "/en/71", "example.com/en/7", "allow", None),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block", None),
        "http://notcom/en/8": ("notcom", "/en/8", None, "allow", None),
        "https://a.example.net/de/8#f": ("a.example.net", "/de/8", "example.net/de/8", "block", None),
        "https://a.net/de/?ref=1": ("a.net", "/de/", "net/de/", "allow", None),
        "http://x.org/spam/1?ref=2": ("x.org", "/spam/1", None, "block", "r1"),
        "http://x.org/ham?ref": ("x.org", "/ham", None, "block", "r2"),
        "http://x.org/ham": ("x.org", "/ham", None, "allow", None),
        "no scheme/en/7": ("", "", None, "allow", None),
        None: ("", "", None, "allow", None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("row", F.lit(0))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["mined_rule"]) for r in urls.judge(df, rules, mined).collect()}
    assert got == dict(enumerate(cases.values()))
    none = urls.judge(df, rules, mined.limit(0)).collect()
    assert len(none) == len(cases) and all(r["mined_rule"] is None for r in none)


def slow_rules(spark, rows, least, confidence):
    """All token sets by counting, and of them those that the docstring of ``mine`` asks for."""
    tokens_of = tokens_by_url(spark, [url for url, _ in rows])
    known = [(tokens_of[url], label == "block") for url, label in rows if url and label]
    share = sum(bad for _, bad in known) / len(known)
    total, blocked = Counter(), Counter()
    for tokens, bad in known:
        for k in range(1, len(tokens) + 1):
            for subset in combinations(sorted(tokens), k):
                total[subset] += 1
                blocked[subset] += bad
    kept = {}
    for subset, n in total.items():
        p, z = blocked[subset] / n, urls.CERTAINTY
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if blocked[subset] >= least and p >= confidence and low > share:
            kept[subset] = p
    return {s: p for s, p in kept.items() if not any(kept.get(tuple(t for t in s if t != gone), -1) >= p for gone in s)}


def test_mined_rules_are_all_that_hold(spark):
    rng = random.Random(9)
    rows = [(None, "block"), ("http://x", None)]
    for i in range(600):
        host, word = f"h{rng.randrange(5)}.org", rng.choice(["casino", "news", "shop"])
        bad = rng.random() < (0.97 if word == "casino" and host != "h0.org" else 0.9 if word == "shop" and host == "h1.org" else 0.15)
        rows.append((f"http://{host}/{word}/{i}{rng.choice(['', '?ref=a'])}", "block" if bad else "allow"))
    rows += [(f"http://once.net/rare/{i}", "block") for i in range(19)]  # one too few
    mined = {tuple(r["antecedent"]): r["confidence"] for r in urls.mine(spark.createDataFrame(rows, "url string, label string")).collect()}
    want = slow_rules(spark, rows, urls.LEAST_URLS, urls.CONFIDENCE)
    assert mined.keys() == want.keys() and len(want) >= 3 and not any("host1=once" in s for s in want)
    assert all(abs(mined[s] - p) < 1e-9 for s, p in want.items())
    # On urls it has not seen, what the rules block is bad as often as they say, and most of it is found.
    new = [f"http://h{i % 5}.org/{w}/{i}" for i, w in enumerate(["casino", "news", "shop"] * 40)]
    pages = spark.createDataFrame(list(enumerate(new)), "page_id long, url string")
    rules = spark.createDataFrame([(" ".join(s), list(s), p, 0.1) for s, p in mined.items()], urls._RULES)
    tokens_of = tokens_by_url(spark, new)
    for r in urls.judge(pages, [], rules).collect():
        fits = [s for s in mined if set(s) <= tokens_of[new[r["page_id"]]]]
        assert (r["verdict"] == "block") == bool(fits)
    assert urls.mine(spark.createDataFrame([], "url string, label string")).count() == 0
