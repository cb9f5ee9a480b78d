"""Training-data operators on small fixtures: brute force, exact round trips, and the cases every operator defines."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folimetry.llm.registry")
import public_tokenizers as P

from folimetry.llm import exact_dedup, neighbours, ngram_join, overlaps, packed_ids, quality, scratch, sentence_pieces, source_mix, toxicity, url_filter, warc
from folimetry.llm.components import components
from folimetry.llm.scratch import shared_folder, written

DOCS = "doc_id long, text string, keep_id string, size string"  # with names that operators use themselves


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", "y") for i, t in enumerate(texts)]
    return written(spark.createDataFrame(rows, DOCS))


ODD = [None, "", "  \n", "a", "A b c", "a b c", "x " * 30_000, "é漢 😀\t\x00 ﬁ ▁▁", "a b c"]


# --- 1


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat,", "and"]) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["THE!!", "CAT!!", "$$$", "SAT!!"]) for _ in range(40)) for _ in range(60)]
    docs = docs_of(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 120 + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 120 and r.held_out]
    assert held and all(r.predicted == (r.doc_id < 60) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_quality_features_by_brute_force(spark, monkeypatch):
    """Context vectors and pooled features, word by word, and the network's scores, unit by unit."""
    monkeypatch.setattr(quality, "SLICE_BYTES", 60)
    monkeypatch.setattr(quality, "SLICE_WORDS", 5)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["The ", "cat, ", "SAT!! ", "on ", "4 ", "é ", "aa aa "]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, "", "one"]
    index, sums, seen = quality.index_vectors().astype(int), np.zeros((quality.SYMBOLS, quality.DIM)), np.zeros(quality.SYMBOLS)
    documents = []
    for t in texts:
        bucket, shape, _ = quality.symbols(pa.array([t or ""], pa.large_string()))
        documents.append(list(zip(bucket.tolist(), shape.tolist())))
        own = [index[b] + index[s] for b, s in documents[-1]]
        for i, symbols in enumerate(documents[-1]):
            around = sum((own[j] for j in range(max(i - quality.WINDOW, 0), min(i + quality.WINDOW + 1, len(own))) if j != i), np.zeros(quality.DIM))
            for symbol in symbols:
                sums[symbol] += around
                seen[symbol] += 1
    mean = sums.sum(axis=0) / seen.sum()
    want = np.array([(sums[k] / seen[k] - mean) if seen[k] else np.zeros(quality.DIM) for k in range(quality.SYMBOLS)])
    want /= np.maximum(np.linalg.norm(want, axis=1), 1e-9)[:, None]
    vectors = quality.word_vectors(docs_of(spark, texts).repartition(3))
    assert np.allclose(vectors, want, atol=1e-5)
    features = quality.pooled(pa.array([t or "" for t in texts], pa.large_string()), vectors)
    for row, symbols in zip(features, documents):
        words, shapes = (np.array([vectors[x[k]] for x in symbols] or [np.zeros(quality.DIM)], float) for k in (0, 1))
        plain = [*words.mean(axis=0), *shapes.mean(axis=0), *shapes.std(axis=0), np.log1p(len(symbols))]
        assert np.allclose(row, plain, atol=1e-3)
    net = quality.fit_network(features.astype(float), np.array([i % 2 for i in range(len(texts))]))
    for row, score in zip(features.astype(float), net.score(features.astype(float))):
        hidden = [max(sum((row[i] - net.shift[i]) / net.scale[i] * net.w1[i, j] for i in range(len(row))) + net.b1[j], 0) for j in range(quality.HIDDEN)]
        out = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert abs(1 / (1 + np.exp(-out)) - score) < 1e-9


def test_quality_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(docs_of(spark, []), none).count() == 0
    assert {r.score for r in quality.quality_scores(docs_of(spark, ["a", None]), none).collect()} == {0.5}


def test_temperature_flattens_overconfident_outputs():
    y = np.array([1, 0] * 50 + [1] * 20)
    assert quality.fit_temperature(np.where(y > 0, 1, 1) * 8.0, y) > 2


# --- 2


def test_encoding_is_the_librarys(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.PieceModel(path)
    rng, pieces = random.Random(2), [p.replace("▁", " ") for p in own.ids]
    texts = ["", " ", " " * 100, "a" * 3000, "▁x▁", "\n\n\t", "日本語テキスト😀", "<s> </s> <0x41>", "a\x00b"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choice("abest  .,\nÉé▁") for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for t, ids in zip(texts, own.rows(pa.array(texts, pa.large_string())), strict=True):
        assert ids.tolist() == library.encode(t)
        whole = np.concatenate([[1], ids, [2]]).astype("<u4")
        assert own.decode(whole).decode() == library.decode(whole.tolist())
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(8)]
        assert own.decode(np.array(ids, "<u4")).decode() == library.decode(ids)
    replayed = own.encode("the theory of everything")
    assert [own.pieces[i] for i in replayed] == sentence_pieces.merged_by_rank("▁the▁theory▁of▁everything", own.rank)


def test_encoding_of_odd_rows(spark):
    got = sentence_pieces.encode_texts(docs_of(spark, ODD), P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.decoded for r in got} == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)} and got[0]["size"] == "y"
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)


# --- 3


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                high, low = sorted((find(i), find(j)), reverse=True)
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 1 << 20), (5, 80, 1 << 20), (3, 90, 150), (3, 80, 60), (1, 60, 100)])
def test_ngram_components(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)  # small ones: clusters of several blocks
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", max(1, block // 10))
    rng, texts = random.Random(7), list(ODD)
    for _ in range(25):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5, 9, 10, 12, 20, 60, 200]))]
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"W{rng.randrange(50)}"
            texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts), words, percent).collect()}
    assert got == brute_components(texts, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_keys_of_linked_sets_meet(percent):
    rng = np.random.default_rng(3)
    bands, linked = ngram_join.Bands(percent), 0
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.5 - percent / 200], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            for hot in (a[:0], a[:3], a[: n // 2]):
                assert len(np.intersect1d(bands.keys(a, hot), bands.keys(b, hot)))
    assert linked > 200


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 40, 500, 520, 700, 1030, 5000)]
    sets = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.06], rng.integers(0, 2**63, len(s) // 30).astype(np.uint64)])) for s in base for _ in range(12)]
    sets = sorted((s for s in sets if len(s)), key=len)
    maps = [overlaps.parity_bitmap(s) for s in sets]
    members = overlaps.Members(80, [len(s) for s in sets], maps, [s.tobytes() for s in sets])
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    for i, j in links:
        assert j in members.possible(len(sets[i]), np.frombuffer(maps[i], np.uint64)) and i in members.possible(len(sets[j]), np.frombuffer(maps[j], np.uint64))
    assert links and closure(members.links()) == closure(links)


def closure(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in links:
        high, low = sorted((find(u), find(v)), reverse=True)
        root[high] = low
    return {i: find(i) for i in list(root)}


@pytest.mark.parametrize(("holders", "most"), [(64, 4096), (3, 4096), (64, 5), (2, 4)])
def test_tiles_hold_all_holders_of_a_key(monkeypatch, holders, most):
    """Through chunks and batches of any size, rows that share a key are members of one tile or candidates."""
    monkeypatch.setattr(ngram_join, "CHUNK_HOLDERS", holders)
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", most)
    rng = np.random.default_rng(holders * most)
    key, row = rng.integers(0, 60, 400) ** 2 // 60, rng.integers(0, 90, 400)
    chunks = [ngram_join._held_keys(key[a : a + 70], row[a : a + 70]).to_pylist() for a in range(0, 400, 70)]
    rows = sorted((r for c in chunks for r in c), key=lambda r: (r["key"] is not None, r["key"] or 0, r["u"]))
    schema = pa.schema([(n, pa.int64()) for n in ("key", "u", "v")])
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 33], schema) for a in range(0, len(rows), 33)]
    tiles, links = {}, []
    for r in (r for b in ngram_join._tiles(iter(batches)) for r in b.to_pylist()):
        if r["key"] is None:
            links.append((r["u"], r["v"]))
        else:
            tiles.setdefault(r["key"], set()).add(r["u"])
    assert all(2 <= len(t) <= most for t in tiles.values())
    links += [(u, min(t)) for t in tiles.values() for u in t]
    wanted = [(u, min(row[key == k])) for k in set(key) for u in row[key == k]]
    assert closure((int(u), int(v)) for u, v in wanted if u != v) == closure((u, v) for u, v in links if u != v)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (50, 60)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}


# --- 4


@pytest.mark.parametrize(("keep", "digits"), [("largest", 32), ("smallest", 32), ("largest", 1)])
def test_exact_groups(spark, keep, digits):
    texts = ODD + ["a", "b", None, "a"]
    got = exact_dedup.exact_groups(docs_of(spark, texts), keep, digits).collect()
    best = max if keep == "largest" else min
    for r in got:
        same = [i for i, t in enumerate(texts) if (t or "") == (texts[r.doc_id] or "")]
        assert (r.keep_id, r.group_size, r.kept) == (best(same), len(same), r.doc_id == best(same))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert len(got) == len(texts)


def test_exact_groups_with_null_and_repeated_ids(spark):
    got = exact_dedup.exact_groups(docs_of(spark, ["a", "a", "a", "b"], [None, 3, 3, None])).collect()
    assert Counter((r.keep_id, r.kept) for r in got) == Counter({(3, False): 2, (3, True): 1, (None, True): 1})
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0


def test_index_compacts():
    rng = np.random.default_rng(0)
    index, copies, least = exact_dedup.DigestIndex(memtable_rows=64, fanout=3), Counter(), {}
    for _ in range(30):
        high, unknown, place, row = rng.integers(0, 200, 40), rng.integers(0, 2, 40), rng.integers(-50, 50, 40), rng.integers(0, 9, 40)
        index.put((high, high * 3, unknown, place, row, np.ones(40, np.int64)))
        copies.update(high.tolist())
        for h, *identity in zip(*(x.tolist() for x in (high, unknown, place, row)), strict=True):
            least[h] = min(least.get(h, identity), identity)
    high, low, *identity, n = index.merged()
    assert high.tolist() == sorted(copies) and n.tolist() == [copies[h] for h in sorted(copies)] and (low == high * 3).all()
    assert [list(x) for x in zip(*(c.tolist() for c in identity), strict=True)] == [least[h] for h in high.tolist()]
    assert all(len(c) == 0 for c in exact_dedup.DigestIndex().merged())


def test_filter_knows_all_hits(spark):
    held = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    hits = spark.createDataFrame([(int(h),) for h in held], "high long").repartition(3)
    made = exact_dedup.filter_of(hits, 3000)
    assert made.may_hold(held).all() and made.may_hold(np.random.default_rng(2).integers(-(2**63), 2**63, 3000)).mean() < 0.05


@pytest.mark.parametrize("few", [0, 200_000])
def test_exact_groups_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", few)
    texts = [f"t{i % 7}" if i % 3 else f"u{i}" for i in range(60)]
    got = exact_dedup.exact_groups(docs_of(spark, texts, [i if i % 5 else None for i in range(60)]), "smallest", 2 if few else 32).collect()
    for r in got:
        same = [i for i in range(60) if hashlib.sha256(texts[i].encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i % 5]
        assert r.group_size == len(same) and r.keep_id == (min(ids) if ids else None)
    assert sum(r.kept for r in got) == len(set(texts)) and len(got) == 60


# --- 5


def test_warc_round_trip(spark):
    rows = [(1, "u v", "x" * 200), (2, None, "x" * 200), (3, "http://é\n", "ab"), (4, "q", "ab"), (None, "q", None), (2, "z", "x" * 200), (5, "w", "é" * 100_000)]
    files = warc.write_warc(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string"), shared_folder(spark))
    for split in (11, 1000, 1 << 20):
        got = warc.read_warc(files, split).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter(
            [(1, "response", None, 200), (2, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "response", None, 2), (4, "response", None, 2), (None, "response", None, 0), (5, "response", None, 200_000)]
        )
        assert {r.payload_digest for r in got} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
        assert next(bytes(r.payload) for r in got if r.page_id == 5).decode() == "é" * 100_000
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), shared_folder(spark))).count() == 0


def test_warc_survives_planted_members(spark):
    """Magic bytes in payloads, and whole members or their beginnings between records, don't make or hide records."""
    rng = random.Random(0)
    noise = ["".join(rng.choice(["\x1f\x8b\x08", "WARC/1.1\r\n", "\r\n\r\n", chr(rng.randrange(32, 0x3000))]) for _ in range(4000)) for _ in range(6)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(noise)], "page_id long, url string, html string")
    files = warc.write_warc(pages, shared_folder(spark))
    for split in (7, 997, 1 << 22):
        got = warc.read_warc(files, split).collect()
        assert sorted((r.page_id, r.payload_digest) for r in got) == [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(noise)]
    whole = warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), False, 0, None, None, None)
    import gzip
    import io

    junk = [b"\x1f\x8b\x08", whole[: len(whole) // 2], gzip.compress(b"WARC/1.1 not a record"), gzip.compress(b"other"), b""]
    data, starts = b"", []
    for k in range(20):
        data += junk[k % 5]
        starts.append(len(data))
        data += whole
    for split in (1, 13, 400, 1 << 20):
        found = [r.offset for a in range(0, len(data), split) for r in warc.records_between(io.BytesIO(data), a, min(a + split, len(data)))]
        assert found == starts


def test_warc_revisits_name_their_response(spark):
    rows = [(3, "http://b/é", "x" * 200), (2, "http://a/ b", "x" * 200)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), shared_folder(spark))
    found = {}
    for f in files.collect():
        where, inner = scratch.filesystem(f.path)
        with where.open_input_file(inner) as source:
            found |= {r.headers["x-page-id"]: r.headers for r in warc.records_between(source, 0, f.size)}
    assert found["3"]["warc-refers-to"] == found["2"]["warc-record-id"] and found["3"]["warc-refers-to-target-uri"] == found["2"]["warc-target-uri"] == "http://a/%20b"


# --- 6


def test_toxicity_learns_and_scores_everything(spark):
    rng = random.Random(0)
    plain = [" ".join("".join(rng.choice("bdklmnoprstu") for _ in range(3)) for _ in range(30)) for _ in range(200)]
    toxic = [t + " zzgrob" + rng.choice("abc") if i % 2 else t + " you idiot" for i, t in enumerate(plain[:80])]
    texts = plain[80:] + toxic + ODD
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs_of(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 200 and r.held_out]
    assert held and np.mean([r.predicted == (r.doc_id >= 120) for r in held]) > 0.9 and got[200].predicted == 0


def test_repeated_and_long_documents_score_alike(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdef") * 3 for _ in range(30)) for _ in range(80)]
    texts = [t + " you idiot moron" if i % 2 else t for i, t in enumerate(plain)]
    rows = list(enumerate(texts)) + [(1, texts[1]), (1, texts[1]), (None, texts[3]), (500, "scum moron " * 100_000)]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, score double, held_out int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(80)] + [(1, 1, 0), (9999, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for scored in (toxicity.toxicity_scores(docs, labels), quality.quality_scores(docs, labels)):
        got = scored.collect()
        assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 1}) == 1 and {r.doc_id for r in got} == {i for i, _ in rows}
        assert next(r for r in got if r.doc_id is None).held_out is False
    found = toxicity.toxicity_scores(docs, labels).filter("doc_id = 500").first()
    assert found.predicted == 1


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known accuracies, two voters being copies of each other."""
    rng = np.random.default_rng(0)
    n, right = 20_000, np.array([0.9, 0.9, 0.6, 0.85, 0.85, 0.7, 0.8, 0.75, 0.8, 0.9])
    label = rng.random(n) < 0.3
    votes = np.where(rng.random((n, 10)) < right, label[:, None], ~label[:, None]) * 2
    votes[:, 9] = votes[:, 0]
    votes[rng.random((n, 10)) < 0.3] = toxicity.NOTHING
    names, docs = np.unique(votes @ toxicity.POWERS, return_counts=True)
    model = toxicity.fit_label_model(names, docs.astype(float), np.zeros(len(names)), np.zeros(len(names)))
    assert np.abs(model.accuracies - right).max() < 0.06 and (model.parents[9] == 0 or model.parents[0] == 9)
    assert ((model.posterior[votes @ toxicity.POWERS] > 0.5) == label).mean() > 0.9


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs_of(spark, []), none).count() == 0
    assert toxicity.toxicity_scores(docs_of(spark, ["a b", None]), none).count() == 2


# --- 7


def nearest_by_force(rows, k=10):
    """Of each row number that asks, (distance, id) of the nearest others."""
    usable = [(r, i, np.array(v, np.float32).astype(np.float64)) for r, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for r, i, v in usable:
        if i % 100 == 0:
            gaps = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for s, j, w in usable if s != r and len(w) == len(v))
            out.append((i, gaps[:k]))
    return out


@pytest.mark.parametrize(("n", "width", "shards"), [(1500, 16, 1), (3000, 8, 4)])
def test_neighbours(spark, monkeypatch, n, width, shards):
    monkeypatch.setattr(neighbours, "LEAST_SHARD", -(-n // shards))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[200:700] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 100, [0.0] * width), (n + 200, [float("nan")] * width), (n + 300, [1.0, None]), (0, x[5].tolist()), (100, x[100].tolist()), (400, [1.0, 2.0]), (401, [1.0, 3.0])]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, row string")
    got = neighbours.nearest_rows(table, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    want = nearest_by_force(rows)
    assert Counter(r.query_id for r in got) == Counter(q for q, gaps in want for _ in gaps)
    true, mine = Counter((q, round(g, 9), i) for q, gaps in want for g, i in gaps), Counter((r.query_id, round(r.score, 9), r.vec_id) for r in got)
    assert sum((true & mine).values()) >= 0.95 * sum(true.values())
    twins = sorted((r.rank, r.vec_id) for r in got if r.query_id == 300)  # ties: the smallest keys, in order, but its own
    assert twins == [(k + 1, 200 + k) for k in range(10)]
    assert neighbours.nearest_rows(table.filter("vec_id < 0"), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest_rows(table.filter("vec_id in (1, 2, 600)"), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 2


# --- 8


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000)
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, 1000) == ids).all()


def test_packed_documents(spark):
    texts = [*ODD, "it's 's  two\n\nthe end. ", "plain words, and more\nhere", "<|endoftext|>"]
    tool = packed_ids.encoder(P.path("byte_bpe_50k.json")).tokenizer
    got = sorted(packed_ids.packed_documents(docs_of(spark, texts), P.path("byte_bpe_50k.json")).collect())
    start = 0
    for i, r in enumerate(got):
        ids = np.array([*tool.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert packed_ids.packed_documents(docs_of(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_packed_documents_with_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    tool, rows = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [(3, "c"), (None, "no id"), (1, "first one"), (1, "a"), (3, None), (1, "first one"), (2, "long " * 300_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, row long")
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):  # as stored where ids repeat
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = packed_ids.packed_documents(written(docs.coalesce(1)), P.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_packed_documents_with_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tool, texts = Tokenizer.from_file(path), ["a <|endoftext|> b", "plain words", "<|endoftext|><|endoftext|>", "it's <|endoftext|>", "<|endoftext|", "more words"]
    start = 0
    for r, t in zip(sorted(packed_ids.packed_documents(docs_of(spark, texts), path).collect()), texts, strict=True):
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tool.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


# --- 9


def test_targets_are_shared_again_above_the_cap():
    got = source_mix.targets([("b", 10), ("a", 1), (None, 100)])
    assert got["a"] == 3 and sum(got.values()) == pytest.approx(111) and got["b"] == 30 and got[None] == pytest.approx(78)


@pytest.mark.parametrize("capacity", [1, 20, 200, 1 << 16])
def test_fitting_is_the_best_subset_sum(capacity):
    """Against all sums that whole documents can make, found one document at a time."""
    rng = np.random.default_rng(0)
    for k in range(60):
        size = np.unique(rng.integers(0, 60, 6)) * (3 if k % 3 else 1)
        count = rng.integers(1, 6, len(size))
        sums = {0}
        for n, many in zip(size.tolist(), count.tolist(), strict=True):
            sums = {s + n * m for s in sums for m in range(many + 1)}
        budget = int(rng.integers(0, (size * count).sum() + 5))
        taken = source_mix.fit_lengths(size, count, budget, capacity)
        assert (taken >= 0).all() and (taken <= count).all() and (size * taken).sum() == max(s for s in sums if s <= budget)
    assert (source_mix.fit_lengths(np.array([3, 5]), np.array([2, 2]), 11) * [3, 5]).sum() == 11


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["a", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "d")]
    docs = source_mix.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got, again = source_mix.mix_counts(docs).collect(), source_mix.mix_counts(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {i: s for i, _, s in rows}
    for s in ("a", "b", "c", None):
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in mine)
    assert len(got) == 602


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, target double, taken long, size string, row_id string"
    assert source_mix.mix_counts(source_mix.sized(spark.createDataFrame([], schema))).count() == 0
    rows = [(7, "a b", "x")] * 300 + [(None, "c", None)] * 50 + [(1, None, "x"), (2, "  ", "y"), (3, "w " * 200_000, "z")]
    docs = written(spark.createDataFrame([(*r, 0.5, 9, "s", "r") for r in rows], schema))
    got, again = (sorted(map(tuple, source_mix.mix_counts(source_mix.sized(docs)).collect())) for _ in range(2))
    assert got == again and len(got) == len(rows) and Counter(r[1] for r in got) == Counter(r[0] for r in rows)
    by_source = source_mix.targets([("x", 600), (None, 50), ("y", 0), ("z", 200_000)])
    for s, ids in (("x", {7, 1}), (None, {None}), ("z", {3})):
        mine = [r for r in source_mix.mix_counts(source_mix.sized(docs)).collect() if r.doc_id in ids]
        assert all(r.target == by_source[s] and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
        whole = sum(r["size"] for r in mine)
        least = min(r["size"] for r in mine if r["size"])
        assert whole * (by_source[s] // whole if by_source[s] < 3 * whole else 3) <= sum(r.taken for r in mine) + least and sum(r.taken for r in mine) <= by_source[s] + 1


# --- 10


def test_url_filter(spark):
    cases = {
        "http://A.Example.com/en/x": "block", "https://www.example.com/en/": "allow", "http://example.com/fr": "allow", "x://b.net/es/1?q": "block",
        "x://b.net/es": "allow", "http://notexample.com/en/": "allow", "nothing": "allow", "http://net/fr/#a": "block", None: "allow", "": "allow",
    }
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "r")], "page_id long, url string, rule string")
    got = url_filter.filter_urls(df).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == Counter([(i, v) for i, v in enumerate(cases.values())] + [(0, "block")])
    assert {r.page_id: (r.host, r.path, r.rule) for r in got}[0] == ("a.example.com", "/en/x", "example.com/en/")
    assert url_filter.filter_urls(df.filter("page_id < 0")).count() == 0


def test_url_filter_ties_and_long_urls(spark):
    rules = [("a.b", "/c", "allow"), ("b", "/cde", "block"), ("b", "/", "block"), ("a.b", "/" + "x" * 5000, "block"), ("B", "/q", "allow")]
    cases = {
        "x://a.b/cde": ("a.b/c", "allow"),  # as long as b/cde (5 characters each): the longer host wins
        "x://z.b/cdef": ("b/cde", "block"), "x://a.b/" + "x" * 9000: ("a.b/" + "x" * 5000, "block"), "x://" + "s." * 3000 + "a.b/c": ("a.b/c", "allow"),
        "x://b/Q": ("b/", "block"), "x://B/q": ("B/q".lower(), "allow"), "x://ab/c": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(cases)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == dict(enumerate(cases.values()))
    assert {r.verdict for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}


def test_encoding_of_an_empty_table(spark):
    got = sentence_pieces.encode_texts(docs_of(spark, []), P.path("piece_bpe_32k.model"))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "size", "n_tokens", "ids", "decoded"]


CLASHES = ["doc_id", "text", "lang", "source", "n_chars", "__row", "_metadata", "__times", "__copy", "__text", "__path", "__file", "__at", "ids", "n_tokens", "Decoded", "row_id", "score", "c0", "a.b", "component"]


def clashing(spark, texts, ids=None, sources=("a", "b", None)):
    """Documents with columns named as operators name theirs; each holds its own value."""
    kinds = {"doc_id": "long", "n_chars": "long", "__row": "long", "ids": "long"}
    rows = [tuple({"doc_id": i if ids is None else ids[i], "text": t, "source": sources[i % len(sources)], "n_chars": 7, "__row": 88, "ids": 99}.get(c, f"own {c}") for c in CLASHES) for i, t in enumerate(texts)]
    return written(spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in CLASHES)))


def own_values(row):
    return all(row[c] == {"n_chars": 7, "__row": 88, "ids": 99}.get(c, f"own {c}") for c in CLASHES if c in row.__fields__ and c not in ("doc_id", "text", "source"))


STAGE_TEXTS = [*ODD, "b " * 10, "the cat sat on the mat and on it went", "the cat sat on the mat and on it went", "word " * 200_000]


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = [*range(len(STAGE_TEXTS) - 3), None, None, 5]
    docs = clashing(spark, STAGE_TEXTS, ids)
    want = {"quality classifier": len(STAGE_TEXTS), "exact dedup": len({t or "" for t in STAGE_TEXTS})}
    blank = sum(n == 0 for n, _ in brute_components(STAGE_TEXTS, 5, 80).values())
    want["n-gram Jaccard join"] = blank + len({c for n, c in brute_components(STAGE_TEXTS, 5, 80).values() if n})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        assert got and all(own_values(r) for r in got), name
        assert len(got) == want.get(name, len(got)), name
        if stage is not sentence_pieces.encode_stage:
            assert list(got[0].__fields__) == CLASHES
        none = stage(spark, written(docs.limit(0)), str(tmp_path))
        assert none.count() == 0 and (stage is sentence_pieces.encode_stage or none.columns == CLASHES)
    encoded = sentence_pieces.encode_stage(spark, docs, "").collect()
    assert encoded[0].__fields__[-3:] == ["_n_tokens", "_ids", "_decoded"] and len(encoded) == len(STAGE_TEXTS)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = [[1, *library.encode(t or ""), 2] for t in STAGE_TEXTS]
    assert Counter((tuple(r["_ids"]), r["_decoded"]) for r in encoded) == Counter((tuple(i), library.decode(i)) for i in ids)


def test_dedup_stages_keep_one_row_of_each(spark):
    docs = clashing(spark, STAGE_TEXTS, [None, 3, 3, None, 1, 1, 8, 9, 10, 11, None, 2, 2])
    kept = exact_dedup.dedup_stage(spark, docs, "").collect()
    assert sorted((r.text or "") for r in kept) == sorted({t or "" for t in STAGE_TEXTS})
    near = ngram_join.near_dedup_stage(spark, docs, "").collect()
    assert next(r.doc_id for r in near if (r.text or "").startswith("the cat")) == 2


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() against the five stages one after the other: scores by the fitted network, then plain Python."""
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat,", "and", "dog", "ran", "far"]) for _ in range(rng.randrange(8, 60))) for _ in range(80)]
    bad = [" ".join(rng.choice(["THE!!", "CAT!!", "$$$", "SAT!!"]) for _ in range(40)) for _ in range(60)]
    texts = good + bad + good[:10] + [t + " tail" for t in good if len(t.split()) > 40] + [None, "", "é漢 😀"]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(t in set(good)), 0) for i, t in enumerate(texts) if t in set(good) | set(bad)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    vectors, network = quality.fit_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = network.score(quality.pooled(pa.array([t or "" for t in texts], pa.large_string()), vectors).astype(np.float64))
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    last = {r[1] or "": r for r in kept}
    kept = [r for r in kept if last[r[1] or ""] is r]
    parts = brute_components([r[1] for r in kept], 5, 80)
    kept = [r for i, r in enumerate(kept) if not parts[i][0] or parts[i][1] == i]
    left = {r[0]: r for r in kept}
    assert {r.doc_id for r in got} <= set(left) and not any(t in set(bad) for _, t, *_ in kept) and len(kept) > 60
    words = {i: len((r[1] or "").split()) for i, r in left.items()}
    totals = Counter()
    for i, r in left.items():
        totals[r[3]] += words[i]
    wanted, taken, copies = source_mix.targets(list(totals.items())), Counter(), Counter(r.doc_id for r in got)
    for r in got:
        taken[r.source] += words[r.doc_id]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in totals) and max(copies.values()) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in got:
        ids = [1, *library.encode(left[r.doc_id][1] or ""), 2]
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids))


# --- row identifiers


def test_rows_stay_known_when_scans_split_differently(spark, monkeypatch):
    """As if executors came or went: every job of a query reads its table in other partitions than the one before."""
    texts = ["one two three four five six", "b", "", None] * 6 + [f"{i} alone among the others here" for i in range(16)]
    path, jobs = f"{shared_folder(spark)}/docs", [0]
    rows = [(i, t, t and t * 20) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, html string").repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)

    def shaken(df, folder=None, rows=None):
        jobs[0] += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k" if jobs[0] % 2 else "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "64k" if jobs[0] % 2 else "4m")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return written(df, folder, rows)

    for module in (exact_dedup, ngram_join, warc):
        monkeypatch.setattr(module, "written", shaken)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    last = {t or "": i for i, t in enumerate(texts)}
    try:
        got = exact_dedup.exact_groups(docs).collect()
        assert sorted(r.doc_id for r in got if r.kept) == sorted(last.values()) and len(got) == len(texts)
        assert all(r.keep_id == last[texts[r.doc_id] or ""] for r in got)
        kept = exact_dedup.dedup_stage(spark, docs, "").collect()
        assert Counter(r.text or "" for r in kept) == Counter(list(last))
        kept = ngram_join.near_dedup_stage(spark, docs, "").collect()
        assert sorted(r.doc_id for r in kept) == sorted(i for i, t in enumerate(texts) if not t or first[t] == i)
        files = warc.write_warc(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "html"), shared_folder(spark))
        pages = warc.read_warc(files).collect()
        long = [t for t in texts if t and len(t) * 20 >= warc.LEAST_PAYLOAD]
        assert sum(r.record_type == "revisit" for r in pages) == len(long) - len(set(long))
        assert all(r.refers_to == first[texts[r.page_id]] for r in pages if r.record_type == "revisit")
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")
