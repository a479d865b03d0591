import base64
import collections
import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import bagminhash, bpe, exact_dedup, mixing, ngram, pii, suffix_quality, token_records, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, T string, size int, h int"
WORDS = "the of and to in is was he for it with as his on be at by had not are but from or have an they".split()


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(i * j % 97) for j, i in enumerate(rng.integers(0, len(WORDS), n)))


LONG = words(3000, 1)
TEXTS = [None, "", " \n\t", "one", "Ünï çode 1 \U0001f600 two", LONG, LONG, LONG + " tail", words(60, 2), words(60, 2).replace(" ", "\n"),
         "same line\nsame line\n \n" + "a b c d e f g h " * 8, "x" * 5000, "a\x1cb\x85 c　d\r\ne", "#*$%&|<> " * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "x", "y", "z", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s1", 1, "x", "y", "z", 1, 2), (3, "one", None, "s0", 1, "x", "y", "z", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty, tmp_path):
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert exact_dedup.dedup_groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    assert suffix_quality.good(empty).count() == 0
    assert bagminhash.near_classes(empty).count() == 0 and bagminhash.near_dedup(empty).count() == 0
    assert ngram.held_out_scores(empty).count() == 0
    assert pii.find(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.held_out_scores(empty, labels).count() == 0
    token_records.write(empty, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/t")
    assert token_records.read_back(spark, f"file://{tmp_path}/t").count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_exact_dedup(docs):
    out = exact_dedup.dedup_groups(docs).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in [*TEXTS, "no id", "one"]]
    assert len(out) == len(norm) and sum(r.kept for r in out) == len(set(norm))
    assert {r.id: r.keep_id for r in out}[6] == 5 and {r.id: r.keep_id for r in out}[9] == 8
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm))


def test_dedup_of_equal_rows_and_many_groups(spark, monkeypatch):
    rows = [(i // 2, f"text {i % 40}", i) for i in range(400)] + [(None, "text 1", 9), (900, None, 1), (901, "", 2), (0, "text 0", 7), (0, "text 0", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest__ int").withColumn("m", F.create_map(F.lit("a"), F.col("digest__")))
    for few in (1 << 19, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", few)
        a, b = (exact_dedup.dedup(df.repartition(n)) for n in (2, 5))
        assert a.columns == df.columns
        a, b = (sorted((r.text or "", r.doc_id, r.digest__) for r in x.collect()) for x in (a, b))
        assert a == b and [(t, i) for t, i, _ in a] == sorted([("", 900)] + [(f"text {k}", k // 2) for k in range(40)])


def test_heavy_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    out = exact_dedup.dedup_groups(df).filter("group_size = 1000").collect()
    assert len(out) == 1000 and {r.keep_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    caps, w, left, out = {"a": 200.0, "b": 2000.0, "c": 0.0, None: 1000.0}, {"a": 3, "b": 1, "c": 2, None: 3}, 2400.0, {}
    while True:
        share = {s: left * w[s] / sum(w[t] for t in caps if t not in out) for s in caps if s not in out}
        over = [s for s in share if share[s] > caps[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = caps[s]
        left = 2400.0 - sum(out.values())
    assert got == pytest.approx(out)


def test_mixing(docs):
    a, b = mixing.taken(docs).toPandas(), mixing.taken(docs).toPandas()
    assert len(a) == len(TEXTS) + 2 and (a.taken <= 2 * a["size"]).all()
    assert sorted(zip(a.id.fillna(-1), a["size"], a.taken)) == sorted(zip(b.id.fillna(-1), b["size"], b.taken))
    for _, g in a.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 4 * g.block.iloc[0]
    assert mixing.mixed(docs).columns == docs.columns


def mix_by_hand(rows, block=mixing.BLOCK, repeat=mixing.REPEAT):
    """Words taken of each row from (rid, source, size, h, id, target, block) by a plain loop over slots and streams."""
    taken, sources = collections.Counter(), {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    for size in {r.block for r in rows}:
        group = sorted((s for s in sources if sources[s][0].block == size), key=lambda s: (s is None, s))
        edges, total = [], 0.0
        for s in group:
            edges.append((total, total := total + sources[s][0].target))
        hits = collections.Counter()
        for i in range(int(-(-total // size))):
            u = (i * mixing.GOLDEN % (1 << 45)) / (1 << 45)
            for s, (low, high) in zip(group, edges):
                if low / total <= u < high / total:
                    hits[s] += 1
        for s in group:
            stream = [r.rid for r in sorted(sources[s], key=lambda r: (r.bucket, r.h, -1 if r.id is None else r.id, r.rid)) for _ in range(r.size)]
            blocks = [stream[i : i + size] for i in range(0, len(stream), size)]
            for k in range(min(hits[s], repeat * len(blocks))):
                taken.update(blocks[k % len(blocks)])
    return taken


def test_mixing_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, words(int(rng.integers(0, 400)), i), ["big", "b2", "b3", None][int(rng.integers(0, 4))] if i % 9 else f"tiny{i % 27}") for i in range(220)]
    rows += [(500, "one", "a word"), (501, "three more words", "b words"), (502, None, "none"), (None, "no id", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.taken(df).withColumn("bucket", F.shiftrightunsigned("h", 48)).collect()
    want = mix_by_hand(out)
    assert {r.rid: r.taken for r in out} == {r.rid: want[r.rid] for r in out} and len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, [0, r.target, r.block])[0] += r.taken
    assert all(abs(t - target) <= 4 * b for t, target, b in by.values()) and by["a word"][0] >= 1 and by["b words"][0] >= 2
    assert {b for _, _, b in by.values()} >= {1, 16, 128} or len({b for _, _, b in by.values()}) > 2


def test_golden_points_are_exact(spark):
    some = [0, 1, 2, 12345, (1 << 40) + 7, (1 << 60) + 3]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in some], "i long").coalesce(1).select(mixing.golden_point(F.col("i"))).collect()]
    assert got == [(i * mixing.GOLDEN % (1 << 45)) / (1 << 45) for i in some]


def test_quality(docs):
    got = {r.id: r for r in suffix_quality.measures(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(cover)), i
        m = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        assert got[i].n_passage_words == len({j for k in range(len(w) - 4) if m[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        assert got[i].longest_repeat == max((k for k in range(len(w)) if len({tuple(w[a : a + k]) for a in range(len(w) - k + 1)}) < len(w) - k + 1), default=0) if len(w) < 700 else True
    assert got[10].n_dup_lines == 1 and got[13].n_symbols == 240
    assert suffix_quality.good(docs).columns == docs.columns


def test_quality_verdict_decides(spark):
    five = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(6)]
    once = [f"w{i}" for i in range(400)]
    texts = {
        "clean": " ".join(once), "short passages": " ".join(x for i in range(12) for x in (five[i % 6], f"x{i}")), "one long passage": " ".join(once[:7] + once[20:35] + once[:7]),
        "base": " ".join(once[:30] * 3), "few words": "a b c", "long text, one passage": " ".join(once + once[:20]),
    }
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id string, text string, n_words int")
    got = {r.id: (r.failed, r.kept) for r in suffix_quality.measures(df).select("id", suffix_quality.base_failed().alias("failed"), suffix_quality.verdict().alias("kept")).collect()}
    assert got == {"clean": (False, True), "short passages": (False, False), "one long passage": (False, False), "base": (True, False), "few words": (True, False), "long text, one passage": (False, True)}
    assert {r.doc_id for r in suffix_quality.good(df).collect()} == {"clean", "long text, one passage"}


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.id: r for r in bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 19)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1 << 14)
    path, most = P.path("byte_bpe_multi_50k.tiktoken"), 0
    enc = bpe.Encoder(bpe.encoder(path, P.PATTERN).ranks, P.PATTERN)
    texts = [" ".join(f"w{i}x{j}" * 20 for j in range(40)) for i in range(240)]
    plain = bpe.Encoder(enc.ranks, P.PATTERN)
    for text, ids in zip(texts, enc.encode_all(texts)):
        assert ids.tolist() == plain.encode(text)
        most = max(most, sum(len(w) + len(i or b"") for memo in (enc.memo, enc.older) for w, i in memo.items()))
    # Two memos, each with a group beyond the bound; all words and ids have about 3 MB.
    assert 1 << 19 < most < 3 << 19


def test_bpe_gives_a_batch_on_in_slices(spark, monkeypatch):
    """Ids of a large batch aren't held all at once, and rows and order stay."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = [words(2000 + i, i) for i in range(400)] + ["", LONG * 100, "", "end"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts})
    out = list(bpe.round_trip(docs, path, P.PATTERN, with_ids=True)(iter([batch, batch.slice(0, 0), batch.slice(401)])))
    assert max(sum(len(texts[i]) for i in b.column("id").to_pylist()) for b in out) <= max(1 << 20, len(LONG) * 100)
    assert sum(b.num_rows > 1 for b in out) > 3
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["id"] for r in rows] == [*range(404), 401, 402, 403]
    enc = bpe.encoder(path, P.PATTERN)
    for r in rows:
        assert enc.decode(r["ids"]).decode() == texts[r["id"]] and r["n_tokens"] == len(r["ids"])
    ids = [r for b in bpe.tokenise(docs, path, P.PATTERN)(iter([batch])) for r in b.to_pylist()]
    assert [r["ids"] for r in ids] == [r["ids"] for r in rows[:404]]


def test_worker_drops_what_another_operator_kept(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_pydict({"id": [1], "t": [LONG]})
    for _ in range(2):
        list(bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)(iter([batch])))
        assert bpe.encoder.cache_info().currsize == 1
    list(suffix_quality.measures(docs)(iter([batch])))
    assert bpe.encoder.cache_info().currsize == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    assert sorted(bpe.PerfectHash(keys).places(keys).tolist()) == list(range(5000))


def test_token_records(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_records.write(docs.filter("doc_id <> 3"), P.path("byte_bpe_50k.json"), folder)
    tok, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.id: r for r in token_records.read_back(spark, folder, shuffled=True).collect()}
    for i, t in enumerate(TEXTS):
        if i != 3:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), ids.tobytes())
            start += len(ids)
    row = spark.read.parquet(f"{folder}/index").first()
    assert row.wide == 2
    broken = bytearray(token_records.frame(b"abcd"))
    broken[13] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(broken))


def test_token_encoder_equals_library():
    path = P.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_records.encoder(path)
    rng = np.random.default_rng(11)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\0", "a", "don't", "it's'", "'", "''re", "12³4", "x1", "é", "ñandú", "ǅ", "字", "\u0378", "😀!", "<|endoftext|>", "...", "_", "-", "the", "ª", "½"]
    texts = ["", "x <|endoftext|> y", "<|endoftext|>", " <|endoftext|>", *["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(3000)]]
    for t in texts * 2:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert 50256 not in np.frombuffer(token_records.Encoder(path, special_as_text=True).encode("x <|endoftext|> y"), "<u2")


def test_token_records_in_scan_order(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i} <|endoftext|>") for i in range(40)], "doc_id long, text string")
    folder = f"file://{tmp_path}"
    rows.coalesce(1).write.parquet(f"{folder}/in")
    one = spark.read.parquet(f"{folder}/in")
    assert token_records._in_order(one.select(F.col("doc_id").alias("id"))) is not None
    assert token_records._in_order(rows.orderBy(F.desc("doc_id")).select(F.col("doc_id").alias("id"))) is None
    assert token_records._in_order(rows.unionByName(rows).select(F.col("doc_id").alias("id"))) is None
    token_records.write(one, P.path("byte_bpe_50k.json"), f"{folder}/a")
    token_records.write(rows.orderBy(F.desc("doc_id")), P.path("byte_bpe_50k.json"), f"{folder}/b")
    a, b = (sorted(map(tuple, token_records.read_back(spark, f"{folder}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 40


def test_warc(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    big = "é" * 700
    html = [None, "", "small", "small", big, big, big, trap, trap * 60, "z" * 9000, words(500)]
    pages = spark.createDataFrame([(i, f"http://x/{i} y", h) for i, h in enumerate(html)] + [(None, None, big)], "page_id long, url string, html string").repartition(2)
    warc.write(pages, f"file://{tmp_path}/w")
    for split in (512, 8 << 20):
        got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/w", split).collect()}
        assert len(got) == len(html) + 1
        for i, h in enumerate(html):
            data = (h or "").encode()
            r = got[str(i)]
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", "6") if i in (4, 5) else ("response", None))
            assert r.record_type == "revisit" or bytes(r.payload) == data
        assert got[None].refers_to == "6"


def test_warc_equal_rows_clashing_columns_and_long_payloads(spark, tmp_path):
    big, long = "b" * 1500, "l" * 3_000_000
    rows = [(7, "u", big, 1, "x")] * 3 + [(7, "v", big, 1, "x"), (3, None, big, 1, "x"), (None, "u", big, 1, "x"), (9, "u", "tiny", 1, "x"), (9, "u", "tiny", 1, "x")]
    rows += [(20, "w", long, 1, "x"), (21, "w", long, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int, payload string").withColumn("size", F.lit(5)).repartition(3)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(pages).filter("page_id IS NOT NULL").collect())
    assert got == sorted([("7", "response", None, 1500)] + [("7", "revisit", "7", 1500)] * 3 + [("3", "revisit", "7", 1500)] + [("9", "response", None, 4)] * 2
                         + [("20", "revisit", "21", len(long)), ("21", "response", None, len(long))])
    warc.write(pages.filter("page_id = 7 AND url = 'u'"), f"file://{tmp_path}/w")
    assert sorted(r.record_type for r in warc.read(spark, f"file://{tmp_path}/w", 700).collect()) == ["response", "revisit", "revisit"]


def test_warc_reads_a_split_about_once(tmp_path):
    rng, parts = np.random.default_rng(4), []
    for i in range(1500):
        text = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx" if i % 7 == 0 else rng.bytes(int(rng.integers(0, 6000)))
        parts.append(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(text) + text + b"\r\n\r\n")
    (tmp_path / "f").write_bytes(data := b"".join(parts))
    starts, read = np.cumsum([0] + [len(p) for p in parts])[:-1].tolist(), 0
    split = 1 << 18
    reached, at = {0}, 0
    for low in range(0, len(data), split):
        view = warc._open(f"file://{tmp_path}/f", len(data))
        found, exits = warc._exits(view, low, min(low + split, len(data)))
        assert set(s for s in starts if low <= s < low + split) <= set(found)
        read += view.read
        if at in found:
            at = dict(zip(found, exits))[at]
            reached.add(at)
    assert at == len(data) and reached - {len(data)} <= set(starts) and read <= 1.1 * len(data)


def test_near_dedup(spark):
    base = [words(80, s).split() for s in range(40)]
    rows = []
    for s, w in enumerate(base):
        for k in range(4):
            rows.append((10 * s + k, " ".join(w[:40] + ["zz"] + w[41:] if k == 1 else w[:-1] if k == 2 else w)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in bagminhash.near_classes(df).collect()}
    assert all(got[10 * s + k].class_id == 10 * s for s in range(40) for k in range(4))
    assert (got[1000].class_size, got[1001].class_size, got[1003].class_id, got[None].class_id) == (1, 1, 1002, 1002)
    assert bagminhash.near_dedup(df).count() == 43


def crowd(n=400, seed=5):
    """Texts of one template with a part of their own, similar to each other by less than 0.8; every tenth has a partner by more."""
    rng = np.random.default_rng(seed)
    template, rows = words(300, 77), []
    for i in range(n):
        own = [f"o{x}" for x in rng.integers(0, 1 << 40, 40)]
        rows.append((2 * i, f"{template} {' '.join(own)}"))
        if i % 10 == 0:
            rows.append((2 * i + 1, f"{template} {' '.join(own[:3])} " + " ".join(f"p{x}" for x in rng.integers(0, 1 << 40, 37))))
    return rows


def test_near_dedup_crowd(spark):
    rows = crowd()
    bags = {i: bagminhash._bag(t) for i, t in rows}
    assert bagminhash.similarity(bags[0], bags[1]) >= 0.8 > bagminhash.similarity(bags[0], bags[2]) > 0.6
    got = {r.id: r for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i].class_id == i - i % 2 for i, _ in rows)
    assert sum(r.class_size == 2 for r in got.values()) == 80


def test_near_dedup_needs_no_orders(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "ORDERS", 1)
    got = bagminhash.near_classes(spark.createDataFrame(crowd(150), "doc_id long, text string").repartition(4)).collect()
    assert all(r.class_id == r.id - r.id % 2 for r in got)


def test_signatures_are_unbiased():
    a = (np.arange(100, dtype=np.uint64), np.r_[np.full(60, 3), np.full(40, 1)])
    b = (np.arange(20, 120, dtype=np.uint64), np.r_[np.full(60, 2), np.full(40, 5)])
    true = bagminhash.similarity(a, b)
    m = 4096
    least = bagminhash.signatures(np.r_[np.zeros(100, int), np.ones(100, int)], bagminhash.mix(np.r_[a[0], b[0]]), np.r_[a[1], b[1]], 2, m)
    assert np.isfinite(least).all() and abs((least[0] == least[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_ngram(docs):
    out = ngram.held_out_scores(docs).toPandas()
    assert len(out) == len(TEXTS) + 2 and np.isfinite(out.score).all() and (out.score <= 1e-9).all()
    assert (out.held_out == [zlib.crc32(b"" if np.isnan(i) else str(int(i)).encode()) % 7 == 2 for i in out.id]).all()


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries: a function from context and word to the probability."""
    raw = collections.Counter()
    for t in texts:
        w = ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) + ["</s>"]
        raw.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    vocabulary = {g[-1] for g in raw}
    cut = {k: ngram._discounts([list(c.values()).count(i) for i in (1, 2, 3, 4)]) for k, c in counts.items()}

    def p(context, word):
        k = len(context) + 1
        below = p(context[1:], word) if context else 1 / (len(vocabulary) + 1)
        of = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not of:
            return below
        left = sum(cut[k][min(n, 3) - 1] for n in of.values())
        n = of.get((*context, word), 0)
        return (n - (cut[k][min(n, 3) - 1] if n else 0) + left * below) / sum(of.values())

    return p, vocabulary, sum(raw.values())


@pytest.mark.parametrize(("order", "per_bucket"), [(1, 1 << 21), (2, 40), (3, 40), (3, 1 << 21), (4, 100)])
def test_ngram_equals_brute_force(spark, order, per_bucket):
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("aaaabbbccdefghi"), rng.integers(0, 9))) for _ in range(60)] + ["A b", "", "zz a b c"] + ["the end"] * 300
    model = ngram.train(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), order, per_bucket)
    p, vocabulary, n = kneser_ney(texts, order)
    assert (model.n_tokens, model.n_words) == (n, len(vocabulary))
    queries = [*texts[:25], "unknown word", "a unknown b", "the the end end", "zz A B c d"]
    data = [q.encode() for q in queries]
    got = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    unigrams = collections.Counter(w for t in texts for w in [*t.lower().split(), "</s>"])
    for i, q in enumerate(queries):
        w = ["<s>"] * (order - 1) + q.lower().split() + ["</s>"]
        want = sum(np.log10(p(tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w)))
        assert got["score"][i] == pytest.approx(want, rel=1e-9), q
        words = w[order - 1 :]
        assert got["base_score"][i] == pytest.approx(sum(np.log10((unigrams[x] + 1) / (n + len(vocabulary) + 1)) for x in words), rel=1e-9)
        assert (got["n_tokens"][i], got["n_known"][i]) == (len(words), sum(x in unigrams for x in words))
    for context in (("a",), ("the",), ("zz", "a"), ("unknown",)):
        full = ("<s>",) * max(0, order - 1 - len(context)) + context[len(context) - min(order - 1, len(context)) :]
        assert sum(p(full, x) for x in [*vocabulary, "?"]) == pytest.approx(1.0)


def test_ngram_counts_beyond_a_byte():
    values = np.array([0, 1, 254, 255, 256, 1 << 40])
    arrays = ngram._narrow("a", values)
    assert ngram._counts(arrays, "a", np.array([5, 4, 3, 2, 1, 0, -1])).tolist() == [1 << 40, 256, 255, 254, 1, 0, 0]
    columns = [np.array([0, 0, 7, 1 << 40]), np.array([5, 1 << 33, 0, 2]), np.array([1, 2, 3, 300])]
    assert all((x == y).all() for x, y in zip(ngram._unpack(ngram._pack(columns)), columns))
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    stored = ngram._hashed(keys, {"a": np.arange(5000)})
    assert (ngram._counts(stored, "a", ngram._find(stored, keys)) == np.arange(5000)).all() and (ngram._find(stored, keys + np.uint64(1)) < 0).all()


def test_toxicity(spark):
    rows = [(i, words(30, i) + (" you 1d10t fool " if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "ІDІОТ"), (1002, words(30, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None)], "doc_id long, toxic int")
    got = {r.id: r for r in toxicity.held_out_scores(df, labels).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(400)) and got[1000].score < 0.7 and got[1002].score < 0.7
    assert got[1001].n_hits == 1


def test_toxicity_folding():
    assert toxicity.fold("Call 455 now, 3 4 5 $4 1d!0t 1DI0T f00l! @ss wa|t") == ["caii", "455", "now", "3", "4", "5", "4", "idiot", "idiot", "fooi", "ass", "wait"]
    assert toxicity.fold("") == toxicity.fold(" .,! ") == [] and toxicity.fold("4_5 a_1") == ["4", "5", "a", "1"]


def test_toxicity_matcher_equals_naive_search(monkeypatch):
    stored = {"w": {"bad": 1.0, "fooi": 2.0, "a": 0.5}, "p": {"not bad": 0.0, "bad fooi": 0.0, "a a": 0.0}}
    monkeypatch.setattr(toxicity, "_stored", stored.__getitem__)
    toxicity._machine.cache_clear()
    lexicon, rng = toxicity.Lexicon("w", "p"), np.random.default_rng(2)
    for _ in range(500):
        words = rng.choice(["bad", "fooi", "a", "not", "x", "ab"], rng.integers(0, 12)).tolist()
        covered = {i + j for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in stored["p"] for j in (0, 1)}
        want = [(sum(len(w) + 1 for w in words[:i]), stored["w"][w]) for i, w in enumerate(words) if w in stored["w"] and i not in covered]
        assert [(a, v) for a, _, v in lexicon.hits(words)] == want, words
    toxicity._machine.cache_clear()


def test_toxicity_keeps_every_term(spark):
    letters = "bcdfghjkmn"
    terms = ["q" + "".join(letters[int(d)] for d in f"{i:04}") + "w" for i in range(2100)]
    rows = [(k, " ".join(terms)) for k in range(20)] + [(100 + k, words(30, k)) for k in range(40)]
    lexicon, _ = toxicity.learn(spark.createDataFrame([(i, t, int(i < 100)) for i, t in rows], "id long, t string, y int"))
    assert set(terms) <= set(lexicon.weights)


def test_pii(spark):
    text = "mail a.b@c.example.org or +1 (555) 222-3333, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111 and 4111 1111 1111 1112 @ x@y"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain words\nno data")], "doc_id long, text string")
    got = {r.id: r for r in pii.find(df).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    base = ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in (("email", "a.b@c.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 222-3333")))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == got[3].spans == ""
    for t in ("a@b@c.d", "x@y.z@q.r", "a@@b.c", "@a.b c@d.e"):
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "email"] == [m.span() for m in pii._PATTERN["email"].finditer(t)]


def extra(text):
    return [(k, text[a:b]) for k, a, b in pii.added_spans([text], [pii.base_spans(text)])[0]]


def test_pii_written_out_address():
    assert extra("no data\nkelmo wrute jo.fan [at] exmple [dot] com\nplain") == [("email", "jo.fan [at] exmple [dot] com")]


def test_pii_items_side_by_side():
    for by in (", ", " "):
        assert [s for _, s in extra(f"(212) 555-1234{by}(415) 555-9876")] == ["(212) 555-1234", "(415) 555-9876"], by
    assert pii._items("card", "4111 1111 1111 1111 5500 0000 0000 0004", 0, 39) == [(0, 19), (20, 39)]


def test_pii_long_line():
    for n in range(252, 257):
        assert extra(" ".join(["kelmo"] * n) + " jo.fan [at] exmple [dot] com") == [("email", "jo.fan [at] exmple [dot] com")], n
    assert pii.shape("a" * 70 + "9") == "x+9"


def test_pii_plain_addresses_and_numbers():
    assert extra("write to john at example dot com today") == [("email", "john at example dot com")]
    assert extra("Ask John AT Example DOT com, or 9807915762804490") == [("email", "John AT Example DOT com"), ("card", "9807915762804490")]
    for clean in ("see you at noon dot", "look at the dot com boom", "meet at 10:30 on 2024-01-02 at home", "the year 2020 and 12345678 items", "v1.2.3 at 45%"):
        assert extra(clean) == [], clean


def test_pii_field_on_held_out_sentences():
    right = found = true = 0
    for words, labels in pii.labelled_table(200, 99):
        got, labels = pii.field().labels([words])[0], np.array(labels)
        right, found, true = right + ((got == labels) & (labels > 0)).sum(), found + (got > 0).sum(), true + (labels > 0).sum()
    assert right / found > 0.97 and right / true > 0.97


def test_pii_pieces_equal_whole_lines():
    rng, model = np.random.default_rng(8), pii.field()
    lines = [[*w] for w, _ in pii.labelled_table(60, 5)] + [sum((w for w, _ in pii.labelled_table(40, 6)), []), ["at"], ["a"] * 9]
    lines += [rng.choice(["at", "dot", "com", "x@y.z", "555", "(212)", "word", "4111"], rng.integers(1, 12)).tolist() for _ in range(60)]
    for words, got in zip(lines, model.labels(lines)):
        assert (got == pii.viterbi([model.scores([words])[0]], model.moves)[0]).all(), words


def test_pii_planted_documents(spark):
    """Written-out addresses, numbers without a country and mistyped cards, which the base patterns don't see."""
    rows, clean = [], []
    for i, (w, labels) in enumerate(pii.labelled_table(120, 33)):
        plain = [x for x, y in zip(w, labels) if not y and x.isalpha() and x not in ("at", "dot")] or ["word"]
        item = ["kim at home dot org", "(212) 555-0199", "4111 1111 1111 1112", "ana.b (at) some-host [dot] net"][i % 4]
        rows.append((i, " ".join([*plain, item, *plain]), item))
        clean.append((1000 + i, " ".join(plain * 2), ""))
    df = spark.createDataFrame(rows + clean + rows[:5], "doc_id long, text string, T string").withColumn("row", F.lit(1))
    out = pii.find(df).collect()
    items, texts = {i: t for i, _, t in rows}, {i: t for i, t, _ in rows}
    assert len(out) == 245 and not any(r.n_spans for r in out if r.id >= 1000)
    caught = sum(items[r.id] in [texts[r.id][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in out if r.id < 1000)
    assert caught >= 0.95 * 125 and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out) == 0


def test_pii_empty_repeated_and_long(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string, id string")).count() == 0
    long = "word " * 60000 + "kim at home dot org " + "word " * 60000
    out = pii.find(spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.spans for r in out) == ["", "email:300000:300019", "email:300000:300019"]


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    moves, seqs = rng.normal(size=(3, 3)), [rng.normal(size=(n, 3)) for n in (1, 4, 5)]
    for s, got in zip(seqs, pii.viterbi(seqs, moves)):
        best = max(itertools.product(range(3), repeat=len(s)), key=lambda p: sum(s[i, p[i]] for i in range(len(s))) + sum(moves[p[i], p[i + 1]] for i in range(len(s) - 1)))
        assert tuple(got) == best


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest__ int, row string, ID string, label int"


def pipeline_rows():
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(60 + i)), "en", f"s{i % 3}", 1, 1, "r", "i", 0) for i in range(30)]
    near = [(100 + i, clean[i][1].replace(f"w{i}x59", "other"), "en", clean[i][3], 1, 1, "r", "i", 0) for i in range(5)]
    same = [(200 + i, clean[i][1].replace(" ", "\n"), None, clean[i][3], 1, 1, "r", "i", 0) for i in range(5)]
    bad = [(300, None, None, None, None, None, None, None, None), (301, "", "en", "s1", 0, 1, "r", "i", 0), (302, "again " * 300, "en", "s1", 0, 1, "r", "i", 0), (303, "few words", "en", None, 0, 1, "r", "i", 0)]
    long = [(400, " ".join(f"l{k}" for k in range(200_000)), "en", "s2", 1, 1, "r", "i", 0), (None, " ".join(f"n{k}" for k in range(90)), "en", "s0", 1, 1, "r", "i", 0)]
    return clean + near + same + bad + long + clean[:2]


def test_pipeline_stages(spark):
    rows = pipeline_rows()
    docs, seen = spark.createDataFrame(rows, PIPELINE_SCHEMA).repartition(3), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.keep(stage(spark, docs, ""), f"test-{name}")
        assert name == "tokens" or out.schema.simpleString() == docs.schema.simpleString()
        seen[name] = out.collect()
        docs = out
    clean = set(range(30)) | {400, None}
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert set(ids["quality"]) == clean | set(range(100, 105)) | set(range(200, 205)) and len(ids["quality"]) == 44
    assert set(ids["exact"]) == clean | set(range(100, 105)) and len(ids["exact"]) == 37
    assert sorted(ids["near"], key=str) == sorted(clean, key=str)
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in seen["mix"])
    sizes, taken = collections.Counter(), collections.Counter()
    for r in seen["near"]:
        sizes[r.source] += len(r.text.split())
    for r in seen["mix"]:
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 2 * n for s, n in sizes.items()) and sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.35)
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert len(seen["tokens"]) == len(seen["mix"])
    for r in seen["tokens"]:
        assert enc.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_of_empty_table(spark):
    docs = spark.createDataFrame([], PIPELINE_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, ""), f"empty-{name}")
        assert docs.count() == 0, name


def test_near_classes_equal_brute_force(spark):
    """Texts of a few themes with edits of every size: classes are the components of the graph of all pairs of 0.8 or more."""
    rng, rows = np.random.default_rng(21), []
    for theme in range(12):
        base = words(int(rng.integers(20, 160)), theme).split()
        for _ in range(14):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(w[int(rng.integers(0, 4)) :])))
    bags = [bagminhash._bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bagminhash.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.id: r.class_id for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("LABEL", F.lit("x")).repartition(3)).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if top(i) == top(j)]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs) > 100
    assert all(top(i) == top(j) for i in got for j in got if got[i] == got[j])


def test_empty_tables_of_bpe_and_records(spark, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0 and bpe.tokenise(empty, path, P.PATTERN).count() == 0
