"""Small tables with nulls, empty and repeated texts against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from polyquill.llm import chunks, decontam, mainhtml, minhash, packing, pii, quality_rules, toxicity
from polyquill.llm.linecrf import train

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my nu xi omikron pi rho sigma tau ypsilon".split()


def _text(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 20, n), r.integers(0, 50, n)))


PASSAGE = _text(99, 70)
TEXTS = [
    None, "", "   ", "one", _text(1), _text(1), _text(2) + " end", _text(2), _text(3) + " " + PASSAGE + " " + _text(4), _text(5) + " xx " + PASSAGE, _text(6, 3000),
    "mail a.b@c.org or 10.0.0.1 and +49 (30) 1234567 then 4111 1111 1111 1111 here", "x" * 3000, "line one\nline one\n" + _text(7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars int").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(4, 14)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def test_packing_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = packing.report(docs.select("doc_id", "text")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.start == 4096 * r.piece and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.report(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_whole_and_no_worse(seed):
    left = np.bincount(np.random.default_rng(seed).integers(1, 100, 150), minlength=101)
    s = packing.solve(left, 100)
    used = np.zeros(101, int)
    for f, n in s:
        assert sum(f) <= 100
        np.add.at(used, list(f), n)
    assert (used == left).all() and sum(n for _, n in s) <= sum(n for _, n in packing.best_fit(left, 100))


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(t) for t in TEXTS], list(range(len(TEXTS)))
    for i in range(len(up)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), up[i]) for i in range(len(up))}
    assert minhash.near_duplicates(none).count() == 0


def test_pipeline_drops_copies_from_a_similarity_of_80(spark):
    import corpus_pipeline

    def copy(words, k):  # k changed words, far apart, are in 5 k of the shingles
        return " ".join(f"new{i}" if i % 30 == 10 and i // 30 < k else w for i, w in enumerate(words))

    a, b = ([f"{p}{i}" for i in range(1000)] for p in "ab")
    texts = [" ".join(a), copy(a, 20), " ".join(b), copy(b, 25)]  # 896 / 1096 and 871 / 1121
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_rows_that_share_a_doc_id(spark):
    import corpus_pipeline

    texts = [_text(s) for s in (31, 32, 33, 34)]
    near = [t + " end" for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, near[0]), (3, near[1]), (4, texts[2]), (4, texts[2]), (5, near[2]), (5, texts[3]), (6, ""), (6, ""), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (5, 5), (6, 6), (6, 6)]
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([rows[i] for i in (0, 1, 4, 7, 8, 9, 10)], key=str)


def test_decontamination(docs, spark):
    items = ["  ", None, PASSAGE, "alpha7", _text(6, 3000)[200:300], "not in there at all"]
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for r in decontam.report(docs, bench).collect():
        w = words(TEXTS[r.doc_id])
        hit, found = set(), set()
        for k, t in enumerate(items):
            p = words(t)
            m = min(10, len(p))
            wins = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    found.add(f"i{k}")
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


def test_personal_data(docs):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (1, 1, 1, 1)
    assert all(got[i].spans == "" for i in (0, 1, 2, 4, 12))
    d, _, spans = pii.with_spans(docs.where("doc_id = 11"), pii.train(docs.sparkSession))
    assert d.select(pii.redacted(d["text"], d[spans])).first()[0] == "mail [EMAIL] or [IP] and [PHONE] then [CARD] here"


def test_quality_rules(docs, labels, none):
    crf = train(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, crf).collect()}
    assert [rows[i].n_words for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 120]
    assert rows[13].n_dup_lines == 1 and rows[0].base_failed and not rows[0].kept
    assert quality_rules.judge(none, crf).count() == 0


def test_training_reads_texts_whole(spark, monkeypatch):
    from polyquill.llm import linecrf

    seen = []
    monkeypatch.setattr(linecrf, "fit", lambda f, first, good: seen.append(np.diff(first).tolist()))
    docs = spark.createDataFrame([(0, "\n".join(_text(i, 5) for i in range(900))), (1, "a b\nc d")], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    linecrf.train(docs, marks)
    linecrf.train(docs, marks, lines=500)
    assert seen == [[900, 2], [2]]


def test_toxicity(docs, labels, none):
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.score < 0.5 for r in toxicity.report(docs, labels.where("false")).collect())
    assert toxicity.report(none, labels).count() == 0


def test_repeats(docs, none):
    got = {r.doc_id: r for r in chunks.report(docs).collect()}
    assert got[8].has_repeats and got[9].has_repeats and got[9].owners == [8]
    assert got[5].surplus_bytes == got[5].n_bytes and got[4].surplus_bytes == 0
    assert not any(got[i].has_repeats for i in (0, 1, 2, 3, 10, 11))
    assert chunks.report(none).count() == 0


def test_repeats_of_just_over_50_words(spark):
    r = np.random.default_rng(12)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, k)) for k in r.integers(3, 8, n))

    texts, passages = [], 300
    for i in range(passages):
        p = words(51 + i % 10)
        while len(p) < 265:
            p += "a"
        texts += [f"{words(40)} {p} {words(30)}", f"{words(25)} {p} {words(50)}"]
    texts += [f"{words(20)} {'ab cdefg ' * 80} {words(20)}", f"{words(30)} {'hijk ' * 90} {words(20)}"]  # repeats in the text itself
    texts += [words(100) for _ in range(50)]
    got = chunks.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id for x in got if x.has_repeats} == set(range(2 * passages + 2))


def test_chunks_of_periodic_and_short_texts():
    from polyquill.llm.textkit import utf8
    import pyarrow as pa

    for texts in (["x" * 3000, "-=" * 800, "", None, "short", "ab c" * 20], ["short"], [None], []):
        raw, at = utf8(pa.array(texts, pa.string()))
        ends, counts = chunks.borders(raw, at)
        sizes = np.diff(ends, prepend=0)
        assert sizes.sum() == len(raw) and counts.sum() == len(ends) and (sizes > 0).all() and (sizes <= chunks.MOST).all()
        assert all((c == 0) == (not t) and c <= len(t or '') // 32 + 10 for c, t in zip(counts, texts))


def test_chunks_are_whole():
    from polyquill.llm.textkit import utf8
    import pyarrow as pa

    raw, at = utf8(pa.array(TEXTS, pa.string()))
    ends, counts = chunks.borders(raw, at)
    first = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(TEXTS):
        assert (ends[first[i + 1] - 1] == at[i + 1]) if t else counts[i] == 0
    h = 0
    for b in raw[at[4] : at[4] + 50]:
        h = (2 * h + int(chunks._GEAR[b])) % 2**32
    assert chunks.gear(raw, at)[at[4] + 49] == h


def test_items_that_share_an_id_and_clashing_columns(spark):
    a = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("x", a), ("x", "red green blue"), (None, "only this")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{a} red green blue", "h", b"w"), (None, "see only this", "h", b"w"), (3, "", "h", b"w")], "doc_id long, text string, _hits string, _Items binary")
    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert (got[1].n_items, got[1].n_hit, got[1].items) == (1, 13, ["x"]) and got[None].items == [""] and got[3].n_words == 0
    found, (marks, *_) = decontam.hits(docs, bench)
    assert {r["_hits"] for r in found.collect()} == {"h"} and marks not in docs.columns
    assert decontam.report(docs.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs, bench.where("false")).collect())
    d, _, spans = pii.with_spans(docs.withColumn("_spans", docs["text"]), pii.train(spark))
    assert d.where(f"size({spans}) = 0").count() == 3 and "_spans" in d.columns and spans != "_spans"


def test_hashes_tell_crafted_words_apart(spark):
    """Two words that collide in every polynomial hash modulo 2**64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [f"{a} {a[::-1]} x y z q", f"{b} {b[::-1]} x2 y2 z2 q2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert [r.contaminated for r in decontam.report(docs, bench).orderBy("doc_id").collect()] == [True, False]
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]


def _chain_pairs(n):
    """Pairs of 16 byte words that collide in a hash which chains one 64-bit word through bijections, as the first one here did."""
    from polyquill.llm.textkit import _BASE, mix

    one = np.uint64(1)
    start = mix(np.uint64([0]) + _BASE)[0]
    r, found = np.random.default_rng(8), []
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    blocks = letters[r.integers(0, 26, (200_000, 8))].copy().view("<u8").ravel()
    state = mix((mix((np.uint64([16]) + start) * _BASE)[0] ^ blocks) * _BASE + one)
    for i in range(0, len(blocks) - 1, 2):  # the second blocks differ by what undoes the difference of the states
        second = np.frombuffer(b"abcdefgh", "<u8")[0]
        other = np.uint64(second ^ state[i] ^ state[i + 1])
        found.append((blocks[i].tobytes() + second.tobytes(), blocks[i + 1].tobytes() + other.tobytes()))
        if len(found) == n:
            return found


def test_hashes_tell_pairs_of_a_chain_apart():
    from polyquill.llm.textkit import Hasher, windows

    for a, b in _chain_pairs(500):
        raw = np.frombuffer(a + b, np.uint8)
        h = Hasher().spans(raw, np.array([0, 16]), np.array([16, 32]))
        assert h[0] != h[1]
    h = np.random.default_rng(1).integers(0, 2**63, 6).astype(np.uint64)
    k = np.uint64(12345)  # sums of multiples would not notice that one word's hash takes over what another's loses
    assert windows(h, np.array([0, 5]), 5, 5)[0][0] != windows(np.append(h[:3] + k, h[3:]), np.array([0, 5]), 5, 5)[0][0]


def test_hashes_are_siphash():
    """The public test vector: key 00..0f, message 00..0e."""
    from polyquill.llm.textkit import Hasher, eights

    raw = np.arange(15, dtype=np.uint8)
    key = np.frombuffer(bytes(range(16)), "<u8")
    assert int(Hasher._sip(eights(raw), np.array([0]), np.array([15]), 1, key)[0]) == 0xA129CA6149BE45E5


def test_token_ids_where_all_hashes_collide(monkeypatch):
    """Ids follow the bytes, even with a hash that tells only lengths apart."""
    import public_tokenizers
    import pyarrow as pa

    from polyquill.llm import wordids

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = wordids.WordIds(f.read())
    monkeypatch.setattr(wordids.Hasher, "spans", lambda self, raw, begin, end, seed=0: (end - begin).astype(np.uint64) + np.uint64(1))
    texts = ["the cat sat on the mat", "red dog and new hat, é É è!", "The THE the 12 34", "lgxbtyjqaabbdeaa tgonhjizycxxxzfx"]
    for _ in range(2):
        ids, first = words.encode(pa.array(texts), 1)
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_bytes_are_compared():
    from polyquill.llm.textkit import eights, same_bytes, utf8
    import pyarrow as pa

    raw, at = utf8(pa.array(["abcdefghijk", "abcdefghijX", "abc", "abcdefgh"]))
    size, e = np.diff(at), eights(raw)
    same = lambda i, j: bool(same_bytes(e, at[i : i + 1], size[i : i + 1], e, at[j : j + 1], size[j : j + 1])[0])
    assert [[same(i, j) for j in range(4)] for i in range(4)] == [[i == j for j in range(4)] for i in range(4)]


def test_token_ids_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa

    from polyquill.llm.wordids import WordIds

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = WordIds(f.read())
    r = np.random.default_rng(3)
    signs = list("aAzZjJ09 '’sStT!?<|>řßK\n\t.,-") + ["\u0338", "\u0301", "\u030c", "\u0085", "\x1c", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "İ", "ﬁ"]
    texts = ["".join(r.choice(signs, int(r.integers(0, 30)))) for _ in range(4000)] + ["", "x" * 3000, " ".join(map(str, range(3000)))]
    for _ in range(2):  # the second time from memory
        ids, first = words.encode(pa.array([*texts, None], pa.string()), 1)
        for i, t in enumerate([*texts, ""]):
            assert ids[first[i] : first[i + 1]].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_code_travels_to_executors(tmp_path):
    """Models and functions reach workers that have no copy of the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from polyquill.llm import decontam, mainhtml, quality_crf
docs = spark.createDataFrame([(i, f"some words of text {{i}} here") for i in range(8)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
print("rows", len(decontam.report(docs, docs.selectExpr("cast(doc_id as string) item_id", "text")).collect()), len(quality_crf.report(docs, labels).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 8 8" in out.stdout, out.stderr[-2000:]


def test_repeats_of_rows_without_an_id(spark):
    t = _text(41, 80)
    rows = [(None, t, "k"), (3, t, "k"), (None, _text(42, 80), "k"), (None, _text(43, 80), "k"), (None, _text(43, 80), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = {(r.doc_id, r.n_bytes, r.surplus_bytes > 0, r.has_repeats, tuple(r.owners)) for r in chunks.report(docs).collect()}
    size = lambda x: len(x.encode())
    assert got == {(None, size(t), True, True, (3,)), (3, size(t), False, True, ()), (None, size(_text(42, 80)), False, False, ()), (None, size(_text(43, 80)), True, True, ())}
    a, b = _text(44, 60), _text(45, 60)
    docs = spark.createDataFrame([(1, f"{PASSAGE}", 1.5), (2, f"{a} {PASSAGE} {b}", 2.5), (3, None, 0.5), (4, "é" * 300, 0.1)], "doc_id long, text string, x double")
    left = {r.doc_id: r for r in chunks.without_repeats(docs).collect()}
    assert left[1].text == PASSAGE and left[2].text.startswith(a[:60]) and left[2].text.endswith(b[-60:]) and len(left[2].text) < len(a) + len(b) + 80 and left[3].text is None and left[2].x == 2.5


def test_duplicates_of_rows_without_an_id(spark):
    import corpus_pipeline

    t = _text(51)
    docs = spark.createDataFrame([(None, t, 1), (None, t, 2), (7, t, 3), (8, t, 4), (8, t, 4)], "doc_id long, text string, _id int")
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True)] * 2 + [(7, 7, True)] + [(8, 7, False)] * 2, key=str)
    assert sorted(r["_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2, 3]


def test_components_of_stars_and_chains(spark):
    from polyquill.llm.shared import components

    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(299, 5000), (5000, 4000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(300), 4000, 5000]}, **{1000 + i: 1000 for i in range(41)}}


def test_components_of_hot_and_cold_nodes(spark, monkeypatch):
    from polyquill.llm import shared

    monkeypatch.setattr(shared, "HOT_PARTS", 3)  # other nodes get their minimum by shuffle
    edges = [(7, 7), *((500, i) for i in range(100, 160)), *((i, 90) for i in range(130, 200)), *((600 + i, 601 + i) for i in range(9)), (609, 700), (700, 609)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 90 for i in [90, *range(100, 200), 500]}, **{i: 600 for i in [*range(600, 610), 700]}}


def test_components_take_few_tasks(spark):
    """What the driver keeps of each task is what its memory grows by."""
    from polyquill.llm.shared import components

    context, held = spark.sparkContext, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    edges = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long").repartition(4, "b")
    for k, v in held.items():
        spark.conf.set(k, v)
    context.setJobGroup("components", "")
    try:
        components(edges)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k in held:
            spark.conf.unset(k)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    done = [info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s))]
    assert 40 < sum(done) <= 70  # with 4 partitions a shuffle


def test_columns_that_clash_with_the_rules_names(spark, labels):
    words = " ".join(f"w{i}." for i in range(80))
    docs = spark.createDataFrame([(1, words, 5, True, "a"), (1, None, 6, None, "b"), (None, "", 7, False, "c")], "doc_id long, text string, n_words int, kept boolean, _q_kept string")
    found, called = quality_rules.judged(docs, train(docs, labels))
    assert len(set(found.columns)) == len(found.columns) and called["kept"] == "kept_"
    assert {(r.n_words, r[called["n_words"]]) for r in found.collect()} == {(5, 80), (6, 0), (7, 0)}


def test_repeated_ids_stay_within_the_bounds(spark):
    docs = spark.createDataFrame([(1, f"some words of text {i}.\nand a second line", 1) for i in range(300)], "doc_id long, text string, k int")
    marks = spark.createDataFrame([(1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert train(docs, marks, rows=20).weight is not None
    weights, offset = toxicity.train(docs, marks, rows=20, unlabelled_rows=5)
    assert len(weights) and np.isfinite(offset)


def test_more_benchmark_than_one_block(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    items = [(f"i{k}", _text(200 + k, 14)) for k in range(12)]
    docs = spark.createDataFrame([(k, f"{_text(300 + k, 30)} {items[k][1]} {_text(400 + k, 30)}") for k in range(12)] + [(50, _text(500, 60)), (51, items[3][1] + " x " + items[9][1])], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.report(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {**{k: [f"i{k}"] for k in range(12)}, 50: [], 51: ["i3", "i9"]}


def test_packing_equals_the_optimum_of_small_cases():
    def optimum(lengths, capacity):
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for room in sorted(set(bins)):
                if room >= lengths[i]:
                    rest = list(bins)
                    rest.remove(room)
                    place(i + 1, [*rest, room - lengths[i]])
            place(i + 1, [*bins, capacity - lengths[i]])

        place(0, [])
        return best

    r = np.random.default_rng(11)
    for _ in range(150):
        capacity = int(r.integers(8, 40))
        lengths = sorted(r.integers(1, capacity + 1, int(r.integers(1, 10))).tolist(), reverse=True)
        left = np.bincount(lengths, minlength=capacity + 1)
        found = packing.solve(left, capacity)
        used = np.zeros(capacity + 1, int)
        for filling, times in found:
            assert sum(filling) <= capacity
            np.add.at(used, list(filling), times)
        assert (used == left).all()
        n, want = sum(t for _, t in found), optimum(lengths, capacity)
        assert packing.least_bins(left, capacity) <= want == n, (lengths, capacity)
    assert packing.least_bins(np.zeros(9, int), 8) == 0 and packing.least_bins(np.bincount([2049] * 7, minlength=4097), 4096) == 7 and packing.least_bins(np.bincount([1366] * 7, minlength=4097), 4096) == 4


def test_packing_sequences_of_very_many_pieces(spark):
    r = np.random.default_rng(17)
    for left in (np.bincount([11] * 1117, minlength=4097), np.bincount([7, 11] * 2000 + [11] * 1117, minlength=4097), np.bincount([1] * 9000 + [4095, 4000, 3000], minlength=4097), np.bincount(r.choice([5, 9, 11, 13], 30_000), minlength=4097), np.bincount(np.append(r.integers(2, 13, 20_000), r.integers(13, 4097, 200)), minlength=4097)):
        s, used = packing.solve(left), np.zeros(4097, int)
        for f, n in s:
            assert sum(f) <= 4096
            np.add.at(used, list(f), n)
        assert (used == left).all() and packing.least_bins(left, 4096) <= sum(n for _, n in s) <= sum(n for _, n in packing.best_fit(left, 4096))
    assert packing.fillings(packing.Counts(np.bincount([7, 11] * 2000, minlength=4097)), 11, 4096)[0][0] == 0  # 366 of 11 and 10 of 7: the last pieces are searched all the same
    docs = spark.createDataFrame([(i, "a " * 10) for i in range(1117)], "doc_id long, text string")
    rows = packing.report(docs).collect()
    assert sorted(x.doc_id for x in rows) == list(range(1117)) and {x.length for x in rows} == {11}
    assert sorted((x.sequence_id, x.offset) for x in rows) == sorted((q, 11 * k) for q, n in enumerate([372, 372, 372, 1]) for k in range(n))


def test_the_whole_pipeline(spark, tmp_path, labels):
    """Five stages over a table with nulls, empties, repeats and clashing names, against what each stage is for."""
    import corpus_pipeline

    good = lambda k: "\n".join(". ".join(_text(1000 + 10 * k + j, 12).split(" ")[i] + " the" for i in range(12)) + "." for j in range(8))
    leak = _text(900, 30)
    texts = [(i, good(i)) for i in range(12)] + [(20, good(3)), (21, good(4) + " end"), (22, good(5) + "\n" + leak), (30, None), (31, ""), (32, "short"), (None, good(7) + " null"), (33, good(8) + "\nwrite to someone.here@example.org now")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", True, 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int, _q_kept string, kept boolean, n_words int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(30, 0, 0), (31, 0, 0), (32, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage, kept = docs, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        kept.append({r.doc_id for r in stage.collect()})
    assert not kept[0] & {30, 31, 32} and kept[0] >= set(range(12)) | {20, 21, 22, 33, None}
    assert 20 not in kept[1] and 21 not in kept[1] and kept[1] >= set(range(12)) | {None}
    assert 22 not in kept[2] and kept[2] == kept[1] - {22}
    assert kept[3] == kept[2] and all("someone.here@" not in r.text for r in stage.collect())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept[3] and all(r.offset + r.length <= 4096 for r in rows)
    empty = tmp_path / "empty"
    docs.where("false").write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(empty / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_groups_with_heads_chains_and_small_blocks(spark, monkeypatch):
    """Copies near a head, chains of which only neighbours are linked, and texts that share a passage but no link; blocks of a few texts."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = np.random.default_rng(6)
    base = _text(700, 200).split()

    def changed(words, at, n):
        return [*words[:at], *(f"new{at}x{j}y{r.integers(10**6)}" for j in range(n)), *words[at + n :]]

    texts = [base] + [changed(base, int(r.integers(0, 195)), 1) for _ in range(14)]
    chain = base
    for k in range(12):
        chain = changed(chain, 15 * k, 8)
        texts.append(chain)
    other = _text(701, 200).split()
    texts += [other, changed(other, 3, 4), [*base[:60], *_text(702, 140).split()], _text(703, 150).split()]
    texts = [" ".join(t) for t in texts] + [" ".join(base)] * 3
    order = r.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string").repartition(3)

    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i: root(i) for i in range(len(texts))}
    assert len(set(want.values())) > 3 and max(np.bincount(list(want.values()))) > 20
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()} == want
