"""The operators against brute force, round trips and held-out accuracy, on small tables and on odd rows."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries, simple8b, trie_lm
from ledgerloom.llm.byte_bpe import encode_texts
from ledgerloom.llm.forest import near_duplicates
from ledgerloom.llm.jaccard import jaccard_components
from ledgerloom.llm.language import identify
from ledgerloom.llm.order_minhash import fingerprints
from ledgerloom.llm.packing import difference, pack, windows
from ledgerloom.llm.sharding import balanced_tree, grown, shard_rows
from ledgerloom.llm.toxicity import judge
from ledgerloom.llm.trie_lm import EliasFano
from ledgerloom.llm.trie_lm import score_texts as lm_scores

SMALL = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \t"), (4, "one"), (5, "One"), (6, "a  b   c \n d"), (7, "it's 12 o'clock!!  \t"), (None, "no id here at all"),
    (9, "same words in two rows"), (9, "same words in two rows"), (10, "SAME words in two rows"), (11, "日本 語 テ ẖ İ"), (12, "12 34 ..."), (13, "x" * 3000),
    (14, "word " * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket int, node int, sequence_id int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def word_ids():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(WORD)
    coder.encode_special_tokens = True
    return lambda text, end: np.array([*coder.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc_fold(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def test_shards(spark, docs, odd, empty):
    rows = queries.op1_hash_tree_sharding(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.size == len((docs[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode())
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    tree = balanced_tree(8)
    again = shard_rows(odd, "doc_id", tree, grown(tree, 8)).collect()
    assert len(again) == len(ODD) and len({r.shard for r in again if r.doc_id == 9}) == 1
    assert shard_rows(empty, "doc_id", tree).count() == 0


def test_only_a_subtree_with_a_new_weight_moves(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = balanced_tree(8)
    heavier = {**tree, "region0": {**tree["region0"], "rack0": {"shard0": (0, 3.0), "shard1": (1, 1.0)}}}
    rows = shard_rows(ids, "doc_id", tree, heavier).collect()
    assert all(r.shard == r.grown_shard or r.grown_shard in (0, 1, 2, 3) for r in rows)
    share = sum(r.grown_shard == 0 for r in rows) / len(rows)
    assert abs(share - 0.3) < 0.02


def test_simple8b_words():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 1 << k, 300) for k in (1, 3, 9, 16, 40, 59)] + [np.array([1 << 60, (1 << 63) + 5, 0, 1], np.uint64)]).astype(np.uint64)
    bounds = np.array([0, 0, 1, 700, 701, len(ids)])
    words, per_span, spans, escapes = simple8b.encode(ids, bounds)
    assert (simple8b.decode(words, escapes) == ids).all()
    assert per_span.sum() == len(words) and len(escapes) == 2 and spans.tolist() == [0, 1, 3, 1, math.ceil((len(ids) - 701) / 256)]


def check_ids(rows, source, end):
    code, at = word_ids(), 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        ids = code(source[r.doc_id], end)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), r
        at += len(ids)


def test_id_files(spark, docs, odd, empty, tmp_path):
    check_ids(queries.op2_simple8b_ids(spark, SMALL).collect(), docs, 1)
    for name, df, source in (("odd", odd, dict(ODD)), ("empty", empty, {})):
        simple8b.write_ids(df, str(tmp_path / name), WORD)
        rows = simple8b.read_ids(spark, str(tmp_path / name)).collect()
        assert len(rows) == (len(ODD) if source else 0)
        check_ids(rows, source, 1)


def test_differencing():
    assert difference(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    sizes = np.random.default_rng(1).integers(1, 700, 400)
    found = windows(sizes)
    sums = np.bincount(found, sizes)
    assert sums.max() <= 4096 and sums.max() - sums.min() < 200 and len(sums) <= -(-sizes.sum() // 4096) + 1


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(spark, docs, odd, empty, which):
    code = word_ids()
    df, source = {"docs": (spark.read.parquet(f"{SMALL}/documents.parquet"), docs), "odd": (odd, dict(ODD)), "empty": (empty, {})}[which]
    rows = pack(df, WORD, with_ids=True).collect()
    tokens = collections.Counter()
    for r in rows:
        ids = code(source[r.doc_id], 2)
        assert r.doc_tokens == len(ids) and r.ids == ids[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids)
        tokens[r.doc_id] += r.length
    repeated = collections.Counter(i for i, _ in ODD) if which == "odd" else collections.Counter(list(source))
    assert tokens == {i: len(code(source[i], 2)) * repeated[i] for i in source}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def brute_components(source, words, percent):
    sets = {}
    for key, text in source.items():
        own = (text or "").encode().lower().split()
        sets[key] = {tuple(own)} if 0 < len(own) < words else {tuple(own[k : k + words]) for k in range(len(own) - words + 1)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, words, percent):
    rows = jaccard_components(spark.read.parquet(f"{SMALL}/documents.parquet"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs, words, percent) and len(rows) == len(docs)


def test_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    source = {}
    for i in range(150):
        text = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            text[at] = f"v{rng.integers(0, 400)}"
        source[i] = " ".join(text)
    rows = jaccard_components(spark.createDataFrame(list(source.items()), "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(source, 3, 90)


def test_jaccard_of_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in jaccard_components(odd).collect()}
    assert rows[5].component_id == 4 and rows[10].component_id == 9 and rows[2].n_shingles == 0 and rows[1].component_id == 1
    assert rows[None].component_id is None and jaccard_components(empty).count() == 0


def test_toxicity(spark, odd, empty):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = judge(spark.read.parquet(f"{base}/documents.parquet"), labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert all(r.held_out == (crc_fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)  # 51 labelled rows only
    assert judge(odd, labels).count() == len(ODD) and judge(empty, labels.limit(0)).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.9
    found = {r.doc_id: r.lang_pred for r in identify(odd).collect()}
    assert found[1] == found[2] == found[3] == found[12] == "und" and found[4] == "x" and len(found) == len(set(dict(ODD)))
    assert identify(empty).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_order_minhash(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = fingerprints(df).collect()
    source = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0]), reverse=True)
    want = collections.Counter()
    for (i, text), (_, after) in zip(source, source[1:] + source[:1], strict=True):
        half = len(text) // 2
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    texts = dict(source)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    if which == "docs":
        assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.1


def test_order_minhash_sees_order_and_no_python(spark):
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in [*range(200, 400), *range(200)])
    df = fingerprints(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))
    near = {r.doc_id: r.near_next for r in df.collect()}
    assert 0.3 < near[2] < 0.8 and near[1] == 1.0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and fingerprints(df.limit(0).withColumn("text", F.lit("x"))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1000, 1 << 40), (5, 10), (3000, 4000), (1, 1), (200, 1 << 63)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        coded = EliasFano(EliasFano.build(values))
        assert (coded.get(np.arange(len(values))) == values).all() and (coded.find(values) == np.arange(len(values))).all()
        assert (coded.find(np.setdiff1d(rng.integers(0, top, n).astype(np.uint64), values)) == -1).all()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_language_model(spark, odd, empty, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), b" end"]) for r in df.select("doc_id", "text").collect()]
    fold = lambda i: crc_fold("" if i is None else i, 5) == 1
    train = [t for i, t in tokens if not fold(i)]
    c = collections.Counter(w for t in train for w in t)
    z = c.total() + 0.5 * (len(c) + 1)
    pairs = collections.Counter(p for t in train for p in zip([b" start", *t], t))  # noqa: B905
    total, kinds = collections.Counter(), collections.Counter()
    for (u, _), n in pairs.items():
        total[u] += n
        kinds[u] += 1
    want = collections.defaultdict(list)
    for i, t in tokens:
        score = 0.0
        for u, w in zip([b" start", *t], t):  # noqa: B905
            k = 8 * kinds[u]
            score += math.log10((pairs[u, w] + k * (c[w] + 0.5) / z) / (total[u] + k) if k else (c[w] + 0.5) / z)
        want[i].append((len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.5) / z) for w in t), score))
    rows = lm_scores(df).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        n, known, base, score = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), n, known, c.total())
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) < 0.03 * n + 0.05
    assert lm_scores(empty).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_language_model_with_spread_contexts(spark, odd, empty, which, monkeypatch):
    monkeypatch.setattr(trie_lm, "SPREAD", 3)
    test_language_model(spark, odd, empty, which)


@pytest.mark.parametrize("which,listed,spread", [("docs", 50, 3), ("docs", 2000, 200_000), ("odd", 0, 200_000), ("odd", 3, 3)])
def test_language_model_with_words_that_are_not_listed(spark, odd, empty, which, listed, spread, monkeypatch):
    monkeypatch.setattr(trie_lm, "LISTED", listed)
    monkeypatch.setattr(trie_lm, "SPREAD", spread)
    monkeypatch.setattr(trie_lm, "SHARD", 2_000)
    test_language_model(spark, odd, empty, which)


def test_language_model_with_repeated_chunks_and_null_ids(spark, monkeypatch):
    """Equal rows, null ids and null texts among them, in equal chunks of several tasks get equal scores."""
    monkeypatch.setattr(trie_lm, "LISTED", 2)
    rows = [(None, "a b a c"), (None, "a b a c"), (7, None), (7, None), (8, ""), (9, "a b x"), (9, "a b x")]
    twice = spark.createDataFrame(rows * 6, "doc_id long, text string").coalesce(1)
    twice = twice.union(twice)
    found = collections.defaultdict(set)
    for r in lm_scores(twice).collect():
        found[r.doc_id].add((r.n_tokens, r.n_known, round(r.score, 9), round(r.base_score, 9)))
    assert {k: len(v) for k, v in found.items()} == {None: 1, 7: 1, 8: 1, 9: 1}
    assert {k: min(v)[0] for k, v in found.items()} == {None: 5, 7: 1, 8: 1, 9: 4}


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_byte_bpe(spark, odd, empty, which):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = {"odd": odd, "empty": empty, "docs": spark.read.parquet(f"{SMALL}/documents.parquet")}[which]
    source = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    rows = encode_texts(df, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = coder.encode_ordinary(source[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for centre in rng.standard_normal((60, 16)):
            rows += [(label, centre + rng.standard_normal(16) * s) for s in (0.05, 0.1, 0.2)]
    dense = rng.standard_normal(16)
    rows += [(0, dense + rng.standard_normal(16) * 0.05) for _ in range(300)] + [(1, rows[0][1]), (1, rows[0][1])]
    data = [(i, v.astype(float).tolist(), label) for i, (label, v) in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16]
    data += [(10_000 + i, v, 0) for i, v in enumerate(odd)] + [(20_000, data[0][1], None), (None, [1e300, -1e300], 0)]
    found = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(found) == len(data)
    links = near = 0
    for label in (0, 1):
        ids = [i for i, (own, _) in enumerate(rows) if own == label]
        x = np.stack([rows[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want = (x @ x.T >= 0.93).sum(axis=1) - 1
        got = np.array([found[i].n_links for i in ids])
        assert (got <= want).all()
        links, near = links + want.sum(), near + got.sum()
    assert near >= 0.9 * links
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (10_000, 10_001, 10_002, 10_003, 10_004, 20_000))


@pytest.mark.parametrize("cosines", [[0.95], [0.99, 0.95, 0.94]])
def test_large_groups_of_near_vectors_keep_all_links(spark, cosines):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, parts = unit(rng.standard_normal(64)), [unit(rng.standard_normal((2000, 64)))]
    for cosine in cosines:
        parts.append(unit(math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * unit(rng.standard_normal((5000 // len(cosines), 64)))))
    x = np.concatenate(parts)
    found = near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    got = np.array([r.n_links for r in sorted(found, key=lambda r: r.vec_id)])
    dots = x @ x.T
    low, high = (dots >= 0.93 + 1e-9).sum(axis=1) - 1, (dots >= 0.93 - 1e-9).sum(axis=1) - 1
    assert (low <= high).all() and (got <= high).all() and got.sum() >= 0.9999 * low.sum()
    if len(cosines) == 1:
        assert (got >= low).all() and {r.component_id for r in found if r.vec_id >= 2000} == {2000}


def test_pipeline(spark, docs):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["languages", "toxic", "near_duplicates", "packing"]
    kept = {r.doc_id for r in rows}
    groups = brute_components({i: docs[i] for i in docs}, 5, 80)
    heads = collections.Counter(groups[i][1] for i in kept if groups[i][0])
    assert kept <= set(docs) and len(kept) > 0.6 * len(docs) and max(heads.values()) == 1
    code = word_ids()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(code(docs[i], 2)) for i in kept}


def test_pipeline_stages_judge_rows(spark, docs, empty):
    """Null and repeated ids, null and letterless texts, equal rows, and columns with the names that stages use."""
    first, *others = [t for t in docs.values() if t and len(t.split()) > 40][:12]
    rows = [(i, t, "en", "x", 1.5, 1) for i, t in docs.items()]
    odd = [(None, None), (None, "12 34"), (None, first), (None, first), (-1, "!!"), (-1, others[0]), (-2, others[1]), (-2, others[1])]
    rows += [(i, t, None, "y", None, 0) for i, t in odd]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, `row` int").repartition(4)
    want = lambda df: collections.Counter(df.select("doc_id", "text", "source", "score", "row").collect())
    told = corpus_pipeline.languages(spark, table, SMALL)
    assert told.columns == table.columns
    found, given = want(told), want(table)
    assert not found - given
    assert {(r.doc_id, r.text) for r in found if r.source == "y"} == {x for x in odd if x[1] not in (None, "12 34", "!!")}
    assert sum(n for r, n in found.items() if r.source == "y") == 5
    harmless = corpus_pipeline.toxic(spark, told, SMALL)
    assert harmless.columns == table.columns and not want(harmless) - found
    single = corpus_pipeline.near_duplicates(spark, told, SMALL)
    assert single.columns == table.columns and not want(single) - found
    kept = [r for r, n in want(single).items() for _ in range(n)]
    shingles = {i: r.text for i, r in enumerate(kept)}
    groups = brute_components({i: r.text for i, r in enumerate(r for r, n in found.items() for _ in range(n))}, 5, 80)
    assert len(kept) == len({c for n, c in groups.values() if n}) + sum(not n for n, _ in groups.values())
    assert max(collections.Counter(c for n, c in brute_components(shingles, 5, 80).values() if n).values()) == 1
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SMALL).count() == 0
