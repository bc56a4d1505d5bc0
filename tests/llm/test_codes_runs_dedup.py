"""Vector codes, periodic runs and exact duplicates against brute force and SQL, on small tables and on odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import periodic_runs as pr
from ledgerloom.llm import queries
from ledgerloom.llm.exact_dedup import exact_classes, without_copies
from ledgerloom.llm.vector_codes import Codebooks, compress, encode, train
from test_operators import ODD, SMALL

SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    other = duck.execute(queries.ORACLE_SQL[name])
    assert [d[0] for d in other.description] == df.columns
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(other.fetchall(), key=key)


# --- exact duplicates


def norm(text):
    out, space = [], False
    for c in text or "":
        if c not in SPACES:
            out.append(c)
        elif not space:
            out.append(" ")
        space = c in SPACES
    return "".join(out)


def brute_classes(rows):
    classes = {}
    for i, (doc_id, text) in enumerate(rows):
        classes.setdefault(norm(text), []).append((doc_id is None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        members = classes[norm(text)]
        keep = min(members)
        out.append((doc_id, None if keep[0] else keep[1], len(members), hashlib.sha256(norm(text).encode()).hexdigest()))
    return out, len(classes)


EXTRA = [(20, "a\tb"), (21, "a  b"), (22, " a b"), (23, "a b\n"), (24, "a b \r\n"), (25, "a\x1cb"), (26, "a\xa0b"), (None, "a b"), (None, "only null ids"), (None, "only null ids"), (27, "  "), (28, "\n")]


@pytest.mark.parametrize("key_bytes", [16, 1, 0])
def test_exact_classes(spark, key_bytes):
    """Also with hashes so short that texts collide."""
    rows = ODD + EXTRA + [(100 + i, f"text {i % 50}") for i in range(300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, row string").repartition(5)
    got = exact_classes(df, key_bytes).collect()
    wanted, n = brute_classes(rows)
    order = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=order) == sorted(wanted, key=order)
    assert sum(r.kept for r in got) == n == len({r.text_sha256 for r in got if r.kept})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_classes_of_nothing_and_rows_that_stay(spark):
    rows = ODD + EXTRA
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, group_size int")
    assert exact_classes(df.limit(0)).count() == 0 and without_copies(df.limit(0)).count() == 0
    left = without_copies(df).collect()
    assert without_copies(df).columns == df.columns
    assert len(left) == brute_classes(rows)[1] == len({norm(r.text) for r in left})


def test_exact_classes_use_no_python(spark):
    df = exact_classes(spark.createDataFrame(ODD, "doc_id long, text string"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


# --- periodic runs


def brute_runs(words):
    """Every maximal stretch of a smallest period, straight from the definition."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                stretch = words[start : start + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.add((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        words = []
        while len(words) < rng.randint(0, 160):
            root = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 9, 12, 17]))]
            words += (root * rng.randint(1, 9))[: rng.randint(1, 90)]
        yield words


def as_arrays(texts):
    numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    ids = np.array([numbers[w] for t in texts for w in t], np.int64)
    return ids, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def test_runs_match_brute_force():
    texts = list(random_texts(3, 700)) + [["a"] * n for n in range(9)] + [["a", "a", "b"] * 30, list("abaababaabaab") * 12]
    ids, rows = as_arrays(texts)
    got = pr.runs_of(ids, rows)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    wanted = [(t, int(starts[t]) + s, n, q) for t, words in enumerate(texts) for s, n, q in brute_runs(words)]
    assert [tuple(r) for r in got.tolist()] == wanted and len(wanted) > 500


def test_one_word_over_and_over_is_cheap():
    ids = np.zeros(300_000, np.int64)
    assert pr.runs_of(ids, ids).tolist() == [[0, 0, 300_000, 1]]
    ids = np.arange(300_000) % 1000
    assert pr.runs_of(ids, ids * 0).tolist() == [[0, 0, 300_000, 1000]]


def brute_row(doc_id, text):
    words = norm(text).split(" ")
    words = [w for w in words if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_runs_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = [(i, t) for i, t in rows if len((t or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, t in short:
        assert got[i] == brute_row(i, t)


def test_periodic_runs_of_odd_rows(spark):
    rows = ODD + [(200 + i, "\t".join(t)) for i, t in enumerate(random_texts(8, 120))] + [(None, "x y " * 9)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, runs int, start string").repartition(3)
    found = pr.periodic_runs(df, edit=queries._repeats_itself)
    got = sorted((tuple(r) for r in pr.digest(found).collect()), key=str)
    assert got == sorted(
        (brute_row(i, t) if i != 14 else next(r for r in got if r[0] == 14) for i, t in rows), key=str
    )
    long = next(r for r in got if r[0] == 14)
    assert long[1:5] == (1, 0, 5000, 1) and long[7] == hashlib.sha256(b"word").hexdigest()
    assert pr.digest(pr.periodic_runs(df.limit(0))).count() == 0
    assert pr.digest(pr.periodic_runs(df.where("text IS NULL"))).first()[1:6] == (0, None, None, None, None)


# --- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    usable = [(k, label, np.array([int(np.floor(256 * float(x))) for x in v])) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0))
    books = [[p.copy() for p in row] for row in zip(*(np.array_split(z, parts) for _, _, z in usable[:entries]), strict=True)]
    near = lambda book, p: min(range(len(book)), key=lambda e: (int(((book[e] - p) ** 2).sum()), e))
    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, _, z in usable:
            for i, p in enumerate(np.array_split(z, parts)):
                groups[i].setdefault(near(books[i], p), []).append(p)
        for i, g in enumerate(groups):
            for e, members in g.items():
                books[i][e] = np.array([int(s) // len(members) for s in np.sum(members, axis=0)])
    out = []
    for k, label, z in usable:
        code = [near(books[i], p) for i, p in enumerate(np.array_split(z, parts))]
        error = sum(int(((books[i][code[i]] - p) ** 2).sum()) for i, p in enumerate(np.array_split(z, parts)))
        out.append((k, label, "".join(f"{c:02x}" for c in code), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e.tolist()).encode()).hexdigest()
    return [(k, c, e, sum(f for _, m, _, f in out if m == label), sha) for k, label, c, e in out]


def test_vector_codes_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=34)], int(i % 4) if i % 5 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [float("nan")] * 34, 1), (202, [None] * 34, 2), (203, [float("inf")] * 34, 2), (7, rows[7][1], 3), (None, rows[8][1], 3), (204, [0.0] * 34, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, part int").repartition(4)
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for k, v, m in rows]
    assert sorted((tuple(r) for r in compress(df).collect()), key=str) == sorted(brute_codes(rows), key=str)
    few = df.where("vec_id < 5")
    assert sorted((tuple(r) for r in compress(few).collect()), key=str) == sorted(brute_codes([r for r in rows if r[0] is not None and r[0] < 5]), key=str)
    assert compress(df.limit(0)).columns == compress(df).columns and compress(df.limit(0)).count() == 0
    assert compress(df.where("vec_id IN (200, 201)")).count() == 0


def test_vectors_of_another_length_have_no_code(spark):
    df = spark.createDataFrame([(i, [0.1 * i] * (4 if i != 3 else 5), 0) for i in range(6)], "vec_id long, embedding array<double>, label int")
    books = train(df, parts=2, entries=3)
    got = {r.vec_id: r for r in encode(df, books).collect()}
    assert got[3].code is None and got[3].error is None and all(got[i].code for i in (0, 1, 2, 4, 5))


def test_codes_decode_to_their_entries():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (80, 24))
    books = Codebooks.of(vectors[:10], 4)
    codes, errors = books.assign(vectors)
    assert (books.decode(codes[:10]) == vectors[:10]).all() and (errors[:10] == 0).all()
    assert (((books.decode(codes) - vectors) ** 2).sum(axis=1) == errors.sum(axis=1)).all()


# --- repairs of earlier operators


def test_id_files_are_in_the_order_of_their_names(spark, tmp_path):
    from ledgerloom.llm.simple8b import unpack, write_ids
    from test_operators import WORD

    rows = [(i * 7919 % 1000, f"text {i} of some words") for i in range(1000)]
    path = str(tmp_path / "ids")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, WORD)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    import glob

    import pyarrow.parquet as pq

    seen, files = [], sorted(glob.glob(f"{path}/part-*.parquet"))
    for file in files:
        for payload in pq.read_table(file).column("payload").to_pylist():
            seen += unpack(payload)[0].tolist()
    assert len(files) > 4 and seen == sorted(i for i, _ in rows)


def test_a_thinly_labelled_language_does_not_win_other_languages_words(spark):
    from ledgerloom.llm import language

    rng = random.Random(2)
    english = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(english, weights=[1 / (k + 1) for k in range(3000)], k=60)), "en") for i in range(600)]
    rows += [(9000 + i, f"qzx vuu {w}", "xx") for i, w in enumerate(("qqa", "qqb"))]
    rows += [(10_000 + i, " ".join(rng.sample(english[1500:], 12)), None) for i in range(40)] + [(20_000, "qzx vuu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predict(df.where("lang IS NULL"), language.train(df)).collect()}
    assert {v for k, v in found.items() if k < 20_000} == {"en"} and found[20_000] == "xx"
    few = language.train(df, most=100)
    assert few.words.get("qzx") is not None


def test_packing_of_very_many_short_rows_needs_little_memory():
    import tracemalloc

    from ledgerloom.llm.packing import PIECES, difference

    tracemalloc.start()
    found = difference(np.full(PIECES, 16), 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(found).max() <= 4096 and peak < 300 << 20


def test_packing_of_300_000_one_token_rows(spark):
    from ledgerloom.llm.packing import pack
    from test_operators import WORD

    rows = pack(spark.range(300_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text"), WORD)
    filled = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("m")).collect()
    assert sum(r.n for r in filled) == 300_000 and all(r.n == r.m <= 4096 for r in filled) and len(filled) < 85
