"""Line dedup, spelling groups and whitened embeddings against plain Python, numpy and their SQL; archives and near vectors on tables that have some."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from xsfactor.llm import line_dedup, spelling, whitening

SF = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OWN = ["h", "h2", "part", "pos", "word", "keep", "text_hash", "n", "n_lines", "n_dropped", "_doc_id", "_keep", "key", "longer", "form", "root", "v", "d", "component", "whitened"]


def odd(df):
    return df.withColumns({c: F.lit("own") for c in OWN})


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_spelling"])
def test_same_rows_as_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ref = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in ref.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(ref.fetchall())
    assert Counter(tuple(r) for r in df.select(*names).collect()) == want
    assert len({r[names.index("n_dropped" if "n_dropped" in names else "form")] for r in want}) > 3


def deduped(rows, least_chars=40, least_docs=5):
    """By row (lines, dropped lines, text)."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def some_lines(n, seed):
    rng = random.Random(seed)
    pool = [f"{'É' if k % 3 else 'E'}verybody writes this line number {k} at times, some days" + " more" * (k % 4) for k in range(60)]
    pool += ["short", "", " ", "\x1c" * 50, "x" * 39, "y" * 40, "é" * 40, "\x0b \t" + "z" * 40 + "\f"]
    rows = []
    for i in range(n):
        lines = rng.choices(pool, [1 / (k + 1) for k in range(len(pool))], k=rng.choice([0, 1, 3, 20, 200]))
        lines = [rng.choice([x, x.upper(), "  " + x + "\r"]) if rng.random() < 0.4 else x for x in lines]
        rows.append((rng.choice([i, i, i, rng.randrange(n)]) if i % 20 else None, "\n".join(lines) if i % 17 else None))
    return rows


@pytest.mark.parametrize(("seed", "salts"), [(1, 1024), (2, 3)])
def test_lines_of_odd_rows(spark, monkeypatch, seed, salts):
    monkeypatch.setattr(line_dedup, "SALTS", salts)
    rows = some_lines(300, seed)
    docs = odd(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.dedup(docs, n_lines="before", n_dropped="dropped")
    assert got.columns == [*docs.columns, "before", "dropped"]
    want = deduped(rows)
    assert sum(w[2] for w in want) > 1000
    assert Counter((r["doc_id"], r["before"], r["dropped"], r["text"]) for r in got.collect()) == Counter(want)
    assert line_dedup.dedup(docs).columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_bitmaps_store_words_with_dropped_lines_only(spark):
    common = "this very line is part of each of the documents here"
    own = lambda i, k: f"line {k} of document {i} is like no other line in any of these"
    rows = [(i, "\n".join(common if k in (0, 63, 64, 130) else own(i, k) for k in range(300))) for i in range(6)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert sorted(got.index) == [0, 1, 2, 3, 4] and (got.n_dropped == 4).all()
    for words in got.keep:
        gone = [64 * w["word"] + b for w in words for b in range(64) if not w["bits"] >> b & 1]
        assert gone == [0, 63, 64, 130] and [w["word"] for w in words] == [0, 1, 2]


def test_lines_stay_on_the_jvm(spark):
    plan = entry.queries()["op11_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def words_of(rows, least_chars=7, least_n=2):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def spelled(rows, times=10):
    n = words_of(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def test_spelling_of_odd_rows(spark):
    rng = random.Random(6)
    base = ["bananana", "ananana", "mississippi", "aaaaaaaaa", "éàéàéàé", "interest", "Überraschung", "straÿe×nbahn"]
    pick = lambda: rng.choice("abnisép÷Ü")
    words = []
    for b in base:
        words += [b] * 400
        for _ in range(60):
            at = rng.randrange(len(b))
            x = rng.choice([b[:at] + b[at + 1 :], b[:at] + pick() + b[at:], b[:at] + pick() + b[at + 1 :], b[:at] + b[at : at + 2][::-1] + b[at + 2 :]])
            words += [x] * rng.choice([1, 2, 4, 35])
            y = x[: len(x) // 2] + pick() + x[len(x) // 2 :]
            words += [y] * rng.choice([1, 2, 3])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::150])) for i in range(150)] + [(None, "interest Interest null"), (7, None), (8, ""), (9, "a" * 50_000 + " " + "a" * 50_000), (10, "a" * 50_001), (10, "a" * 50_001)]
    got = spelling.group(odd(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = spelled(rows)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want and len(got) == len(want)
    assert sum(w[2] is not None for w in want.values()) > 100 and any(w[2] not in (None, w[4]) for w in want.values())
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_edit_shares_a_key():
    rng = random.Random(2)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 14)))
        at = rng.randrange(len(w) + 1)
        x = rng.choice([w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abc") + w[at + 1 :]])
        if not one_edit(w, x):
            continue
        counts = {a + b: rng.randint(1, 4) for a in "abc" for b in "abc"}
        (w_own, w_long), (x_own, _) = spelling.keys_of(w, counts), spelling.keys_of(x, counts)
        x_long = spelling.keys_of(x, counts)[1]
        assert w_own & x_own if len(w) == len(x) else w_own & x_long if len(x) > len(w) else x_own & w_long


def whitened(x, most=32):
    n, mean = len(x), x.mean(0)
    e, v = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    return ((x - mean) @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :most], e / e.sum()


def test_whitening_is_numpys(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = entry.queries()["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * np.stack(vectors.sort_values("vec_id").embedding).astype(float)) + 1_000_000
    n = len(x)
    w, share = whitened(x - 1_000_000)
    assert len(got) == 32 * n and (got.n == n).all() and got.component.tolist() == [*range(1, 33)] * n
    deviation = ((n * x.astype(np.int64) - x.astype(np.int64).sum(0)) ** 2).sum(1)
    assert (got.deviation.to_numpy().reshape(n, 32) == deviation[:, None]).all()
    mine = got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-8
    assert np.abs(got.explained.to_numpy().reshape(n, 32) - share[:32]).max() < 1e-12
    error = np.abs(mine.T @ mine / n - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and error < 1e-9


def test_small_deviations_keep_their_accuracy():
    """Columns of lengths from 1 to 1e-12: an eigenvalue solver on the product R'R would lose the small ones."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 13)))
    sizes = 10.0 ** -np.arange(13)
    sigma, v = whitening.jacobi(whitening.triangle(iter([q[:20] * sizes, q[20:] * sizes]), 13))
    assert np.abs(sigma / sizes - 1).max() < 1e-10 and np.abs(v.T @ v - np.eye(13)).max() < 1e-13


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_of_odd_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "COMBINED", 1)  # two at a time
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)) @ np.diag([5.0, 1.0, 0.0]), 2)
    rows = [(i, [*v, 7.5]) for i, v in enumerate(x.tolist())] + [(None, [1.0, 2.0, 0.0, 7.5]), (1, x[1].tolist() + [7.5])]
    bad = [(200, None), (201, []), (202, [nan, 0.0, 0.0, 0.0]), (203, [inf, 0.0, 0.0, 0.0]), (204, [None, 0.0, 0.0, 0.0]), (205, [1.0] * 3), (206, [1e300, 0.0, 0.0, 0.0])]
    df = odd(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(parts))
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * len(rows) and not set(got.vec_id.dropna()) & {b[0] for b in bad}
    assert got[got.component > 2].whitened.isna().all() and got[got.component <= 2].whitened.notna().all()
    w, share = whitened(np.floor(64 * np.array([r[1] for r in rows])), 2)
    mine = got[got.vec_id == 5].sort_values("component")
    assert np.allclose(np.abs(mine.whitened[:2]), np.abs(w[5])) and np.allclose(mine.explained, share)
    assert (got.identity_error < 1e-9).all()
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 200 and vec_id < 205")).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).toPandas()
    assert len(same) == 6 and same[["whitened", "explained", "identity_error"]].isna().all().all() and (same.deviation == 0).all()
    huge = whitening.whiten(spark.createDataFrame([(i, [float(2**50) * i]) for i in range(3)], "vec_id long, embedding array<double>")).toPandas()
    assert huge.deviation.isna().tolist() == [True, False, True] or huge.sort_values("vec_id").deviation.isna().tolist() == [True, False, True]


def by_sql(spark, folder, name, tables):
    """The registered query's rows and its SQL's, on tables of a folder of our own."""
    df = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    ref = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in ref.description]
    assert sorted(names) == sorted(df.columns)
    got, want = [r.asDict() for r in df.collect()], [dict(zip(names, r, strict=True)) for r in ref.fetchall()]
    key = lambda rows: Counter(tuple(r[c] for c in names) for r in rows)
    assert key(got) == key(want)
    return got


def test_near_vectors_of_the_sql(spark, tmp_path):
    """64 dimensions: a group of a third of all rows, pairs, chains whose ends are far apart, copies, scaled copies, odd vectors."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 64))
    x[:400] = x[0] + rng.normal(size=(400, 64)) * 0.3
    for k in range(400, 480, 2):
        x[k + 1] = x[k] + rng.normal(size=64) * 0.3
    for k in range(500, 560):  # each is near the one before it
        x[k] = x[k - 1] / np.linalg.norm(x[k - 1]) * 8 + rng.normal(size=64) * 0.35
    x[600:650] = x[600]
    x[650:700] = x[650] * rng.uniform(0.1, 9, (50, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, [0.0] * 64, 1), (2001, None, 1), (2002, [float("nan")] + [1.0] * 63, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in by_sql(spark, tmp_path, "op9_cover_tree", ["embeddings"])}
    assert got[0]["n_links"] > 200 and got[559]["component_id"] < 540 and got[649]["n_links"] == 49 and got[699]["component_id"] == 650
    assert got[400]["n_links"] >= 1 and not got[401]["kept"] and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (2000, 2001, 2002))


def test_repeated_pages_of_the_sql(spark, tmp_path):
    """A payload that a third of all pages share, pairs, short ones, and texts that differ in their last character only."""
    rng = random.Random(3)
    page = lambda k, n=300: f"<html>{k} " + "x" * n + "</html>"
    rows = [(i, f"http://a/{i}", page("hot")) for i in range(0, 900, 3)] + [(i, f"http://a/{i}", page(i // 6)) for i in range(1, 900, 3)]
    rows += [(i, None if i % 4 else f"http://b/{i}", rng.choice([None, "", "short", "y" * 99, "y" * 100, "é" * 50, page("end") + str(i % 7)])) for i in range(2, 900, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in by_sql(spark, tmp_path, "op5_warc", ["pages"])}
    assert sum(r["record_type"] == "revisit" for r in got.values()) > 450 and got[3]["refers_to"] == 0 and got[0]["record_type"] == "response"
