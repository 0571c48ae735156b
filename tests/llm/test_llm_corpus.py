"""Sharding, archives, dedup, extraction, classifier and pipeline, against plain Python."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from helixspark.llm import classifier, exact_dedup, html_extract, minhash, packing, sharding, warc
from helixspark.llm.common import scratch, shared_folder
from helixspark.llm.components import components

SCHEMA = "doc_id long, text string, digest string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)


@pytest.mark.parametrize("bucket", [32 << 20, 300])
def test_sharding(spark, bucket):
    rows = [(i, f"text {i % 17}") for i in range(500)] + [(None, None), (None, "x"), (3, "text 3"), (1, "")] + [(7, "same")] * 100
    df = docs(spark, rows).withColumn("slot", F.lit("clash")).repartition(3)
    got = sharding.shard_documents(df, 7, seed=5, bucket_bytes=bucket).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.text.fillna("null"))) == sorted((-1 if i is None else i, "null" if t is None else t) for i, t in rows)
    n = got.groupby("shard").size()
    assert len(n) == 7 and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    if bucket > 1000:  # the order of arrival makes no difference
        again = sharding.shard_documents(df.repartition(5), 7, seed=5, bucket_bytes=bucket).toPandas()
        key = ["shard", "slot"]
        assert got.sort_values(key).doc_id.fillna(-1).tolist() == again.sort_values(key).doc_id.fillna(-1).tolist()
    assert sharding.shard_documents(docs(spark, []), 7).count() == 0


def test_shard_files(spark, tmp_path):
    got = sharding.shard_documents(docs(spark, [(i, str(i)) for i in range(100)]), 4)
    back = sharding.write_shards(got, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.collect())) and back.select("shard").distinct().count() == 4
    assert len(list((tmp_path / "s").glob("shard=*"))) == 4


def test_fisher_yates():
    counts = defaultdict(int)
    for i in range(6000):
        counts[tuple(sharding.fisher_yates(3, [i]))] += 1
    assert len(counts) == 6 and min(counts.values()) > 850


def test_sharding_query(spark):
    from helixspark.llm.queries import op3_sharding

    d = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = op3_sharding(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(d.index) and got.groupby("shard").size().agg(lambda x: x.max() - x.min()) <= 1
    for r in got.itertuples():
        b = d[r.doc_id].encode()
        assert r.size == len(b) + 16 and r.text_crc32 == zlib.crc32(b)


def archive(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "test-warc")
    manifest = warc.write_archives(df, path, **options)
    return path, manifest, warc.read_archives(spark, path)


def test_warc(spark):
    rows = [(i, f"http://x/{i % 5}\n", "page " * (i % 7)) for i in range(60)] + [(100, None, None), (7, "http://x/2\n", "page " * 0), (None, "u", "alone"), (None, "u", "page ")] + [(5, "http://x/0\n", "page " * 5)] * 2
    path, manifest, back = archive(spark, rows, file_bytes=1500, part_bytes=9000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = back.toPandas()
    first = {}
    for i, _, h in rows:
        if i is not None:
            h = h or ""
            first[h] = min(first.get(h, i), i)
    responses = defaultdict(int)
    for r in got.itertuples():
        i = None if pd.isna(r.page_id) else int(r.page_id)
        h = next((x[2] or "" for x in rows if x[0] == i and base64.b32encode(hashlib.sha1((x[2] or "").encode()).digest()).decode() == r.payload_digest))
        assert r.payload_bytes == len(h.encode())
        if r.record_type == "response":
            responses[h] += 1
            assert bytes(r.payload).decode() == h and pd.isna(r.refers_to) and (i == first.get(h) or h not in first)
        else:
            assert r.refers_to == first[h]
    assert set(responses.values()) == {1} and set(responses) == {x[2] or "" for x in rows}
    again, _, _ = archive(spark, rows[::-1], file_bytes=1500, part_bytes=9000)
    files = lambda p: {r.file: r.sha256 for r in spark.read.parquet(f"{p}/_manifest").collect()}
    assert files(path) == files(again)
    _, _, none = archive(spark, [])
    assert none.count() == 0
    _, _, all_full = archive(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], least_revisit=3)
    assert [r.record_type for r in all_full.orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


def test_warc_wide_and_clustered_ids(spark):
    """Identifiers at both ends of their type, and many in a row with one far away, make even parts."""
    ends = [(s * 9_223_372_036_854_775_000 + i, "u", f"page {i} " * 20) for s in (-1, 1) for i in range(30)]
    _, manifest, back = archive(spark, ends, part_bytes=8000)
    assert sorted(r.page_id for r in back.collect()) == sorted(r[0] for r in ends)
    assert manifest.count() >= 4 and manifest.agg(F.max("n_records")).first()[0] <= 15
    row = [(i, "u", f"page {i}") for i in range(400)] + [(10**15, "u", "far")]
    _, manifest, back = archive(spark, row, part_bytes=20_000)
    assert back.count() == 401 and manifest.count() >= 8 and manifest.agg(F.max("n_records")).first()[0] <= 50


def test_warc_query(spark):
    from helixspark.llm.queries import op4_warc

    p = pd.read_parquet(f"{SF}/pages.parquet")
    first = {}
    for i, h in sorted(zip(p.page_id, p.html.fillna(""))):
        first.setdefault(h, i)
    got = op4_warc(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(p)
    for i, h in zip(p.page_id, p.html.fillna("")):
        b, r = h.encode(), got.loc[i]
        assert r.payload_bytes == len(b) and r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r.record_type == "response" and pd.isna(r.refers_to)) if first[h] == i else (r.record_type == "revisit" and r.refers_to == first[h])


def test_warc_damage():
    data = warc.record("response", 1, "http://x", b"abc", warc.sha1_32(b"abc"), "2024-01-01T00:00:00Z")
    assert warc.parse(data)[1].endswith(b"abc")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"abc", b"abd"))


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, keep, bits):
    rows = [(i, f"t{i % 40}") for i in range(200)] + [(300, None), (301, ""), (None, "t1"), (None, "only"), (None, "only"), (400, "twice"), (400, "twice"), (5, "t6")] + [(500 + i, "hot " * 2000) for i in range(50)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep, digest_bits=bits).toPandas()
    assert len(got) == len(rows)
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    of = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in ids.items()}
    for r in got[got.text_sha256.isin(of)].itertuples():
        own = of[r.text_sha256]
        known = [x for x in own if x is not None]
        want = (min if keep == "min" else max)(known) if known else None
        assert r.group_size == len(own) and (r.keep_id == want or pd.isna(r.keep_id) and want is None)
    if bits == 256:
        assert (got.groupby("text_sha256").kept.sum() == 1).all() and got.text_sha256.isin(of).all()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    left = exact_dedup.keep_one(docs(spark, rows), keep=keep).toPandas()
    assert sorted(left.text.fillna("")) == sorted(ids) and list(left.columns) == ["doc_id", "text", "digest", "keep_id"]


def test_native():
    import inspect

    source = inspect.getsource(exact_dedup)
    assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "collect("))


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    small = {}
    for x in range(len(rows)):
        if rows[x][0] is not None:
            small[find(x)] = min(small.get(find(x), rows[x][0]), rows[x][0])
    return [(len(s), small.get(find(x)) if s else rows[x][0]) for x, s in enumerate(sets)]


def near_copies(seed, n=120):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 3000, rng.integers(8, 120))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(base[i % 8])
        for _ in range(rng.integers(0, 1 + len(w) // 12)):
            w[rng.integers(len(w))] = f"v{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, monkeypatch):
    texts = near_copies(k)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "oNE"), (505, "a b"), (None, texts[0]), (506, "long " * 30_000), (7, texts[7])]
    monkeypatch.setattr(minhash, "BLOCK", 16)  # several blocks a bucket
    monkeypatch.setattr(minhash, "DEALT", 4)
    got = minhash.near_duplicates(docs(spark, rows), shingle=k).toPandas()
    want = sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, brute(rows, k)))
    assert sorted(zip(got.doc_id.fillna(-1), got.n_shingles, got.component_id)) == want
    assert (got.kept == (got.doc_id == got.component_id)).all()
    assert minhash.near_duplicates(docs(spark, []), shingle=k).count() == 0


def test_near_duplicates_query(spark):
    from helixspark.llm.queries import op9_minhash

    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = op9_minhash(spark, SF).toPandas().set_index("doc_id")
    for (i, _), (n, c) in zip(zip(d.doc_id, d.text), brute(list(zip(d.doc_id, d.text)), 2)):
        assert (got.n_shingles[i], got.component_id[i]) == (n, c)


def test_posterior_bound():
    """Pairs at the least similarity aren't given up, clearly unlike ones are."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5000, minhash.HASHES), dtype=np.uint8)
    same = lambda p: np.where(rng.random(a.shape) < p, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(minhash.alike(a, same(0.8), 0.8)) == 5000
    assert len(minhash.alike(a, same(0.4), 0.8)) == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 60: 50}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page"><header>Site</header><nav><ul><li>menu</ul></nav>
<div id="side-bar" class="sidebar">s</div><div class="wrap"><div class="tagline">Best site since 1999</div><div class="content"><h1>A&amp;B&nbsp;{0}</h1><p>One<br>two <b>{0}</b><p>three<!-- c --><ul><li>x{0}<li>y</ul>
<span class="ad">buy</span> tail</div></div><form>f<input></form><section class="comments"><p>c1</section><script>var t="</p>";</script><footer>f</footer>"""


def test_html(spark):
    rows = [(i, "http://a.example/x", PAGE.format(i)) for i in range(12)] + [(20, None, None), (21, "u", ""), (22, "http://b.example/", "<p>only"), (22, "http://b.example/", "<p>only"), (23, "x", "a < b & c &lt;d&gt;"), (24, "x", "<article><p>in</article><div>out</div>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i in range(12):  # what every page of the host repeats goes, and so does what names itself
        assert got[i] == f"A&B {i}\n\nOne two {i}\n\nthree\n\nx{i}\n\ny\n\ntail" or got[i] == f"A&B {i}\n\nOne two {i}\n\nthree\n\nx{i}\n\ny"
        assert "1999" not in got[i]
    assert got[20] == got[21] == "" and got[22] == "only" and got[23] == "a < b & c <d>" and got[24] == "in"
    assert html_extract.extract(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "http://c.example/", f"<article><p>one article</article><div class=ad>{i}</div>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(same).collect()} == {"one article"}


def test_html_tree_decides(spark):
    """Without names and tags that mean anything, what the pages of a host share goes, long as it is; one page alone can't tell."""
    template = "<div><div><div>{t}</div></div><section><h2>T {i}</h2><p>{a}</p></section></div>"
    words = "every page of this host says so in many words and more of them than its article has " * 4
    rows = [(i, "http://d.example/", template.format(t=words, i=i, a=f"what page {i} alone has to say")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"T {i}\n\nwhat page {i} alone has to say" for i in range(8)}
    assert "every page" in html_extract.extract(df.limit(1)).first().text


def test_html_without_names(monkeypatch):
    """On the tables the names of classes decide nothing."""
    p = pd.read_parquet(f"{SF}/pages.parquet").html
    whole = [html_extract.main_text(html_extract.parse(x), set()) for x in p]
    monkeypatch.setattr(html_extract, "SIDE_NAMES", set())
    assert whole == [html_extract.main_text(html_extract.parse(x), set()) for x in p]


def test_html_deep(spark):
    deep = "".join(f"<div>x{i}" for i in range(5000))
    got = html_extract.extract(spark.createDataFrame([(i, "http://e.example/", deep + str(i)) for i in range(3)], "page_id long, url string, html string")).collect()
    assert len(got) == 3 and all(r.text.startswith("x0\n\nx1\n\n") or "x4999" in r.text for r in got)


def test_html_query(spark):
    import re
    from html import unescape

    from helixspark.llm.queries import op8_html

    p = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    for r in op8_html(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", p[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_classifier(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(word() + ("" if good else rng.choice(["###", "!!", "***"])) for _ in range(30))
        rows.append((i, text))
        labels.append((i, int(good), "clash"))
    rows += [(1000, None), (1001, ""), (None, "abc"), (5, rows[5][1])]
    labels += [(None, 1, "x"), (4, None, "x"), (6, 1, "x"), (6, 0, "x")]
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = classifier.train(df, lab)
    got = classifier.scored(df, model).select("doc_id", "score", classifier.held_out("doc_id").alias("held")).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got[got.doc_id == 5].score.nunique() == 1
    own = got[got.held & (got.doc_id < 600)].drop_duplicates("doc_id")
    assert len(own) > 80 and ((own.score >= 0.3) == (own.doc_id % 3 > 0)).mean() > 0.95
    assert [bool(x) for x in got[got.doc_id < 600].held] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in got[got.doc_id < 600].doc_id]
    none = classifier.train(df, lab.limit(0))
    assert set(classifier.scored(df, none).toPandas().score) == {0.5}
    assert classifier.scored(docs(spark, []), model).count() == 0
    kept = classifier.keep_good(df, lab)
    assert kept.columns == df.columns


def test_classifier_query(spark):
    from helixspark.llm.queries import op10_quality_classifier

    m = op10_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    own = m[m.held_out]
    assert (own.predicted == own.quality).mean() >= 0.95


def test_pipeline(spark):
    import corpus_pipeline

    d, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
        out[name] = d.toPandas()
        d = spark.createDataFrame(out[name], d.schema)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(out[n].columns) == columns for n in list(out)[:-1])
    ruled, exact, near, packed = (out[n] for n in ("quality_rules", "exact_dedup", "minhash", "packing"))
    assert sorted(exact.doc_id) == sorted(ruled.groupby("text").doc_id.min())
    want = brute(list(zip(exact.doc_id, exact.text)), 5)
    assert sorted(near.doc_id) == sorted({c for _, c in want})
    assert set(packed.doc_id) == set(near.doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    good = out["quality_classifier"].doc_id
    assert labels.reindex(good).dropna().mean() > 0.97
    assert packing.CAPACITY >= packed.groupby("sequence_id").length.sum().max()
    assert len(corpus_pipeline.run(spark, SF).toPandas()) == len(packed)


ODD_DOCS = [(None, None, None, None, None), (None, "", "en", None, 0), (900_001, None, None, "x", None), (900_002, "", "en", "x", 0), (900_003, "word " * 60_000, "en", "x", 300_000)]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with clashing names."""
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in d.collect()]
    rows += [*ODD_DOCS, rows[0], rows[0], (900_004, *rows[1][1:]), (None, *rows[2][1:]), (900_005, rows[3][1] + " end", *rows[3][2:])]
    more = "score double, failed long, component_id long, sequence_id string, digest binary, row long, __text string"
    clash = [(0.5, 1, 2, "s", b"d", 3, "t")] * len(rows)
    kinds = ", ".join(f"{n} {t}" for n, t in d.dtypes)
    return spark.createDataFrame([(*r, *c) for r, c in zip(rows, clash, strict=True)], f"{kinds}, {more}")


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns
            assert out.exceptAll(docs).isEmpty()
            kept[name] = got
        else:
            ids = docs.toPandas().doc_id
            assert set(got.doc_id.dropna()) == set(ids.dropna()) and got.doc_id.isna().any() and got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
            assert (got[got.doc_id == 900_003].length.sum() - 1) % 60_000 == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert 900_002 not in set(kept["quality_rules"].doc_id) and len(kept["exact_dedup"]) == len(set(kept["exact_dedup"].text.fillna("")))
    near = kept["minhash"]
    assert 900_005 not in set(near.doc_id) and {900_001, 900_002} <= set(near.doc_id) and near.doc_id.isna().sum() == 3


def test_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
