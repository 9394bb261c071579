import gzip
import hashlib
import io
import json
import math
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipika.llm import ann, common, urls, warc

# --- 2: nearest neighbours ---


def brute_nearest(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i in queries:
            s = np.zeros(len(m))
            for d in range(m.shape[1]):
                s += m[:, d] * v[d]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vectors(n=1500, dims=8, seed=3):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dims)).astype(np.float32)
    m[::3] = m[0]  # a third are one vector
    m[1::50] = m[1] * 2
    return [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [1.0, None] + [0.0] * (dims - 2)), (n + 4, [float("inf")] * dims)]


SCHEMA = "vec_id long, embedding array<float>"


def test_ann_recall_scores_and_ties(spark):
    rows = vectors()
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    report = {}
    c = ann.AnnConfig(leaf_rows=40, shard=200, probes=64)
    got = ann.nearest(d, d.where("vec_id % 20 = 0"), c, report).collect()
    want = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want) and report["visited"] < report["leaves"]
    hits = 0
    for q, found in by.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found]
        score = dict(brute_nearest(rows, {q}, len(rows))[q])
        assert all(score[i] == s for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_ann_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])], SCHEMA)
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(d, d.where("vec_id % 20 = 0")).collect()}
    assert got == {(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)}
    assert ann.nearest(d.limit(0), d).count() == 0
    assert ann.nearest(d, d.limit(0)).count() == 0


@pytest.mark.parametrize("sf, m", [("sf0.01", 20), ("sf0.01", 50), ("sf0.1", 20), ("sf0.1", 50)])
def test_ann_prunes_given_vectors(spark, sf, m):
    at = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(at):
        pytest.skip("no tables here")
    d = spark.read.parquet(at).select("vec_id", "embedding")
    report = {}
    got = ann.nearest(d, d.where(f"vec_id % {m} = 0"), report=report).collect()
    rows = [tuple(r) for r in d.collect()]
    want = brute_nearest(rows, {i for i, _ in rows if i % m == 0}, 20)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, i) for q, x in want.items() for i, _ in x}) >= 0.9 * 20 * len(want)
    assert report["leaves"] >= 60 and report["visited"] < 0.75 * report["leaves"]


def test_ann_prunes_clusters(spark):
    r = np.random.default_rng(5)
    m = np.repeat(r.normal(size=(60, 16)) * 5, 40, axis=0) + r.normal(size=(2400, 16)) * 0.1
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m.astype(np.float32))]
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    report = {}
    got = ann.nearest(d, d.where("vec_id % 20 = 0"), ann.AnnConfig(shard=300), report).collect()  # 8 shards, queries in one slice each
    want = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, i) for q, x in want.items() for i, _ in x}) >= 0.9 * 20 * len(want)
    assert report["visited"] < 0.3 * report["leaves"]


def test_ann_slices_of_queries_and_lengths(spark):
    """Vectors of another length than most take no part, and slices of queries change nothing."""
    rows = vectors(400)
    odd = [(5000, [1.0] * 3), (5020, [1.0] * 9), (5040, [])]
    d = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    q = d.where("vec_id % 20 = 0")
    shown = lambda c: sorted(tuple(r) for r in ann.nearest(d, q, c).collect())
    got = shown(ann.AnnConfig(leaf_rows=16))
    assert got == shown(ann.AnnConfig(leaf_rows=16, shard=7))
    assert {r[0] for r in got} == {i for i, _ in rows if i % 20 == 0 and i < 400} and max(r[2] for r in got) < 400


def test_ann_null_and_repeated_ids(spark):
    rows = [(20, [1.0, 2.0]), (20, [3.0, 1.0]), (1, [1.0, 2.0]), (20, [1.0, 2.0]), (None, [5.0, 5.0]), (40, [0.5, 0.5]), (1, [1.0, 2.0])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", ids string, leaf int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(d, d.where("vec_id % 20 = 0")).collect())
    # 20 stands for (1, 2), the lesser of its vectors; the null id takes no part
    assert got == [(20, 1, 1, 5.0), (20, 2, 40, 1.5), (40, 1, 1, 1.5), (40, 2, 20, 1.5)]


# --- 3: WARC ---


def pages(spark, n=120):
    r = random.Random(5)
    rows = [(i, r.choice([None, "", "http://é.example/ä b", f"http://x{i}.org/"]), r.choice([None, "", "short", "x" * 999, "y" * 1000, "ü" * 600, f"<p>{i}</p>" * 300])) for i in range(n)]
    return rows + rows[:2], spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("zip64, package_bytes", [(False, 1 << 20), (True, 500)])
def test_warc_round_trip(spark, zip64, package_bytes, tmp_path):
    rows, d = pages(spark)
    packages = warc.write_archives(warc.mark_revisits(d), f"file://{tmp_path}/p", package_bytes, zip64)
    got = warc.read_archives(packages).collect()
    last = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            last[h] = max(i, last.get(h, -1))
    assert len(got) == len(rows) and packages.agg({"records": "sum"}).first()[0] == len(rows)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        h = html[r.page_id]
        refers = last.get(h) if last.get(h, r.page_id) != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if refers is None else "revisit", refers)
        assert r.payload is None if refers is not None else bytes(r.payload).decode() == h
    for p in packages.collect():
        z = zipfile.ZipFile(p.path.removeprefix("file://"))
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]


def test_warc_null_ids_and_reading_tasks(spark, tmp_path):
    rows = [(None, "http://a/", "n" * 2000, 1), (5, "http://b/", "n" * 2000, 2), (None, "http://c/", "m" * 2000, 3), (6, None, None, 4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archives(warc.write_archives(warc.mark_revisits(d), f"file://{tmp_path}/n")).collect())
    assert got == [(0, "response", 0), (0, "revisit", 5), (5, "response", 0), (6, "response", 0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        _, d = pages(spark)
        d = d.withColumn("html", F.concat("html", F.expr("repeat(sha2(cast(page_id as string), 256), 9)")))
        assert warc.read_archives(warc.write_archives(warc.mark_revisits(d), f"file://{tmp_path}/t", 4000)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_record(kind, payload, target="http://x.org/", extra="", http=True):
    """As common writers make them: UUID ids, base-32 digests."""
    import base64

    body = (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if http else b"") + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1-2>\r\n" + (f"WARC-Target-URI: {target}\r\n" if target else "") + f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: {'application/http; msgtype=response' if http else 'text/plain'}\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n")


@pytest.mark.parametrize("index", ["lines", "gz", "none", "json"])
def test_packages_of_other_writers(spark, tmp_path, index):
    records = [plain_record("warcinfo", b"software: s", None, http=False), plain_record("response", b"<p>one</p>"), plain_record("response", "zwei ü".encode() * 400, "http://y.org/a b"), plain_record("resource", b"plain", http=False)]
    second = [plain_record("response", b"other archive")]
    lines = [b"!meta {\"format\": \"cdxj\"}"]
    for name, rs in (("a.warc.gz", records), ("b.warc.gz", second)):
        at = 0
        for r in rs:
            about = json.dumps({"url": "u", "offset": str(at) if index == "lines" else at, "length": len(r), "filename": name})
            lines.append(about.encode() if index == "json" else b"org,x)/ 20240101000000 " + about.encode())
            at += len(r)
    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/a.warc.gz", b"".join(records))
        z.writestr("archive/b.warc.gz", b"".join(second))
        if index != "none":
            data = b"\n".join(lines) + b"\n"
            z.writestr("indexes/index.cdx.gz" if index == "gz" else "indexes/index.cdxj", gzip.compress(data) if index == "gz" else data)
    packages = spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "path string")
    got = warc.read_archives(packages).collect()
    assert sorted((r.record_type, r.url or "", bytes(r.payload)) for r in got) == sorted([("warcinfo", "", b"software: s"), ("response", "http://x.org/", b"<p>one</p>"), ("response", "http://y.org/a b", "zwei ü".encode() * 400), ("resource", "http://x.org/", b"plain"), ("response", "http://x.org/", b"other archive")])
    assert all(r.page_id is None and r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in got)


def test_damaged_packages_raise(spark, tmp_path):
    good = plain_record("response", b"payload")
    bad = plain_record("response", b"payload").replace(b"x", b"x")
    data = gzip.decompress(bad).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")
    for name, member in (("digest", good + gzip.compress(data)), ("cut", good + good[:-9]), ("none", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w") as z:
            z.writestr("archive/a.warc.gz" if member else "x.txt", member or b"")
        with pytest.raises(Exception, match="digest|cut off|no stored"):
            warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{name}.wacz",)], "path string")).collect()


def test_revisits_are_checked_against_their_responses(spark, tmp_path):
    rows, d = pages(spark)
    got = warc.read_archives(warc.write_archives(warc.mark_revisits(d), f"file://{tmp_path}/p"))
    assert warc.unresolved_revisits(got).count() == 0
    some = got.where("record_type = 'revisit'").first()
    assert warc.unresolved_revisits(got.where(f"not (record_type = 'response' and page_id = {some.refers_to})")).count() > 0


def test_zip_reader_of_other_writers():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", b"one")
        z.writestr(zipfile.ZipInfo("dir/ü"), b"two" * 100)
        z.comment = b"PK\x05\x06 not the end"
    data = b.getvalue()
    z = warc.ZipReader(lambda o, n: data[o : o + n], len(data))
    at, size = z.locate("dir/ü")
    assert data[at : at + size] == b"two" * 100
    with pytest.raises(ValueError):
        warc.ZipReader(lambda o, n: b"x" * n, 100)


def test_warc_of_nothing_and_damage(spark, tmp_path):
    _, d = pages(spark)
    empty = warc.write_archives(warc.mark_revisits(d.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archives(empty).count() == 0
    packages = warc.write_archives(warc.mark_revisits(d.coalesce(1)), f"file://{tmp_path}/d")
    path = packages.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[200] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read_archives(packages).collect()


# --- 7: URLs ---


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    odd = ["http://Example.COM/en/x", "https://www.example.com/en/?q=http://y", "http://a.net/es/", "http://a.net/en/", "http://com", "http://com/", "x", None, "", "://", "http://b.org/p?x#y", "http://B.NET?/es/", "http://ÄB.net/fr/x#", "http://nocom/", "http://x.com\n.net/es/", "a://b://c/d"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(100 + i, f"http://bad.net/es/{i}") for i in range(40)] + [(200, "http://bad.net/de/1"), (201, "http://good.org/1"), (1, odd[1])]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(d).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        host, path, rule, verdict = brute_rule(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[200] == "block" and verdicts[201] == "allow"
    assert urls.judge_urls(d.limit(0)).count() == 0


def brute_reputation(outcomes, hosts, c):
    """p_bad of each host from (host, bad), level by level in plain Python."""
    def names(host):
        labels = host.split(".")
        two = len(labels) > 1 and len(labels[-1]) == 2 and labels[-1].isalpha() and labels[-2] in c.generic
        n = 2 if two else 1
        return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])

    n, bad = {}, {}
    for h, y in outcomes:
        n[h], bad[h] = n.get(h, 0) + 1, bad.get(h, 0) + y

    def level(children, pa, pb):
        """(mean, strength) from (bad, n) of the children."""
        b, k = (sum(x[i] for x in children) for i in (0, 1))
        mean = (b + pa) / (k + pa + pb)
        spread = sum(y * (x / y) ** 2 for x, y in children) / k - (b / k) ** 2
        inv, bound = len(children) / k, mean * (1 - mean)
        s = c.strength if len(children) < 2 else c.most if spread <= bound * inv else (bound - spread) / (spread - bound * inv)
        s = min(max(s, c.least), c.most)
        return mean * s, (1 - mean) * s

    domains = {}
    for h in n:
        domains.setdefault(names(h), []).append((bad[h], n[h]))
    suffix = {s: level([tuple(map(sum, zip(*v))) for (x, _), v in domains.items() if x == s], *c.base) for s in {s for s, _ in domains}}
    domain = {d: level(v, *suffix[s]) for (s, d), v in domains.items()}
    out = {}
    for h in hosts:
        s, d = names(h)
        a, b = domain.get(d) or suffix.get(s) or c.base
        out[h] = 1 - common.beta_cdf(c.bad_rate, a + bad.get(h, 0), b + n.get(h, 0) - bad.get(h, 0))
    return out


def test_reputation_against_plain_python(spark):
    r, c = random.Random(4), urls.ReputationConfig()
    hosts = [f"{x}.d{d}.{s}" for s, rate in (("org", 0.1), ("net", 0.9), ("co.uk", 0.5), ("uk", 0.5), ("info", 0.5)) for d in range(3) for x in "abc"]
    rate = {h: r.random() for h in hosts}
    outcomes = [(h, int(r.random() < rate[h])) for h in hosts for _ in range(r.randint(0, 30))] + [("bare", 1), ("", 0), ("co.uk", 1)]
    asked = [*hosts, "new.d1.org", "new.other.org", "new.new", "", "x.new.co.uk", "10.0.0.1"]
    got = urls.host_reputation(spark.createDataFrame(outcomes, "host string, bad int"), spark.createDataFrame([(h,) for h in asked * 2], "host string")).collect()
    want = brute_reputation(outcomes, asked, c)
    assert len(got) == len(set(asked)) and len({round(x, 6) for x in want.values()}) > 20
    for x in got:
        assert x.p_bad == pytest.approx(want[x.host], abs=1e-9) and x.bad_host == (x.p_bad >= c.certainty)


def test_pages_are_outcomes_by_their_own_text(spark):
    fine, empty, links = "<p>" + "word " * 80 + "</p><script>x y z</script>", "<script>" + "word " * 90 + "</script><!-- " + "w " * 90 + "-->few", "<a href='x'>" + "word " * 80 + "</a> and more"
    d = spark.createDataFrame([(1, fine), (2, empty), (3, links), (4, None), (5, "")], "i long, html string")
    assert {r.i: r.b for r in d.select("i", urls.bad_page(F.col("html")).alias("b")).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    rows = [(i, f"http://fine.net/de/{i}", fine) for i in range(20)] + [(i, f"http://bad.net/de/{i}", links) for i in range(100, 120)] + [(None, "http://fine.net/es/", fine)]
    got = {r.page_id: (r.verdict, r.p_bad) for r in urls.judge_urls(spark.createDataFrame([(*x, "h", 1) for x in rows], "page_id long, url string, html string, host string, bad int")).collect()}
    assert got[3][0] == "allow" and got[103][0] == "block" and got[None] == ("block", None) and got[3][1] < 0.05 and got[103][1] > 0.95


def test_reputation_follows_labels_and_shrinks(spark):
    rows = [(i, f"http://h{i % 4}.spam.org/{i}") for i in range(80)] + [(i, f"http://h{i % 4}.fine.org/{i}") for i in range(100, 180)] + [(500, "http://new.spam.org/"), (501, "http://new.fine.org/"), (502, "http://other.info/")]
    labels = spark.createDataFrame([(i, int(i < 80)) for i in [*range(80), *range(100, 180)]], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()}
    assert got[3].verdict == "block" and got[103].verdict == "allow"
    assert got[500].p_bad > 0.9 > 0.5 > got[501].p_bad and got[502].verdict == "allow"


@pytest.mark.parametrize("a, b, x", [(1, 1, 0.3), (2.5, 4, 0.2), (40, 3, 0.95), (0.5, 0.5, 0.1), (300, 200, 0.61)])
def test_beta_cdf(a, b, x):
    n = 400_000
    t = (np.arange(n) + 0.5) / n
    log = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    w = np.exp(log - log.max())
    assert common.beta_cdf(x, a, b) == pytest.approx(w[t <= x].sum() / w.sum(), abs=2e-3)
    assert common.beta_above(x, np.array([a, 1.0]), np.array([b, 1.0])) == pytest.approx([1 - common.beta_cdf(x, a, b), 1 - x], abs=1e-12)
