import hashlib
import zlib

from hypothesis import given
from hypothesis import strategies as st

from tesserae.llm import interleave


def check(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    want = []
    for i, t in rows:
        b = t.encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        stored = interleave.store_pgm(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), interleave.describe(interleave.read_pgm(stored))))
    rows_ = interleave.op6(df).collect()
    assert sorted((tuple(r)[:8] for r in rows_), key=str) == sorted(want, key=str)
    for r in rows_:  # the figure stands between the halves of its text, with its own caption
        assert r["caption"] == f"document {'' if r['doc_id'] is None else r['doc_id']}".strip() and 0 <= r["position"] < r["elements"] <= 3


def test_whole_table(small):
    check(small)


def test_edges(edge, empty):
    check(edge)
    assert interleave.op6(empty).count() == 0


@given(st.binary(max_size=500))
def test_round_trip(data):
    p = data + bytes(-len(data) % 64 if data else 64)
    assert interleave.read_pgm(interleave.store_pgm(p)).tobytes() == p


def test_sequence_order_and_captions(spark):
    html = "<p>one<b>!</b></p><figure><img src='media/sha256:aa' alt='x'><figcaption>cap &amp; y</figcaption></figure>two<img src=zz.png alt=q><p>three"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    media = spark.createDataFrame([("aa", 7)], "digest string, n int")
    got = sorted((tuple(r) for r in interleave.resolve(interleave.sequences(pages), media, ["page_id"]).select("page_id", "pos", "kind", "text", "digest", "caption", "n").collect()), key=lambda r: (r[0], r[1] or 0))
    assert got == [
        (1, 0, "text", "one!", None, None, None),
        (1, 1, "media", None, "aa", "cap & y", 7),
        (1, 2, "text", "two", None, None, None),
        (1, 3, "media", None, "zz.png", "q", None),
        (1, 4, "text", "three", None, None, None),
        (2, None, None, None, None, None, None),
    ]


def test_pages_with_several_elements(spark):
    """Real pages: order, positions and texts of the sequence, and payloads resolved by digest."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    media = spark.createDataFrame([("a" * 64, bytearray(b"x")), ("b" * 64, bytearray(b"y"))], interleave.MEDIA)
    first, second = ('<figure><img src="m/sha256:%s"><figcaption>%s</figcaption></figure>' % (d * 64, c) for d, c in (("a", "one"), ("b", "two")))
    rows = [(r["page_id"], r["html"].replace("</article>", first + "between" + second + "</article>")) for r in pages.collect()]
    shown = interleave.resolve(interleave.sequences(spark.createDataFrame(rows, pages.schema)), media, ["page_id"]).collect()
    for page, source in rows:
        mine = sorted((r for r in shown if r["page_id"] == page), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(len(mine))) and len(mine) > 4
        figures = [i for i, r in enumerate(mine) if r["caption"] in ("one", "two")]
        if "</article>" in source:
            i, j = figures
            assert (j - i, mine[i + 1]["text"]) == (2, "between") and bytes(mine[i]["media"]) == b"x" and bytes(mine[j]["media"]) == b"y"
        assert all((r["text"] is None) == (r["kind"] == "media") for r in mine)


def test_a_hot_digest(spark):
    from tesserae.llm.common import join_hot

    refs = spark.range(150_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) AS digest")
    media = refs.select("digest").distinct().selectExpr("digest", "length(digest) AS n")
    got = join_hot(refs, media, "digest")
    assert got.count() == 150_000 and got.where("n <> length(digest)").count() == 0
