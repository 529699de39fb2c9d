"""The rules of detection, in texts of our own."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import detection as d
from spanweave.operators.geometry import needs_independent_geometry, place_spans
from spanweave.plans import catalog


def found(text, **policy):
    return [(text[s.start : s.end], s.kind, s.status) for s in d.candidates(text, d.Policy(**policy))]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("see https://a.example/b?c=1, then", [("https://a.example/b?c=1", "http(s)", "mask")]),
        ("看https：／／example.com/a。后", [("https：／／example.com/a", "http(s)", "mask")]),
        ("go to www.shop.org now", [("www.shop.org", "www", "mask")]),
        ("example . com is spaced", [("example . com", "domain", "mask")]),
        ("Finished. Word follows", []),
        ("open main.py and notes.md", [("main.py", "domain", "keep"), ("notes.md", "domain", "keep")]),
        ("call sp.io() here", [("sp.io", "domain", "keep")]),
        ("2.chapter.com", [("2.chapter.com", "domain", "needs_review")]),
        ("name.unknownsuffix", []),
        ("write a.b@site.com", []),
        ("", []),
    ],
)
def test_addresses(text, expected):
    assert found(text) == expected


@pytest.mark.parametrize("name", ["shop.example.nz", "name.eu", "x.store", "y.cloud", "z.mx", "a.za", "b.xn--p1ai"])
def test_every_public_suffix_is_known(name):
    seen = [(name, "domain", "mask")] if not name.startswith("b.") else []  # the pattern of names has letters alone at the end
    assert found(f"see {name} now") == seen
    assert name.rpartition(".")[2] in d.DEFAULT_TLDS and len(d.DEFAULT_TLDS) == 1437


def test_workers_know_every_public_suffix(spark):
    df = spark.createDataFrame([("see name.eu now",), ("name.unknownsuffix",)], "text string")
    assert [len(r.spans) for r in d.detect(df).collect()] == [1, 0]


def test_tld_filter_takes_every_public_suffix(spark, tmp_path):
    urls = ["https://a.example.nz/x", "https://b.store", "http://c.EU:80/", "https://d.unknownsuffix", "https://e.test/", "https://f.com"]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.suffix for r in catalog.QUERIES["tld_filter_domains"](spark, str(tmp_path)).collect()} == {"nz", "store", "eu", "test", "com"}


def test_code_point_offsets():
    assert d.candidates("😀😀 www.a.com")[0].start == 3


def test_host_policy():
    text = "x https://github.com/me/repo y"
    assert found(text, host_policy="host") == [("https://github.com", "http(s)", "mask")]
    for other in ("https://github.com.evil/x", "https://github.com@evil/x"):
        assert found(other, host_policy="host") == [(other, "http(s)", "mask")]
    with pytest.raises(ValueError, match="policy"):
        d.Policy(host_policy="none")


def test_private_details():
    p = {"privacy": True}
    assert found("mail a.b@site.com", **p) == [("a.b@site.com", "email", "mask")]
    assert found("num 13912345678 end", **p) == [("13912345678", "phone", "mask")]
    assert found("tel: +1 (555) 010-99", **p) == [("+1 (555) 010-99", "phone", "mask")]
    assert found("phone 139123456789", **p) == [("139123456789", "phone", "mask")]
    assert found("in /Users/kim/work/a.txt", **p)[0] == ("/Users/kim/", "identity_path", "mask")
    assert found("in /Users/kim/work/a.txt", path_policy="parent", **p)[0] == ("/Users/kim/work/", "identity_path", "mask")
    assert found(r"in C:\Users\kim\x.md z", **p)[0] == ("C:\\Users\\kim\\", "identity_path", "mask")
    assert found("/home/kim/my dir/a", path_policy="parent", **p)[0][2] == "needs_review"


def test_spoken():
    assert found("say shop dot com now", channel="audio") == [("shop dot com", "spoken_address", "needs_review")]
    assert found("一三九一二三四五六七八", channel="subtitle", privacy=True)[0][1:] == ("phone", "needs_review")
    assert found("my wechat", channel="audio", privacy=True) == [("wechat", "contact_cue", "needs_review")]
    assert found("my wechat", privacy=True) == []


def test_detect_equals_candidates(spark):
    texts = ["go www.a.com", None, "", "plain words", "tel 5551234567", "see a.io(x)", "/home/me/x"]
    out = d.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), policy=d.Policy(privacy=True)).orderBy("i").collect()
    assert [[tuple(s) for s in r.spans] for r in out] == [[tuple(s) for s in d.candidates(t or "", d.Policy(privacy=True))] for t in texts]


def test_marker_spans(spark):
    df = spark.createDataFrame([("😀 a1 b22",), ("none",), (None,)], "t string")
    out = [r[0] for r in df.select(d.marker_spans(F.col("t"), "[0-9]+")).collect()]
    assert [[tuple(s) for s in r] if r is not None else None for r in out[:2]] == [[(3, "1"), (6, "22")], []]


def line(spark, text, start, end, boxes, chars=None):
    box = "struct<x:double,y:double,w:double,h:double>"
    glyphs = chars or [(i, i + 1, b) for i, b in enumerate(boxes)]
    row = (text, (0.1, 0.4, 0.8, 0.1), glyphs, start, end)
    return spark.createDataFrame([row], f"text string, box {box}, chars array<struct<start:int,end:int,box:{box}>>, start int, end int")


def placed(df):
    r = place_spans(df, 1000, 1000).first()
    return r.box_method, tuple(r.pixel_box)


def test_geometry_labels(spark):
    even = [(0.1 + 0.1 * i, 0.4, 0.08, 0.1) for i in range(8)]
    assert placed(line(spark, "abcdefgh", 2, 5, even)) == ("characters", (296, 396, 288, 108))
    assert placed(line(spark, "abcdefgh", 0, 3, [even[0]] * 4 + even[4:]))[0] == "shared_character_boxes"
    assert placed(line(spark, "abcdefgh", 0, 4, [even[0]] * 4 + even[4:]))[0] == "repeated_character_boxes"
    assert placed(line(spark, "abcdefgh", 2, 5, even[:4]))[0] == "line_fallback"
    wide = [(0.1 + 0.1 * i, 0.4, 0.15 if i == 4 else 0.08, 0.1) for i in range(8)]
    assert placed(line(spark, "abcdefgh", 2, 5, wide))[0] == "overlapping_character_boxes"
    chars = [(0, 4, (0.1, 0.4, 0.4, 0.1)), (4, 8, (0.5, 0.4, 0.4, 0.1))]
    assert placed(line(spark, "abcdefgh", 2, 8, [], chars))[0] == "crossing_character_range"
    assert placed(line(spark, "abcdefgh", 0, 8, [])) == ("line_fallback", (96, 396, 808, 108))


def test_glyph_trigger(spark):
    even = [(0.1 * i, 0.4, 0.08, 0.1) for i in range(3)]
    assert line(spark, "abc", 0, 1, even).select(needs_independent_geometry(F.col("chars"))).first()[0] is False
    assert line(spark, "abc", 0, 1, even[:2] + even[:1]).select(needs_independent_geometry(F.col("chars"))).first()[0] is True


def test_no_text_with_a_span_is_without_a_trigger(spark):
    rng = random.Random(12)
    pool = ["shop", "a", "b1", ".", "．", " . ", ". ", " .", "com", "COM", "me", "io", "eu", "xn--p1ai", "İo", "ıo", "tesſt", "\u212a", "www", "http", "https", " : ", ":", "//", "／", "/", "?q", "#", "@", "13812345678", "tel: 555 1234", "/home/", "C:\\Users\\", " dot ", "点", "一三八", "email", "加我", "\n", " ", "é", "-", "_", "(", "x.py", "。"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    for policy in (d.Policy(), d.Policy(privacy=True, channel="audio")):
        wanted = {t for t in cases if d.candidates(t, policy)}
        df = spark.createDataFrame([(t,) for t in cases], "text string")
        passed = {r.text for r in df.where(F.col("text").rlike(d.trigger(policy))).collect()}
        assert wanted <= passed and len(wanted) > 300, sorted(wanted - passed)[:5]
    assert spark.createDataFrame([("A sentence. And another one. Was it 3. or 4? Yes.",)], "text string").where(F.col("text").rlike(d.trigger(d.Policy()))).count() == 0
