"""Every event on links and files, its rules, and what it leaves alone."""

import pytest

from catalograph.operators import granule_edits as ge

GRANULES = f"granule_ur string, related_urls array<{ge.LINK}>, files array<struct<{ge.FILE},files:array<struct<{ge.FILE}>>>>"
GIVEN = f"granule_ur string, event_type string, links array<{ge.INPUT}>, value string, files array<struct<{ge.FILE}>>"
CLOUD = "https://opendap.cloud.org/x"
A = ("http://a", "GET DATA", None, "text/x", None)
S3 = ("s3://old", ge.DIRECT, None, None, "d")
NEAR = ("http://opendap.here/y", "OLD", ge.SERVICE_DATA, None, "mine")
FAR = (CLOUD, ge.SERVICE, ge.SERVICE_DATA, None, None)


def link(url=None, **k):
    return (url, k.get("from_"), k.get("to"), k.get("type"), k.get("subtype"), k.get("mime"), k.get("text"))


def file(name, nbytes=None, size=None, unit=None, fmt=None, ftype=None, mime=None, checksum=None, files=None, top=True):
    return (name, nbytes, size, unit, fmt, ftype, mime, checksum, *([files] if top else []))


def run(spark, urls, event, links=None, value=None, files=None, old_files=None):
    g = spark.createDataFrame([("G", urls, old_files), ("other", [A], None)], GRANULES)
    i = spark.createDataFrame([("G", event, links, value, files)], GIVEN)
    out = {r["granule_ur"]: r for r in ge.edit_links_and_files(g, i).collect()}
    assert [tuple(x) for x in out["other"]["related_urls"]] == [A] and (out["other"]["edited"], out["other"]["message"]) == (False, None)
    r = out["G"]
    return r, None if r["related_urls"] is None else [tuple(x) for x in r["related_urls"]]


DONE = [
    ([A, S3], "update_field:relatedurl", dict(links=[link(from_="http://a", to="http://b"), link(from_="http://none", to="x")]), [("http://b", *A[1:]), S3]),
    ([A], "append_to_field:relatedurl", dict(links=[link("http://c", type="T", mime="m")]), [A, ("http://c", "T", None, "m", None)]),
    (None, "append_to_field:relatedurl", dict(links=[link("http://c")]), [("http://c", None, None, None, None)]),
    ([A, S3, A], "remove_field:relatedurl", dict(links=[link("http://a"), link("http://none")]), [S3]),
    ([A], "remove_field:relatedurl", dict(links=[link("http://a")]), None),
    ([A, S3], "update_field:mimetype", dict(links=[link("http://a", mime="text/y")]), [(*A[:3], "text/y", None), S3]),
    ([A, S3], "update_field:s3link", dict(value="s3://n, s3://m,s3://n"), [("s3://n", ge.DIRECT, None, None, ge.DIRECT_TEXT), ("s3://m", ge.DIRECT, None, None, ge.DIRECT_TEXT), A]),
    ([A, S3], "append_to_field:s3link", dict(value="s3://old, s3://m"), [A, S3, ("s3://m", ge.DIRECT, None, None, ge.DIRECT_TEXT)]),
    ([A, NEAR], "update_field:opendaplink", dict(value=f"http://new/y, {CLOUD}"), [("http://new/y", ge.SERVICE, ge.SERVICE_DATA, None, "mine"), FAR, A]),
    ([FAR, A, NEAR], "update_field:opendaplink", dict(value=CLOUD + "2"), [NEAR, (CLOUD + "2", *FAR[1:]), A]),
    ([A, NEAR], "append_to_field:opendaplink", dict(value=CLOUD), [A, NEAR, FAR]),
    ([A, ("http://x/OpenDAP/1", "T", "S", None, None)], "update_type:opendaplink", {}, [A, ("http://x/OpenDAP/1", ge.SERVICE, ge.SERVICE_DATA, None, None)]),
    ([A, ("http://x", "T", "opendap DATA (dods)", None, None)], "update_type:opendaplink", dict(value="OPeNDAP data (DODS)"), [A, ("http://x", ge.SERVICE, ge.SERVICE_DATA, None, None)]),
]


@pytest.mark.parametrize("urls, event, given, want", DONE)
def test_links(spark, urls, event, given, want):
    r, got = run(spark, urls, event, **given)
    assert (r["edited"], r["message"]) == (True, None) and got == want


BROKEN = [
    ("update_field:mimetype", dict(links=[link("http://a", mime="x"), link("http://none", mime="y")]), "only links of the granule"),
    ("update_field:mimetype", dict(links=[link("http://a", mime="x"), link("http://a", mime="y")]), "given twice"),
    ("update_field:s3link", dict(value="s3://a, http://b"), "must start with s3://, but was http://b"),
    ("append_to_field:s3link", dict(value=""), "must start with s3://"),
    ("update_field:opendaplink", dict(value="s3://a"), "can't start with s3://"),
    ("update_field:opendaplink", dict(value="http://a,http://b,http://c"), "more than two"),
    ("update_field:opendaplink", dict(value=f"{CLOUD},{CLOUD}2"), "one service link in the cloud"),
    ("append_to_field:opendaplink", dict(value="http://a,http://b"), "one service link on premises"),
    ("append_to_field:opendaplink", dict(value="http://a"), "on premises already"),
    ("update_type:opendaplink", dict(value="nothing"), "no service links"),
    ("update_field:nothing", {}, "unknown event"),
]


@pytest.mark.parametrize("event, given, want", BROKEN)
def test_broken_rules_change_nothing(spark, event, given, want):
    r, got = run(spark, [A, S3, NEAR], event, **given)
    assert not r["edited"] and want in r["message"] and got == [A, S3, NEAR]


def _plain(r):
    return None if r is None else [tuple(x if not hasattr(x, "asDict") else tuple(x) for x in f[:-1]) + (None if f["files"] is None else [tuple(x if not hasattr(x, "asDict") else tuple(x) for x in y) for y in f["files"]],) for f in r]


def test_files(spark):
    old = [file("a", 10, 1.0, "MB", "f", None, "m", ("v", "MD5")), file("p", files=[file("q", 5, top=False), file("s", top=False)])]
    new = [file("a", 0, 0.0, mime="n", checksum=("w", None), top=False), file("q", None, 2.0, "KB", checksum=("z", "SHA"), top=False)]
    r, _ = run(spark, [A], "update_field:additionalfile", files=new, old_files=old)
    assert r["edited"] and _plain(r["files"]) == [
        ("a", None, None, None, "f", None, "n", ("w", "MD5"), None),
        ("p", None, None, None, None, None, None, None, [("q", 5, 2.0, "KB", None, None, None, ("z", "SHA")), ("s", None, None, None, None, None, None, None)]),
    ]
    cases = [
        ([file("none", top=False)], old, "only files of the granule"), ([file("a", top=False)], [*old, file("q")], "files of one name"), ([file("a", top=False)] * 2, old, "given twice"),
        ([file("q", size=3.0, top=False)], old, "size without a unit: q"), ([file("q", unit="MB", top=False)], old, "unit without a size: q"),
        ([file("a", checksum=(None, "SHA"), top=False)], old, "algorithm without a value: a"), ([file("q", checksum=("v", None), top=False)], old, "value without an algorithm: q"),
    ]
    for given, held, want in cases:
        r, _ = run(spark, [A], "update_field:additionalfile", files=given, old_files=held)
        assert not r["edited"] and want in r["message"] and _plain(r["files"]) == [f for f in _plain_rows(held)]


def _plain_rows(files):
    return [(*f[:-1], f[-1]) for f in files]
