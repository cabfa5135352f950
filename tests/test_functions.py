import pytest
from pyspark.sql import functions as F

from quern.functions import text, urls


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("source", "expected"),
    [("https://Example.COM:443/a", "example.com"), ("example.com.", "example.com"), ("//shop.example.nl/x", "shop.example.nl"), ("ftp://a.b", None), ("localhost", None), ("10.0.0.1", None), ("https://u@h.nl", None), ("a_b.nl", None), ("", None), (None, None), ("-a.nl", None)],
)
def test_normalize_domain(spark, source, expected):
    assert values(spark, [source], urls.normalize_domain) == [expected]


def test_company_url(spark):
    got = values(spark, ["HTTP://WWW.EXAMPLE.DE:80/services/?utm_source=x&b=2&gclid=9&a=1#team", "example.com/", "https://a.b:8443/x//", "mailto:x@y.nl"], urls.normalize_company_url)
    assert got == ["https://example.de/services?a=1&b=2", "https://example.com", "https://a.b:8443/x", None]


def test_registrable_domain(spark):
    assert values(spark, ["shop.example.co.uk", "tenant.github.io", "a.b.c.example.com", "unknownsuffix", "co.uk"], urls.registrable_domain) == ["example.co.uk", "tenant.github.io", "example.com", "unknownsuffix", "co.uk"]
    assert values(spark, ["tenant.github.io"], lambda c: urls.registrable_domain(c, private=False)) == ["github.io"]


@pytest.mark.parametrize(("name", "expected"), [("Acme B.V.", "acme"), ("Acme & Sons Ltd.", "acme and sons"), ("Foo Holding GmbH", "foo holding"), ("Company Limited", None), ("Bar S.A.R.L.", "bar"), ("X Company Inc", "x")])
def test_company_name(spark, name, expected):
    assert values(spark, [name], text.normalize_company_name) == [expected]


def test_contact_and_person(spark):
    assert values(spark, ["mail a.b@c.nl", "call +31 20 123 4567", "room 12", None], text.contains_contact) == [True, True, False, False]
    assert values(spark, ["Jan de Vries", "Acme Digital", "One"], text.looks_like_person_name) == [True, False, False]


def test_country_and_json(spark):
    assert values(spark, ["In Duitsland", "the netherlands!", "francefrance"], text.country_from_text) == ["Germany", "Netherlands", None]
    assert values(spark, ['{"a": ["X  y", {"b": "Ä"}], "c": 1}', "no json", None], text.json_strings) == [["x y", "ä"], [], None]
    assert values(spark, ["straße"], text.casefold) == ["strasse"]


def test_ids(spark):
    assert values(spark, ["https://www.wikidata.org/wiki/q12", "Q7", "x"], text.wikidata_id) == ["Q12", "Q7", None]
    assert values(spark, ["https://opencorporates.com/companies/NL/ 12", "us_de/9", "nl"], text.registry_id) == ["nl/12", "us_de/9", None]


def test_cells(spark):
    assert values(spark, ["=1+1", "a \t b\n  c", "plain"], lambda c: text.spreadsheet_cell(c, 20)) == ["'=1+1", "a b\nc", "plain"]


def test_public_addresses(spark):
    refused = ["http://[::1]/", "http://[fe80::1]/", "http://[fc00::2]:80/", "http://[::ffff:10.0.0.1]/", "http://[2001:db8::1]/", "http://[2001::1]/", "http://[2002:a00:1::]/", "http://[", "http://192.0.2.1/", "http://198.18.0.1/", "http://198.51.100.7/", "http://203.0.113.5/", "http://100.64.1.1/", "http://240.0.0.1/"]
    allowed = ["http://[2606:4700::1111]/", "https://[2a00:1450:4001::8a]:443/x", "http://192.0.3.1/", "http://100.128.0.1/", "https://example.org/"]
    rows = spark.createDataFrame([(u,) for u in refused + allowed], "u string").select("u", urls.is_public_http(F.col("u")).alias("ok")).collect()
    assert {r.u for r in rows if r.ok} == set(allowed)


def test_page_labels_are_no_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("Our Team", "We", "About Acme", "Team Acme Digital 24", "Acme Web Agency")], "x string").select("x", text.plausible_company_name(F.col("x")).alias("ok")).collect()
    assert [r.x for r in rows if r.ok] == ["Team Acme Digital 24", "Acme Web Agency"]


def test_texts_are_folded_part_by_part(monkeypatch):
    import pyarrow as pa

    # parts end before a text that would pass the bound; a longer text is a part of its own
    monkeypatch.setattr(text, "CHARS_AT_ONCE", 8)
    texts = ["Ab", None, "STRASSE", "", "ſ" * 30, None, "C", "ﬁ"]
    parts, concat = [], pa.concat_arrays
    monkeypatch.setattr(pa, "concat_arrays", lambda xs: parts.extend(len(x) for x in xs) or concat(xs))
    got = text._by_parts(pa.array(["x", *texts]).slice(1), str.casefold).to_pylist()
    assert got == [t and t.casefold() for t in texts] and parts == [2, 2, 1, 3]
    assert text._by_parts(pa.array([], pa.string()), str.casefold).to_pylist() == []
