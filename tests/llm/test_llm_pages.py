"""Language of pages and WARC derivatives."""

import glob
import hashlib
import json
import re
import tempfile

import pytest
from quire.llm import langid, queries, warc

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_op6_agrees_with_the_pages(spark):
    rows = queries.op6_evidence_fusion(spark, SF01).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    right = sum(r["lang"] == r["declared"] for r in rows)
    assert right / len(rows) > 0.95 and all(0 < r["probability"] <= 1 + 1e-9 for r in rows)


WORDS = {"en": "the and of with that this thing other where which", "fr": "le la les des avec pour dans une vous nous"}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(WORDS[lang].split()[k % 10] for k in range(i, i + 60)), lang) for i in range(20) for lang in WORDS]
    return spark.createDataFrame(rows + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")


def page(lang, body):
    return f'<html lang="{lang}"><body><p>{body}</p></body></html>'


def test_evidence_decides_where_the_text_does_not(spark, texts):
    rows = [(i, f"http://a.site.fr/{i}", page("fr", WORDS["fr"])) for i in range(30)] + [(100 + i, f"http://b.site.com/{i}", page("en", WORDS["en"])) for i in range(30)]
    rows += [(200, "http://a.site.fr/x", page("", "")), (201, "http://b.site.com/x", page("", "")), (202, "http://new.org/fr", page("fr", "")), (203, "http://a.site.fr/y", page("fr", WORDS["en"] * 5))]
    rows += [(204, None, None), (205, "", ""), (206, "not an address", "<p>" + WORDS["fr"] * 2000), (0, "http://a.site.fr/0", page("fr", WORDS["fr"])), (None, "http://a.site.fr/z", page("fr", WORDS["fr"]))]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, lang string")
    found = langid.identify(pages, texts).collect()
    got = {r["page_id"]: r["lang"] for r in found}
    assert len(found) == len(rows)
    assert all(got[i] == "fr" for i in (*range(30), 200, 202, 206, None)) and all(got[100 + i] == "en" for i in range(30))
    assert got[201] == "en" and got[203] == "en" and got[204] in WORDS and got[205] == got[204]
    assert langid.identify(pages.limit(0), texts).collect() == []
    assert {r["lang"] for r in langid.identify(pages, texts.limit(0)).collect()} == {None}


def test_posteriors_equal_a_plain_version(spark, texts):
    rows = [(i, f"http://{h}.site.{s}/{i}", page(d, WORDS[t])) for i, (h, s, d, t) in enumerate([("a", "fr", "fr", "fr"), ("a", "fr", "en", "en"), ("b", "fr", "", "fr"), ("c", "com", "en", "en"), ("c", "com", "en", "fr")] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    langs, table = langid.fit_text(texts)
    import numpy as np

    log = {}
    for i, _, html in rows:
        c = langid.cells(re.sub("<[^>]*>", " ", html))
        log[i] = table.astype(np.float32)[:, c].sum(1, dtype=float) / np.sqrt(len(c))
    p = {i: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for i, v in log.items()}
    total = sum(p.values())
    part = lambda key, i: sum((p[j] for j, r in enumerate(rows) if key(r) == key(rows[i])), np.zeros(2))
    host, domain, suffix = (lambda r: r[1].split("/")[2]), (lambda r: ".".join(r[1].split("/")[2].split(".")[1:])), (lambda r: r[1].split("/")[2].split(".")[2])
    declared = lambda r: re.search('lang="(.*?)"', r[2])[1]
    want = {}
    for i, r in enumerate(rows):
        prior = (total + 1) / (total.sum() + 2)
        for key in (suffix, domain, host):
            own = np.maximum(part(key, i) - p[i], 0)
            prior = (own + 5 * prior) / (own.sum() + 5)
        z = log[i] + np.log(prior)
        if declared(r):
            rest = np.maximum(total - p[i], 0) + 0.5
            z = z + np.log(np.maximum(part(declared, i) - p[i], 0) / rest + 1 / rest.sum())
        want[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for r in langid.identify(pages, texts).collect():
        assert r["lang"] == langs[int(want[r["page_id"]].argmax())] and abs(r["probability"] - want[r["page_id"]].max()) < 1e-6


def test_rare_values_have_counts_of_their_own(spark, texts):
    code = lambda k: "x" + chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(c, "en") for k in range(260) for c in [code(k)] * (4 if k < 200 else 2)] + [("yy", "fr")] * 300 + [("fr", "fr")] * 3
    rows = [(i, f"http://h{i}/{i}", page(c, WORDS[t])) for i, (c, t) in enumerate(rows)] + [(-1, "http://new/x", page("fr", ""))]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), texts).collect()}
    assert len(got) == len(rows) and got[-1] == "fr"


def test_pages_with_wrong_or_no_declaration(spark):
    """Pages made of documents of a known language, which is kept apart; half of the declarations are wrong or missing, a fifth of the texts a few words."""
    import random

    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r["doc_id"], r["lang"], r["text"].split()) for r in docs.where("lang IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(600).collect()]
    langs = sorted({lang for _, lang, _ in rows})
    pages, truth, said = [], {}, {}
    for i, lang, words in rows:
        kind = rng.random()
        declared = "" if kind < 0.25 else rng.choice(langs) if kind < 0.5 else lang
        words = words[:4] if rng.random() < 0.2 else words[:80]
        host = f"www.{lang}{rng.randrange(6)}.site.{lang}" if rng.random() < 0.7 else f"h{rng.randrange(9)}.com"
        truth[i], said[i] = lang, declared
        pages.append((i, f"http://{host}/{i}", page(declared, " ".join(words).replace("<", " "))))
    found = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()
    wrong = [r for r in found if said[r["page_id"]] != truth[r["page_id"]]]
    right = lambda rows, c: sum(r[c] == truth[r["page_id"]] for r in rows) / len(rows)
    assert len(found) == len(rows) and len(wrong) > 150
    assert right(wrong, "lang") > 0.95 and right(found, "lang") > 0.97 and right(found, "lang") >= right(found, "text_lang")


def test_a_value_of_one_page_says_nothing(spark, texts):
    rows = [(i, f"http://a{i}.com/", page("fr", WORDS["fr"])) for i in range(40)] + [(100 + i, f"http://b{i}.com/", page("en", WORDS["en"])) for i in range(4)]
    pages = lambda code: spark.createDataFrame([*rows, (-1, "http://new.com/", page(code, "x y"))], "page_id long, url string, html string")
    alone, none = ({r["page_id"]: r["probability"] for r in langid.identify(pages(code), texts).collect()}[-1] for code in ("zz", ""))
    assert abs(alone - none) < 1e-9


def test_numeric_hosts_have_no_suffix_and_long_texts_a_class(spark, texts):
    longer = spark.createDataFrame([(500, "der die das und nicht mit einem auch " * 1000, "de")], texts.schema)
    langs, table = langid.fit_text(texts.union(longer))
    assert langs == ["de", "en", "fr"]
    urls = [(1, "http://10.0.0.77/a", ""), (2, "http://a.b.fr/", ""), (3, "http://www.shop.co.uk/", ""), (4, "http://co.uk/", "")]
    got = {r["page_id"]: (r["domain"], r["suffix"]) for r in langid.evidence(spark.createDataFrame(urls, "page_id long, url string, html string"), langs, table).collect()}
    assert got == {1: ("10.0.0.77", ""), 2: ("b.fr", "fr"), 3: ("shop.co.uk", "uk"), 4: ("co.uk", "uk")}


def read_warc(path):
    """Records of WARC files, by Content-Length."""
    for name in sorted(glob.glob(f"{path}/part-*")):
        raw = open(name, "rb").read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.0\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            yield fields, rest[:n]
            raw = rest[n + 4 :]


HTML = '<!DOCTYPE html><html lang="fr"><head><title> A &amp; "B"\n</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><a href="/x">X</a> <a class=c href=\'y"z\'>Y</a></nav><script>var t="</p>";</script><p>One&nbsp;&lt;two&gt;<br>three   four</p></body></html>'


def test_derivatives(spark):
    rows = [(1, "http://a.org/1", HTML), (2, None, None), (3, "http://b.org/\r\nX-Evil: 1", ""), (None, "u", "é" * 60_000), (1, "http://a.org/1", HTML)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, block string, record_id string")
    sources = warc.responses(pages)
    records = warc.derivatives(sources)
    path = tempfile.mkdtemp(prefix="quire-test-") + "/out"
    warc.write_records(records, path)
    found = list(read_warc(path))
    assert len(found) == 10
    by_id = {r["record_id"]: r for r in sources.collect()}
    assert len(by_id) == 4
    for fields, block in found:
        source = by_id[fields["WARC-Refers-To"]]
        assert fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
        assert fields["WARC-Payload-Digest"] == source["payload_digest"] == "sha1:" + hashlib.sha1(source["payload"].encode()).hexdigest()
        assert fields.get("WARC-Target-URI", "") == source["target_uri"] and "\n" not in source["target_uri"]
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
    first = {f["WARC-Type"]: (f, b) for f, b in found if f.get("WARC-Target-URI") == "http://a.org/1"}
    about = json.loads(first["metadata"][1])
    assert about["links"] == ["/x", 'y"z'] and about["title"].strip() == 'A &amp; "B"' and about["lang"] == "fr"
    assert about["source-headers"].startswith("HTTP/1.1 200 OK\r\n") and about["refers-to"] == first["metadata"][0]["WARC-Refers-To"]
    assert first["conversion"][1].decode() == "X Y\nOne <two>\nthree four"
    assert first["conversion"][0]["WARC-Concurrent-To"] == first["metadata"][0]["WARC-Record-ID"]
    assert about["text-digest"] == first["conversion"][0]["WARC-Block-Digest"]
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []


def test_links_are_those_of_an_html_parser(spark):
    from html.parser import HTMLParser

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found += [v for k, v in attrs if tag == "a" and k == "href"][:1]

    bodies = [
        "<a href=/x>1</a><A HREF = '/y z'>2</A><a class=c\n href\n=\n\"/w\">3</a>", "<a data-href=/no href=/yes>4</a><a name=n>5</a><abbr href=/no>6</abbr>", "<a href=https://a.org/?q=1&r=2 class=k>7</a><a href=''>8</a>",
        "<a class='x'href='/tight'>9</a><link href=/no><a\thref=/tab\tid=i>10</a>", "no links",
    ]
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()] + [(10_000 + i, b) for i, b in enumerate(bodies)]
    made = warc.derivatives(warc.responses(spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in pages], "page_id long, url string, html string")))
    got = {r["page_id"]: json.loads(r["block"])["links"] for r in made.where("record_type = 'metadata'").collect()}
    for i, body in pages:
        parser = Anchors()
        parser.feed(body or "")
        assert got[i] == parser.found, (i, body)
    assert sum(map(len, got.values())) > 50


def test_op10_has_two_records_a_page(spark):
    rows = queries.op10_derivative_records(spark, SF001).collect()
    assert len(rows) == 2 * spark.read.parquet(f"{SF001}/pages.parquet").count() and len({r["record_id"] for r in rows}) == len(rows)
