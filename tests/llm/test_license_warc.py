import hashlib
import re
import textwrap

import pytest

from quarkflow.llm import license_scan, warc

from .oddities import empty, odd


def scan(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.license_scan(df, "doc_id", "text", **options).collect()}


def test_variants_of_a_license_have_one_digest(spark):
    mit = license_scan._MIT
    got = scan(spark, mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), "The MIT Licence (MIT)\r\n\r\nCopyright 1999 A & B\r\n" + mit.replace('"', "'").replace("\n\n", "\r\n   \r\n"), mit + " Except on Sundays.")
    assert [got[i].license_id for i in range(4)] == ["MIT", "MIT", "MIT", None]
    assert got[0].text_digest == got[1].text_digest


def test_full_texts_are_known(spark):
    full = dict(license_scan._FULL)
    got = scan(spark, full["Apache-2.0"], full["GPL-2.0"].upper(), full["GPL-3.0"].replace("\n", "\r\n"), full["LGPL-2.1"], full["MPL-2.0"], full["GPL-3.0"] + "More.")
    assert [got[i].license_id for i in range(6)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", None]


def test_notices_in_lines(spark):
    got = scan(spark, "Some text.\nreleased under the MIT licence\nmore", "Licensed under CC-BY-NC 4.0!\nReleased under the MIT License.", "no licence here", None, "")
    assert [got[i].notices for i in range(5)] == ["MIT", "CC-BY-NC-4.0,MIT", None, None, None]
    assert got[3].text_digest == got[4].text_digest == hashlib.sha256(b"").hexdigest()


def test_scan_odd_rows_and_limits(spark):
    assert license_scan.license_scan(odd(spark), "doc_id", "text").count() == 11
    assert license_scan.license_scan(empty(spark), "doc_id", "text").count() == 0
    assert scan(spark, "Released under the MIT License.", known=[])[0].license_id is None


def test_many_known_texts_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_BROADCAST", 10)
    got = scan(spark, "Known text 17\nno other", "known text 17", known=[(f"L{i}", f"known text {i}") for i in range(40)])
    assert [(got[i].license_id, got[i].notices) for i in (0, 1)] == [(None, "L17"), ("L17", "L17")]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "    "])
def test_known_texts_match_however_they_are_wrapped_and_commented(spark, mark):
    texts, want = [], []
    for name, text in license_scan.KNOWN:
        if len(text) > 150:
            for width in (60, 65, 72, 79, 80, 100):
                paragraphs = [textwrap.fill(p.strip(), width) for p in re.split(r"\n[ \t]*\n", text.strip())]
                texts.append("\n".join(mark + line for line in "\n\n".join(["Copyright (c) 2020-2021, Some One <a@b.c>", *paragraphs]).split("\n")))
                want.append(name)
    got = scan(spark, *texts)
    assert [(i, want[i]) for i in range(len(texts)) if got[i].license_id != want[i]] == []


def test_prose_about_copyright_stays(spark):
    got = scan(spark, "Copyright is a right of authors.", "is a right of authors.", "Copyright 2001 A. Author\nProse.", "Prose.", "# (C) 1999 B\n/* Copyright © C */ Prose.", "")
    assert got[0].text_digest != got[5].text_digest != got[2].text_digest == got[3].text_digest and got[4].text_digest == got[5].text_digest


def test_notices_and_terms_on_one_line(spark):
    """A notice ends with its sentence: what follows on the line is read, and unlike texts have unlike digests."""
    lines = ["Copyright (c) 2020 X. Licensed under the MIT License.", "Copyright 2020 J. Smith, Acme Inc. and others. Released under the MIT License.", "# (c) 1999 A. B.; Licensed under CC BY 4.0.", "Prose first. Licensed under the MIT License."]
    got = scan(spark, *lines, "Copyright © law protects authors. This long essay says why.", "Copyright © law protects authors. Another essay.", "", "Copyright (c) 2020 J. Smith\n" + license_scan._MIT, "Copyright (c) 2020 J. Smith. " + license_scan._MIT)
    assert [got[i].notices for i in range(4)] == ["MIT", "MIT", "CC-BY-4.0", "MIT"]
    assert len({got[i].text_digest for i in (4, 5, 6)}) == 3
    assert got[7].license_id == got[8].license_id == "MIT"


def test_a_long_line_after_a_notice(spark):
    """A hundred thousand words and points on one line neither fail nor vanish."""
    got = scan(spark, "Copyright (c) 2020 A. " + "Some words. " * 100_000, "Copyright (c) 2020 A. " + "a." * 300_000, "")
    assert len({got[i].text_digest for i in range(3)}) == 3


def test_texts_are_read_and_made_canonical_once(spark):
    plan = license_scan.license_scan(odd(spark), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_repeated_rows_and_ids_keep_their_own_notices(spark):
    rows = [(1, "Released under the MIT License.\nx"), (1, "Released under the MIT License.\nx"), (1, "nothing"), (None, "Released under the MIT License.\ny"), (None, "z")]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((repr(r.doc_id), repr(r.notices)) for r in got) == [("1", "'MIT'"), ("1", "'MIT'"), ("1", "None"), ("None", "'MIT'"), ("None", "None")]


def test_scan_runs_no_python(spark):
    plan = license_scan.license_scan(odd(spark), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = "page_id long, url string, html string, payload string, rec_id string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "p", "q") for r in rows], PAGES)


def resolve(df, **options):
    return sorted((tuple(r) for r in warc.dedup_archives(df.drop("payload"), "page_id", "url", "html", **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_revisits_name_the_largest_id(spark, tmp_path):
    body = "b\r\n\r\nWARC/1.1\r\n" + "x" * 1000 + "é🙂"
    small = "s" * 999
    df = pages(spark, (1, "http://a", body), (2, "http://b\r\nX: y", body), (3, None, body), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", body), (3, "again", body))
    got = resolve(df, path=str(tmp_path / "out"))
    n, d = len(body.encode()), hashlib.sha1(body.encode()).hexdigest()
    want = [(i, n, d, "revisit", 3) for i in (1, 2, None)] + [(3, n, d, "response", None)] * 2
    want += [(i, 999, hashlib.sha1(small.encode()).hexdigest(), "response", None) for i in (4, 5)] + [(i, 0, hashlib.sha1(b"").hexdigest(), "response", None) for i in (6, 7)]
    assert got == sorted(want, key=repr)
    records = warc.read_archives(spark, str(tmp_path / "out"), with_payload=True).collect()
    assert sum(bytes(r.payload) == body.encode() for r in records if r.payload is not None) == 2
    assert all(r.target_uri == "http://b  X: y" for r in records if r.record_id == "<urn:quarkflow:record:2>")


def test_all_null_ids_are_responses(spark):
    assert {r[3] for r in resolve(pages(spark, (None, "u", "z" * 2000), (None, "u", "z" * 2000)))} == {"response"}


def test_no_pages(spark):
    assert resolve(pages(spark)) == []
