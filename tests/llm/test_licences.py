import textwrap
from pathlib import Path

import pytest
from tests.llm.fixtures import frame

from spanforge.llm import licences as op


def test_lines_and_whole_texts(spark):
    some = [
        (1, "Copyright (c) 2020 Someone\n  LICENSED under the apache licence -- Version 2.0", "", "", 0),
        (2, "Some words.\nReleased under the MIT Licence\nmore\nreleased   under the M.I.T. license\nReleased under the MIT License.", "", "", 0),
        (3, None, "", "", 0),
        (4, "", "", "", 0),
        (5, "prose about the MIT License and others", "", "", 0),
        (6, "Licensed under CC BY-NC 4.0.", "", "", 0),
        (6, "Licensed under CC BY-NC 4.0.", "", "", 0),
        (None, "Licensed under CC BY 4.0.", "", "", 0),
    ]
    got = sorted(((str(r.doc_id), r.n_lines, r.licence, r.n_licence_lines, r.n_licence_blocks, r.licences) for r in op.scan(frame(spark, some)).collect()))
    assert got == sorted([
        ("1", 2, "Apache-2.0", 1, 1, "Apache-2.0"),
        ("2", 5, None, 2, 0, "MIT"),
        ("3", 1, None, 0, 0, ""),
        ("4", 1, None, 0, 0, ""),
        ("5", 1, None, 0, 0, ""),
        ("6", 1, "CC-BY-NC-4.0", 1, 1, "CC-BY-NC-4.0"),
        ("6", 1, "CC-BY-NC-4.0", 1, 1, "CC-BY-NC-4.0"),
        ("None", 1, "CC-BY-4.0", 1, 1, "CC-BY-4.0"),
    ])


def test_known_table_and_empty(spark):
    known = spark.createDataFrame([("X", "my own\nterms"), ("Y", "My own terms!"), ("Z", None)], "licence string, text string")
    (r,) = op.scan(frame(spark, [(1, "MY OWN   TERMS", "", "", 0)]), known).collect()
    assert r.licence == "X" and r.n_licence_lines == 1
    assert op.scan(frame(spark, [])).count() == 0


def wrapped(text, width=72, indent=""):
    return "\n\n".join(textwrap.fill(p, width, initial_indent=indent, subsequent_indent=indent) for p in text.split("\n\n"))


def test_entire_licences_in_other_forms(spark):
    bodies = dict(op.TEXTS)
    mit = bodies["MIT"]
    some = [
        (1, "MIT License\n\nCopyright (c) 2019-2024 Ann Lee\n\n" + wrapped(mit), "MIT"),
        (2, "The MIT License (MIT)\n\nCopyright 2001 Some Company, Inc. All rights reserved.\n" + wrapped(mit, 50, " * "), "MIT"),
        (3, mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,"), "MIT"),
        (4, "(c) 2020 Ann Lee\n" + bodies["BSD-3-Clause"].replace("1.", "(1)").replace("2.", "(2)").replace("3.", "(3)").replace("disclaimer", "Disclaimer"), "BSD-3-Clause"),
        (5, bodies["Zlib"].replace("acknowledgment", "acknowledgement").replace("\n\n", "\r\n\r\n"), "Zlib"),
        (6, wrapped(bodies["ISC"], 40).replace("\n\n", "\n"), "ISC"),
        (7, wrapped(bodies["Unlicense"]).replace("https", "http").replace("recognize", "recognise"), "Unlicense"),
        (8, mit.replace("free of charge", "for a fee"), None),
        (9, bodies["0BSD"] + " more", None),
    ]
    got = {r.doc_id: r for r in op.scan(frame(spark, [(i, t, "", "", 0) for i, t, _ in some])).collect()}
    assert {i: got[i].licence for i, _, _ in some} == {i: x for i, _, x in some}


def test_a_licence_inside_a_document(spark):
    body = wrapped(dict(op.TEXTS)["BSD-2-Clause"])
    some = [
        (1, "Some program.\n\nIt does things.\n\nCopyright (c) 2020 Ann\n\n" + body + "\n\nMore words."),
        (2, "Words.\n\nThis work is licensed under the GNU General\nPublic License, version 3.\n\nWords."),
        (3, body + "\n\n" + wrapped(dict(op.TEXTS)["MIT"], 60)),
    ]
    got = {r.doc_id: (r.licence, r.n_licence_blocks, r.licences) for r in op.scan(frame(spark, [(i, t, "", "", 0) for i, t in some])).collect()}
    assert got == {1: (None, 1, "BSD-2-Clause"), 2: (None, 1, "GPL-3.0"), 3: (None, 2, "BSD-2-Clause,MIT")}


def test_digests_of_longer_licences(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"GPL-3.0": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    if not all((folder / f).exists() for f in files.values()):
        pytest.skip("no licence texts on this machine")
    texts = {k: (folder / f).read_text() for k, f in files.items()}
    some = [(k, "\n".join(f"  {x} " for x in t.replace("license", "licence").split("\n")) if k != "Apache-2.0" else "\n".join(f"# {x}" for x in t.upper().split("\n"))) for k, t in texts.items()]
    got = op.scan(spark.createDataFrame(some, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {k: k for k in files}
