from provisor.llm.licenses import scan
from tests.llm.helpers import corpus, frame, row

CASES = {
    "Released under the MIT license, or licensed under the Apache License, Version 2.0": ["apache-2.0", "mit"],
    "Licensed under the MIT license or the Apache License, Version 2.0.": ["apache-2.0", "mit"],
    "Licensed under the GNU General Public License version 2 or version 3.": ["gpl-2.0", "gpl-3.0"],
    "Licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
    "Licensed under the GNU Affero General Public License, version 3.": ["agpl-3.0"],
    "Licensed under the GNU Lesser General Public License version 3.": ["lgpl"],
    "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["cc-by-nc"],
    "Licensed under a Creative Commons\nAttribution 4.0 International License": ["cc-by"],
    "Some text stands here\nand goes on. Licensed under a Creative Commons\nAttribution 4.0 International License\nand more text follows it": ["cc-by"],
    "Released under the MIT License.\nReleased under the MIT License.": ["mit"],
    "Licensed under a Creative Commons\n\nAttribution 4.0 International License": [],
    "She lost her license\nand the public\nwas reserved under the terms": [],
}


def test_every_family_of_a_paragraph_and_wrapped_notices(spark):
    rows = [row(1000 + i, text) for i, text in enumerate(CASES)]
    got = {r.doc_id: r for r in scan(frame(spark, rows + corpus(n=12))).collect()}
    assert {text: got[1000 + i].families for i, text in enumerate(CASES)} == CASES
    lines = {i: [n.paragraph for n in got[1000 + i].notices] for i in range(len(CASES))}
    assert lines[7] == [0] and lines[8] == [1] and lines[9] == [0, 1]


def test_another_licence_of_the_same_wording_is_no_notice(spark):
    rows = [row(1, "Licensed under the Eclipse Public License, version 2.0."), row(2, "Released under the ISC License."),
            row(3, "Licensed under the Mozilla Public License, version 2.0.")]
    assert {r.doc_id: r.families for r in scan(frame(spark, rows)).collect()} == {1: [], 2: [], 3: ["mpl-2.0"]}
