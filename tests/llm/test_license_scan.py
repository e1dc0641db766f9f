import random
import re

from conftest import keeps_extra_columns, odd_rows
from oracle import compare

from dupweave.llm import license_scan as L
from dupweave.llm import queries


def dice(a, b):
    x, y = set(L.bigrams_of(a)), set(L.bigrams_of(b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def planted():
    mit, apache = L.TEMPLATES["mit"], L.TEMPLATES["apache-2.0-notice"]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    return [mit, wrapped, f"Some code.\n\n{wrapped}\n\nmore code here", f"text before\n{apache.upper()}\ntext after", "Released under the MIT License.", "Released under the MIT licence terms", "licensed", "the the the the", " ".join(words[:60])]


def test_planted_licences(spark):
    df = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    got = {r.doc_id: [x.name for x in r.licenses] for r in L.scan_licenses(df).collect()}
    assert got[0] == got[1] == got[2] == ["mit"] and got[3] == ["apache-2.0-notice"] and got[4] == ["mit-notice"] and got[6] == got[7] == got[8] == []
    for i, text in enumerate(planted()):
        units = [*text.split("\n"), *[p for p in text.split("\n\n") if "\n" in p.strip()], text]
        assert got[i] == sorted(n for n, t in L.TEMPLATES.items() if max(dice(u, t) for u in [*units, *windows(text, t)]) >= L.DICE)


def windows(text, template):
    words = re.sub("[^A-Za-z0-9]+", " ", text).split()
    length, step = L.window_words(template)
    return [" ".join(words[k : k + length]) for k in range(0, max(1, len(words) - 1), step)]


def test_licences_within_other_text(spark):
    """Where no line or paragraph is a licence alone."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    mit, header = L.TEMPLATES["mit"], L.TEMPLATES["apache-2.0-header"]
    thirds = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    code = "\n".join(f"int {prose(1)} = {prose(1)};" for _ in range(60))
    comment = "\n".join("# " + " ".join(header.split()[i : i + 10]) for i in range(0, len(header.split()), 10))
    gpl = L.TEMPLATES["gpl-3.0-header"].replace(" This program is distributed", "\n\nThis program is distributed")
    hosts = [("mit", f"{prose(800)}\n\n{thirds}"), ("mit", f"{thirds}\n{code}"), ("apache-2.0-header", f"{comment}\n{code}"), ("gpl-3.0-header", f"{prose(50)}\n\n{gpl}\n\n{prose(50)}"), ("apache-2.0-notice", f"{prose(16)} {L.TEMPLATES['apache-2.0-notice']}"), ("apache-2.0-notice", f"{prose(40)} {L.TEMPLATES['apache-2.0-notice']} {prose(40)}"), ("zlib", f"{prose(300)} {L.TEMPLATES['zlib']} {prose(300)}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(hosts)], "doc_id long, text string")
    got = {x.doc_id: [y.name for y in x.licenses] for x in L.scan_licenses(df).collect()}
    assert all(name in got[i] for i, (name, _) in enumerate(hosts)), got


def test_query_equals_sql(spark):
    assert compare(spark, queries.op6_license_scan, queries.oracle_sql()["op6_license_scan"]) == 200


def test_odd_rows_as_sql(spark, odd, none):
    import duckdb

    rows = [(r[0], r[1]) for r in odd_rows()] + list(enumerate(planted(), 100))
    got = sorted((tuple(r) for r in L.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(L.license_sql()).fetchall(), key=repr)
    assert keeps_extra_columns(L.scan_licenses(odd).collect()) and L.scan_licenses(odd).count() == len(odd_rows()) and L.license_digest(none).isEmpty()


def test_bounds_never_prune_a_match():
    for size in range(1, 200):
        low, high = L.size_bounds(size, L.DICE)
        for other in range(1, 400):
            if 2 * min(size, other) / (size + other) >= L.DICE:
                assert low - 1e-9 <= other <= high + 1e-9


def test_every_match_has_an_anchor():
    sets = {n: L.bigrams_of(t) for n, t in L.TEMPLATES.items()}
    anchors = set(L.anchor_words(sets, L.DICE))
    for own in sets.values():
        bare = [b for b in own if not set(b.split()) & anchors]
        assert len(bare) < L.DICE / (2 - L.DICE) * len(own)


def test_no_python(docs):
    plan = L.license_digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_complete_public_texts(spark):
    """Alone, under a copyright line, and as a paragraph of a longer document."""
    hosts = []
    for name, text in (("bsd-2-clause", BSD_2), ("isc", ISC), ("mit", L.TEMPLATES["mit"])):
        block = "\n".join(line for line in text.split("\n") if line.strip())
        block = block if "\n" in block else block.replace(". ", ".\n")
        hosts += [(name, t) for t in (text, f"Copyright (c) 2020, A Person\n\n{text}", f"# Project\n\nSome words on it.\n\n{block}\n\n" + "And more prose after it. " * 40)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(hosts)], "doc_id long, text string")
    assert all(hosts[r.doc_id][0] in [x.name for x in r.licenses] for r in L.scan_licenses(df).collect())
