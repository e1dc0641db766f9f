import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dupweave.functions import constants as C
from dupweave.functions import tokens
from dupweave.functions.tokens import code_stream, prose_streams
from dupweave.operators import fingerprints, runs
from dupweave.operators.diff import diff_tokens
from dupweave.operators.matches import Edit, trim_partial_lines

streams = st.lists(st.integers(0, 3), max_size=60).map(lambda x: np.array(x, np.int64))


def brute_runs(a, b, least):
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j] or a[i] == 0 or (i and j and a[i - 1] == b[j - 1] and a[i - 1] != 0):
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] != 0:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


@given(streams, streams, st.integers(2, 6))
@settings(max_examples=200, deadline=None)
def test_common_runs_are_all_maximal_runs(a, b, least):
    assert set(runs.common_runs(a, b, least)) == brute_runs(a, b, least)


@given(streams, st.integers(2, 8))
@settings(max_examples=200, deadline=None)
def test_self_runs_are_clipped_maximal_runs(a, least):
    expected = {(p, q, min(n, q - p)) for p, q, n in brute_runs(a, a, least) if p < q and min(n, q - p) >= least}
    assert set(runs.self_runs_of(a, least)) == expected


@given(streams, st.integers(1, 4), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_winnow_takes_the_rightmost_least_gram_of_each_window(a, k, w):
    grams = fingerprints.gram_hashes(a, k).tolist()
    expected = sorted({max(i for i in range(s, s + w) if grams[i] == min(grams[s : s + w])) for s in range(len(grams) - w + 1)})
    expected = [i for i in expected if grams[i] != int(fingerprints.NONE)]
    assert fingerprints.winnow(a, k, w)[1].tolist() == expected


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


@given(streams, streams)
@settings(max_examples=300, deadline=None)
def test_diff_is_a_shortest_script(after, before):
    d = diff_tokens(after, before)
    kept = d.target[d.target >= 0]
    assert (np.diff(kept) > 0).all() and not d.is_new[kept].any() and len(kept) + d.is_new.sum() == len(after)
    assert (after[kept] == before[d.target >= 0]).all()
    lead = 0
    while lead < min(len(after), len(before)) and after[lead] == before[lead]:
        lead += 1
    # Equal ends are taken first, which never makes a script longer.
    assert d.is_new.sum() + (d.target < 0).sum() == distance(after, before)
    assert (d.target[:lead] == np.arange(lead)).all()


def test_diff_is_capped():
    rng = random.Random(1)
    a, b = (np.array([rng.randrange(10**6) for _ in range(700)]) for _ in range(2))
    d = diff_tokens(a, b)
    assert d.capped and d.is_new.all() and (d.target < 0).all()
    assert not diff_tokens(a, a[:0]).capped and diff_tokens(a[:0], a).is_new.sum() == 0


def test_prose_tokens_and_lines():
    a, b, c = prose_streams(pa.array(["Hello, été x_1\n\nnext", None, "Hello"]))
    assert a.start_lines.tolist() == [1, 1, 1, 1, 3] and len(b.hashes) == 0 and c.hashes[0] == a.hashes[0]


def test_comments_and_layout_do_not_count():
    a = code_stream("int x = 1; // note\nreturn x;", "c")
    b = code_stream("int   x=1;\n/* more\n */ return x ;", "c")
    assert a.hashes.tolist() == b.hashes.tolist() and b.start_lines.tolist()[-1] == 3
    assert code_stream("x = 'a # b'  # c", "python").hashes.tolist() == code_stream("x='a # b'", "python").hashes.tolist()
    assert code_stream("1", "c").hashes[0] != code_stream("'1'", "c").hashes[0]


@pytest.mark.parametrize(("format_", "mark"), [("python", "#"), ("sql", "--"), ("clojure", ";"), ("erlang", "%"), ("fortran", "!"), ("vbnet", "'"), ("zig", "//")])
def test_line_comments_by_family(format_, mark):
    assert code_stream(f"a b {mark} note, and more\nc", format_).hashes.tolist() == code_stream("a b\nc", format_).hashes.tolist()


def test_block_formats_have_separators():
    s = code_stream("<p>a</p>\n<script>\nlet x\n</script><style>p{}</style>", "vue")
    assert (s.hashes == C.SEPARATOR).sum() == 2 and s.hashes[0] and s.hashes[-1] and (np.diff(s.start_lines[s.hashes != 0][-8:]) >= 0).any()
    assert len(code_stream("just text", "markdown").hashes) == 0 and len(code_stream(None, "c").hashes) == 0


def trim_brute(starts, ends, first, n):
    """The rule in plain words, token by token."""
    end = first + n
    if first and ends[first - 1] == starts[first]:
        line = starts[first]
        inside = next((i for i in range(first, end) if starts[i] != line), end) - first
        outside = first - next((i + 1 for i in range(first - 1, -1, -1) if ends[i] != line), 0)
        first += inside if inside <= outside else 0
    if first < end < len(starts) and starts[end] == ends[end - 1]:
        line = ends[end - 1]
        inside = end - next((i + 1 for i in range(end - 1, first - 1, -1) if ends[i] != line), first)
        outside = next((i for i in range(end, len(starts)) if starts[i] != line), len(starts)) - end
        end -= inside if inside <= outside else 0
    return first, end - first


@given(st.lists(st.integers(0, 1), min_size=2, max_size=25), st.data())
@settings(max_examples=200, deadline=None)
def test_trimming(steps, data):
    lines = np.cumsum(steps) + 1
    first = data.draw(st.integers(0, len(lines) - 1))
    n = data.draw(st.integers(1, len(lines) - first))
    assert trim_partial_lines(lines, lines, first, n) == trim_brute(lines.tolist(), lines.tolist(), first, n)


# Scenarios of edits. Functions are made of distinct words, so nothing matches by accident.
def function(name, lines, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    return [f"function {name}({word()}, {word()}) {{", *[f"  const {word()} = {word()}({word()});" for _ in range(lines - 2)], "}"]


SUM, PARSE, RENDER, RETRY = function("summarize", 20, 1), function("parse", 8, 2), function("render", 8, 3), function("retry", 12, 4)
A = ["const VERSION = 3;", "", *SUM, "", *PARSE]


def ts(lines):
    return code_stream("\n".join(lines), "typescript")


def check(after, before=None, other=None):
    """(cross runs against `other`, own runs) with line numbers."""
    s = ts(after)
    e = Edit(s.hashes, s.start_lines, s.end_lines, None if before is None else ts(before).hashes, 50, 5)
    lines = lambda t, at, n: (int(t.start_lines[at]), int(t.end_lines[at + n - 1]))
    o = ts(other) if other else None
    cross = [(lines(s, r, n), lines(o, p, n)) for r, p, n in e.cross(o.hashes)] if o else []
    return cross, [(lines(s, r, n), lines(s, p, n)) for r, p, n in e.own()]


def test_a_copied_function_in_a_new_file():
    assert check([*SUM, "", "call(x);"], None, A) == ([((1, 20), (3, 22))], [])


def test_an_inserted_copy():
    c = [*RENDER, "", *RETRY]
    (cross, own) = check([*RENDER, "", *SUM, "", *RETRY], c, A)
    assert cross == [((10, 29), (3, 22))] and not own


def test_edits_elsewhere_or_within_an_old_copy_are_silent():
    d = [*RETRY, "", *SUM, "", *RENDER]
    assert check([*RETRY[:3], "  other();", *RETRY[3:], "", *SUM, "", *RENDER], d, A) == ([], [])
    assert check([*RETRY, "", *SUM[:9], "  const changed = 1;", *SUM[10:], "", *RENDER], d, A) == ([], [])


def test_coming_together_again_is_silent():
    apart = [*RETRY, "", *SUM[:9], "  const other = 2;", *SUM[10:]]
    assert check([*RETRY, "", *SUM], apart, A) == ([], [])


def test_copies_within_a_file():
    again = [SUM[0].replace("summarize", "again"), *SUM[1:]]
    e = [*SUM, "", *RENDER]
    assert check([*e, "", *again], e)[1] == [((31, 50), (1, 20))] or check([*e, "", *again], e)[1] == [((32, 50), (2, 20))]
    both = [*e, "", *again]
    assert check([*RETRY, "", *both], both)[1] == []


def test_thresholds_and_deletions():
    assert check(["x;", *SUM[:6]], None, A)[0] == []
    assert check(["x;", " ".join(SUM)], None, A)[0] == []
    d = [*RETRY, "", *SUM, "", *RENDER]
    assert check([*RETRY, *d[len(RETRY) + 6 :]], d, A) == ([], [])


def test_layout_and_comments_do_not_hide_a_copy():
    loose = [x for i, line in enumerate(SUM) for x in (["  // why", line.replace(" = ", "   =  ") + " /* in */"] if i % 5 == 2 else [line])]
    assert check(["let y = 2;", *loose], None, A)[0] == [((2, 1 + len(loose)), (3, 22))]


@pytest.mark.parametrize("new", [False, True])
def test_rewrites_beyond_the_diffs_bound(new):
    lots = lambda side, t: [f'let {side}Label{i}: string = "{side}-{i}";' if t else f"const {side}Count{i} = {i};" for i in range(150)]
    pair = [*SUM, "", *RENDER, "", SUM[0].replace("summarize", "again"), *SUM[1:]]
    around = lambda t, middle: [*lots("top", t), "", *middle, "", *lots("bottom", t)]
    extra = ["", *RETRY, "", RETRY[0].replace("retry", "anew"), *RETRY[1:]] if new else []
    own = check(around(True, [*pair, *extra]), around(False, pair))[1]
    at = 150 + 2 + len(pair) + 1
    fresh = [(r, o) for r, o in own if r[0] >= at]
    assert own == fresh and len(fresh) == (1 if new else 0)


def lexed_by_definition(text, format_):
    """(hash, first line, last line) of each token, match by match."""
    kinds = {"comment": tokens._FAMILY.get(format_, tokens._C_COMMENT), "string": tokens._TEXT, "number": r"\d[\w.]*", "word": r"\w+", "mark": r"[^\w\s]"}
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items()), re.S)
    for m in pattern.finditer(text):
        if m.lastgroup != "comment":
            first = text.count("\n", 0, m.start())
            yield tokens.token_hash(m.lastgroup, m.group()), first, first + m.group().count("\n")


@pytest.mark.parametrize("format_", ["typescript", *(names.split()[0] for names in tokens._COMMENTS.values())])
def test_code_tokens_by_definition(format_, monkeypatch):
    monkeypatch.setattr(tokens, "LEXICON_BYTES", 20_000)
    pieces = ["/*", "*/", "//", "#", "--", "<!--", "-->", ";", "%", "!", "'", '"', "`", '"""', "'''", "\\", "(*", "*)", "\n", "\r\n", "\n\n  ", " ", "\t", "a1", "été", "1.5e", "=", "٣x", "\u2028", "名"]
    draw = random.Random(7)
    for _ in range(400):
        text = "".join(draw.choices(pieces, k=draw.randrange(40)))
        assert [tuple(row) for row in tokens._lex(text, 0, format_).T] == list(lexed_by_definition(text, format_))


def test_streams_keep_the_order_of_code_and_prose():
    texts = pa.array(["a b", "x = 1 // y", None, None, "c", ""])
    formats = [None, "typescript", "typescript", None, "txt", "python"]
    found = [len(s.hashes) for s in tokens.streams(texts, formats)]
    assert found == [2, 3, 0, 0, 1, 0]
