"""Queries without SQL against plain Python, on the smallest tables."""

import re
from collections import defaultdict

import pytest
from oracle import SF

from dupweave.functions import constants as C
from dupweave.operators import fingerprints
from dupweave.plans import corpus, queries

TOKEN = re.compile("[A-Za-z0-9_\u0080-\U0010ffff]+|[!-/:-@\\[-^`{-~]")


def tokens(text):
    """(tokens, their lines) of prose."""
    found = [(m, i) for i, line in enumerate((text or "").split("\n"), 1) for m in TOKEN.findall(line)]
    return [t for t, _ in found], [i for _, i in found]


GRAMS = {}


def grams(b, least):
    """Places by run of `least` tokens; kept, with the list that it is of."""
    if (id(b), least) not in GRAMS:
        at = defaultdict(list)
        for j in range(len(b) - least + 1):
            at[tuple(b[j : j + least])].append(j)
        GRAMS[id(b), least] = b, at
    return GRAMS[id(b), least][1]


def shared(a, b, least):
    """Maximal runs (i, j, n) by extending from equal grams."""
    at, out = grams(b, least), []
    if grams(a, least).keys().isdisjoint(at):
        return out
    for i in range(len(a) - least + 1):
        for j in at.get(tuple(a[i : i + least]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = least
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
    return out


def trimmed(lines, i, n):
    end = i + n
    if i and lines[i - 1] == lines[i]:
        inside = sum(1 for k in range(i, end) if lines[k] == lines[i])
        outside = sum(1 for k in range(i) if lines[k] == lines[i])
        i += inside if inside <= outside else 0
    if i < end < len(lines) and lines[end] == lines[end - 1]:
        inside = sum(1 for k in range(i, end) if lines[k] == lines[end - 1])
        outside = sum(1 for k in range(end, len(lines)) if lines[k] == lines[end - 1])
        end -= inside if inside <= outside else 0
    return i, end - i


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_myers_diff_keeps_a_longest_common_part(spark):
    rows = defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id][r.turn] = r.text
    got = queries.myers_diff(spark, SF).collect()
    assert len(got) > 20
    for r in got:
        after, before = (tokens(rows[r.conv_id][t])[0] for t in (r.turn, max(t for t in rows[r.conv_id] if t < r.turn)))
        assert not r.capped and r.n_tokens == len(after) and r.n_kept == lcs(after, before) and r.n_new == len(after) - r.n_kept


def matches_of(after, before, own_file, files, least):
    """Matches of an edit that appends to `before` (None: a new file), by the definitions; files: name -> (tokens, lines)."""
    (new, lines), old = after, before[0] if before else None
    first_new = len(old) if old is not None else 0
    found = []
    for name, (other, other_lines) in files.items():
        if name == own_file:
            continue
        free = [True] * len(other)
        for _, j, n in shared(old, other, least) if old is not None else []:
            free[j : j + n] = [False] * n
        for i, j, n in shared(new, other, least):
            s, k = trimmed(lines, i, n)
            o = j + s - i
            if k >= least and s + k > first_new and sum(free[o : o + k]) >= least:
                found.append((-k, False, name, s, o, k, lines[s], lines[s + k - 1], other_lines[o], other_lines[o + k - 1]))
    covered = [False] * len(new)
    within = lambda t: [(p, q, min(n, q - p)) for p, q, n in shared(t, t, least) if p < q and min(n, q - p) >= least]
    for p, q, n in within(old) if old is not None else []:
        covered[p : p + n] = [True] * n
        covered[q : q + n] = [True] * n
    for p, q, n in within(new):
        i, j = (q, p) if q + n > first_new else (p, q)
        s, k = trimmed(lines, i, n)
        o = j + s - i
        if i + n > first_new and k >= least and s + k > first_new and k - sum(covered[s : s + k]) >= least:
            found.append((-k, True, own_file, s, o, k, lines[s], lines[s + k - 1], lines[o], lines[o + k - 1]))
    kept = []
    for m in sorted(found):
        if not any((min(x[3] + x[5], m[3] + m[5]) - max(x[3], m[3])) * 2 > m[5] for x in kept):
            kept.append(m)
    return sorted((m[6], m[7], m[2], m[8], m[9], m[5]) for m in kept)


def by_edit(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.edit_id].append((r.start_line, r.end_line, r.other_file, r.other_start, r.other_end, r.tokens))
    return {k: sorted(v) for k, v in out.items()}


def test_insert_edits_by_the_definitions(spark):
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    files = {k: tokens(t) for k, t in docs.items()}
    got = by_edit(queries.insert_edit_matches(spark, SF).collect())
    checked = 0
    for name, text in docs.items():
        lines = (text or "").split("\n")
        before = tokens("\n".join(lines[: -(-len(lines) // 2)]))
        # Long texts take plain Python too long.
        if len(files[name][0]) > 900:
            continue
        expected = matches_of(files[name], before, name, files, C.MIN_TOKENS)
        assert got.get(int(name), []) == expected, name
        checked += bool(expected)
    assert checked > 5


def test_conversation_edits_by_the_definitions(spark):
    docs = {str(r.doc_id): tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    edits = corpus.conversation_edits(spark, SF).collect()
    got = by_edit(queries.conversation_edits(spark, SF).collect())
    assert sum(map(len, got.values())) > 5
    for r in edits:
        after, before = tokens(r.after), tokens(r.before) if r.before is not None else None
        if len(after[0]) <= 2500:
            assert got.get(r.edit_id, []) == matches_of(after, before, r.file, docs, queries.PROBE_TOKENS), r.edit_id


def test_self_runs_by_the_definitions(spark):
    pages = {f"page{r.page_id}": tokens(r.html)[0] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = defaultdict(set)
    for r in queries.self_runs(spark, SF).collect():
        got[r.file].add((r.other, r.region, r.len))
    every = 0
    for name, t in pages.items():
        expected = {(p, q, min(n, q - p)) for p, q, n in shared(t, t, 10) if p < q and min(n, q - p) >= 10}
        assert got[name] <= expected
        # All of them where no fingerprint has more places than are paired: none can where no gram has.
        grams = defaultdict(int)
        for i in range(len(t) - 4):
            grams[tuple(t[i : i + 5])] += 1
        if max(grams.values(), default=0) <= C.MAX_SELF_OCCURRENCES:
            assert got[name] == expected
            every += 1
    assert every > 5


@pytest.mark.parametrize("format_", ["markup", "vue", "svelte", "astro", "markdown"])
def test_block_formats_part_their_languages(spark, format_):
    """Separators stand between a file's own text and each block that has tokens; markdown keeps its blocks only."""
    body = "<p>some text {x}</p>\n<script lang=ts>\nlet a = 1 // note\n</script>\n<style>\np { color: red }\n</style>\n<script></script>\n```js\nf(1)\n```\nlast words"
    files = spark.createDataFrame([("f", format_, body), ("g", format_, None), ("h", format_, "only text here")], "file string, format string, text string")
    got = {r.file: (len(r.hashes), [i for i, h in enumerate(r.hashes) if h == C.SEPARATOR]) for r in fingerprints.token_table(files).collect()}
    parts = [b - a - 1 for a, b in zip([-1, *got["f"][1]], [*got["f"][1], got["f"][0]], strict=True)]
    # let a = 1; p { color : red }; f ( 1 )
    assert parts[-3:] == [4, 6, 4] and len(parts) == (3 if format_ == "markdown" else 4)
    assert got["g"] == (0, []) and (got["h"][0] == 0) == (format_ == "markdown")


def test_block_streams_query(spark):
    """Separators are one fewer than the parts with tokens: the page's own text, and each script and style that has any."""
    got = {r.file: r for r in queries.block_streams(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        html = r.html or ""
        bodies = [m[1] for m in re.findall(r"(?is)<(script|style)\b[^>]*>(.*?)</\1\s*>", html)]
        filled = sum(bool(re.sub(r"(?s)//[^\n]*|/\*.*?(\*/|$)", "", b).strip()) for b in bodies)
        assert got[f"page{r.page_id}"].n_separators == filled, r.page_id
