import numpy as np
import pytest

from dupweave.operators import matches, runs

PASSAGE = " ".join(f"p{i}" for i in range(24))


def test_an_edit_meets_all_places_of_a_passage(spark):
    """As many as 140 copies of a passage in one file: all but the first are reported, each against the first."""
    after = "\n".join(f"{PASSAGE}\nu{i} v{i}" for i in range(140))
    edits = spark.createDataFrame([(1, "f", "txt", None, "absent", None, after)], "edit_id long, file string, format string, before string, before_kind string, before_path string, after string")
    files = spark.createDataFrame([], "file string, format string, text string")
    got = sorted((r.start_line, r.other_file, r.other_start, r.tokens) for r in matches.new_duplicates(edits, files, 20, 1).collect())
    assert got == [(2 * i + 1, "f", 1, 24) for i in range(1, 140)]


@pytest.mark.parametrize("at_once", [7, 1 << 22])
def test_all_self_runs_by_diagonals(monkeypatch, at_once):
    monkeypatch.setattr(runs, "MATCHES", at_once)
    rng = np.random.default_rng(3)
    for case in range(60):
        tokens = rng.integers(case % 2, rng.integers(2, 6), rng.integers(0, 120)).astype(np.int64)
        tokens = np.tile(tokens[: len(tokens) // 5 + 1], 6) if case % 3 == 0 else tokens
        expected = sorted((p, p + s, min(n, s)) for s in range(4, len(tokens)) for p, n in runs.islands(tokens, tokens, s, 4))
        assert runs.self_runs_of(tokens, 4) == expected
