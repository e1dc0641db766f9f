import numpy as np
import pyarrow as pa
from test_moved import SF, texts

from dupweave.operators import matches, runs
from dupweave.plans import corpus, queries


def test_edits_and_files_make_no_table_of_pairs(spark):
    """Each edit and file of a large group is one row, and goes to blocks; their pairs, which grow with the square, are no rows."""
    edits = corpus.conversation_edits(spark, SF)
    files = corpus.document_files(spark, SF)
    plan = matches.candidates(edits, files, queries.PROBE_TOKENS, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "other_fp" not in plan and "partners" not in plan
    assert plan.count("unknown") == 0  # what can't be isn't joined


def test_edits_and_files_meet_in_blocks_as_in_one(spark, monkeypatch):
    """Also files of one content, and an edit of a file that others equal."""
    rows, later = texts(), texts(6)
    files = spark.createDataFrame([(k, "txt", t) for k, t in rows.items()], "file string, format string, text string")
    made = [(i, k, "txt", rows[k] if i % 3 else None, ("absent", "content", "unknown")[i % 3], None, f"{rows[k] or ''}\n{t or ''}") for i, (k, t) in enumerate(later.items())]
    edits = spark.createDataFrame(made, "edit_id long, file string, format string, before string, before_kind string, before_path string, after string")
    found = []
    for block in (128, 3):
        monkeypatch.setattr(runs, "BLOCK", block)
        found.append(sorted(tuple(r) for r in matches.new_duplicates(edits, files, 10, 1, lambda df: df.localCheckpoint()).collect()))
    plain = sorted(tuple(r) for r in matches.new_duplicates(edits, files, 10, 1).collect())
    assert len(plain) > 15 and found == [plain, plain]


def test_packed_parts_come_back():
    for parts in ([b"ab" * 50, b"ab" * 40, None], [b"", None, np.arange(3).tobytes()], [None], [b""]):
        assert matches.unpacked(matches.packed(parts)) == parts
    assert [matches.unpacked(x) for x in matches.packed_texts(pa.array(["a", None])).to_pylist()] == [[b"a"], [None]]
