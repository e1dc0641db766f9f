import numpy as np
import pytest

from dupweave.functions.tokens import prose_streams
from dupweave.operators import fingerprints, runs
from dupweave.plans import queries

SF = "/root/testdata/sf0.01"


def stored(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def documents_size():
    from pathlib import Path

    found = Path(f"{SF}/documents.parquet")
    return stored(found) if found.is_dir() else found.stat().st_size


def texts(seed=5):
    """Texts of a few words that share passages, some of them equal, some below the bound."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 12, 14)) for _ in range(6)]
    own = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 4000, n))
    made = ["\n".join([own(5), *(passages[x] for x in rng.integers(0, 6, rng.integers(0, 4))), own(3)]) for _ in range(40)]
    made += [made[0]] * 7 + [made[3]] * 2 + ["", None, "a b"]
    return {f"f{i}": t for i, t in enumerate(made)}


def brute(rows, least):
    import pyarrow as pa

    hashes = {k: next(prose_streams(pa.array([t], pa.string()))).hashes for k, t in rows.items()}
    out = []
    for a in rows:
        for b in rows:
            if a < b:
                x, y = hashes[a].tolist(), hashes[b].tolist()
                for i in range(len(x)):
                    for j in range(len(y)):
                        if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                            n = 1
                            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                                n += 1
                            if n >= least:
                                out.append((a, b, i, j, n))
    return sorted(out)


@pytest.mark.parametrize("block, part", [(128, 512), (3, 2)])
@pytest.mark.parametrize("tokens", [False, True])
def test_cross_runs_by_the_definition(spark, monkeypatch, block, part, tokens):
    monkeypatch.setattr(runs, "BLOCK", block)
    monkeypatch.setattr(runs, "PART", part)
    rows = texts()
    files = spark.createDataFrame([(k, "txt", t) for k, t in rows.items()], "file string, format string, text string")
    got = runs.cross_runs(fingerprints.token_table(files) if tokens else files, 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_cross_runs_stores_and_moves_little(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    found = queries.cross_runs(spark, SF)
    assert found.count() and stored(tmp_path) < documents_size()


def test_insert_edit_matches_stores_little(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert queries.insert_edit_matches(spark, SF).count() and stored(tmp_path) < documents_size()


def test_conversation_edits_stores_little(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert queries.conversation_edits(spark, SF).count() and stored(tmp_path) < documents_size()
