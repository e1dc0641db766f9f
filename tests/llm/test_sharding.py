from collections import Counter

from conftest import COLUMNS, keeps_extra_columns, odd_rows
from oracle import compare

from dupweave.llm import queries, sharding


def brute_table(shards, slots, seed):
    """Whole permutations, then turns."""
    orders = []
    for i in range(shards):
        offset, skip = sharding._number(f"{seed}:offset:{i}") % slots, sharding._number(f"{seed}:skip:{i}") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    owner, turn = {}, 0
    while len(owner) < slots:
        mine = turn % shards
        owner[next(s for s in orders[mine] if s not in owner)] = mine
        turn += 1
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns():
    for shards, slots in ((1, 2), (3, 13), (7, 101), (5, 5)):
        assert sharding.lookup_table(shards, slots, "x") == brute_table(shards, slots, "x")


def test_shares_differ_by_one_slot_and_few_move():
    a, b = sharding.lookup_table(16, 1601), sharding.lookup_table(17, 1601)
    shares = Counter(a).values()
    assert max(shares) - min(shares) <= 1
    moved = sum(x != y and y != 16 for x, y in zip(a, b, strict=True))
    assert moved < 0.1 * len(a)


def test_query_equals_sql(spark):
    assert compare(spark, queries.op1_sharding, queries.oracle_sql()["op1_sharding"]) == 200


def test_odd_rows(spark, odd, none):
    got = sharding.assign_shards(odd)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and "a.b" in got.columns and [c for c in got.columns if c.lower() in ("slot", "shard")] == ["slot", "shard"]
    assert all(0 <= r.shard < sharding.SHARDS for r in rows) and keeps_extra_columns(rows)
    assert len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert sharding.assign_shards(none).isEmpty() and len(spark.createDataFrame([], COLUMNS).columns) == 35


def test_no_shuffle(docs):
    plan = sharding.assign_shards(docs)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
