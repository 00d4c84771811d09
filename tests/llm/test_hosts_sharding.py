import collections
import zlib

import duckdb
import fixtures
import pytest

from textloom.llm import hosts, sharding


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_are_those_of_the_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(hosts.OP2_SQL)
    got = hosts.op2_host_reputation(spark, d)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_bad_hosts_are_blocked_and_odd_urls_are_fine(spark):
    rows = [(i, "http://bad.example.org/x") for i in range(40)] + [(100 + i, f"https://H{i % 4}.example.org/a?b") for i in range(60)]
    odd = [(200, None), (201, "no scheme"), (202, "x://"), (203, "http://a.co.uk"), (204, "ftp://H.example.COM/en/7#e"), (205, "http://net/de/1"), (None, "http://com/en/"), (206, "http://a.b.example.net/de/85"), (206, "http://xcom/en/")]
    pages = spark.createDataFrame(rows + odd, "page_id long, url string").selectExpr("*", "1 as host", "2 as n", "3 as x", "4 as mean")
    labels = spark.createDataFrame([(i, True) for i in range(40)] + [(100 + i, i == 0) for i in range(60)] + [(None, True), (3, None)], "id long, bad boolean")
    got = {(r.page_id, r.host): r for r in hosts.judge(pages, labels).collect()}
    assert got[(1, "bad.example.org")].verdict == "block" and got[(101, "h1.example.org")].verdict == "allow"
    assert got[(200, "")].path == "" and got[(201, "")].verdict == "allow" and got[(202, "")].rule is None
    assert got[(204, "h.example.com")].rule == "example.com/en/7" and got[(205, "net")].rule == "net/de/"
    assert got[(None, "com")].verdict == "block" and got[(206, "a.b.example.net")].rule == "example.net/de/8" and got[(206, "xcom")].rule is None
    assert hosts.judge(pages.limit(0), labels.limit(0)).collect() == []
    assert hosts.judge(pages, labels.limit(0)).where("rule is null and verdict = 'block'").isEmpty()


def test_sharding(spark):
    docs = fixtures.rows(3, 200) + [(5000 + i, "x") for i in range(3000)]
    shards = sharding.tree(24)
    rows = sharding.assign(fixtures.frame(spark, docs), shards, then=sharding.grown(shards)).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    for s, slots in collections.defaultdict(list, {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}).items():
        assert slots == list(range(len(slots))) and 60 < len(slots) < 220
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {24} and 60 < len(moved) < 220
    assert sharding.assign(fixtures.frame(spark, []).limit(0), shards).collect() == []


def test_movement_stays_in_the_subtree(spark):
    old = sharding.tree(24)
    new = [s._replace(weight=3.0) if s.shard == 5 else s for s in old]
    ids = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    both = ids.select(sharding.placed(ids.doc_id, old).alias("a"), sharding.placed(ids.doc_id, new).alias("b")).where("a <> b").collect()
    region = {s.shard: s.region for s in old}
    assert both and all(region[r.b] == region[5] for r in both)
    assert all(r.b == 5 or region[r.a] != region[5] or r.b // 4 == 1 for r in both)


def verdicts(spark, rows, bad):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(bad, "id long, bad boolean")
    return hosts.judge(pages, labels)


def test_few_labels_block_nothing(spark):
    rows = [(i, f"http://h{i % 7}.example{i % 3}.com/x") for i in range(60)] + [(100, None)]
    for bad in ([], [(3, True)], [(3, True), (4, True)], [(3, False)], [(3, True), (10, True)]):
        got = verdicts(spark, rows, bad).collect()
        assert {r.verdict for r in got} == {"allow"} and len(got) == 61
        assert all(0 < r.bad_share < 1 and 0 <= r.risk <= 1 for r in got)


def test_hosts_are_judged_by_their_own_pages_and_their_domain(spark):
    rows = [(i, f"http://h{i % 40}.{'spam' if i % 40 < 20 else 'fine'}.com/x") for i in range(1600)] + [(5000, "http://new.spam.com/"), (5001, "http://new.fine.com/"), (5002, "http://spam.com/")]
    bad = [(i, i % 40 < 20 and i % 10 < 8) for i in range(1600) if i % 2]
    got = {r.host: r for r in verdicts(spark, rows, bad).collect()}
    assert got["h3.spam.com"].verdict == "block" and got["h30.fine.com"].verdict == "allow"
    assert got["new.spam.com"].bad_share > 0.5 > got["new.fine.com"].bad_share and got["new.fine.com"].verdict == "allow"


def test_the_chance_below_is_that_of_the_beta_distribution():
    import math

    import numpy as np

    for x, a, b in [(0.5, 2, 2), (0.2, 0.3, 5), (0.9, 50, 10), (0.3, 30, 80), (0.01, 1.5, 1.5), (0.0, 2, 3), (1.0, 2, 3), (0.24, 300, 900)]:
        u = (np.arange(400_000) + 0.5) / 400_000
        y, weight = (u ** (1 / a), (1 - u ** (1 / a)) ** (b - 1)) if a < 1 else (u, np.exp((a - 1) * np.log(u) + (b - 1) * np.log1p(-u) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)))
        part, whole = weight[y < x].sum(), weight.sum()
        assert abs(hosts.beta_below(np.array([x]), np.array([a]), np.array([b]))[0] - part / whole) < 1e-3


def test_many_rules_give_the_verdicts_of_few(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(["http://com/en/", "http://a.example.com/en/7x", "http://b.example.net/de/85", "http://net/de/", "http://x.org/es/", "http://xorg/es/", None, "http://example.com/en/8", "http://net./de/1"])]
    rules = [*hosts.RULES, hosts.Rule("allow", "com", "/en/"), hosts.Rule("block", "a.example.com", "/e")]
    keep = lambda: sorted(map(repr, hosts.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "id long, bad boolean"), rules=rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    few = keep()
    monkeypatch.setattr(hosts, "PLAN_RULES", 0)
    assert keep() == few


def test_placements_one_by_one(spark):
    """Every draw again in Python: by region, rack and shard, the least -ln(u) / weight of a hash of key and path."""
    import hashlib
    import math

    shards = [s._replace(weight=1.0 + s.shard % 3) for s in sharding.tree(24)] + [sharding.Shard("lone", "r", 90, 2.5), sharding.Shard("lone", "r", 91, 0.0)]

    def place(key):
        members, path = [s for s in shards if s.weight > 0], ""
        for level in range(3):
            names = list(dict.fromkeys(str(m[level]) for m in members))
            if len(names) > 1:
                def draw(name):
                    digest = hashlib.md5(f"{key}{path}/{name}".encode()).hexdigest()
                    return -math.log((int(digest[:13], 16) + 0.5) / 2**52) / sum(m.weight for m in members if str(m[level]) == name)
                name = min(names, key=draw)
            else:
                name = names[0]
            members, path = [m for m in members if str(m[level]) == name], f"{path}/{name}"
        return members[0].shard

    ids = [*range(-200, 2000), 2**63 - 1, None]
    frame = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.assign(frame, shards).collect()}
    assert got == {i: place("" if i is None else i) for i in ids} and 91 not in got.values()


def test_sharding_is_that_of_the_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(sharding.OP3_SQL)
    got = sharding.op3_hash_tree_sharding(spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
