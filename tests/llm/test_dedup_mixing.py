"""Exact dedup, SimHash groups and mixing against brute force on small, hostile tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from opsloom.llm import checks, exact_dedup, mixing, queries, simhash
from opsloom.llm.components import star_forest
from tests.llm.conftest import HARD, SMALL

SPACES = " \t\n\x0b\x0c\r"


def strip(text):
    return "".join(c for c in text or "" if c not in SPACES)


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[strip(text)].append((doc_id, text or ""))
    found = []
    for body, members in groups.items():
        most = max(len(t) for _, t in members)
        ids = [d for d, t in members if len(t) == most]
        keep = min((d for d in ids if d is not None), default=None)
        digest = hashlib.sha256(body.encode()).hexdigest()
        found += [(d, keep, len(members), d == keep and len(t) == most, digest) for d, t in members]
    return sorted(found, key=str)


def test_exact_dedup_matches_brute_force(documents):
    got = exact_dedup.dedup_groups(documents(HARD)).drop("key").collect()
    assert sorted(map(tuple, got), key=str) == expected_groups(HARD)


def test_huge_texts_are_hashed_in_parts(documents, monkeypatch):
    """Parts of any size give the same fingerprints, groups and rows."""
    draw = random.Random(3)
    body = "".join(draw.choice("abcdé \n😀") for _ in range(9000))
    rows = [*HARD, (500, body), (500, body), (501, " " + body), (502, body[:-1] + "z"), (503, body[: len(body) // 2] * 2), (504, " " * 5000)]
    want = {r.key: r.print for r in exact_dedup.fingerprints(documents(rows)).collect()}
    monkeypatch.setattr(exact_dedup, "PART", 1000)
    got = exact_dedup.fingerprints(documents(rows)).collect()
    assert len(got) == len(rows) and {r.key: r.print for r in got} == want
    groups = exact_dedup.dedup_groups(documents(rows)).drop("key").collect()
    assert sorted(map(tuple, groups), key=str) == expected_groups(rows)


def test_long_equal_texts_are_compared_in_linear_time(documents):
    end = F.when(F.col("doc_id") == 2, " ").when(F.col("doc_id") == 3, "x").otherwise("")
    docs = documents([(1, ""), (2, ""), (3, "")])
    docs = docs.withColumn("text", F.concat(F.repeat(F.lit("0123456 89"), 1_600_000), end))
    got = exact_dedup.dedup_groups(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_exact_dedup_of_nothing(documents):
    assert exact_dedup.dedup_groups(documents([])).count() == 0


def test_fingerprints_combine(documents):
    data = bytes(random.Random(1).randrange(256) for _ in range(10_000))
    whole = exact_dedup.chunk_hashes(data)
    total = whole[0]
    for part in whole[1:]:
        total = exact_dedup.combine(total, part)
    for cut in (1, 4095, 4096, 5000):
        parts = exact_dedup.chunk_hashes(data[:cut]) + exact_dedup.chunk_hashes(data[cut:])
        again = parts[0]
        for part in parts[1:]:
            again = exact_dedup.combine(again, part)
        assert again == total
    assert exact_dedup.fingerprint(b"\0") != exact_dedup.fingerprint(b"")


def test_equal_fingerprints_with_other_texts_are_told_apart(documents, monkeypatch, spark):
    """With every fingerprint equal, the comparison alone must give the same groups."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "text_fingerprint", lambda c: F.lit("same"))
    got = exact_dedup.dedup_groups(documents(HARD)).drop("key").collect()
    assert sorted(map(tuple, got), key=str) == expected_groups(HARD)


def test_exact_dedup_keeps_one_row_of_each_group(documents):
    kept = exact_dedup.kept_documents(documents(HARD))
    assert kept.columns == documents([]).columns
    texts = [strip(r.text) for r in kept.collect()]
    assert Counter(texts) == Counter({strip(t) for _, t in HARD})


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def check_near_groups(rows, got):
    prints = [brute_simhash(t) for _, t in rows]
    part = brute_components(set(prints))
    least = defaultdict(list)
    for (doc_id, _), p in zip(rows, prints, strict=True):
        least[part[p]].append(doc_id)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    want = [(d, f"{p:016x}", smallest[part[p]]) for (d, _), p in zip(rows, prints, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_simhash_groups_match_brute_force(documents):
    words = [f"w{i}" for i in range(60)]
    draw = random.Random(7)
    base = [draw.choice(words) for _ in range(400)]
    rows = list(HARD)
    for i in range(80):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((100 + i, " ".join(copy)))
    check_near_groups(rows, simhash.near_groups(documents(rows)).drop("key").collect())


def test_simhash_query_matches_brute_force(run, spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_near_groups(rows, run("op4_simhash").collect())


def test_close_fingerprints_are_connected(spark, monkeypatch):
    """Random clusters, with and without the spread over shared neighbours."""
    draw = random.Random(3)
    prints = set()
    for _ in range(6):
        p = draw.getrandbits(64)
        for _ in range(60):
            prints.add(p)
            for _ in range(draw.choice((1, 1, 2, 3))):
                p ^= 1 << draw.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    want = brute_components(set(prints))
    unsigned = lambda x: x & (1 << 64) - 1
    for paired in (1, 8, 1000):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        forest = {unsigned(r.node): unsigned(r.root) for r in star_forest(simhash.close_pairs(frame)).collect()}
        groups, truth = defaultdict(set), defaultdict(set)
        for p in prints:
            groups[forest.get(p, p)].add(p)
            truth[want[p]].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_simhash_of_nothing(documents):
    assert simhash.near_groups(documents([])).count() == 0


def test_simhash_keeps_one_document_of_each_group(documents):
    groups = simhash.near_groups(documents(HARD)).collect()
    assert simhash.kept_documents(documents(HARD)).count() == len({r.component_id for r in groups})


def test_simhash_keeps_components_whose_ids_are_null_or_repeated(documents):
    draw = random.Random(2)
    texts = [" ".join(f"{draw.getrandbits(40):x}" for _ in range(50)) for _ in range(7)]
    ids = [None, None, None, 5, 5, 5, 6]
    rows = [*zip(ids, texts, strict=True), (9, texts[0]), (7, texts[6])]
    kept = simhash.kept_documents(documents(rows)).collect()
    want = [(9, texts[0]), *zip(ids[1:], texts[1:], strict=True)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def duck(sql, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?)", rows)
    return con.execute(sql).fetchall()


def mix_rows():
    draw = random.Random(5)
    rows = [(d, t, "s1") for d, t in HARD if d is not None and "\0" not in (t or "")]
    rows += [(200 + i, "w " * draw.randrange(1, 300), draw.choice(["big", "big", "b", None, "c"])) for i in range(300)]
    return rows + [(900, "", "empty source"), (901, None, "empty source"), (902, "one", "é"), (903, "one", "z")]


def test_mixing_matches_sql(documents):
    rows = mix_rows()
    got = mixing.mixed(documents(rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=str) == sorted(duck(checks.MIXING, rows), key=str)


def test_mixing_with_a_long_tail_matches_sql(documents):
    """Sources far below 64 of the mix's blocks, where the block follows the smallest target."""
    draw = random.Random(9)
    rows = [(i, "w " * 4000, draw.choice("ab")) for i in range(120)]
    rows += [(1000 + i, "w " * draw.randrange(1, 40), f"t{i % 37:02}") for i in range(150)]
    got = mixing.mixed(documents(rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=str) == sorted(duck(checks.MIXING, rows), key=str)


def test_mixing_meets_its_targets(documents):
    got = mixing.mixed(documents(mix_rows())).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 2 for (_, target), taken in by_target.items())
    assert abs(sum(by_target.values()) - 1.5 * sum(r["size"] for r in got)) <= 10


def test_highest_quotients(spark):
    """Quotas are those of handing out the blocks one by one."""
    sizes = {"a": 70_001, "b": 9_999, "c": 321, "d": 17, "e": 3}
    goals = [(s, n, 1.5 * n, sum(sizes.values())) for s, n in sizes.items()]
    frame = spark.createDataFrame(goals, "source string, source_size long, target double, all_words long")
    got = {r.source: r.quota for r in mixing.quotas(frame).collect()}
    total = sum(sizes.values())
    block = max(1, -(-int(total * 1.5) // mixing.BLOCKS))
    seats = Counter()
    for _ in range(int(1.5 * total / block + 0.5)):
        best = max(sizes, key=lambda s: (1.5 * sizes[s] / (seats[s] + 0.5), [-ord(s)]))
        seats[best] += 1
    assert got == {s: min(seats[s] * block, 2 * n) for s, n in sizes.items()}


def test_small_sources_of_a_large_mix_meet_their_targets(spark):
    """Two sources hold nearly all words; the block follows the long tail, not the mix."""
    sizes = {"a": 3_000_000_000, "b": 1_900_000_000} | {f"t{i:03}": 1_000 + 211 * i for i in range(200)}
    frame = spark.createDataFrame(sizes.items(), "source string, source_size long")
    goals = {r.source: r for r in mixing.quotas(mixing.targets(frame)).collect()}
    assert set(goals) == set(sizes)
    for r in goals.values():
        assert abs(r.quota - r.target) <= max(2, r.target / 50)
    assert abs(sum(r.quota for r in goals.values()) - 1.5 * sum(sizes.values())) <= 1_000_000


def test_mixing_of_nothing(documents):
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).columns == documents([]).columns


def test_mixed_documents_repeat_rows(documents):
    rows = mix_rows()
    taken = {r.doc_id: r for r in mixing.mixed(documents(rows)).collect()}
    copies = Counter(r.doc_id for r in mixing.mixed_documents(documents(rows)).collect())
    for doc_id, r in taken.items():
        if doc_id != 13 and r["size"]:
            assert copies[doc_id] == int(r.taken / r["size"] + 0.5)


def test_mixing_runs_without_python(documents):
    plan = mixing.mixed(documents(mix_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_check_names_a_query():
    assert set(queries.CHECKS) <= set(queries.QUERIES)
