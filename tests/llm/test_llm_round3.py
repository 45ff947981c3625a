"""Mixing, Merkle manifest and prefix trie: against SQL, plain versions and
awkward rows."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from geomart.llm import decontam, linededup, merkle, mixing, ngramjoin, trie
from geomart.llm.positions import positions

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, `a.b` int, path string"
LONG = " ".join(f"W{i % 977}" for i in range(60_000))
ROWS = [
    (5, "One two", "en", "b", 7), (3, None, "en", "b", None), (4, "", None, None, 0), (1, "ÀB c\nD", "de", "a", 6), (1, "other text", "de", "a", 10), (2, "x  y\tz", None, "a", 6),
    (2, "x  y\tz", None, "a", 6), (None, "no id", "en", "c", 5), (9, LONG, "en", "c", len(LONG)), (7, "q", "fr", None, 1), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100 + i, " ".join(f"Word{j}" for j in range(i % 23)), "en" if i % 3 else "es", f"s{i % 4}", i) for i in range(150)]
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in [*ROWS, *more]], DOC).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", ["op11_mix_sources", "op12_merkle_manifest", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = E.queries()[name](spark, sf_small).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_positions_number_every_group_over_many_partitions(spark):
    rows = [(None if i % 7 == 0 else f"g{i % 3 if i % 2 else 0}", i * 37 % 101) for i in range(900)] + [("hot", i) for i in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = positions(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")], "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r["pos"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for x, v in rows if x == g)


# 11 -------------------------------------------------------------------------
def _targets(sizes, weights, most):
    """Resharing round by round, as the contract tells it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
        for s in list(free):
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("weights, most", [((1, 2, 3), 3), ((1,), 1), ((5, 1, 1, 40), 2)])
def test_mix_meets_its_targets(spark, docs, weights, most):
    mixed = mixing.mix_sources(docs, keep=["doc_id", "source", "lang", "a.b", "size"], weights=weights, most=most)
    assert mixed.columns == ["doc_id", "source", "lang", "a.b", *mixing.ADDED]
    got = mixed.collect()
    rows = [(r["doc_id"], r["source"], len(re.findall(mixing.WORD, r["text"] or ""))) for r in docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.source, r["size"]) for r in got])) == sorted(map(repr, rows))
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = _targets(sizes, weights, most)
    assert math.isclose(sum(want.values()), sum(sizes.values()), rel_tol=1e-9)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(r.taken == r.copies * r["size"] and math.floor(rate - 1e-6) <= r.copies <= min(most, math.ceil(rate + 1e-6)) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r["size"] for r in mine)
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) <= 1
    again = mixing.mix_sources(docs.repartition(3), keep=["doc_id", "source", "lang", "a.b", "size"], weights=weights, most=most)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_mix_emits_whole_documents(spark, docs, none):
    mixed = mixing.mix_sources(docs, keep=docs.columns)
    out = mixing.emitted(mixed)
    assert {"text", "lang", "copy"} <= set(out.columns)
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert mixing.mix_sources(none).count() == 0


# 12 -------------------------------------------------------------------------
def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def _tree(leaves, arity):
    """Root and, per leaf, the siblings ``(before, after)`` level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            a = at[i] // arity * arity
            p.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + arity])))
        nodes, at = [_h(*nodes[a : a + arity]) for a in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], paths


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest_equals_plain_trees(spark, docs, none, arity):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    change = {"text": F.when(chosen, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    got = merkle.manifest(docs, change, arity=arity).withColumn("proof", F.sha2(merkle.proof_text(), 256)).drop("path").collect()
    rows = [r.asDict() for r in docs.collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        bad = r["text"].translate(lower) if hit and r["text"] is not None else r["text"]
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]), _leaf(r, bad)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    root, tops = _tree([trees[g][0] for g in names], arity)
    want = []
    for g, top in zip(names, tops):
        for (has, i, leaf, bad), path in zip(sorted(groups[g]), trees[g][1]):
            fold = bad
            for before, after in [*path, *top]:
                fold = _h(before, fold, after)
            want.append((i if has else None, g, leaf, trees[g][0], root, fold, _h(*itertools.chain(*path, *top))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert 0 < sum(w[5] != root for w in want) < len(want)
    assert merkle.manifest(none, change, arity=arity).count() == 0


def test_a_lone_leaf_is_the_root(spark):
    one = spark.createDataFrame([(4, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.manifest(one, {}).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.path == []


# 13 -------------------------------------------------------------------------
CONV = "conv_id long, turn long, role string, text string, conv string"


def _talks():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 90), 203, 204, 2_000_000, -7, -40]:
        if c in (60, 33):
            continue
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {rng.integers(0, 2)}" if t < 3 else f"long talk {rng.integers(0, 3)} x"))
    rows += [(61, t, "user", f"step {t}") for t in range(20, 320)]
    rows += [(500, None, None, None), (500, 1, "user", ""), (500, 0, "", "a b"), (None, 0, "user", "nobody"), (61, 25, "user", "step 25"), (501, 0, "user", LONG)]
    return [(*r, "clash") for r in rows]


def _rebuilt(rows):
    talks = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()[:16]))] for c, ts in talks.items()}
    out = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(talks.get(c - int(math.fmod(c, 20)), [])[:h] + talks[c][h:])
    return out


def _plain_trie(talks):
    members = {}
    for c, ts in talks.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    rows = []
    for node, cs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        kids = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in under)]
        saved = sum((len(members[m]) - 1) * len(re.findall(mixing.WORD, m[-1][1])) for m in under if m)
        ends = ",".join(map(str, sorted(c for c in cs if talks[c] == node)))
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("unit, slab, most", [(None, trie.SLAB, trie.QUEUE_MESSAGES), (5, 7, 3), (0, 50, 1), (10_000, 2, 2)])
def test_trie_equals_plain_version(spark, unit, slab, most):
    from geomart.llm.queries import rebuilt_conversations

    rows = _talks()
    turns, members = rebuilt_conversations(spark.createDataFrame(rows, CONV).repartition(4))
    got = trie.prefix_trie(turns, members, unit=unit, slab=slab, most=most).drop("key", "parent").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain_trie(_rebuilt(rows))))


def test_conversations_cut_by_many_partitions_and_none(spark):
    from geomart.llm.queries import rebuilt_conversations

    rows = [(c, t, "user", f"turn {t if t < 150 else (t, c)}", "x") for c in (1, 2, 3) for t in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        turns, members = rebuilt_conversations(spark.createDataFrame(rows, CONV))
        got = trie.prefix_trie(turns, members, slab=32).drop("key", "parent").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain_trie(_rebuilt(rows))))
    turns, members = rebuilt_conversations(spark.createDataFrame([], CONV))
    assert trie.prefix_trie(turns, members).count() == 0
    # Members without any turn are members of the root alone.
    turns, members = rebuilt_conversations(spark.createDataFrame([(31, 0, "user", "a", "x"), (33, 0, "user", "a", "x")], CONV))
    got = trie.prefix_trie(turns, members).drop("key", "parent").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain_trie(_rebuilt([(31, 0, "user", "a", ""), (33, 0, "user", "a", "")]))))


def test_queue_gives_messages_in_order_from_spilled_runs():
    rng = np.random.default_rng(5)
    queue, want = trie.SpillingQueue(4), {}
    for i in range(200):
        k = (int(rng.integers(0, 20)), b"k")
        queue.push(k, (i, i))
        want.setdefault(k, []).append((i, i))
    for k in sorted(want):
        assert sorted(queue.take(k)) == sorted(want[k])


# 5, 8, 2: what changed ----------------------------------------------------------
def test_line_passages_equal_plain_version(spark):
    rng = np.random.default_rng(21)
    lines = [f"line {i}" for i in range(30)] + ["", "é ü", "x"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 14)))) for i in range(120)]
    rows += [(200 + i, "\n".join([f"own {i}", *[f"long {j}" for j in range(25)], f"end {i}"])) for i in range(20)]
    rows += [(400, "\n".join(["x"] * 9)), (401, "\n".join(["x"] * 4)), (402, "\n" * 6), (403, "a\nb\nc\na\nb\nc\na\nb"), (404, None), (405, ""), (406, LONG + "\n" + LONG), (407, "k\n" + LONG + "\n" + LONG)]
    first, want = {}, {}
    for i, t in rows:
        for k, pair in enumerate(itertools.pairwise((t or "").split("\n"))):
            first.setdefault(pair, (i, k))
    for i, t in rows:
        gone = set()
        for k, pair in enumerate(itertools.pairwise((t or "").split("\n"))):
            if first[pair] not in ((i, k), (i, k - 1)):
                gone |= {k, k + 1}
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone))
    docs = spark.createDataFrame([(i, t, 9, "a") for i, t in rows], "doc_id long, text string, n_removed_lines int, `x.y` string").repartition(6)
    out = linededup.remove_repeated_passages(docs)
    assert out.columns == ["doc_id", "text", "x.y", "n_lines", "n_removed_lines"]
    assert {r.doc_id: (r.text, r.n_removed_lines) for r in out.collect()} == want
    assert sum(n for _, n in want.values()) > 500


def test_lines_that_went_by_a_shared_hash_come_back():
    import pandas as pd

    unit = lambda line, body, h, gone=True: {"line": line, "n": body.count(b"\n") + 1, "h": h, "gone": gone, "body": body}
    cut = pd.DataFrame({"text": ["a\nf", None, "x"], "n_lines": [6, 0, 1], "units": [[unit(1, b"b\nc", 7), unit(2, b"c\nd", 8), unit(3, b"d\ne", 7), unit(0, b"a\nb", 9, False)], None, []]})
    out = linededup._restore({(7, 2)}).func(cut)
    assert out.values.tolist() == [["a\nb\ne\nf", 6, 2], [None, 0, 0], ["x", 1, 0]]


def test_bitmap_keeps_every_member(spark):
    docs = spark.range(5000).select((F.col("id") - 2500).alias("doc_id"), F.xxhash64("id").alias("_k"), F.lit("t").alias("text"))
    members = docs.filter("doc_id % 10 = 0").select("doc_id", "_k")
    kept = ngramjoin._among(docs, members)
    assert kept.join(members, ["doc_id", "_k"]).count() == 500 and kept.count() < 520
    assert ngramjoin._among(docs, members.limit(0)).count() == 0


def test_bands_are_as_many_as_the_recall_needs():
    bands, rows = ngramjoin.choose_bands(0.1, 0.9999, 16)
    assert rows == 1 and 1 - (1 - 0.1) ** bands >= 0.9999


def test_copies_in_other_punctuation_or_edited_at_the_rare_word_are_found(spark):
    rng = np.random.default_rng(4)
    common = [f"w{i}" for i in range(60)]
    say = lambda n: list(rng.choice(common, n))
    item = [*say(9), "zyzzyva", *say(9)]
    edited = ["other" if w == "zyzzyva" else w for w in item]
    quoted = [f"\u201c{w}\u201d" if i % 3 == 0 else w + "\u2014" for i, w in enumerate(item)]
    docs = [(i, " ".join(say(200))) for i in range(60)] + [(100, " ".join([*say(40), *edited, *say(40)])), (101, " ".join([*say(40), *quoted, *say(40)]))]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    found = {r.doc_id: r.score for r in got.collect()}
    assert found[100] > 0.85 and found[101] == 1.0
