"""Registered queries against DuckDB, and the pipeline stage by stage against
plain versions."""

import itertools
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from geomart.llm import quality


def test_all_eleven_queries_are_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op10_exact_top_k"])
def test_query_equals_its_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in E.queries()[name](spark, sf_small).select(*columns).collect()) == sorted(want.fetchall())


def test_toxic_documents_of_every_language_are_found(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = E.queries()["op4_toxicity"](spark, folder).filter("held_out").join(labels, "doc_id").filter("toxic = 1").toPandas()
    assert sorted(got.lang.unique()) == ["de", "en", "es", "fr"]
    assert got.groupby("lang")["predicted"].mean().min() > 0.5


def _grams(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(700)]
    say = lambda n: " ".join(rng.choice(words, n))
    # Rows that share an id are put in order by the hash of their text.
    xxh = lambda t: spark.range(1).select(F.xxhash64(F.lit(t or ""))).first()[0]
    items = [say(25) for _ in range(3)]
    block = "\n".join(say(4) for _ in range(14))
    base = say(90)
    rows = [(i, "\n".join(say(9) for _ in range(6))) for i in range(50)]
    rows += [(50 + i, " ".join(f"{w}%%%" for w in say(60).split())) for i in range(12)]
    rows += [(70 + i, say(8) + "\n" + block + "\n" + say(8)) for i in range(6)]
    rows += [(80 + i, base.replace(base.split()[7 * i + 3], "edit", 1)) for i in range(5)] + [(90, rows[3][1]), (91, say(40) + " " + items[1] + " " + say(30)), (92, items[2].upper())]
    rows += [(None, say(70)), (95, None), (96, ""), (97, say(4000)), (97, say(50))]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 50 <= i < 62)) for i in range(0, 92, 2)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]

    # quality: the n-gram ratio of each text decides, up to the noise of the draw.
    good = {i for i in range(0, 92, 2) if not 50 <= i < 62}
    raw, target, grams = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), []
    for i, t in rows:
        grams.append(quality.gram_buckets([t], quality.BUCKETS)[0])
        raw += np.bincount(grams[-1], minlength=quality.BUCKETS)
        target += np.bincount(grams[-1], minlength=quality.BUCKETS) * (i in good)
    ratio = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    weight = [float(ratio[g].sum()) for g in grams]
    have = [(r["doc_id"], r["text"]) for r in kept["quality"]]
    assert len(have) == -(-len(rows) * len(good) // 46)
    inside = [w for r, w in zip(rows, weight) if r in have]
    assert min(inside) + 25 > max(w for r, w in zip(rows, weight) if r not in have)

    # line dedup: what stands in two lines that stand together before goes.
    first, cut = {}, []
    lines = {(i, t): t.split("\n") for i, t in have if t is not None}
    order = sorted(set(have), key=lambda r: (r[0] is None, r[0] or 0, xxh(r[1])))
    for r in order:
        for k, pair in enumerate(itertools.pairwise(lines.get(r, []))):
            first.setdefault(pair, (r, k))
    for r in have:
        gone = set()
        for k, pair in enumerate(itertools.pairwise(lines.get(r, []))):
            if first[pair] != (r, k) and first[pair] != (r, k - 1):
                gone |= {k, k + 1}
        cut.append((r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(lines[r]) if k not in gone)))
    # Rows that share an id are told apart by their place only, so compare as sets.
    assert sorted(((r["doc_id"], r["text"]) for r in kept["line_dedup"]), key=repr) == sorted(cut, key=repr)

    root = list(range(len(cut)))

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = [_grams(t or "") for _, t in cut]
    for a, b in itertools.combinations([k for k, r in enumerate(cut) if r[0] is not None], 2):
        if (cut[a][1] or "").split() == (cut[b][1] or "").split() or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    one = {}
    for k, r in enumerate(cut):
        if r[0] is not None and r[0] <= one.get(find(k), (r[0],))[0]:
            one.setdefault(find(k), r)
    want = [*one.values(), *[r for r in cut if r[0] is None]]
    assert sorted(r["doc_id"] or -1 for r in kept["near_duplicates"]) == sorted(r[0] or -1 for r in want)

    plain = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    leaked = {r["doc_id"] for r in kept["near_duplicates"] if any(" ".join(plain(x)) in " ".join(plain(r["text"])) for x in items)}
    assert {r["doc_id"] for r in kept["near_duplicates"]} - {r["doc_id"] for r in kept["decontamination"]} == leaked and leaked

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept["decontamination"])
    assert sum(r["length"] for r in kept["packing"]) == total
    held = {}
    for r in kept["packing"]:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) for x in held.values())
