"""Removal of repeated passages of several lines, by content-defined chunks.

A document is cut into chunks after each line where a rolling hash over the last
``WINDOW`` line hashes is divisible by ``DIVISOR``, so boundaries move with the
text and an insertion changes only the chunks around it. A chunk of several
lines that stands more than once in the corpus stays where it does so first
(smallest ``doc_id``, then place in the document) and goes elsewhere.

A passage rarely begins and ends at boundaries, so matches are grown beyond the
chunks: of every chunk that stays, and across every boundary, the pairs of
neighbouring lines are looked up the same way. Pairs overlap, so a repeated
passage goes from its first to its last line, wherever in a document it stands;
every line that is removed stands, with a neighbour, at an earlier place. The
pairs inside chunks that go need no look-up, which are most of them in copies.

Nothing goes by its hash alone: the bytes of each chunk and pair that is removed
are compared with those at its first place, all units of a hash in one minimum
and maximum. Texts are shuffled once.

``remove_repeated_chunks`` removes whole chunks only.

Single lines are never removed, nor are lines that repeat the ones they overlap
with (of three equal lines all stay).

Cases: a null text stays null and an empty one empty; a null ``doc_id`` comes
after all others; rows that share ``doc_id`` and text count as one document,
so they keep the same lines; lines are what stands between line feeds; an empty
table gives an empty result. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import carried, materialise, passes, text_key

WINDOW = 2
DIVISOR = 4
#: Shares that the places of a hash are cut into when they meet its first one.
SHARES = 16
_MASK = (1 << 64) - 1


def chunk_ends(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Number of lines before each chunk boundary, the last one included."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    base = 0x9E3779B97F4A7C15
    out_of = pow(base, window, 1 << 64)
    rolling, ends = 0, []
    for i, h in enumerate(hashes):
        rolling = (rolling * base + h) & _MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * out_of) & _MASK
        if i >= window - 1 and (rolling ^ rolling >> 32) % divisor == 0:
            ends.append(i + 1)
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return ends


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """``(first line, lines, bytes)`` of each chunk of a text."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    ends = chunk_ends(lines)
    return [(a, b - a, b"\n".join(lines[a:b])) for a, b in zip([0, *ends], ends)]


_CHUNKS = "doc long, _k long, line int, n int, h long, pairs array<long>, edge array<long>"


def _signed(h: int) -> int:
    return h - (1 << 63)


def _chunk_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per chunk: its hash, those of the pairs of lines in it, and that of
    the pair across its end, if lines follow."""
    for part in passes(frames):
        rows = []
        for d, k, t in zip(part["doc"], part["_k"], part["text"]):
            lines = t.encode("utf-8", "surrogatepass").split(b"\n")
            pairs = [_signed(xxhash.xxh3_64_intdigest(b"\n".join(lines[i : i + 2]))) for i in range(len(lines) - 1)]
            ends = chunk_ends(lines)
            for a, b in zip([0, *ends], ends):
                whole = _signed(xxhash.xxh3_64_intdigest(b"\n".join(lines[a:b]), seed=1))
                rows.append((d, k, a, b - a, whole, pairs[a : b - 1], pairs[b - 1 : b]))
        yield pd.DataFrame(rows, columns=["doc", "_k", "line", "n", "h", "pairs", "edge"])


def _places(units: DataFrame, name: str) -> DataFrame:
    """``units`` (``doc, _k, line, n, h, ..``) that stand more than once: ``gone``
    where an earlier one stands, not ``gone`` at the first place."""
    place = F.struct("doc", "_k", "line")
    first = units.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f != l").select("h", "f")
    # A hash that very many documents have is no single key.
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    joined = units.withColumn("share", F.pmod(F.xxhash64("doc", "_k"), F.lit(SHARES)).cast("int")).join(first.withColumn("share", shares), ["h", "share"], "left")
    # Not a repeat: one that overlaps the first.
    onto_itself = (F.col("doc") == F.col("f.doc")) & (F.col("_k") == F.col("f._k")) & (F.col("line") - F.col("f.line")).between(1, F.col("n") - 1)
    state = F.when(place == F.col("f"), False).when(~onto_itself, True)
    return materialise(joined.withColumn("gone", state).drop("share", "f"), name)


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated passage of at least two lines cut out of its
    text column, and ``n_lines`` and ``n_removed_lines`` added."""
    return _remove(docs, True, doc_id, text)


def remove_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks cut out of its text column, and
    ``n_lines`` and ``n_removed_lines`` added."""
    return _remove(docs, False, doc_id, text)


def _remove(docs: DataFrame, grow: bool, doc_id: str, text: str) -> DataFrame:
    # Null ids sort last; their documents are told apart by text.
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(doc.alias("doc"), text_key(text).alias("_k"), F.col(text).alias("text")).filter(F.instr("text", "\n") > 0)
    # distinct: rows that share id and text have the same places.
    chunks = materialise(keyed.mapInPandas(_chunk_rows, _CHUNKS), "chunks")
    found = _places(chunks.filter("n > 1"), "repeated_chunks")
    unit = ["doc", "_k", "line", "n", "h", "gone"]
    marks = found.filter("gone IS NOT NULL").select(*unit)
    if grow:
        inside = found.filter("gone IS NULL OR NOT gone").select("doc", "_k", "line", F.posexplode("pairs").alias("i", "h"))
        across = chunks.select("doc", "_k", (F.col("line") + F.col("n") - 1).alias("line"), F.explode("edge").alias("h"))
        pairs = inside.select("doc", "_k", (F.col("line") + F.col("i")).alias("line"), "h").unionByName(across)
        marks = marks.unionByName(_places(pairs.withColumn("n", F.lit(2)), "repeated_pairs").filter("gone IS NOT NULL").select(*unit))
    # At most two units for each line of a document.
    per_doc = marks.groupBy("doc", "_k").agg(F.collect_set(F.struct("line", "n", "h", "gone")).alias("__llm_marks"))
    per_doc = per_doc.withColumnsRenamed({"doc": "__llm_doc", "_k": "__llm_key"})
    joined = docs.withColumns({"__llm_doc": doc, "__llm_key": text_key(text)}).join(per_doc, ["__llm_doc", "__llm_key"], "left")

    @F.pandas_udf("text string, n_lines long, n_removed_lines long, units array<struct<line:int,n:int,h:long,gone:boolean,body:binary>>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, units in zip(texts, found):
            if not isinstance(t, str):
                out.append((None, 0, 0, []))
            elif units is None or not len(units):
                out.append((t, t.count("\n") + 1, 0, []))
            else:
                lines = t.split("\n")
                gone = {i for u in units if u["gone"] for i in range(u["line"], u["line"] + u["n"])}
                bodies = [{**u, "body": "\n".join(lines[u["line"] : u["line"] + u["n"]]).encode("utf-8", "surrogatepass")} for u in units]
                out.append(("\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone), bodies))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed_lines", "units"])

    done = joined.withColumn("__llm_cut", cut(F.col(text), "__llm_marks"))
    added = ["n_lines", "n_removed_lines"]
    done = done.select(*carried(docs, [*added, text.lower()]), "__llm_cut")
    done = materialise(done, "cut", compression="zstd")
    units = done.select(F.explode("__llm_cut.units").alias("u")).select("u.n", "u.h", "u.body")
    bad = units.groupBy("h", "n").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a != b").select("h", "n")
    clash = {(r["h"], r["n"]) for r in bad.collect()}  # hashes of 64 bits that two texts share: none, as a rule
    result = F.col("__llm_cut")
    if clash:
        result = _restore(clash)(result)
    names = [c for c in docs.columns if c.lower() not in added]
    values = [result["text"].alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names]
    return done.select(*values, *[result[c].alias(c) for c in added])


def _restore(clash: set[tuple[int, int]]):
    """Puts lines back that went only by units of a hash that texts share."""

    @F.pandas_udf("text string, n_lines long, n_removed_lines long")
    def restore(cut: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, n, units in zip(cut["text"], cut["n_lines"], cut["units"]):
            if units is None or not len(units):
                out.append((t, n, 0))
                continue
            went = {u["line"] + i: line for u in units if u["gone"] for i, line in enumerate(u["body"].decode("utf-8", "surrogatepass").split("\n"))}
            good = {u["line"] + i for u in units if u["gone"] and (u["h"], u["n"]) not in clash for i in range(u["n"])}
            kept = iter(t.split("\n"))
            lines = [went[i] if i in went else next(kept) for i in range(n)]
            out.append(("\n".join(line for i, line in enumerate(lines) if i not in good), n, len(good)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed_lines"])

    return restore
