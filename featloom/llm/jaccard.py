"""Exact Jaccard join of documents as sets of word shingles, up to connected components.

The join follows the relations between sets, not only between a set and a token:

* Equal sets are one set. Every shard of documents sends its distinct shingles once to their range of
  hashes and gets back in how many sets each occurs. With shingles ordered from rare to frequent, two
  sets that link share a shingle among the first `n - ceil(0.8 n) + 1` of each; only those that occur in
  two sets make entries (shingle, set, size, position) of the index.
* Index lists are cut into blocks of sizes (a factor of 1.25 each), so blocks whose sizes cannot link are
  skipped whole, and a pair of entries whose positions leave too few shingles is skipped too.
* Round 1 compares each set with the heads of its block and of the two next to it: the set there with the
  fewest shingles of its own. So a list of m sets gives at most 3m pairs, however many of them are alike. A
  set's closest linked head becomes its anchor.
* Round 2 compares anchors that meet in a list and are not connected yet.
* Round 3 derives the answers of all other sets from those of their anchors: for x with anchor a and y with
  anchor b, at most |a & b| + |x - a| + |y - b| shingles are shared. Pairs that this decides are skipped; the
  rest is compared.

Sets that are connected already are never compared. Comparing means counting the shared shingles of the whole
texts. Components come from the links of all rounds, so none is lost. Pairs of a linked group are not written out,
but rounds 2 and 3 pair all anchors of a list that are not connected: m unlinked documents made of the same passages
can give m^2 / 2 pairs.

Null, empty and blank texts have no set, size 0, and stay alone. A text of fewer words than a shingle has one.
Repeated rows and equal sets are linked with each other. A null id stays in its component; the component's id
is the smallest one that is not null, null if there is none. Other columns are left out. Sets are
told apart by 64-bit digests. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from featloom.llm.common import bucket_cuts, lean, lean_table, offsets_in, pack, partitions, shard_of, small_batches, staged, unpack
from featloom.llm.graph import components
from featloom.llm.shingles import shingle_sets

WIDTH = 5
#: A link: 100 * shared >= PERCENT * together.
PERCENT = 80
#: Shards of documents for each shuffle partition: two, so that partitions even out.
SHARDS = 2
MOST_COUNTED = np.iinfo(np.uint16).max


def links(shared: str, n: str, m: str) -> str:
    """SQL: whether sets of sizes n and m that share so many are linked."""
    return f"(100 + {PERCENT}) * ({shared}) >= {PERCENT} * ({n} + {m})"


def set_ids(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, at, out = sets.astype("<u8").tobytes(), 0, []
    for end in (8 * ends).tolist():
        out.append(int.from_bytes(blake2b(data[at:end], digest_size=8).digest(), "little", signed=True))
        at = end
    return np.array(out, np.int64)


def text_digest(text_col: str = "text") -> Column:
    """64 bits that tell rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digests: bool = False) -> DataFrame:
    """doc_id, shard, n, sid: the set of every document; with `digests` also digest, that of its text."""
    own = [text_digest(text_col).alias("digest")] if digests else []
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        shard_of(id_col, SHARDS * partitions(docs.sparkSession)).alias("shard"), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, ends = shingle_sets(b.column("text").to_pylist(), width)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "shard": b.column("shard"),
                                   "n": pa.array(np.diff(ends, prepend=0), pa.int64()),
                                   "sid": pa.array(set_ids(sets, ends), pa.int64())}
                                  | ({"digest": b.column("digest")} if digests else {}))
    return small_batches(texts).mapInArrow(lambda batches: lean(run(batches)), "doc_id bigint, shard int, n bigint, sid bigint" + (", digest bigint" if digests else ""))


# Counts of shingles travel as packed offsets (common.pack); they only decide an order.
_COUNTS = "shard int, bucket int, keys binary, counts binary"
_ANSWER = "shard int, bucket int, counts binary, owned array<bigint>"
_ENTRIES = "sid bigint, n bigint, alone bigint, token bigint, pos int, text binary"


def _own_sets(texts: pa.Table, owned: list[int], width: int):
    """Texts, ids and shingles of the sets that this shard answers for, in the order of the ids."""
    column = texts.column("text").to_pylist()
    sets, ends = shingle_sets(column, width)
    ids = set_ids(sets, ends)
    wanted = np.array(sorted(owned), np.int64)
    order = np.argsort(ids, kind="stable")
    at = order[np.searchsorted(ids[order], wanted)]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    tokens = [sets[starts[i]:ends[i]] for i in at.tolist()]
    return [column[i] for i in at.tolist()], wanted, tokens


def _owned(t: pa.Table) -> list[int]:
    return [x for xs in t.column("owned").to_pylist() if xs for x in xs]


def index(docs: DataFrame, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Two kinds of rows: entries (sid, n, token, pos) and, with null token, the compressed text of each set that has one."""
    n = partitions(docs.sparkSession)
    texts = docs.select(shard_of(id_col, SHARDS * n).alias("shard"), F.col(text_col).cast("string").alias("text")).repartition(n, "shard")
    # one shard answers for a set, so that copies are counted once
    owners = sets.where("n > 0").groupBy("sid").agg(F.min("shard").alias("shard"))
    owned = owners.groupBy("shard").agg(F.collect_list("sid").alias("owned"))

    def count(t: pa.Table, o: pa.Table) -> pa.Table:
        kinds = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        if not o.num_rows:
            return kinds.empty_table()
        _, _, tokens = _own_sets(t, _owned(o), width)
        keys, counts = np.unique(np.concatenate(tokens), return_counts=True)
        counts = np.minimum(counts, MOST_COUNTED).astype("<u2")
        cuts = bucket_cuts(keys, n)
        rows = [(b, x, y) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return pa.table({"shard": pa.array([o.column("shard")[0].as_py()] * len(rows), pa.int32()),
                         "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                         "keys": pa.array([pack(offsets_in(keys[x:y], b, n)) for b, x, y in rows], pa.binary()),
                         "counts": pa.array([counts[x:y].tobytes() for _, x, y in rows], pa.binary())}, kinds)

    def add(t: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in t.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in t.column("counts").to_pylist()]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        distinct, start = np.unique(every[order], return_index=True)
        total = np.minimum(np.add.reduceat(counts[order], start), MOST_COUNTED).astype("<u2")
        answers = [total[np.searchsorted(distinct, k)].tobytes() for k in keys]
        return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "counts": pa.array(answers, pa.binary()),
                         "owned": pa.nulls(len(keys), pa.list_(pa.int64()))})

    def enter(t: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard
        names = _owned(answers)
        own_texts, sids, tokens = _own_sets(t, names, width) if names else ([], [], [])
        kinds = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("token", pa.int64()), ("pos", pa.int32()),
                           ("text", pa.binary())])
        if not tokens:
            return kinds.empty_table()
        counted = sorted((b, c) for b, c in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()) if c is not None)
        df = np.concatenate([np.frombuffer(c, "<u2") for _, c in counted])
        every = np.concatenate(tokens)
        keys, where = np.unique(every, return_inverse=True)
        if len(keys) != len(df):
            raise ValueError("the documents of a shard changed between two reads")
        df = df[where]
        sizes = np.array([len(x) for x in tokens])
        firsts = sizes - (PERCENT * sizes + 99) // 100 + 1
        single = np.add.reduceat(df == 1, np.cumsum(sizes) - sizes)
        out, kept = [], []
        compress = zstandard.ZstdCompressor(level=1).compress
        at = 0
        for i, (size, first, alone) in enumerate(zip(sizes.tolist(), firsts.tolist(), single.tolist())):
            if alone < first:
                own = df[at:at + size]
                order = np.lexsort((tokens[i], own))[alone:first]
                out.append((np.full(len(order), sids[i]), np.full(len(order), size), np.full(len(order), alone), tokens[i][order].view(np.int64),
                            np.arange(alone, first, dtype=np.int32)))
                kept.append(i)
            at += size
        if not kept:
            return kinds.empty_table()
        sid, n_, lone, token, pos = (np.concatenate(x) for x in zip(*out))
        entries = pa.table({"sid": sid, "n": n_, "alone": lone, "token": token, "pos": pos, "text": pa.nulls(len(sid), pa.binary())}, kinds)
        held = pa.table({"sid": sids[kept], "n": sizes[kept], "alone": single[kept].astype(np.int64), "token": pa.nulls(len(kept), pa.int64()),
                         "pos": pa.nulls(len(kept), pa.int32()),
                         "text": pa.array([compress((own_texts[i] or "").encode()) for i in kept], pa.binary())}, kinds)
        return pa.concat_tables([entries, held])

    counts = texts.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(lambda t, o: lean_table(count(t, o)), _COUNTS)
    totals = counts.groupBy("bucket").applyInArrow(add, _ANSWER)
    names = owned.select("shard", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "owned")
    answers = totals.unionByName(names)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda t, a: lean_table(enter(t, a)), _ENTRIES)


def overlaps(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """x, y, n, m, shared: sizes and shared shingles of pairs (x, y) of sets, from their whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        read = zstandard.ZstdDecompressor().decompress
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            data = dict(zip(x, b.column("x_text").to_pylist())) | dict(zip(y, b.column("y_text").to_pylist()))
            place = {s: i for i, s in enumerate(data)}
            sets, ends = shingle_sets([read(t).decode() for t in data.values()], width)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            own = [sets[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
            both = [(own[place[i]], own[place[j]]) for i, j in zip(x, y)]
            yield pa.record_batch({
                "x": b.column("x"), "y": b.column("y"), "n": pa.array([len(i) for i, _ in both], pa.int64()),
                "m": pa.array([len(j) for _, j in both], pa.int64()),
                "shared": pa.array([len(np.intersect1d(i, j, assume_unique=True)) for i, j in both], pa.int64())})
    held = (pairs.join(texts.select(F.col("sid").alias("x"), F.col("text").alias("x_text")), "x")
            .join(texts.select(F.col("sid").alias("y"), F.col("text").alias("y_text")), "y"))
    return small_batches(held.select("x", "y", "x_text", "y_text")).mapInArrow(lambda batches: lean(run(batches)), "x bigint, y bigint, n bigint, m bigint, shared bigint")


def _fits(n: str, m: str) -> str:
    """SQL: whether sets of sizes n and m can link at all."""
    return links(f"least({n}, {m})", n, m)


def _first_round(entries: DataFrame) -> DataFrame:
    """x, y: each set and the heads of the blocks around it, which come before it in the order of heads.

    A head is the set of its block with the fewest shingles of its own, then the smallest:
    among copies with edits that is the text they come from, which is nearer to each of
    them than they are to each other.
    """
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    placed = entries.withColumn("block", block)
    heads = placed.groupBy("token", "block").agg(
        F.min(F.struct("alone", "n", "sid", "pos")).alias("head"))
    asked = placed.withColumn("block", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])))
    room = "1 + least(n - pos - 1, head.n - head.pos - 1)"
    return (asked.join(heads, ["token", "block"])
            .where("struct(head.alone, head.n, head.sid) < struct(alone, n, sid)")
            .where(f"{links(room, 'n', 'head.n')} AND {_fits('n', 'head.n')}")
            .select(F.col("sid").alias("x"), F.col("head.sid").alias("y")).distinct())


def _labelled(rows: DataFrame, node: str, roots: DataFrame, to: str) -> DataFrame:
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (rows.join(known, F.col(node) == F.col("_node"), "left")
            .withColumn(to, F.coalesce("_root", F.col(node))).drop("_node", "_root"))


def set_links(entries: DataFrame, texts: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame | None]:
    """The links found (a, b), and node, root of the sets that have one (None without links)."""
    def linked(pairs):
        return pairs.where(links("shared", "n", "m")).select(F.col("x").alias("a"), F.col("y").alias("b"))

    first = staged(overlaps(_first_round(entries), texts, width), "round1")
    found = linked(first)
    roots = components(found)
    # the closest linked head; heads come first in their order, so anchors do not form circles
    near = first.where(links("shared", "n", "m")).groupBy("x").agg(
        F.max_by(F.struct(F.col("y").alias("anchor"), (F.col("n") - F.col("shared")).alias("apart")),
                 F.struct(F.col("shared") / (F.col("n") + F.col("m")), -F.col("y"))).alias("near"))
    # an anchor must stand for itself
    stands = near.select(F.col("x").alias("anchor_x"))
    near = (near.select("x", "near.anchor", "near.apart").join(stands, F.col("anchor") == F.col("anchor_x"), "left_anti"))
    placed = entries.join(near, F.col("sid") == F.col("x"), "left").select(
        "token", "sid", "n", "pos", F.coalesce("anchor", "sid").alias("anchor"), F.coalesce("apart", F.lit(0)).alias("apart"))
    placed = staged(_labelled(placed, "anchor", roots, "root"), "placed")

    def met(rows):
        """Pairs of anchors of different components that meet in a list, with sizes and positions that can link."""
        groups = rows.groupBy("token", "root", "anchor").agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("room"))
        several = groups.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("token")
        groups = groups.join(several, "token")
        a, b = groups.alias("a"), groups.alias("b")
        return (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.anchor") > F.col("b.anchor")) &
                       (F.col("a.root") != F.col("b.root")) &
                       (F.col("a.high") * 100 >= F.col("b.low") * PERCENT) & (F.col("b.high") * 100 >= F.col("a.low") * PERCENT) &
                       F.expr(links("least(a.room, b.room)", "a.low", "b.low")))
                .select(F.col("a.anchor").alias("x"), F.col("b.anchor").alias("y")).distinct())

    ordered = [F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")]
    pairs = met(placed).join(first.select(*ordered), ["x", "y"], "left_anti")
    second = staged(overlaps(pairs, texts, width), "round2")
    if not second.where(links("shared", "n", "m")).isEmpty():
        found = staged(found.unionByName(linked(second)), "links2")
        roots = components(found)
        placed = staged(_labelled(placed.drop("root"), "anchor", roots, "root"), "placed2")
    anchors = first.unionByName(second).select(*ordered, "shared")
    third = staged(overlaps(_third_round(placed, anchors), texts, width), "round3")
    if not third.where(links("shared", "n", "m")).isEmpty():
        found = staged(found.unionByName(linked(third)), "links3")
        roots = components(found)
    return found, roots


def _third_round(placed: DataFrame, anchors: DataFrame) -> DataFrame:
    """x, y: pairs of sets that the answers of their anchors leave open."""
    # anchor pairs for which some two members may link, by the farthest members of each list
    groups = placed.groupBy("token", "anchor", "root").agg(
        F.max("apart").alias("far"), F.min("n").alias("low"), F.max(F.col("n") - F.col("pos")).alias("room"))
    several = groups.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("token")
    groups = groups.join(several, "token")
    open_ = (groups.alias("a").join(groups.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.anchor") > F.col("b.anchor"))
                                    & (F.col("a.root") != F.col("b.root")) & (F.col("a.far") + F.col("b.far") > 0))
             .join(anchors.alias("k"), (F.col("a.anchor") == F.col("k.x")) & (F.col("b.anchor") == F.col("k.y")), "left")
             # anchors that never met in sizes that can link have no count: nothing is known of them
             .where("k.shared IS NULL OR " + links("k.shared + a.far + b.far", "a.low", "b.low"))
             .where(links("least(a.room, b.room)", "a.low", "b.low"))
             .select("a.token", F.col("a.anchor").alias("anchor_x"), F.col("b.anchor").alias("anchor_y"), "k.shared"))
    x, y = placed.alias("x"), placed.alias("y")
    room = "1 + least(x.n - x.pos - 1, y.n - y.pos - 1)"
    return (open_.join(x, (F.col("x.token") == open_["token"]) & (F.col("x.anchor") == F.col("anchor_x")))
            .join(y, (F.col("y.token") == open_["token"]) & (F.col("y.anchor") == F.col("anchor_y")))
            .where(f"x.apart + y.apart > 0 AND {_fits('x.n', 'y.n')} AND {links(room, 'x.n', 'y.n')}")
            .where("shared IS NULL OR " + links("shared + x.apart + y.apart", "x.n", "y.n"))
            .select(F.greatest("x.sid", "y.sid").alias("x"), F.least("x.sid", "y.sid").alias("y")).distinct())


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """The members, and sid, first, root of every set: its smallest id and the set that names its component."""
    sets = staged(members(docs, id_col, text_col, width, digests), "sets")
    built = staged(index(docs, sets, id_col, text_col, width), "index")
    _, roots = set_links(built.where("token IS NOT NULL").drop("text"), built.where("token IS NULL").select("sid", "text"), width)
    ids = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    return sets, _labelled(ids, "sid", roots, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets, ids = _joined(docs, id_col, text_col, width)
    least = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = ids.join(least, "root").select("sid", "component_id")
    some = sets.where("n > 0").join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def surplus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, digest, stays: the (id, digest of the text) of rows that are not to stay all.

    Of each component one row stays: that of the smallest id, a null id being the greatest, then of the smallest
    digest. `stays` tells the rows of which one stays, which are equal, from those of which none does. Rows
    without a set are near nothing; those of one id with equal texts are one document, without an id all stay.
    """
    sets, ids = _joined(docs, id_col, text_col, width, digests=True)
    # a row's place in its component; copies are one row from here on
    rows = sets.groupBy("sid", "n", "doc_id", "digest").agg(F.count("*").alias("copies"))
    placed = rows.where("n > 0").withColumn("place", F.expr("struct(doc_id IS NULL, doc_id, digest)"))
    # the best of each set, then the best set of each component
    best = placed.groupBy("sid").agg(F.min("place").alias("own")).join(ids.select("sid", "root"), "sid")
    first = best.groupBy("root").agg(F.min("own").alias("first"))
    of_set = best.join(first, "root").select("sid", "first")
    some = placed.join(of_set, "sid").select("doc_id", "digest", "copies", F.expr("place = first").alias("stays"))
    none = rows.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "digest", "copies", F.lit(True).alias("stays"))
    return some.unionByName(none).where("NOT stays OR copies > 1").select("doc_id", "digest", "stays")
