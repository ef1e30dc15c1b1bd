"""Remove passages that an earlier document holds, by suffix arrays.

A byte goes if it lies in a string of `width` bytes that also starts in a document with a smaller id. Strings
are windows of a document's bytes; they never cross documents and are judged on the input.

1. Documents are dealt into shards. A shard sends the hashes of some of its 20-byte grams, once each, to
   their range of hashes and learns how many documents hold them: all grams whose hash falls below a fixed
   tenth, and the smallest gram of every window. A window with a gram that one document alone holds cannot
   repeat and is left out; this loses none that repeats.
2. Runs of the windows that remain go to the bucket of their smallest gram, as strings, each distinct one once for a
   shard, with the smallest id there. Windows of a gram that very many documents hold go to buckets of their
   own hash instead, so a hot passage spreads over all of them.
3. A bucket's strings are dealt into ranges by the key that dealt them to the bucket, so equal windows share a range; a range
   of too many bytes is cut into shards of bounded size. Each gets a suffix array (Larsson-Sadakane) and
   common prefixes (Kasai), which group equal windows and give each group its smallest id; the sorted groups of
   the shards of a range are merged by binary search.
4. The smallest ids go back to the documents, which drop what an earlier document holds.

Equal texts are one text with the smallest of their ids; the other rows lose all their bytes if they have
`width` of them. Rows of one id are one document for this rule: they never lose bytes to each other. A null id is the smallest.
Null text is empty. Texts shorter than a window lose nothing. Other columns are left out. An empty table gives
no rows. What is left of a text may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import (
    bucket_cuts, from_planes, heads, mix64, offsets_in, pack, partitions, planes, shard_of, unpack,
)
from featloom.llm.shingles import VALUE, powers
from featloom.llm.suffix import merge, window_groups

WIDTH = 50
GRAM = 20
#: All grams with a smaller hash are counted.
COUNTED = np.uint64((1 << 64) // 10)
#: Documents with a gram from which its windows are dealt one by one.
HOT = 1024
MOST_COUNTED = np.iinfo(np.uint16).max
#: Most bytes of one suffix array, and bytes of documents that are scanned together.
SHARD, GROUP = 1_000_000, 1_000_000
#: Bytes of a range of a bucket, about: the arrays of so many fit into a processor's cache.
RANGE = 250_000
#: Most documents that are scanned together, and the bits of a key above their number.
GROUP_DOCS, KEY = 1 << 16, np.uint64((1 << 64) - (1 << 16))
SMALLEST = -(1 << 63)
#: Shards of documents for each shuffle partition: two, so that partitions even out.
SHARDS = 2


class Windows:
    """Grams and windows of a group of documents, which lie behind each other."""

    def __init__(self, texts: list[bytes], width: int):
        self.width, self.steps = width, width - GRAM + 1
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        n = len(self.data)
        sums, down = _sums(self.data)
        grams = max(0, n - GRAM + 1)
        self.gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:grams]) if grams else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        windows = max(0, n - width + 1)
        self.valid = self.doc[:windows] == self.doc[width - 1:] if windows else np.zeros(0, bool)
        self.least = self._sliding_least(windows)

    def _sliding_least(self, windows: int) -> np.ndarray:
        """The smallest gram of each window."""
        least, span = self.gram, 1
        while 2 * span <= self.steps:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = self.steps - span
        if rest and len(least) > rest:
            least = np.minimum(least[:-rest], least[rest:])
        return least[:windows]

    def low_grams(self) -> np.ndarray:
        """Places of the grams that are always counted."""
        inside = self.doc[:len(self.gram)] == self.doc[GRAM - 1:] if len(self.gram) else np.zeros(0, bool)
        return np.nonzero((self.gram < COUNTED) & inside)[0]

    def high_windows(self) -> np.ndarray:
        """Windows whose smallest gram is counted for their sake alone."""
        return np.nonzero(self.valid & (self.least >= COUNTED))[0]

    def documents_of_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct counted grams, and the number of documents of each.

        A high gram is counted where it is the smallest of a window: wherever this window occurs.
        """
        at, high = self.low_grams(), self.high_windows()
        pairs = np.concatenate((_key(self.gram[at]) | self.doc[at].astype(np.uint64),
                                _key(self.least[high]) | self.doc[high].astype(np.uint64)))
        pairs.sort()
        keys = pairs[heads(pairs)] & KEY
        first = heads(keys)
        return keys[first], np.diff(first, append=len(keys))


class Marks:
    """What is kept of a group's windows until the counts of its grams are known: less than two bytes for each byte."""

    def __init__(self, w: Windows):
        self.steps, self.grams, self.windows = w.steps, len(w.gram), len(w.valid)
        at = w.low_grams()
        keys = _key(np.concatenate((w.gram[at], w.least[w.high_windows()])))
        order = np.argsort(keys)
        keys = keys[order]
        first = heads(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(keys)))
        #: Distinct keys of the counted grams; places of the low ones, and of their keys.
        self.keys, self.at, self.place = keys[first], at.astype(np.int32), place[:len(at)]
        step = np.zeros(self.windows, bool)
        step[heads(w.least)] = True
        #: Smallest gram of the windows from each step to the next one.
        self.least, self.step, self.valid = w.least[step], np.packbits(step), np.packbits(w.valid)

    def runs(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows, deal key, and documents of its gram, of the runs of windows that may repeat."""
        held = counts[np.searchsorted(keys, self.keys)]
        # a low gram of one document rules out all windows that hold it
        unique = np.zeros(self.grams + 1, bool)
        unique[self.at[held[self.place] < 2]] = True
        before = np.concatenate((np.zeros(1, np.int32), np.cumsum(unique, dtype=np.int32)))
        valid, step = (np.unpackbits(x, count=self.windows).view(bool) for x in (self.valid, self.step))
        starts = np.nonzero(valid & (before[self.steps:self.steps + self.windows] == before[:self.windows]))[0]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | step[starts[1:]]
        head = np.nonzero(new)[0]
        first, numbers = starts[head], np.diff(head, append=len(starts))
        deal = mix64(self.least[np.cumsum(step, dtype=np.int32)[first] - 1])
        # and a window's smallest gram of one document rules out that window
        of = counts[np.searchsorted(keys, deal & KEY)]
        may = of >= 2
        return first[may], numbers[may], deal[may], of[may]


def _key(grams: np.ndarray) -> np.ndarray:
    """Counted and smallest grams are small numbers, so a key is the gram mixed anew: keys fall into all ranges alike."""
    return mix64(grams) & KEY


def _window_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of whole windows, from the grams that cover them."""
    sums, down = _sums(data)
    out = np.zeros(len(starts), np.uint64)
    offsets = [*range(0, width - GRAM, GRAM), width - GRAM]
    for i, o in enumerate(offsets):
        at = starts + o
        out = mix64(out + mix64((sums[at + GRAM] - sums[at]) * down[at]) * np.uint64(2 * i + 1))
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes' values, each times the power of its place, before every place; and the inverse powers."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[:len(data)], out=sums[1:])
    return sums, down


def _each(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """`counts` numbers from each start on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _groups(texts: list[bytes]):
    """Consecutive groups of documents of about `GROUP` bytes: first place and texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP or i + 1 == len(texts) or i + 1 - first == GROUP_DOCS:
            yield first, texts[first:i + 1]
            first, size = i + 1, 0


def _rows(t: pa.Table) -> list[tuple[int, bytes, str]]:
    """id, bytes and digest of the rows of a shard, in an order that does not depend on how they arrive."""
    ids = [SMALLEST if x is None else x for x in t.column("id").to_pylist()]
    data = [(x or "").encode() for x in t.column("text").to_pylist()]
    return sorted(zip(ids, data, (_name(x) for x in data)), key=lambda r: (r[0], r[2]))


def _name(data: bytes) -> str:
    return sha256(data).hexdigest()[:32]


def _first_rows(rows, firsts: pa.Table) -> list[int]:
    """Places of the rows that stand for their text: the first one with the smallest id of the text."""
    wanted = {(x["first"], x["name"]) for xs in firsts.column("firsts").to_pylist() if xs for x in xs}
    out = []
    for i, (doc_id, _, name) in enumerate(rows):
        if (doc_id, name) in wanted:
            wanted.remove((doc_id, name))
            out.append(i)
    return out


_PIECES = pa.schema([("to", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()),
                     ("places", pa.binary())])
_COUNTS = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_FIRSTS = pa.list_(pa.struct([("first", pa.int64()), ("name", pa.string())]))
_ANSWERS = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("firsts", _FIRSTS)])
_LEAST = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("own", pa.bool_()), ("least", pa.binary()),
                    ("runs", pa.binary()), ("firsts", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema)


def _reduced(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and the place of each key among the distinct ones."""
    every, numbers = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = heads(every)
    place = np.empty(len(every), np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(every)))
    return every[first], np.add.reduceat(numbers[order], first) if len(first) else numbers, place


def _shard_grams(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [Windows(group, width).documents_of_grams() for _, group in _groups(texts)]
    return _reduced([k for k, _ in found], [c for _, c in found])[:2] if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _merged(keys: list[np.ndarray]) -> np.ndarray:
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]), kind="stable")
    return every[heads(every)]


def least_ids(data: list[bytes], ids: np.ndarray, width: int, shard: int = SHARD) -> list[np.ndarray]:
    """For every window of every string the smallest id of a string that holds it."""
    least, counts = _least(data, ids, width, shard)
    return np.split(least, np.cumsum(counts)[:-1])


def _least(data: list[bytes], ids: np.ndarray, width: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The same one after the other, and the number of windows of each string."""
    sizes = np.array([len(x) for x in data], np.int64)
    windows_of = sizes - width + 1
    blocks = (np.cumsum(sizes) - sizes) // shard
    parts, known = [], (np.zeros(0, f"S{width}"), np.zeros(0, np.int64))
    several = len(blocks) and blocks[-1] > blocks[0]
    for b in np.unique(blocks).tolist():
        own = np.nonzero(blocks == b)[0]
        text = np.frombuffer(b"".join(data[own[0]:own[-1] + 1]), np.uint8)
        counts = windows_of[own]
        group, at = window_groups(text, _each(np.cumsum(sizes[own]) - sizes[own], counts), width)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, group, np.repeat(ids[own], counts))
        windows = None
        if several:
            windows = np.lib.stride_tricks.sliding_window_view(text, width)[at].copy().view(f"S{width}").ravel()
            known = merge(known, (windows, least))
        parts.append((group, least, windows))
    out = [np.zeros(0, np.int64)]
    for group, least, windows in parts:
        if several:
            least = known[1][np.searchsorted(known[0], windows)]
        out.append(least[group])
    return np.concatenate(out), windows_of


def _least_of_bucket(rows: list[tuple[list[bytes], np.ndarray, np.ndarray]], width: int, shard: int, size: int = RANGE) -> list[np.ndarray]:
    """For every window of every row's strings, one after the other, the smallest id of a string of any row that holds it.

    A row has its strings in the order of their places, and their ids; equal windows lie in strings of one place.
    """
    total = sum(sum(map(len, data)) for data, _, _ in rows)
    top = max((int(places[-1]) + 1 for _, _, places in rows if len(places)), default=1)
    edges = np.unique(np.arange(1, max(1, total // size)) * top // max(1, total // size))
    cuts = [[0, *np.searchsorted(places, edges).tolist(), len(places)] for _, _, places in rows]
    out: list[list[np.ndarray]] = [[] for _ in rows]
    for r in range(len(edges) + 1):
        own = [(i, cut[r], cut[r + 1]) for i, cut in enumerate(cuts) if cut[r + 1] > cut[r]]
        if not own:
            continue
        data = [x for i, a, b in own for x in rows[i][0][a:b]]
        # equal strings of several shards are one
        distinct = {x: i for i, x in enumerate(dict.fromkeys(data))}
        place = np.fromiter(map(distinct.__getitem__, data), np.int64, len(data))
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, place, np.concatenate([rows[i][1][a:b] for i, a, b in own]))
        least, counts = _least(list(distinct), low, width, shard)
        each = counts[place]
        told = least[_each((np.cumsum(counts) - counts)[place], each)]
        ends = np.cumsum(each)[np.cumsum([b - a for _, a, b in own]) - 1]
        for (i, _, _), x in zip(own, np.split(told, ends[:-1])):
            out[i].append(x)
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               hot: int = HOT, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), spans (start and end of the maximal runs that go)."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
                       shard_of(id_col, SHARDS * n).alias("shard"))
    names = rows.select(F.coalesce("id", F.lit(SMALLEST)).alias("id"), "shard",
                        F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32).alias("name"))
    firsts = (names.groupBy("name").agg(F.min(F.struct("id", "shard")).alias("at"))
              .groupBy(F.col("at.shard").alias("shard"))
              .agg(F.collect_list(F.struct(F.col("at.id").alias("first"), "name")).alias("firsts")))
    texts = rows.repartition(n, "shard")

    def own_texts(t: pa.Table, f: pa.Table):
        every = _rows(t)
        places = _first_rows(every, f)
        return every, places, [every[i][1] for i in places]

    def count(t: pa.Table, f: pa.Table) -> pa.Table:
        _, _, own = own_texts(t, f)
        keys, counts = _shard_grams(own, width)
        counts = np.minimum(counts, MOST_COUNTED).astype("<u2")
        shard = (t if t.num_rows else f).column("shard")[0].as_py()
        cuts = bucket_cuts(keys, n)
        found = [(shard, b, pack(offsets_in(keys[x:y], b, n)), counts[x:y].tobytes())
                 for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return _table(_COUNTS, found)

    def add(t: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in t.column("keys").to_pylist()]
        _, total, place = _reduced(keys, [np.frombuffer(x, "<u2") for x in t.column("counts").to_pylist()])
        total = np.minimum(total, MOST_COUNTED).astype("<u2")[place]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"),
                         "counts": pa.array([total[e - len(k):e].tobytes() for e, k in zip(ends.tolist(), keys)], pa.binary()),
                         "firsts": pa.nulls(len(keys), _FIRSTS)}, _ANSWERS)

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        every, places, own = own_texts(t, answers)
        marks = [Marks(Windows(group, width)) for _, group in _groups(own)]
        keys = _merged([m.keys for m in marks])
        counted = sorted((b, c) for b, c in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist())
                         if c is not None)
        counts = np.frombuffer(b"".join(c for _, c in counted), "<u2")
        if len(keys) != len(counts):
            raise ValueError("the documents of a shard changed between two reads")
        shard = (t if t.num_rows else answers).column("shard")[0].as_py()
        at_place, ids = np.array(places, np.int64), np.array([r[0] for r in every], np.int64)
        strings: dict[bytes, int] = {}
        uses, dealt = [], []  # row, start, string; deal key, windows and id of each string
        for (first, group), m in zip(_groups(own), marks):
            starts, numbers, deal, held = m.runs(keys, counts)
            data, known, alone = b"".join(group), len(strings), held >= hot
            if alone.any():
                # windows of a gram of very many documents are dealt one by one
                one = _each(starts[alone], numbers[alone])
                deal = np.concatenate((deal[~alone], _window_hashes(np.frombuffer(data, np.uint8), one, width)))
                starts, numbers = np.concatenate((starts[~alone], one)), np.concatenate((numbers[~alone], np.ones(len(one), np.int64)))
            found = np.array([strings.setdefault(data[s:e], len(strings)) for s, e in
                              zip(starts.tolist(), (starts + numbers + (width - 1)).tolist())], np.int64)
            ends = np.cumsum([len(x) for x in group])
            doc = np.searchsorted(ends, starts, side="right")
            row = at_place[first + doc]
            uses.append((row, starts - np.concatenate(([0], ends))[doc], found))
            # rows go by their ids, so a string comes first with its smallest one
            new = found > np.maximum.accumulate(np.concatenate(([known - 1], found)))[:-1]
            dealt.append((deal[new], numbers[new], ids[row[new]]))
        deal, numbers, least = (np.concatenate(x) for x in zip(*dealt)) if dealt else (np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
        order = np.argsort(deal, kind="stable")
        deal, sizes = deal[order], numbers[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(sizes) - sizes
        texts_of = list(strings)
        cuts = bucket_cuts(deal, n)
        out = []
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                out.append((b, shard, b"".join([texts_of[i] for i in order[x:y].tolist()]), planes((sizes[x:y] + (width - 1)).astype("<i4")),
                            planes(least[order[x:y]].astype("<i8")), planes((offsets_in(deal[x:y], b, n) >> np.uint32(16)).astype("<u2"))))
        # where the strings lie in this shard's rows: row, start, first window, windows
        row, start, string = (np.concatenate(x) for x in zip(*uses)) if uses else np.zeros((3, 0), np.int64)
        runs = np.stack((row, start, at[string], numbers[string])).astype("<i4")
        out.append((shard % n, shard, None, planes(runs), planes(np.array(places, "<i4")), None))
        return _table(_PIECES, out)

    def compare(t: pa.Table) -> pa.Table:
        bucket = t.column("to")[0].as_py()
        out, parts, shards = [], [], []
        for row in t.to_pylist():
            if row["data"] is None:
                out.append((row["shard"], None, True, None, row["lengths"], row["ids"]))
                continue
            ends = np.cumsum(from_planes(row["lengths"], "<i4"), dtype=np.int64).tolist()
            parts.append(([row["data"][x:y] for x, y in zip([0, *ends[:-1]], ends)], from_planes(row["ids"], "<i8"), from_planes(row["places"], "<u2")))
            shards.append(row["shard"])
        for shard, least in zip(shards, _least_of_bucket(parts, width, shard_bytes)):
            out.append((shard, bucket, False, planes(least.astype("<i8")), None, None))
        return _table(_LEAST, out)

    def drop(t: pa.Table, found: pa.Table) -> pa.Table:
        every = _rows(t)
        parts = found.to_pylist()
        own = next((x for x in parts if x["own"]), None)
        firsts = set(from_planes(own["firsts"], "<i4").tolist()) if own else set()
        least_of = {name: first for first, name in ((every[i][0], every[i][2]) for i in firsts)}
        told = sorted((x for x in parts if not x["own"]), key=lambda x: x["bucket"])
        least = np.concatenate([np.zeros(0, np.int64), *(from_planes(x["least"], "<i8") for x in told)])
        row, start, first, count = (from_planes(own["runs"], "<i4") if own else np.zeros(0, np.int32)).reshape(4, -1).astype(np.int64)
        gone: dict[int, np.ndarray] = {}
        if len(row):
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows_ = np.repeat(row, count)
            ids = np.array([r[0] for r in every], np.int64)
            earlier = least[np.repeat(first, count) + step] < ids[rows_]
            rows_, at = rows_[earlier], (np.repeat(start, count) + step)[earlier]
            order = np.argsort(rows_, kind="stable")
            rows_, at = rows_[order], at[order]
            heads = np.nonzero(np.concatenate(([True], rows_[1:] != rows_[:-1])))[0] if len(rows_) else []
            for x, y in zip(heads, [*heads[1:], len(rows_)]):
                gone[int(rows_[x])] = at[x:y]
        out = []
        for i, (doc_id, data, name) in enumerate(every):
            if i in firsts or least_of.get(name) == doc_id:
                starts = gone.get(i)
                if starts is None and i not in firsts:
                    # another row of the same id and text loses the same bytes
                    starts = gone.get(next(j for j in firsts if every[j][0] == doc_id and every[j][2] == name))
                spans = _spans(starts, width)
            else:
                spans = [(0, len(data))] if len(data) >= width else []
            kept, at = [], 0
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            kept.append(data[at:])
            out.append((None if doc_id == SMALLEST else doc_id, len(data), b"".join(kept),
                        [{"start": x, "end": y} for x, y in spans]))
        return _table(_KEPT, out)

    counts = texts.groupBy("shard").cogroup(firsts.groupBy("shard")).applyInArrow(count, _ddl(_COUNTS))
    totals = counts.groupBy("bucket").applyInArrow(add, _ddl(_ANSWERS))
    own = firsts.select("shard", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "firsts")
    answers = totals.unionByName(own)
    pieces = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(cut, _ddl(_PIECES))
    least = pieces.groupBy("to").applyInArrow(compare, _ddl(_LEAST))
    return texts.groupBy("shard").cogroup(least.groupBy("shard")).applyInArrow(drop, _ddl(_KEPT))


def _spans(starts: np.ndarray | None, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at these starts cover."""
    if starts is None or not len(starts):
        return []
    starts = np.sort(starts)
    new = np.concatenate(([True], starts[1:] > starts[:-1] + width))
    heads = np.nonzero(new)[0]
    lasts = np.concatenate((heads[1:], [len(starts)])) - 1
    return list(zip(starts[heads].tolist(), (starts[lasts] + width).tolist()))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return kept_bytes(docs, **parameters).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
