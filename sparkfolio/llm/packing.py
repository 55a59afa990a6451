"""Documents -> containers of fixed capacity with little unused room, by bin completion.

Token counts come from a public tokenizer whose file is a parameter.  Documents are spread over shards by
a hash (so no source or uploader makes a hot group); within a shard, per capacity, the largest open document
is completed by the fullest undominated filling, found by branching under an exact bound, and best-fit
decreasing packs the same documents: the better of both is the incumbent.  Where it needs more containers than
the room they must take together, branch-and-bound tries other undominated fillings of each container, cut
by the waste that one container less would allow, until the bound is met, the tree is done or NODES ran out.
A document above the capacity alone is split into full containers and a rest.  The badly filled containers
of all shards are emptied and packed once more, together, in a few larger shards.  The report sets the containers
used against the least number that could do, so what the search left open shows.
"""

from __future__ import annotations

import atexit
import base64
import bisect
import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_rows

TOKENIZER_FILE = os.environ.get("SPARKFOLIO_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_DOCS = 4000
#: Tables of reachable sums held at once (the others are made again), and the share of capacity below which a container is packed once more.
TABLES, REPACK_BELOW = 64, 0.97
#: Fillings tried by branch-and-bound for one shard and capacity before the incumbent stands (the report shows how far it is from the bound).
NODES = 3000
#: Most kinds of containers; every shard packs each of them.
MOST_KINDS = 1000

_ENCODERS: dict = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER_FILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, tokens) over whole texts; null and empty texts have 0 tokens, repeated documents count once."""
    cols = ["doc_id", *keep]
    schema = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in cols) + ", tokens long"

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            out = pdf[cols].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf.text]
            yield out

    n = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.sparkSession.sparkContext.defaultParallelism)
    rows = documents.where("doc_id is not null").select(*cols, "text").repartition(n, "doc_id").dropDuplicates(["doc_id"])
    return rows.mapInPandas(run, schema)


class _Sizes:
    """Items by size: distinct sizes in ascending order with how many are left."""

    def __init__(self, sizes):
        self.left: dict[int, int] = {}
        for s in sizes:
            self.left[s] = self.left.get(s, 0) + 1
        self.order = sorted(self.left)

    def take(self, s: int) -> None:
        self.left[s] -= 1
        if not self.left[s]:
            del self.left[s]
            self.order.pop(bisect.bisect_left(self.order, s))

    def largest(self, room: int) -> int | None:
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else None


def complete(first: int, room: int, sizes: _Sizes, tables: int = TABLES) -> list[int]:
    """The fullest undominated filling of the room beside the largest item.

    Branches take the next item largest first, each no larger than the one before.  The bound is exact: a
    table per size (one bit a sum) has the sums that items up to that size can reach, so a branch is cut
    just when what it leaves can't be filled to the least waste, and the first one not cut is the result
    without going back, however many items it takes.  Largest first, it is undominated: no used items may be
    replaced by one larger item of their joint size.
    """
    # Incumbent: best fit decreasing.
    best: list[int] = []
    rest, used = room, {}
    while (s := _fit(sizes, rest, used, first)) is not None:
        best.append(s)
        used[s] = used.get(s, 0) + 1
        rest -= s
    if rest == 0:
        return best

    # More copies than the room holds are never taken.
    items = [(s, n) for s in sizes.order[: bisect.bisect_right(sizes.order, room)] if (n := min(sizes.left[s] - (s == first), room // s)) > 0]
    marks, reach = [], 1
    for i, (s, n) in enumerate(items):
        if i % tables == 0:
            marks.append(reach)
        reach = _with(reach, s, n, room)
    need = reach.bit_length() - 1
    if room - need == rest:
        return best
    best = []
    for block in range(len(marks) - 1, -1, -1):
        part = items[block * tables : (block + 1) * tables]
        below = [marks[block]]  # per size: the sums that smaller ones reach
        for s, n in part[:-1]:
            below.append(_with(below[-1], s, n, room))
        for (s, n), smaller in zip(reversed(part), reversed(below)):
            n = min(n, need // s)
            while not smaller >> (need - n * s) & 1:
                n -= 1
            best += [s] * n
            need -= n * s
    return best


def _with(reach: int, size: int, copies: int, room: int) -> int:
    """The sums up to the room that are reached with up to so many copies of one more size."""
    mask, n = (1 << room + 1) - 1, 1
    while copies > 0:
        n = min(n, copies)
        reach |= reach << size * n & mask
        copies -= n
        n *= 2
    return reach


def _fit(sizes: _Sizes, room: int, used: dict, first: int) -> int | None:
    i = bisect.bisect_right(sizes.order, room) - 1
    while i >= 0:
        s = sizes.order[i]
        if sizes.left[s] - (s == first) > used.get(s, 0):
            return s
        i -= 1
    return None


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Best fit decreasing: each item into the fullest container with room for it."""
    out, room = [], []  # room: sorted (room left, container)
    for k, s in sorted(items, key=lambda x: (-x[1], x[0])):
        i = bisect.bisect_left(room, (s, -1))
        if i < len(room):
            left, c = room.pop(i)
        else:
            left, c = capacity, len(out)
            out.append([])
        out[c].append((k, s))
        bisect.insort(room, (left - s, c))
    return out


def dominated(filling: list[int], waste: int, left: dict[int, int], order: list[int]) -> bool:
    """Whether an unused item would do better: it fits into the waste, or in place of one or two of the filling.

    left: how many of each size the filling leaves; order: the sizes, ascending.
    """

    def free(low: int, high: int) -> bool:
        i = bisect.bisect_left(order, low)
        while i < len(order) and order[i] <= high:
            if left.get(order[i], 0) > 0:
                return True
            i += 1
        return False

    if free(1, waste):
        return True
    kinds = sorted(set(filling))
    if any(free(s + 1, s + waste) for s in kinds):
        return True
    pairs = {a + b for i, a in enumerate(kinds) for b in kinds[i:] if a != b or filling.count(a) > 1}
    return any(free(x, x + waste) for x in pairs)


def fillings(first: int, room: int, left: dict[int, int], most_waste: int):
    """Undominated fillings beside the largest item, the fullest first, that waste no more than allowed.

    Depth first, sizes from the largest down; the sums that the smaller sizes reach cut every branch that can't
    be filled to the sum wanted, so each leaf is a filling.  A dominated one comes out as None.
    """
    order = sorted(left)
    items = [(s, n) for s in order[: bisect.bisect_right(order, room)] if (n := min(left[s] - (s == first), room // s)) > 0]

    def sums() -> list[int]:
        below = [1]
        for s, n in items:
            below.append(_with(below[-1], s, n, room))
        return below

    below = sums()
    for need in range(room, max(-1, room - most_waste - 1), -1):
        if not below[-1] >> need & 1:
            continue
        stack = [(len(items), need, [])]
        while stack:
            i, rest, taken = stack.pop()
            if rest == 0:
                after = dict(left)
                after[first] -= 1
                for s in taken:
                    after[s] -= 1
                # The tables aren't kept while the search is further down.
                below = None
                yield None if dominated(taken, room - need, after, order) else taken
                below = sums()
                continue
            if i == 0:
                continue
            s, n = items[i - 1]
            for k in range(min(n, rest // s) + 1):
                if below[i - 1] >> (rest - k * s) & 1:
                    stack.append((i - 1, rest - k * s, taken + [s] * k))


def search(sizes: list[int], capacity: int, containers: int, nodes: int = NODES) -> list[list[int]] | None:
    """A packing into fewer containers than given, or None if there is none or the nodes ran out.

    Depth first over the fillings of the largest open item; a branch is cut once its waste passes what the
    containers still allowed leave over.
    """
    spare = (containers - 1) * capacity - sum(sizes)
    if spare < 0:
        return None
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    path: list[tuple[list[int], int]] = []

    def options(waste: int):
        first = max(left)
        for f in fillings(first, capacity - first, left, waste):
            yield f if f is None else [first, *f]

    stack = [options(spare)]
    while stack:
        nodes -= 1
        if nodes < 0:
            return None
        filling = next(stack[-1], ())
        if filling is None:
            continue
        if not filling:
            stack.pop()
            if path:
                undone, waste = path.pop()
                spare += waste
                for s in undone:
                    left[s] = left.get(s, 0) + 1
            continue
        waste = capacity - sum(filling)
        spare -= waste
        path.append((filling, waste))
        for s in filling:
            left[s] -= 1
            if not left[s]:
                del left[s]
        if not left:
            return [f for f, _ in path]
        stack.append(options(spare))
    return None


def least_containers(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer: all sizes together, or the items above half the capacity with what doesn't fit beside them."""
    big = [s for s in sizes if 2 * s > capacity]
    half = -(-max(0, sum(s for s in sizes if 2 * s <= capacity) - sum(capacity - s for s in big)) // capacity)
    return max(-(-sum(sizes) // capacity), len(big) + half)


def pack(items: list[tuple[int, int]], capacity: int, nodes: int = NODES) -> list[list[tuple[int, int]]]:
    """Containers as lists of (id, size) for items no larger than the capacity.

    The largest open item is completed again and again; best fit decreasing over all items stands where that
    needs more containers.  The better one is the incumbent of the search for fewer.
    """
    open_sizes, found = _Sizes([s for _, s in items]), []
    while open_sizes.order:
        first = open_sizes.order[-1]
        filling = [first, *complete(first, capacity - first, open_sizes)]
        for s in filling:
            open_sizes.take(s)
        found.append(filling)
    other = best_fit(items, capacity)
    if len(other) < len(found):
        found = [[s for _, s in c] for c in other]
    all_sizes = [s for _, s in items]
    least = least_containers(all_sizes, capacity)
    while len(found) > least and (fewer := search(all_sizes, capacity, len(found), nodes)):
        found = fewer
    by_size: dict[int, list[int]] = {}
    for k, s in sorted(items, reverse=True):
        by_size.setdefault(s, []).append(k)
    return [[(by_size[s].pop(), s) for s in filling] for filling in found]


_SCHEMA = "container_kind string, capacity_tokens int, container string, doc_id long, part int, tokens int"
_COLUMNS = ["container_kind", "capacity_tokens", "container", "doc_id", "part", "tokens"]


def _pack_shard(limits: list[tuple[str, int]], tag: str):
    """Rows of one shard sorted by (shard, kind, capacity) -> container rows; all capacities at once in the first round (capacity 0)."""

    def rows_of(shard, items, kinds):
        out = []
        for kind, capacity in kinds:
            fit, whole = [], []
            for k, s, part in items:
                if s > capacity:
                    n = s // capacity
                    whole += [(k, capacity, i) for i in range(n)]
                    if s % capacity:
                        fit.append(((k, n), s % capacity))
                elif s > 0:
                    fit.append(((k, part), s))
            name = f"{kind}-{capacity}-{tag}{shard}"
            out += [(kind, capacity, f"{name}-x{k}-{i}", k, i, s) for k, s, i in whole]
            for c, filling in enumerate(pack(fit, capacity)):
                out += [(kind, capacity, f"{name}-{c}", k, part, s) for (k, part), s in filling]
        return out

    kinds_of = lambda key: [x for x in limits if key[2] == 0 or x == (key[1], key[2])]

    def run(batches):
        key, items = None, []
        for pdf in batches:
            out = []
            for shard, kind, capacity, k, part, s in zip(pdf.shard, pdf.kind, pdf.capacity, pdf.doc_id, pdf.part, pdf.tokens):
                if (shard, kind, capacity) != key:
                    if items:
                        out += rows_of(key[0], items, kinds_of(key))
                    key, items = (shard, kind, capacity), []
                items.append((int(k), int(s), int(part)))
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if items:
            yield pd.DataFrame(rows_of(key[0], items, kinds_of(key)), columns=_COLUMNS)

    return run


def pack_documents(documents: DataFrame, limits: DataFrame, path: str = TOKENIZER_FILE) -> DataFrame:
    """(container_kind, capacity_tokens, container, doc_id, part, tokens): where each document went, per capacity.

    `part` numbers the pieces of a document above the capacity; other documents are whole (part 0).  Null and
    empty documents need no room and don't appear.  `limits` is a small fixed table (3 rows).
    """
    kinds = sorted((r[0], int(r[1])) for r in small_rows(limits.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens"), "the table of containers", MOST_KINDS))
    counts = token_counts(documents, path).where("tokens > 0")
    # As many shards as keep about SHARD_DOCS documents in one; the count is read from the table's own metadata.
    shards = max(1, -(-documents.count() // SHARD_DOCS))
    spark = documents.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = counts.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit("").alias("kind"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("part"), F.col("tokens").cast("int").alias("tokens"))
    packed = rows.repartition(min(n, shards), "shard").sortWithinPartitions("shard", "doc_id").mapInPandas(_pack_shard(kinds, "a"), _SCHEMA)
    packed = _cut(packed)
    fill = packed.groupBy("container", "container_kind", "capacity_tokens").agg(F.sum("tokens").alias("used"))
    poor = fill.where(F.col("used") < F.col("capacity_tokens") * REPACK_BELOW).select("container")
    good = packed.join(poor, "container", "left_anti")
    again = packed.join(poor, "container", "left_semi")
    # One container in a shard is badly filled, a few at most, so the second round needs far fewer shards.
    second = max(1, shards // 16)
    left = again.select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(second)).cast("int").alias("shard"), F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"), "doc_id", "part", "tokens")
    repacked = left.repartition(min(n, second * len(kinds) or 1), "shard", "kind", "capacity").sortWithinPartitions("shard", "kind", "capacity", "doc_id", "part").mapInPandas(_pack_shard(kinds, "b"), _SCHEMA)
    return good.select(*_COLUMNS).unionByName(repacked)


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the session's shared folder (spark.checkpoint.dir).

    Where none is named, a local session gets a folder of its own that goes when Python ends; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="sparkfolio-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def packing_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers and the least that could do, tokens placed, documents, documents split, and the share of room used."""
    per = packed.groupBy("container_kind", "capacity_tokens", "container").agg(F.sum("tokens").alias("used"), F.countDistinct("doc_id").alias("docs"))
    split = packed.where("part > 0").groupBy("container_kind", "capacity_tokens").agg(F.countDistinct("doc_id").alias("split_docs"))
    out = per.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("docs").alias("placements"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return out.join(split, ["container_kind", "capacity_tokens"], "left").select(
        "container_kind", "capacity_tokens", "containers", least, "tokens", "placements", F.coalesce("split_docs", F.lit(0)).alias("split_docs"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
