"""Nearest-neighbour retrieval over all queries at once.

Item vectors whose counted size allows are broadcast as one matrix: a block of
queries meets it in slices, a running top-k is kept, and k rows per query leave
the task, already ranked, so nothing is shuffled after the product. Larger item
sides are packed into blocks, and every block is sent once to each group of
queries, which keeps running lists: no list is shuffled either. No pair of
single rows is ever materialised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import vectors as V
from lodestar.sources.storage import cut_lineage

# Least rows of a query block; full Arrow batches are cut into eight blocks, so
# that big inputs re-read the item matrix less often.
QUERY_BLOCK = 256
ITEM_BLOCK = 4096
# Item matrices up to this size are broadcast; larger ones are sent to groups of queries.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of the running lists of a group of queries, and of a pair in them; groups per core, at least.
LIST_BYTES, PAIR_BYTES, GROUPS = 192 * 1024 * 1024, 36, 3
SCORE_SCALE = 1_000_000
# Rough products are of floats up to this product of lengths; one pair in MANY that passes them has exact ones made for all.
ROUGH_MOST, MANY = 1e30, 16


def _pack(df: DataFrame, known: DataFrame, key: str, by: Sequence[str], rows: int, extra: dict[str, str]) -> DataFrame:
    """One row per block of rows that agree in ``by``: sorted ids, their vectors end to end as bytes, lists of the extra columns."""
    types = {name: known.schema[name].dataType.simpleString() for name in by}
    kind = df.schema[key].dataType.simpleString()
    number = _number(df)

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = max(rows, len(frame) // 8)
            for part, group in frame.groupby(list(by), sort=False):
                for start in range(0, len(group), size):
                    chunk = group.iloc[start : start + size].sort_values("id")
                    lists = {name: [[None if x is None else x for x in chunk[name]]] for name in extra}
                    flat = np.stack(chunk["v"].to_numpy()).astype(number).tobytes()
                    yield pd.DataFrame({**dict(zip(by, ([x] for x in part))), "ids": [chunk["id"].to_numpy()], "m": [flat], **lists})

    fields = [f"{n} {t}" for n, t in types.items()] + [f"ids array<{kind}>", "m binary"]
    fields += [f"{n} array<{t}>" for n, t in extra.items()]
    return known.mapInPandas(blocks, ", ".join(fields))


def _number(df: DataFrame) -> str:
    """The least number type that holds the vectors exactly."""
    return "float32" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"


_NEVER = np.iinfo(np.int64).max


def _skip_cells(item_ids: np.ndarray, skips) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every (query, unwanted item) that the sorted items hold."""
    sizes = [0 if s is None else len(s) for s in skips]
    if not len(item_ids) or not sum(sizes):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    wanted = np.concatenate([np.asarray(s) for s in skips if s is not None and len(s)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.minimum(np.searchsorted(item_ids, wanted), len(item_ids) - 1)
    hit = item_ids[cols] == wanted
    return rows[hit], cols[hit]


def _block_topk(query_ids, query_matrix, item_ids, item_matrix, skips, k: int, unit: bool):
    """Best k items for each query, by (rounded score desc, id asc), with their ranks.

    Items are sorted by id, their vectors as stored. They are met ITEM_BLOCK at a time; one integer
    orders by score first, then position.
    """
    n = len(item_ids)
    rows, cols = _skip_cells(item_ids, skips) if skips is not None else (None, None)
    best = np.zeros((len(query_ids), 0), dtype=np.int64)
    for start in range(0, n, ITEM_BLOCK):
        end = min(start + ITEM_BLOCK, n)
        items = _scaled(item_matrix[start:end], unit)
        scores = np.rint(query_matrix @ items.T * SCORE_SCALE).astype(np.int64)
        keys = np.arange(start, end) - scores * n
        if rows is not None:
            inside = (cols >= start) & (cols < end)
            keys[rows[inside], cols[inside] - start] = _NEVER
        best = np.concatenate([best, keys], axis=1)
        if best.shape[1] > k:
            best = np.partition(best, k - 1, axis=1)[:, :k]
    best.sort(axis=1)
    found = best != _NEVER
    at = np.mod(best, max(n, 1))
    ranks = np.broadcast_to(np.arange(1, best.shape[1] + 1), best.shape)
    scores = (at - best)[found] // n / SCORE_SCALE
    return np.repeat(query_ids, best.shape[1])[found.ravel()], item_ids[at[found]], scores, ranks[found]


class _Running:
    """Best k items so far of the queries of a group, over the item blocks that they meet.

    Only what reaches a query's k-th score so far is kept, and cut to k a query when that many more have come.
    Products are made of floats first; exact ones only of pairs that can reach the score within the error of those.
    ``parts`` are the rows of the queries that meet items together (blocks of the queries, without): each has
    lists of its own, so a query of several parts has several. Scores are rounded to whole steps, ``scale`` in a unit.
    """

    def __init__(
        self, ids: np.ndarray, flat: np.ndarray, skips, k: int, parts: list[np.ndarray] | None = None, scale: float = SCORE_SCALE
    ) -> None:
        self.scale = scale
        self.ids, self.matrix, self.skips, self.k = ids, flat.reshape(len(ids), -1), skips, k
        self.parts = [np.arange(a, min(a + QUERY_BLOCK, len(ids))) for a in range(0, len(ids), QUERY_BLOCK)] if parts is None else parts
        self.least = [np.full(len(rows), np.finfo(float).min) for rows in self.parts]
        self.lengths = np.linalg.norm(self.matrix, axis=1)
        with np.errstate(over="ignore"):
            self.floats = self.matrix.astype(np.float32)
        # Per part: (place in the part, item, score) as columns, and how many more than after the last cut.
        self.kept: list[list[tuple]] = [[] for _ in self.parts]
        self.more = [0] * len(self.parts)

    def meet(self, item_ids: np.ndarray, flat: np.ndarray) -> None:
        items = flat.reshape(len(item_ids), -1)
        rough = self._rough(items)
        rows, cols = _skip_cells(item_ids, self.skips) if self.skips is not None else (None, None)
        for part, own in enumerate(self.parts):
            unwanted = None
            if rows is not None:
                inside = (rows >= own[0]) & (rows <= own[-1])
                unwanted = rows[inside] - own[0], cols[inside]
            self.meet_part(part, item_ids, items, rough, unwanted)

    def _rough(self, items: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The items as floats and the length of the longest; None where floats could overflow or a number is none."""
        longest = float(np.linalg.norm(items, axis=1).max(initial=0))
        within = longest < ROUGH_MOST and self.lengths.max(initial=0) < ROUGH_MOST and longest * self.lengths.max(initial=0) < ROUGH_MOST
        return (items.astype(np.float32), longest) if within else None

    def meet_part(
        self, part: int, item_ids: np.ndarray, items: np.ndarray, rough: tuple[np.ndarray, float] | None,
        unwanted: tuple | None = None, among: np.ndarray | None = None,
    ) -> None:
        """``among`` are the places of the part's queries that meet the items; all, without."""
        own, least = self.parts[part], self.least[part]
        if among is not None:
            own, least = own[among], least[among]
        r, c, products = self._reaching(own, least, items, rough, unwanted)
        if len(r):
            places = r if among is None else among[r]
            self.kept[part].append((places.astype(np.int32), item_ids[c], np.rint(products * self.scale)))
            self.more[part] += len(r)
        if self.more[part] >= len(self.parts[part]) * self.k:
            self._trim(part)

    def _reaching(self, own: np.ndarray, least: np.ndarray, items: np.ndarray, rough: tuple | None, unwanted: tuple | None) -> tuple:
        """Rows, columns and exact products of the pairs that reach the least score of their query."""
        if rough is not None and len(items):
            floats, longest = rough
            about = self.floats[own] @ floats.T
            if unwanted is not None:
                about[unwanted] = -np.inf
            # Numbers lose at most 2**-24 of themselves each, a sum of d products d times as much of the product of the lengths.
            error = (items.shape[1] + 4) * 2.0**-24 * longest * self.lengths[own] + 1e-9
            bound = np.nextafter(np.maximum(least - error, -1e38).astype(np.float32), np.float32(-np.inf))
            some = np.flatnonzero(about.max(axis=1) >= bound)
            r, c = np.divmod(np.flatnonzero(about[some] >= bound[some, None]), len(items))
            r = some[r]
            if len(r) * MANY < about.size:
                products = np.einsum("ij,ij->i", self.matrix[own[r]], items[c])
                near = products >= least[r]
                return r[near], c[near], products[near]
        products = self.matrix[own] @ items.T
        if unwanted is not None:
            products[unwanted] = -np.inf
        if rough is None:
            products[np.isnan(products)] = -np.inf
        if products.shape[1] > self.k:
            # What lies a step below a query's k-th of these has no place in its list.
            last = products.shape[1] - self.k
            least = np.fmax(least, np.partition(products, last, axis=1)[:, last] - 1 / self.scale)
        r, c = np.nonzero(products >= least[:, None])
        return r, c, products[r, c]

    def _trim(self, part: int) -> None:
        """Drop what lies below the k-th score of its query; equal scores stay, unless they are many."""
        r, items, scores = (np.concatenate(c) for c in zip(*self.kept[part]))
        queries = len(self.parts[part])
        counts = np.bincount(r, minlength=queries)
        width = counts.max()
        if queries * width > 4 * len(r) or width <= self.k:
            return self._cut(part)
        order = np.argsort(r.astype(np.uint16) if queries < 1 << 16 else r, kind="stable")
        r, items, scores = r[order], items[order], scores[order]
        table = np.full((queries, width), -np.inf)
        table[r, np.arange(len(r)) - (np.cumsum(counts) - counts)[r]] = scores
        last = np.partition(table, width - self.k, axis=1)[:, width - self.k]
        near = scores >= last[r]
        self.kept[part], self.more[part] = [(r[near], items[near], scores[near])], 0
        if near.sum() > 2 * queries * self.k:
            return self._cut(part)
        full = counts >= self.k
        self.least[part][full] = (last[full] - 1) / self.scale

    def _cut(self, part: int) -> None:
        r, items, scores = (np.concatenate(c) for c in zip(*self.kept[part]))
        order = np.lexsort((items, -scores, r))
        r, items, scores = r[order], items[order], scores[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < self.k
        r, items, scores = r[first], items[first], scores[first]
        self.kept[part], self.more[part] = [(r, items, scores)], 0
        # The products of a score lie within half a step of it.
        last = np.flatnonzero(np.bincount(r) == self.k)
        self.least[part][last] = (scores[np.searchsorted(r, last, "right") - 1] - 1) / self.scale

    def rows(self) -> Iterator[pd.DataFrame]:
        for part, kept in enumerate(self.kept):
            if kept:
                self._cut(part)
                r, items, scores = self.kept[part][0]
                yield self._frame(self.parts[part][r], items, scores, np.arange(len(r)) - np.searchsorted(r, r) + 1)

    def merged_rows(self) -> Iterator[pd.DataFrame]:
        """The best k distinct items of a query over the lists of all parts that it belongs to."""
        known = [part for part, kept in enumerate(self.kept) if kept]
        if not known:
            return
        lists = []
        for part in known:
            self._cut(part)
            r, items, scores = self.kept[part][0]
            lists.append((self.parts[part][r], items, scores))
        r, items, scores = (np.concatenate(c) for c in zip(*lists))
        order = np.lexsort((-scores, items, r))
        r, items, scores = r[order], items[order], scores[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (items[1:] != items[:-1])])
        r, items, scores = r[new], items[new], scores[new]
        order = np.lexsort((items, -scores, r))
        r, items, scores = r[order], items[order], scores[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        first = rank <= self.k
        yield self._frame(r[first], items[first], scores[first], rank[first])

    def _frame(self, r: np.ndarray, items: np.ndarray, scores: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": self.ids[r], "i": items, "score": scores / self.scale, "rank": rank.astype(np.int32)})


class _OfCells(_Running):
    """The same for queries that meet only the items of their cells: one list per query and cell."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, cells: np.ndarray, k: int) -> None:
        owner, cell = np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel()
        order = np.argsort(cell, kind="stable")
        found, starts = np.unique(cell[order], return_index=True)
        super().__init__(ids, flat, None, k, np.split(owner[order], starts[1:]))
        self.part_of = {c: part for part, c in enumerate(found)}

    def meet_cells(self, item_ids: np.ndarray, flat: np.ndarray, cells: np.ndarray) -> None:
        items = flat.reshape(len(item_ids), -1)
        rough = self._rough(items)
        for table in cells.T:
            order = np.argsort(table, kind="stable")
            found, starts = np.unique(table[order], return_index=True)
            for cell, own in zip(found, np.split(order, starts[1:])):
                if cell in self.part_of:
                    own_rough = None if rough is None else (rough[0][own], rough[1])
                    self.meet_part(self.part_of[cell], item_ids[own], items[own], own_rough)


def _matrix(vectors: pd.Series, unit: bool) -> np.ndarray:
    return _scaled(np.stack(vectors.to_numpy()), unit)


def _scaled(matrix: np.ndarray, unit: bool) -> np.ndarray:
    matrix = matrix.astype(float)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + V.EPSILON) if unit else matrix


def _parts(frame: pd.DataFrame, number: str) -> dict:
    """Sorted ids and vectors, not widened, of each part of the items: every Python worker keeps them."""
    out = {}
    for part, group in frame.groupby("part", sort=False):
        group = group.sort_values("id")
        out[part] = group["id"].to_numpy(), np.stack(group["v"].to_numpy()).astype(number)
    return out


def _columns(df: DataFrame, key: str, by: str | None, skip: str | None = None, cells: str | None = None) -> DataFrame:
    skip_type = df.schema[skip].dataType.simpleString() if skip else "array<int>"
    return df.filter(F.col("embedding").isNotNull()).select(
        F.col(key).alias("id"),
        F.col("embedding").cast("array<double>").alias("v"),
        (F.col(by) if by else F.lit(0)).alias("part"),
        (F.col(skip) if skip else F.lit(None).cast(skip_type)).alias("skip"),
        *([F.col(cells).alias("cells")] if cells else []),
    )


def _as_lists(frames: Iterator[pd.DataFrame], query_key: str) -> Iterator[pd.DataFrame]:
    """Frames of ranked rows, whole lists of some queries, as one row per query; of a repeated item the lowest score."""
    for frame in frames:
        q, items, scores, rank = (frame.iloc[:, at].to_numpy() for at in range(4))
        number = np.cumsum(rank == 1) - 1
        order = np.lexsort((items, number))
        again = (number[order][1:] == number[order][:-1]) & (items[order][1:] == items[order][:-1])
        if again.any():
            # Equal items keep their order: the last of them is the farthest.
            kept = np.sort(order[np.concatenate([~again, [True]])])
            q, items, scores, number = q[kept], items[kept], scores[kept], number[kept]
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        if items.dtype.kind == "f":
            # Ids with nulls among them.
            items = np.array([None if x != x else int(x) for x in items], dtype=object)
        lists = {"found": np.split(items, starts[1:]), "scores": np.split(scores, starts[1:])} if len(q) else {"found": [], "scores": []}
        yield pd.DataFrame({query_key: q[starts], **lists})


def _lists_schema(query_key: str, query_type: str, item_type: str) -> str:
    return f"`{query_key}` {query_type}, found array<{item_type}>, scores array<double>"


def _topk_of_matrix(
    queries: DataFrame, items: DataFrame, k: int, by: str | None, unit: bool, skip: str | None,
    query_key: str, item_key: str, tasks: int, listed: bool = False,
) -> DataFrame:
    """Top-k against items that fit a broadcast; k ranked rows per query leave the task."""
    known = _columns(items, item_key, by).select("id", "v", "part").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast(_parts(known, _number(items)) if len(known) else {})

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = shared.value
        for frame in frames:
            for part, group in frame.groupby("part", sort=False):
                if part not in parts:
                    continue
                ids, matrix = parts[part]
                for start in range(0, len(group), QUERY_BLOCK):
                    chunk = group.iloc[start : start + QUERY_BLOCK]
                    skips = list(chunk["skip"]) if skip else None
                    q, i, score, rank = _block_topk(
                        chunk["id"].to_numpy(), _matrix(chunk["v"], unit), ids, matrix, skips, k, unit
                    )
                    yield pd.DataFrame({query_key: q, item_key: i, "score": score, "rank": rank.astype(np.int32)})

    query_type = queries.schema[query_key].dataType.simpleString()
    item_type = items.schema[item_key].dataType.simpleString()
    asked = _columns(queries, query_key, by, skip).repartition(tasks)
    if listed:
        return asked.mapInPandas(lambda frames: _as_lists(multiply(frames), query_key), _lists_schema(query_key, query_type, item_type))
    schema = f"`{query_key}` {query_type}, `{item_key}` {item_type}, score double, rank int"
    return asked.mapInPandas(multiply, schema)


def item_matrix(items: DataFrame, most: int = BROADCAST_BYTES) -> Broadcast | None:
    """Sorted ids and vectors, as stored, of the items as a broadcast; None beyond ``most`` counted bytes."""
    number = np.dtype(_number(items))
    size = items.agg(F.sum(F.size("embedding") * number.itemsize)).first()[0] or 0
    if size > most:
        return None
    known = items.filter(F.col("embedding").isNotNull()).select(F.col("item_id").alias("id"), F.col("embedding").alias("v"))
    known = known.toPandas().sort_values("id")
    matrix = np.stack(known["v"].to_numpy()).astype(number) if len(known) else np.zeros((0, 1))
    return items.sparkSession.sparkContext.broadcast((known["id"].to_numpy(np.int64), matrix))


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = C.ANN_K,
    query_key: str = "user_id",
    item_key: str = "item_id",
    by: str | None = None,
    unit: bool = True,
    skip: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    listed: bool = False,
) -> DataFrame:
    """Exact top-k items per query by cosine (``unit``) or dot product.

    ``skip`` names an array column of the queries with items to leave out.
    ``listed`` gives one row per query with its distinct items (``found``), nearest first, and their ``scores``.

    With ``by`` both sides carry that column and only equal values meet. The
    item side is broadcast when its counted size allows; otherwise its blocks are
    sent to groups of queries (``_topk_of_groups``).
    """
    spark = queries.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = items.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    if size <= broadcast_bytes:
        return _topk_of_matrix(queries, items, k, by, unit, skip, query_key, item_key, tasks, listed)
    return _topk_of_groups(queries, items, k, by, unit, skip, query_key, item_key, size, listed=listed)


def _topk_of_groups(
    queries: DataFrame, items: DataFrame, k: int, by: str | None, unit: bool, skip: str | None,
    query_key: str, item_key: str, size: int, cells: str | None = None, listed: bool = False,
) -> DataFrame:
    """Top-k against items of any size: k ranked rows per query leave the task that holds its group.

    A group has as many queries as LIST_BYTES of running lists allow, so what is shuffled is
    the queries once and the items once per group. ``cells`` names an array column of both sides:
    pairs that share no cell don't meet.
    """
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    asked = cut_lineage(_columns(queries, query_key, by, skip, cells))
    counts = asked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    lists = k * (len(asked.select("cells").first()[0]) if cells and total else 1)
    most = max(QUERY_BLOCK, min(LIST_BYTES // (PAIR_BYTES * lists), -(-total // (GROUPS * cores))))
    tasks = max(cores, -(-total // most))
    sizes = counts.select("part", F.ceil(F.col("n") / most).cast("int").alias("groups"))

    known = _columns(items, item_key, by, None, cells)
    if by:
        # Bring a part's rows together so that its blocks fill up; the salt spreads a crowded part over several tasks.
        side = max(2, -(-size // BROADCAST_BYTES))
        known = known.repartition("part", F.pmod(F.hash("id"), F.lit(side))).sortWithinPartitions("part")
        dealt, copied = (lambda df: df.join(sizes, "part")), (lambda df: df.join(sizes, "part"))
    else:
        dealt = copied = lambda df: df.withColumn("groups", F.lit(-(-total // most)))
    own = dealt(asked).withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    extra = {name: asked.schema[name].dataType.simpleString() for name, used in (("skip", skip), ("cells", cells)) if used}
    q = _pack(queries, own, query_key, ["part", "group"], QUERY_BLOCK, extra).withColumn("is_item", F.lit(False))
    some = {"cells": extra["cells"]} if cells else {}
    i = copied(_pack(items, known, item_key, ["part"], ITEM_BLOCK, some).withColumnRenamed("ids", "item_ids"))
    i = i.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    both = q.unionByName(i.withColumn("is_item", F.lit(True)), allowMissingColumns=True)
    # Groups of a part lie in tasks one after the other; in a task, a group's queries come before its items.
    task = F.pmod(F.xxhash64("part") + F.col("group"), F.lit(tasks)).cast("int")
    sent = both.repartitionById(tasks, task).sortWithinPartitions("part", "group", "is_item")
    widths = {False: np.dtype(_number(queries)), True: np.dtype(_number(items))}

    def started(blocks: list) -> _Running:
        ids = np.concatenate([np.asarray(b.ids) for b in blocks])
        matrix = np.concatenate([np.frombuffer(b.m, widths[False]).reshape(len(b.ids), -1) for b in blocks])
        if cells:
            return _OfCells(ids, _scaled(matrix, unit), np.concatenate([np.stack(b.cells) for b in blocks]), k)
        return _Running(ids, _scaled(matrix, unit), [s for b in blocks for s in b.skip] if skip else None, k)

    def ended(running: _Running | None) -> Iterator[pd.DataFrame]:
        if running is not None:
            yield from running.merged_rows() if cells else running.rows()

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, blocks, running = None, [], None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.part, row.group) != group:
                    yield from ended(running)
                    group, blocks, running = (row.part, row.group), [], None
                if not row.is_item:
                    blocks.append(row)
                    continue
                if running is None:
                    if not blocks:
                        continue
                    running, blocks = started(blocks), []
                ids = np.asarray(row.item_ids)
                matrix = _scaled(np.frombuffer(row.m, widths[True]).reshape(len(ids), -1), unit)
                if cells:
                    running.meet_cells(ids, matrix, np.stack(row.cells))
                else:
                    running.meet(ids, matrix)
        yield from ended(running)

    query_type, item_type = (df.schema[key].dataType.simpleString() for df, key in ((queries, query_key), (items, item_key)))
    if listed:
        return sent.mapInPandas(lambda frames: _as_lists(multiply(frames), query_key), _lists_schema(query_key, query_type, item_type))
    found = sent.mapInPandas(multiply, f"q {query_type}, i {item_type}, score double, rank int")
    return found.withColumnsRenamed({"q": query_key, "i": item_key})


def best_per_key(scored: DataFrame, keys: Sequence[str], k: int, item_key: str = "item_id") -> DataFrame:
    """Rank by (score desc, id asc) and keep the first k per key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), item_key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def category_topk(queries: DataFrame, items: DataFrame, k: int, query_key: str = "user_id") -> DataFrame:
    """Top-k within the category that each query names (several rows per query allowed)."""
    keyed = queries.withColumn("_q", F.struct(query_key, "category"))
    named = keyed.select(
        F.concat_ws("\u0001", F.col(query_key).cast("string"), "category").alias("qc"),
        "category",
        "embedding",
    )
    found = vector_topk(named, items, k, query_key="qc", by="category")
    parts = F.split("qc", "\u0001")
    key_type = queries.schema[query_key].dataType
    return found.select(
        parts[0].cast(key_type).alias(query_key),
        parts[1].alias("category"),
        "item_id",
        "score",
        "rank",
    )


def similar_items(items: DataFrame, n: int = C.SIMILAR_ITEMS) -> DataFrame:
    """Item-to-item neighbours: one more than n is searched and the item itself dropped."""
    probes = items.select(F.col("item_id").alias("probe_id"), "embedding")
    found = vector_topk(probes, items, n + 1, query_key="probe_id")
    others = found.filter(F.col("probe_id") != F.col("item_id")).drop("rank")
    return best_per_key(others, ["probe_id"], n)


def most_similar(items: DataFrame, probe: Column, k: int, exclude: Column | None = None) -> DataFrame:
    """k items by cosine distance to one vector; items without a vector come last."""
    pool = items if exclude is None else items.filter(F.col("item_id") != exclude)
    distance = F.round(F.lit(1.0) - V.cosine(F.col("embedding"), F.col("_probe")), 6)
    scored = pool.withColumn("_probe", probe).select("item_id", distance.alias("distance"))
    return scored.orderBy(F.asc_nulls_last("distance"), "item_id").limit(k)


# ---- approximate retrieval ------------------------------------------------------


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dim))


def cell_lists(dim: int, bits: int, tables: int, probes: int, seed: int = 7) -> Callable[..., Column]:
    """Arrow UDF: numbers of a vector's cells, the sign patterns under random hyperplanes.

    A table gives the own cell, then ``probes`` cells with the bits of the smallest margins flipped.
    """
    planes = _planes(dim, bits, tables, seed)

    @F.pandas_udf("array<int>")
    def cells(column: pd.Series) -> pd.Series:
        matrix = np.stack(column.to_numpy()).astype(float)
        powers = 1 << np.arange(bits)
        out = []
        for table in range(tables):
            margin = matrix @ planes[table].T
            own = (margin > 0) @ powers
            weakest = np.argsort(np.abs(margin), axis=1)[:, :probes]
            near = np.concatenate([own[:, None], own[:, None] ^ powers[weakest]], axis=1)
            out.append((near + (table << bits)).astype(np.int32))
        return pd.Series(list(np.concatenate(out, axis=1)))

    return cells


def vector_topk_lsh(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    dim: int,
    bits: int = 4,
    tables: int = 6,
    probes: int = 2,
    query_key: str = "user_id",
) -> DataFrame:
    """Approximate top-k: only items that share a cell with the query are compared.

    The best k of every cell that a query visits make up its list. Vectors travel once with the
    numbers of their cells, not once per cell. Choose ``bits`` so that a cell holds a few blocks
    of items; a crowded cell is still only a longer list of block products.
    """
    q = _with_cells(queries.select(query_key, "embedding"), cell_lists(dim, bits, tables, probes))
    i = _with_cells(items.select("item_id", "embedding"), cell_lists(dim, bits, tables, 0))
    found = _topk_of_groups(q, i, k, None, True, None, query_key, "item_id", 0, "cells")
    once = found.groupBy(query_key, "item_id").agg(F.max("score").alias("score"))
    return best_per_key(once, [query_key], k)


def _with_cells(vectors: DataFrame, cells: Callable[..., Column]) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull()).withColumn("cells", cells("embedding"))


# ---- candidates ---------------------------------------------------------------


def candidate_union(
    retrieved: DataFrame,
    users: DataFrame,
    exploration: DataFrame,
    trending: DataFrame,
) -> DataFrame:
    """Retrieved items, then exploration and trending items not yet present (score 0.0).

    ``exploration`` and ``trending`` are ranked lists (item_id, position) shared
    by all users; their first 5 and 10 entries are injected. ``retrieved`` may have one row per
    (user, item) or, from a search that gives lists, one row for each of ``users`` that has one: lists are dealt
    by user as they are and become rows only with the injected items added, so that no pair is grouped.
    """
    if "found" in retrieved.columns:
        return _union_of_lists(retrieved, users, exploration, trending)
    retrieved_rows = retrieved.select("user_id", "item_id", "score", F.lit(0).alias("source"))
    parts = [
        retrieved_rows,
        _inject(users, exploration, C.EXPLORATION_CANDIDATES, 1),
        _inject(users, trending, C.TRENDING_CANDIDATES, 2),
    ]
    # Dealt by user alone: what follows per user, ranks and look-ups, then needs no further shuffle.
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("user_id")
    first = merged.groupBy("user_id", "item_id").agg(
        F.min("source").alias("source"), F.min("score").alias("any"), F.min(F.when(F.col("source") == 0, F.col("score"))).alias("own")
    )
    # Injected rows of an item have one score.
    return first.select("user_id", "item_id", F.when(F.col("source") == 0, F.col("own")).otherwise(F.col("any")).alias("score"), "source")


def _union_of_lists(lists: DataFrame, users: DataFrame, exploration: DataFrame, trending: DataFrame) -> DataFrame:
    known = users.select("user_id").distinct()
    explored, trends = _head(exploration, C.EXPLORATION_CANDIDATES), _head(trending, C.TRENDING_CANDIDATES)
    none = F.array().cast(lists.schema["found"].dataType)
    found = F.coalesce("found", none)
    extra = F.array_except(F.array_union("_explored", "_trends"), found)
    rows = (
        # Lists are long, which the size that is guessed for them doesn't tell: never sent whole to all tasks.
        known.join(lists.hint("merge"), "user_id", "left")
        .withColumns({"_explored": explored, "_trends": trends})
        .select("user_id", "scores", "_explored", F.size(found).alias("_n"), F.concat(found, extra).alias("_all"))
        .select("user_id", "scores", "_explored", "_n", F.posexplode_outer("_all").alias("_at", "item_id"))
        .filter(F.col("_at").isNotNull())
    )
    own = F.col("_at") < F.col("_n")
    source = F.when(own, 0).when(F.array_contains("_explored", F.col("item_id")), 1).otherwise(2)
    score = F.when(own, F.get("scores", F.col("_at"))).otherwise(0.0)
    return rows.select("user_id", "item_id", score.alias("score"), source.alias("source"))


def _head(ranked: DataFrame, limit: int) -> Column:
    # The list is at most ``limit`` long: it travels as one array value.
    return ranked.filter(F.col("position") <= limit).agg(F.collect_list("item_id")).scalar()


def _inject(users: DataFrame, ranked: DataFrame, limit: int, source: int) -> DataFrame:
    ids = _head(ranked, limit)
    listed = users.select("user_id", ids.alias("_ids"))
    return listed.select(
        "user_id",
        F.explode("_ids").alias("item_id"),
        F.lit(0.0).alias("score"),
        F.lit(source).alias("source"),
    )
