"""SimHash fingerprints, and links within a Hamming distance by a generalised pigeonhole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.text import lower_words
from spanloom.session import stored

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Rows that a bucket may hold before it is split by more bits.
BUCKET = 1 << 15
#: Cost of emitting one key, in comparisons.
EMIT = 30.0


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    found = lower_words(text)
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = min(n, len(found))
    starts = np.concatenate([[0], ends[: len(found) - n] + 1]).tolist()
    cuts = map(slice, starts, ends[n - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both; 64 x 64 sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        cell = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cell))), pa.array(cell)], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for r in rows:
        out[r.cell] = r.n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size; a bit joins the group whose bits it follows most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        seed = max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: tie[b, group].mean())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds whose sum is distance - groups + 1, of the least estimated cost, by dynamic programming.

    -1 leaves a group out. A group's cost is the keys emitted and the pairs expected
    within its threshold, from how often two fingerprints differ in each of its bits.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for group in groups:
        chance = np.array([1.0])
        for q in differ[group]:
            chance = np.convolve(chance, [1 - q, q])
        reach = np.cumsum(chance)
        cost = [0.0]
        for t in range(distance + 1):
            keys = sum(comb(len(group), d) for d in range(t + 1))
            cost.append(EMIT * n * (keys + (t > 0)) + n * n / 2 * reach[min(t, len(reach) - 1)])
        costs.append(cost)
    total = distance + 1  # sum over groups of threshold + 1
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for cost in costs:
        row: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best[-1].items():
            for take in range(total - used + 1):
                now = (so_far + cost[take], [*chosen, take - 1])
                if used + take not in row or now < row[used + take]:
                    row[used + take] = now
        best.append(row)
    return best[-1][total]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed; every pair within ``distance`` meets in one of them."""
    found = min((allocate(n, both, g := correlated_groups(n, both, m), distance) + (g,) for m in range(1, distance + 2)), key=lambda x: x[0])
    return [(g, t) for g, t in zip(found[2], found[1]) if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def _probes(route: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(route).alias("route"), key.bitwiseXOR(x).alias("key"), F.lit(False).alias("own")))


def _keys(fp: Column, groups: list[tuple[list[int], int]]) -> Column:
    """The (route, key, own) entries of a fingerprint: its own key in each group, and its probes around it."""
    parts = []
    for route, (bits, threshold) in enumerate(groups):
        key = fp.bitwiseAND(F.lit(_signed(_mask(bits))))
        parts.append(F.array(F.struct(F.lit(route).alias("route"), key.alias("key"), F.lit(True).alias("own"))))
        flips = [_signed(_mask(c)) for d in range(1, threshold + 1) for c in combinations(bits, d)]
        if flips:
            parts.append(_probes(route, key, flips))
    return F.concat(*parts)


def _linked(own: np.ndarray, probes: np.ndarray, ids: np.ndarray, probe_ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is within ``distance`` in a bucket: enough of them to connect it, not every pair.

    Whatever a row reaches leaves the set of those still to be reached, so a dense
    group of n rows takes about n steps.
    """
    out: list[tuple[int, int]] = []
    fps, nodes = np.concatenate([own, probes]), np.concatenate([ids, probe_ids])
    is_own = np.arange(len(fps)) < len(own)
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[k]) <= distance
            if not is_own[k]:
                near &= is_own[left]
            if near.any():
                reached = left[near]
                out += [(int(nodes[k]), int(x)) for x in nodes[reached]]
                front += reached.tolist()
                left = left[~near]
    return out


def bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) inside buckets with own fingerprints and probes."""

    def lists(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        return column.offsets.to_numpy(), flat.field(field).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, probes = batch.column(0), batch.column(1)
            at, fps = lists(own, "fp")
            _, ids = lists(own, "node")
            pat, pfps = lists(probes, "fp")
            _, pids = lists(probes, "node")
            at, pat = at - at[0], pat - pat[0]
            fps, pfps = fps.view(np.uint64), pfps.view(np.uint64)
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                a, b, c, d = at[i], at[i + 1], pat[i], pat[i + 1]
                if b - a == 2 and c == d:
                    if int(fps[a] ^ fps[a + 1]).bit_count() <= distance:
                        out.append((int(ids[a]), int(ids[a + 1])))
                else:
                    out += _linked(fps[a:b], pfps[c:d], ids[a:b], pids[c:d], distance)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return buckets.select("own", "probes").mapInArrow(run, "a long, b long")


def hamming_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, groups: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp, node) within ``distance`` of each other.

    Every pair within the distance lies in one component of the result. Buckets are
    counted first. One with over ``bucket`` rows is never gathered: its rows are dealt
    again by its key and part of the remaining bits, a further pigeonhole, until buckets
    are small enough. At the end the key holds all but 15 bits, so that even the worst
    one has at most 2 ** 15 rows.
    """
    groups = plan(*bit_statistics(fps), distance) if groups is None else groups
    masks = [_mask(bits) for bits, _ in groups]
    entries = fps.select("fp", "node", F.explode(_keys(F.col("fp"), groups)).alias("e")).select("fp", "node", "e.*")
    links = None
    while True:
        hot = stored(entries.groupBy("route", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("route", "key"), "hot")
        routes = {r.route for r in hot.select("route").distinct().collect()}
        splits = {r: [b for b in range(BITS) if not masks[r] >> b & 1] for r in routes}
        splits = {r: rest for r, rest in splits.items() if len(rest) > 15}
        hot = hot.filter(F.col("route").isin(list(splits))) if splits else None
        cold = entries.join(hot, ["route", "key"], "left_anti") if hot is not None else entries
        member = F.struct("fp", "node")
        found = cold.groupBy("route", "key").agg(F.collect_list(F.when(F.col("own"), member)).alias("own"), F.collect_list(F.when(~F.col("own"), member)).alias("probes"))
        found = bucket_links(found.filter((F.size("own") >= 1) & (F.size("own") + F.size("probes") >= 2)), distance)
        links = found if links is None else links.union(found)
        if hot is None:
            return links
        start, deeper = len(masks), {}
        for r, rest in sorted(splits.items()):
            m = distance + 1
            deeper[r] = list(range(len(masks), len(masks) + m))
            masks += [masks[r] | _mask(rest[k::m]) for k in range(m)]
        heat = entries.join(hot, ["route", "key"], "left_semi")
        table = F.create_map(*[x for r, new in deeper.items() for x in (F.lit(r), F.array(*[F.struct(F.lit(k).alias("route"), F.lit(_signed(masks[k] & ~masks[r])).alias("mask"), F.lit(_signed(masks[r])).alias("old")) for k in new]))])
        entries = heat.select("fp", "node", "key", "own", F.explode(table[F.col("route")]).alias("s")).select("fp", "node", F.col("s.route").alias("route"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("s.mask"))).alias("key"), "own")
        entries = stored(entries, f"split{start}")


def near_groups(docs: DataFrame, distance: int = DISTANCE, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents belong together if a chain of fingerprints joins them, each at most
    ``distance`` bits from the next; component_id is the smallest doc_id among them.
    Copies share a fingerprint and are compared once. Null and empty texts have
    fingerprint 0. A row with a null doc_id keeps null and counts for no component unless
    all its copies have none. Repeated rows stay. An empty table gives an empty table.
    """
    fps = stored(fingerprints(docs, n), "fps")
    kinds = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "kinds")
    found = components(hamming_links(kinds.filter("node IS NOT NULL"), distance))
    named = kinds.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id in each group; rows without an id stay."""
    drop = near_groups(docs).filter("doc_id != component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")
