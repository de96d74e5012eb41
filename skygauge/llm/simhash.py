"""SimHash near-duplicates through a Gray-order hierarchical index."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import local_roots, per_row, settle, text_of
from skygauge.llm.components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
LEAF = 1024
FAN = 32
PIECE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; 0 without words.

    A-Z count as a-z, words are cut at ASCII white space. Shingles are taken in pieces, so a
    very long text needs little memory beyond its words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    starts, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, starts, PIECE):
        hashes = np.fromiter(
            (digest(b" ".join(words[i:i + shingle]), seed) for i in range(at, min(at + PIECE, starts))),
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > starts, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row; a null text counts as empty."""
    def open_task():
        def run(texts):
            return ([int(np.uint64(fingerprint(t, shingle)).astype(np.int64)) for t in texts],)
        return run

    return per_row(df, {"id": F.col(id_col), "text": text_of(text_col)}, "fp long", open_task)


def _gray_rank(code: F.Column) -> F.Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _masks(bands: int) -> list[int]:
    """Masks that deal the 64 bits into runs; two codes with fewer differing bits than runs
    agree on one run at least."""
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows sorted by (band, pattern, Gray rank) into leaves of at most LEAF codes."""
    base, made = TaskContext.get().partitionId() << 33, 0
    held: list[tuple] = []

    def close(bands, tops, codes, cuts):
        nonlocal made
        rows = []
        for lo, hi in zip(cuts, cuts[1:]):
            part = codes[lo:hi]
            shared = ~(np.bitwise_or.reduce(part) ^ np.bitwise_and.reduce(part))
            rows.append((base + made, bands[lo], tops[lo], int(part[0] & shared), int(shared), part))
            made += 1
        return rows

    def table(rows):
        ids, bands, tops, patterns, shared, codes = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(bands, pa.int32()), pa.array(tops, pa.int64()),
             pa.array(patterns, pa.int64()), pa.array(shared, pa.int64()), pa.array(codes, pa.list_(pa.int64()))],
            names=["leaf", "band", "top", "pattern", "shared", "codes"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        band, top, code = (batch.column(n).to_numpy() for n in ("band", "top", "code"))
        if held:
            band, top, code = (np.concatenate([h, x]) for h, x in zip(held, (band, top, code)))
        new = np.flatnonzero((band[1:] != band[:-1]) | (top[1:] != top[:-1])) + 1
        starts = np.concatenate([[0], new, [len(code)]])
        cuts = [0]
        for lo, hi in zip(starts, starts[1:]):
            cuts.extend(range(int(lo) + LEAF, int(hi), LEAF))
            cuts.append(int(hi))
        held = [x[cuts[-2]:] for x in (band, top, code)]
        if len(cuts) > 2:
            yield table(close(band, top, code, cuts[:-1]))
    if held and len(held[0]):
        yield table(close(*held, [0, len(held[0])]))


def _linked(distance: int):
    """Links between the codes of two leaves (or inside one), as a spanning set per leaf pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                x = left.values.to_numpy().view(np.uint64)
                own = right.as_py() is None
                y = x if own else right.values.to_numpy().view(np.uint64)
                i, j = _search(x, y, distance)
                if own:
                    keep = i < j
                    i, j = i[keep], j[keep]
                both = x if own else np.concatenate([x, y])
                root = local_roots(len(both), i, j if own else j + len(x))
                hang = np.flatnonzero(root != np.arange(len(both)))
                out_a.append(both[hang].view(np.int64))
                out_b.append(both[root[hang]].view(np.int64))
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"]
                )
    return run


def _search(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``distance``: y's codes in runs of FAN, each with the bits its codes share;
    a run is left out for the codes of x that differ from those bits too often already."""
    found_x, found_y = [], []
    for lo in range(0, len(y), FAN):
        run = y[lo:lo + FAN]
        shared = ~(np.bitwise_or.reduce(run) ^ np.bitwise_and.reduce(run))
        near = np.flatnonzero(np.bitwise_count((x ^ run[0]) & shared) <= distance)
        if len(near):
            i, j = np.nonzero(np.bitwise_count(x[near][:, None] ^ run[None, :]) <= distance)
            found_x.append(near[i])
            found_y.append(j + lo)
    if not found_x:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_x), np.concatenate(found_y)


def code_links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``code`` within ``distance`` bits.

    Codes are dealt by ``distance + 1`` masked bit patterns: two codes in reach agree on one
    of them. Below a pattern they are sorted by Gray rank and cut into leaves of LEAF codes;
    a leaf holds the bits that its codes share as pattern and mask, and FAN leaves form a
    node with the bits shared by those. Nodes, leaves and runs inside a leaf whose shared
    bits already differ in more than ``distance`` places are pruned with all they hold.
    The range partitioning splits a pattern that many codes have. Exact: no pair is lost.
    """
    masks = _masks(distance + 1)
    rank = _gray_rank(F.col("code"))
    tops = F.explode(F.array(*(
        F.struct(F.lit(i).alias("band"), F.col("code").bitwiseAND(F.lit(m)).alias("top"))
        for i, m in enumerate(masks)
    )))
    leaves = settle(
        codes.select("code", tops.alias("t")).select("t.band", "t.top", "code", rank.alias("rank"))
        .repartitionByRange("band", "top", "rank").sortWithinPartitions("band", "top", "rank")
        .mapInArrow(_leaves, "leaf long, band int, top long, pattern long, shared long, codes array<long>")
    )
    inside = leaves.where(F.size("codes") > 1).select("codes", F.lit(None).cast("array<long>").alias("other"))

    thin = leaves.select("band", "top", "leaf", F.floor(F.col("leaf") / FAN).alias("node"), "pattern", "shared")
    ones, zeros = F.bit_and(F.col("pattern")), F.bit_and(F.bitwise_not("pattern").bitwiseAND(F.col("shared")))
    nodes = (
        thin.groupBy("band", "top", "node")
        .agg(ones.alias("ones"), zeros.alias("zeros"), F.count("*").alias("leaves"))
        .withColumn("pattern", F.col("ones")).withColumn("shared", F.col("ones").bitwiseOR(F.col("zeros")))
    )
    several = nodes.groupBy("band", "top").agg(F.sum("leaves").alias("n")).where("n > 1").select("band", "top")
    nodes = nodes.join(several, ["band", "top"]).select("band", "top", "node", "pattern", "shared")

    def side(frame, mark):
        return frame.select("band", "top", *(F.col(c).alias(f"{mark}_{c}") for c in frame.columns[2:]))

    unlike = (
        F.col("x_pattern").bitwiseXOR(F.col("y_pattern"))
        .bitwiseAND(F.col("x_shared")).bitwiseAND(F.col("y_shared"))
    )
    in_reach = F.bit_count(unlike) <= distance
    met = (
        side(nodes, "x").join(side(nodes, "y"), ["band", "top"])
        .where((F.col("x_node") <= F.col("y_node")) & in_reach)
        .select("band", "top", "x_node", "y_node")
    )
    leaf = thin.select("band", "top", "node", "leaf", "pattern", "shared")
    pairs = (
        met.join(side(leaf, "x"), ["band", "top", "x_node"]).join(side(leaf, "y"), ["band", "top", "y_node"])
        .where((F.col("x_leaf") < F.col("y_leaf")) & in_reach)
        .select("x_leaf", "y_leaf")
    )
    arrays = leaves.select("leaf", "codes")
    across = (
        pairs.join(arrays.select(F.col("leaf").alias("x_leaf"), "codes"), "x_leaf")
        .join(arrays.select(F.col("leaf").alias("y_leaf"), F.col("codes").alias("other")), "y_leaf")
        .select("codes", "other")
    )
    return inside.unionByName(across).mapInArrow(_linked(distance), "a long, b long")


def simhash_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """Group texts whose fingerprints are connected by steps of at most ``distance`` bits.

    Returns one row per row: id (the input's id), fp (long), fingerprint (16 hex digits) and
    component_id (the smallest id of the group). An id may be a struct that makes rows with
    repeated ids distinct; rows that repeat an id outright give repeated rows. Only the id and text columns are read, so other
    columns may have any name. A null text is empty; texts without words have fingerprint 0
    and form a group like any other; a null id is never the smallest unless all are null.
    An empty table gives no rows. Rows with equal fingerprints are aggregated first, so
    copies cost nothing further on.
    """
    prints = settle(fingerprints(df, id_col, text_col, shingle))
    codes = settle(prints.groupBy(F.col("fp").alias("code")).agg(F.min("id").alias("low")))
    groups = components(code_links(codes.select("code"), distance))
    rooted = codes.join(groups, codes["code"] == groups["node"], "left").select(
        "code", "low", F.coalesce("root", "code").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("code", "component_id")
    return prints.join(named, prints["fp"] == named["code"]).select(
        "id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
