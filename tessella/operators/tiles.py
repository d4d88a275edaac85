"""A matrix in tiles: blocks of sites x taxa as bytes, which the permutation null and the site scorers read.

A tile is SITES sites of TAXA taxa at most, one row, with its sites' counts over all taxa beside the codes. A cell is one
byte, and what a scorer needs of a site is in the tile, so scoring joins tiles with counts of taxa only, and a site's score
is a sum over its tiles.

A permuted matrix is never written. A permutation sends each cell of a site to another taxon by a key (functions.keyed), so
counts of a permuted matrix are added up where the tile is, and scores of a permuted matrix's sites look up the counts of
the taxon that a cell was sent to; a site's own counts are the same under any permutation.

A tile meets the counts of its own taxa. A permuted matrix's tiles meet the counts of all its taxa, which are one row: every
permutation gets the tiles dealt to it (`dealt`), so that permutations are worked on side by side, and what moves for one is
the matrix, a byte a cell. For scores the tiles are cut anew into few sites of all taxa (`columns`), so that a row of counts
meets as many tiles however many taxa there are, and a site's scores need no shuffle. `fits` tells whether such a row stays
below MOST_COUNTS bytes; for matrices beyond that, operators.delta has a form by cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keys, sent
from ..sources.shared import prepare, written

SITES, TAXA = 64, 1024
#: A 256th of the bytes of counts that a task adds up; bytes of the counts of all taxa in one row at most.
SOME_COUNTS, MOST_COUNTS = 1 << 20, 1 << 28
#: Cells of a tile of all taxa, about, and its sites at least; cells that one task adds up for a permutation, about; partitions of many permutations.
WIDE, LEAST, PART, DEALT = 1 << 19, 8, 1 << 24, 64
TILES = "aln_id string, site_block int, taxon_block int, first_taxon int, taxa int, sites binary, data binary"


def _sites(row) -> np.ndarray:
    return np.frombuffer(row["sites"], np.int32)


def _codes(row) -> np.ndarray:
    """A tile's codes (taxa, sites)."""
    return np.frombuffer(row["data"], np.int8).reshape(row["taxa"], -1)


def _onehot_sums(x: np.ndarray, n_states: int, axis: int) -> np.ndarray:
    return np.stack([(x == c).sum(axis=axis) for c in range(n_states)], axis=-1).astype(np.int64)


def _lists(x: np.ndarray) -> pa.ListArray:
    """Rows of a matrix of longs as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: c[i].as_py() for name, c in zip(b.schema.names, b.columns)}


def tiles(cells: DataFrame, n_states: int) -> DataFrame:
    """Tiles of cells (aln_id, taxon_idx, col_idx, code), written: TILES with total_taxa and site_counts (longs, sites x
    states, over all taxa). A cell that is not there is a gap."""

    def make(key, table):
        t, s, c = (table[x].to_numpy() for x in ("taxon_idx", "col_idx", "code"))
        first, sites = key[2].as_py() * TAXA, np.unique(s)
        data = np.full((int(t.max()) - first + 1, len(sites)), -1, np.int8)
        data[t - first, np.searchsorted(sites, s)] = c
        values = [key[0].as_py(), key[1].as_py(), key[2].as_py(), first, len(data), sites.astype(np.int32).tobytes(), data.tobytes()]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.binary()])], [x.split()[0] for x in TILES.split(", ")])

    prepare(cells.sparkSession)
    keyed = cells.select("aln_id", F.expr(f"col_idx div {SITES}").cast("int").alias("site_block"), F.expr(f"taxon_idx div {TAXA}").cast("int").alias("taxon_block"), F.col("taxon_idx").cast("int").alias("taxon_idx"), F.col("col_idx").cast("int").alias("col_idx"), F.col("code").cast("byte").alias("code"))
    made = written(keyed.groupBy("aln_id", "site_block", "taxon_block").applyInArrow(make, TILES), "tile-cells")
    # What tiles meet is written, so that Spark knows its size and leaves the tiles where they are.
    total = written(made.groupBy("aln_id").agg(F.max(F.col("first_taxon") + F.col("taxa")).alias("total_taxa")), "tile-totals")
    held = site_counts(made, n_states).groupBy("aln_id", "site_block").agg(F.sort_array(F.collect_list(F.struct("col_idx", "gone"))).alias("l"))  # SITES rows
    held = written(held.select("aln_id", "site_block", F.transform("l", lambda x: x["col_idx"]).alias("all_sites"), F.flatten(F.transform("l", lambda x: x["gone"])).alias("site_counts")), "tile-sites")
    return written(made.join(total, "aln_id").join(held, ["aln_id", "site_block"]), "tiles")


def site_counts(made: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, site_block, col_idx, gone): each site's counts over all taxa, summed over its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            x = _codes(r)
            n = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([r["aln_id"]] * n), pa.array([r["site_block"]] * n, pa.int32()), pa.array(_sites(r)), _lists(_onehot_sums(x, n_states, 0))], ["aln_id", "site_block", "col_idx", "gone"])

    each = made.select("aln_id", "site_block", "taxa", "sites", "data").mapInArrow(run, "aln_id string, site_block int, col_idx int, gone array<bigint>")
    return each.groupBy("aln_id", "site_block", "col_idx").agg(F.array(*[F.sum(F.col("gone")[c]) for c in range(n_states)]).alias("gone"))


def margins(made: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, taxon_idx, o): raw counts of every taxon over the sites of the tiles, summed tile by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            x = _codes(r)
            yield pa.RecordBatch.from_arrays([pa.array([r["aln_id"]] * len(x)), pa.array(np.arange(len(x)) + r["first_taxon"], pa.int32()), _lists(_onehot_sums(x, n_states, 1))], ["aln_id", "taxon_idx", "o"])

    each = made.select("aln_id", "first_taxon", "taxa", "data").mapInArrow(run, "aln_id string, taxon_idx int, o array<bigint>")
    return each.groupBy("aln_id", "taxon_idx").agg(F.array(*[F.sum(F.col("o")[c]) for c in range(n_states)]).alias("o"))


def only(made: DataFrame, sites: DataFrame) -> DataFrame:
    """Tiles of the given sites (aln_id, col_idx) alone; tiles without such a site are not read into Python. sites is a
    batch of a prune loop, which a parameter bounds."""
    wanted = sites.groupBy("aln_id", F.expr(f"col_idx div {SITES}").cast("int").alias("site_block")).agg(F.collect_list(F.col("col_idx").cast("int")).alias("wanted"))
    return _picked(made.join(wanted, ["aln_id", "site_block"]), True)


def without(made: DataFrame, sites: DataFrame) -> DataFrame:
    """Tiles less the given sites (aln_id, col_idx); tiles that lose none pass as they are."""
    wanted = sites.groupBy("aln_id", F.expr(f"col_idx div {SITES}").cast("int").alias("site_block")).agg(F.collect_list(F.col("col_idx").cast("int")).alias("wanted"))
    joined = made.join(wanted, ["aln_id", "site_block"], "left")
    return joined.filter("wanted IS NULL").drop("wanted").unionByName(_picked(joined.filter("wanted IS NOT NULL"), False))


def _picked(joined: DataFrame, keep: bool) -> DataFrame:
    schema = joined.drop("wanted").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: c[i].as_py() for name, c in zip(b.schema.names, b.columns)}
                at = np.isin(_sites(r), r["wanted"]) == keep
                if at.any():
                    counts = np.array(r["site_counts"]).reshape(len(r["all_sites"]), -1)
                    stay = np.isin(r["all_sites"], _sites(r)[at])
                    r |= {"sites": _sites(r)[at].tobytes(), "data": _codes(r)[:, at].tobytes(), "all_sites": [s for s, k in zip(r["all_sites"], stay) if k], "site_counts": counts[stay].ravel().tolist()}
                    names = schema.names
                    yield pa.RecordBatch.from_arrays([pa.array([r[n]], b.schema.field(n).type) for n in names], names)

    return joined.mapInArrow(run, schema)


def permuted_cells(made: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(aln_id, perm, taxon_idx, col_idx, code) of every permutation: what the counts below count, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            x, sites = _codes(r), _sites(r)
            for p in range(permutations):
                to = _moved(r, x, sites, seed + p)
                n = x.size
                yield pa.RecordBatch.from_arrays([pa.array([r["aln_id"]] * n), pa.array(np.full(n, p, np.int32)), pa.array(to.ravel().astype(np.int32)), pa.array(np.tile(sites, len(x))), pa.array(x.ravel().astype(np.int32))], ["aln_id", "perm", "taxon_idx", "col_idx", "code"])

    return made.mapInArrow(run, "aln_id string, perm int, taxon_idx int, col_idx int, code int")


def plain_cells(made: DataFrame) -> DataFrame:
    """(aln_id, taxon_idx, col_idx, code) of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            x, sites = _codes(r), _sites(r)
            taxa = np.repeat(np.arange(len(x)) + r["first_taxon"], len(sites))
            yield pa.RecordBatch.from_arrays([pa.array([r["aln_id"]] * x.size), pa.array(taxa.astype(np.int32)), pa.array(np.tile(sites, len(x))), pa.array(x.ravel().astype(np.int32))], ["aln_id", "taxon_idx", "col_idx", "code"])

    return made.mapInArrow(run, "aln_id string, taxon_idx int, col_idx int, code int")


def _moved(r: dict, x: np.ndarray, sites: np.ndarray, seed: int) -> np.ndarray:
    """The taxon that each cell of a tile goes to."""
    taxon = np.broadcast_to((np.arange(len(x)) + r["first_taxon"])[:, None], x.shape)
    return sent(taxon, r["total_taxa"], np.broadcast_to(keys(seed, sites), x.shape))


def dealt(made: DataFrame, permutations: int, *by: str) -> DataFrame:
    """Each tile once for each permutation (perm), in partitions by alignment, permutation and by."""
    perms = F.slice(F.sequence(F.lit(0), F.lit(permutations)), 1, permutations)
    return _apart(made.withColumn("perm", F.explode(perms)), permutations, *by)


def _apart(table: DataFrame, permutations: int, *by: str) -> DataFrame:
    """table in partitions by alignment, permutation and by, which Spark does not put together: a byte is worth much work."""
    n = max(min(DEALT, 2 * permutations), 2 * table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(n, "aln_id", "perm", *by)


def permuted_counts(made: DataFrame, n_states: int, permutations: int, seed: int) -> DataFrame:
    """(aln_id, perm, taxon_idx, o): raw counts of every permuted matrix.

    A task adds up the tiles of a permutation, PART cells about, before it sends anything, as long as the counts of all taxa
    fit in 256 x SOME_COUNTS bytes; else it sends what a tile adds to each taxon. Spark then adds both up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, waiting = None, np.zeros(0, np.int64), []

        def emit(name: str, p: int, taxa: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(taxa), 1 << 16):
                t, part = taxa[i : i + (1 << 16)], o[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(np.full(len(t), p, np.int32)), pa.array(t.astype(np.int32)), _lists(part)], ["aln_id", "perm", "taxon_idx", "o"])

        def add() -> None:
            nonlocal sums
            if waiting:
                sums += np.bincount(np.concatenate(waiting), minlength=len(sums))
                waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None:
                add()
                yield from emit(*key, np.arange(len(sums) // n_states), sums.reshape(-1, n_states))

        for r in rows(batches):
            x, total, p = _codes(r), r["total_taxa"], r["perm"]
            to = _moved(r, x, _sites(r), seed + p)
            if total * n_states * 8 <= 256 * SOME_COUNTS:
                if (r["aln_id"], p) != key:
                    yield from flush()
                    key, sums = (r["aln_id"], p), np.zeros(total * n_states, np.int64)
                waiting.append((to * n_states + x)[x >= 0])
                # As many cells as there are counts, so that adding up costs no more than the cells do.
                if sum(map(len, waiting)) >= len(sums):
                    add()
            else:
                taxa, row = np.unique(to, return_inverse=True)  # with those that only get gaps
                row = row.reshape(x.shape)
                o = np.bincount((row * n_states + x)[x >= 0], minlength=len(taxa) * n_states).reshape(-1, n_states)
                yield from emit(r["aln_id"], p, taxa, o.astype(np.int64))
        yield from flush()

    part = F.expr(f"site_block div greatest(1L, {PART} div ({SITES}L * total_taxa))").alias("part")
    keyed = dealt(made.select("aln_id", part, "first_taxon", "taxa", "total_taxa", "sites", "data"), permutations, "part").sortWithinPartitions("aln_id", "perm")
    each = keyed.mapInArrow(run, "aln_id string, perm int, taxon_idx int, o array<bigint>")
    return each.groupBy("aln_id", "perm", "taxon_idx").agg(F.array(*[F.sum(F.col("o")[c]) for c in range(n_states)]).alias("o"))


def columns(made: DataFrame, n_states: int) -> DataFrame:
    """Tiles cut anew into LEAST sites or more of all taxa, WIDE cells about: (aln_id, first_taxon, taxa, total_taxa, sites, data,
    gone), gone being the sites' counts. A cell that is not there is a gap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            x, sites = _codes(r), _sites(r)
            gone = np.array(r["site_counts"], np.int64).reshape(-1, n_states)[np.isin(r["all_sites"], sites)]
            part = (sites - r["site_block"] * SITES) // min(SITES, max(LEAST, WIDE // r["total_taxa"]))
            for i in np.unique(part):
                at = part == i
                values = [r["aln_id"], r["site_block"], int(i), r["first_taxon"], r["taxa"], r["total_taxa"], sites[at].tobytes(), x[:, at].tobytes(), gone[at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names)

    def put(table: pa.Table) -> pa.Table:
        parts = list(rows(table.to_batches()))
        total, sites = parts[0]["total_taxa"], np.unique(np.concatenate([_sites(r) for r in parts]))
        data, gone = np.full((total, len(sites)), -1, np.int8), np.zeros((len(sites), n_states), np.int64)
        for r in parts:
            at = np.searchsorted(sites, _sites(r))
            data[r["first_taxon"] : r["first_taxon"] + r["taxa"], at] = _codes(r)
            gone[at] = np.frombuffer(r["gone"], np.int64).reshape(-1, n_states)
        values = [parts[0]["aln_id"], parts[0]["site_block"], parts[0]["part"], 0, total, total, sites.tobytes(), data.tobytes(), gone.tobytes()]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds)], names)

    names = ["aln_id", "site_block", "part", "first_taxon", "taxa", "total_taxa", "sites", "data", "gone"]
    kinds = [pa.string(), *[pa.int32()] * 5, *[pa.binary()] * 3]
    schema = "aln_id string, site_block int, part int, first_taxon int, taxa int, total_taxa int, sites binary, data binary, gone binary"
    own = made.select("aln_id", "site_block", "first_taxon", "taxa", "total_taxa", "sites", "data", "all_sites", "site_counts")
    return own.mapInArrow(cut, schema).groupBy("aln_id", "site_block", "part").applyInArrow(put, schema).drop("site_block", "part")


def fits(made: DataFrame, n_states: int) -> bool:
    """Whether the counts of all taxa of every alignment make a row of at most MOST_COUNTS bytes."""
    most = made.agg(F.max("total_taxa").alias("n")).first()["n"] or 0
    return most * n_states * 4 <= MOST_COUNTS


def _packed(f: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, perm, counts): fudged counts of all taxa of a permuted matrix as int32 (taxa, states)."""

    def make(key, table):
        t = table["taxon_idx"].to_numpy()
        out = np.zeros((int(t.max()) + 1, n_states), np.int32)
        out[t] = table["o"].combine_chunks().flatten().to_numpy().reshape(-1, n_states)
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()])], ["aln_id", "perm", "counts"])

    return f.select("aln_id", "perm", "taxon_idx", "o").groupBy("aln_id", "perm").applyInArrow(make, "aln_id string, perm int, counts binary")


def _own(f: DataFrame, n_states: int) -> DataFrame:
    """(aln_id, taxon_block, counts, tc): fudged counts of a tile's own taxa as int32 (taxa, states), and the matrix's
    totals: all that its tiles need where nothing is permuted."""

    def make(key, table):
        t = table["taxon_idx"].to_numpy()
        out = np.zeros((int(t.max()) % TAXA + 1, n_states), np.int32)
        out[t % TAXA] = table["o"].combine_chunks().flatten().to_numpy().reshape(-1, n_states)
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()]), pa.array([table["tc"][0].as_py()], pa.list_(pa.int64()))], ["aln_id", "taxon_block", "counts", "tc"])

    keyed = f.select("aln_id", F.expr(f"taxon_idx div {TAXA}").cast("int").alias("taxon_block"), "taxon_idx", "o", "tc")
    return keyed.groupBy("aln_id", "taxon_block").applyInArrow(make, "aln_id string, taxon_block int, counts binary, tc array<bigint>")


def left_out(o: np.ndarray, codes: np.ndarray, gone: np.ndarray, totals: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Chi-squared of each cell's taxon in the matrix without the cell's site (taxa, sites).

    o has the counts of taxa (states, taxa), at the taxon of each cell where that is not its row; gone are the sites' counts
    and totals the matrix's. State by state, a taxon's count without the site is squared over the state's share of what is
    left. A site that leaves a state without any count makes expected counts of zero; there every expected count is one more,
    and the sum is of squared differences.
    """
    of = (lambda x: x[:, None]) if at is None else (lambda x: x[at])
    left = totals - gone  # (sites, states): each state's count without the site
    n = left.sum(axis=1)
    row = of(o.sum(axis=0)) - (codes >= 0)
    bare = (left <= 0).any(axis=1) | (row <= 0).any(axis=0)
    out = np.zeros(codes.shape)
    for c in range(gone.shape[1]):
        own = of(o[c]) - (codes == c)
        share = np.divide(left[:, c], n, out=np.zeros(len(n)), where=n > 0)
        plain = np.divide(own * own, share, out=np.zeros(codes.shape), where=share > 0)
        if bare.any():
            e = share * row + 1.0
            plain = np.where(bare, (own - e) ** 2 / e, plain)
        out += plain
    return np.where(bare, out, np.divide(out, row, out=np.zeros(codes.shape), where=row > 0) - row)


def folded(made: DataFrame, f: DataFrame, n_states: int, fold, seed: int | None = None, permutations: int = 0, ref: DataFrame | None = None, k: int = 0) -> DataFrame:
    """(aln_id, perm, col_idx, w): the score of what is left without each site, for fudged counts f (aln_id, [perm,]
    taxon_idx, o). With a seed the matrices are permutations and f has their counts; without, perm is -1.

    fold is a delta.Fold of the taxa's chi-squared, or the name wasserstein or wasserstein_raw (the mean distance of k
    quantiles of Z scores or chi-squared from the null's; ref has aln_id, z_mean, z_scale, q).
    """
    ranked, drawn = isinstance(fold, str), seed is not None
    if drawn:
        # The counts are as large as a matrix of some sites, so neither side is broadcast.
        wide = dealt(columns(made, n_states), permutations)
        sent_ = wide.join(_apart(written(_packed(f, n_states), "packed"), permutations).hint("merge"), ["aln_id", "perm"])
    else:
        sent_ = made.join(_own(f, n_states), ["aln_id", "taxon_block"])
    if ranked:
        own = written(ref.select("aln_id", *(["z_mean", "z_scale"] if fold == "wasserstein" else [F.lit(0.0).alias("z_mean"), F.lit(1.0).alias("z_scale")]), "q"), "reference")
        sent_ = sent_.join(own, "aln_id")
    each_, merge = (None, None) if ranked else (fold.each, fold.merge)
    h = np.arange(1, k + 1) / (k + 1)

    def at_quantiles(z: np.ndarray) -> np.ndarray:
        """The k quantiles of each row of sorted values."""
        low = np.floor(h * (z.shape[1] - 1)).astype(int)
        a, b = z[:, low], z[:, np.minimum(low + 1, z.shape[1] - 1)]
        return a + (b - a) * (h * (z.shape[1] - 1) - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            codes, columns_ = _codes(r), _sites(r)
            o = np.ascontiguousarray(np.frombuffer(r["counts"], np.int32).reshape(-1, n_states).T).astype(np.int64)
            if drawn:
                counts, tc, p = np.frombuffer(r["gone"], np.int64).reshape(-1, n_states), o.sum(axis=1), r["perm"]
            else:
                counts, tc, p = np.array(r["site_counts"], np.int64).reshape(-1, n_states)[np.isin(r["all_sites"], columns_)], np.array(r["tc"]), -1
            step = max(1, SITES * TAXA // len(codes))
            for i in range(0, len(columns_), step):
                x, sites, gone = codes[:, i : i + step], columns_[i : i + step], counts[i : i + step]
                chi2 = left_out(o, x, gone, tc, _moved(r, x, sites, seed + p) if drawn else None)
                head = [pa.array([r["aln_id"]] * len(sites)), pa.array(np.full(len(sites), p, np.int32)), pa.array(sites)]
                if ranked:
                    z = np.sort(((chi2 - r["z_mean"]) / r["z_scale"]).T, axis=1)
                    value = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                    told = z.shape[1] == r["total_taxa"]
                    if told:  # the tile has all of the site, so its quantiles are told here
                        value = pa.array(np.abs(at_quantiles(z) - np.array(r["q"])).mean(axis=1)[:, None].tolist(), pa.list_(pa.float64()))
                else:
                    value = pa.array(getattr(np, merge)(each_(chi2), axis=0))
                yield pa.RecordBatch.from_arrays([*head, value, *([pa.array([told] * len(sites))] if ranked else [])], ["aln_id", "perm", "col_idx", "v", *(["told"] if ranked else [])])

    each = sent_.mapInArrow(run, "aln_id string, perm int, col_idx int, v " + ("array<double>, told boolean" if ranked else "double"))
    by = ["aln_id", "perm", "col_idx"]
    if drawn:
        return each.select(*by, (F.col("v")[0] if ranked else F.col("v")).alias("w"))
    if not ranked:
        return each.groupBy(*by).agg({"sum": F.sum, "max": F.max, "min": F.min}[merge]("v").alias("w"))
    each = written(each, "left-out")
    told = each.filter("told").select(*by, F.col("v")[0].alias("w"))
    values = F.sort_array(F.flatten(F.collect_list("v")))  # the scores of one site's taxa
    apart = each.filter("NOT told").groupBy(*by).agg(values.alias("z")).join(own.select("aln_id", "q"), "aln_id")
    n = F.size("z").cast("double")

    def quantile(i):
        h = (n - 1.0) * (i + 1).cast("double") / F.lit(float(k + 1))
        low = F.floor(h).cast("int")
        a, b = F.get("z", low), F.get("z", F.least(low + 1, F.size("z") - 1))
        return a + (b - a) * (h - low)

    off = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.abs(quantile(i) - F.get("q", i)))
    return told.union(apart.select(*by, (F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))).alias("w")))
