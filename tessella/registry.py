"""Every registered query of the library and its SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import DNA, PROTEIN, detect
from .operators import composition as comp
from .functions import keyed
from .operators import delta, null
from .operators import tiles as tile
from .plans import analyses, pruning
from .sources import report
from .sources import tables as src

#: Permutations, quantiles and batch sizes of the registered queries.
P, K, TOP = 10, 20, 5
QUERIES: dict = {}
ORACLES: dict = {}
_LETTERS = {"docs": (src.documents_letters, PROTEIN), "events": (src.events_letters, DNA), "lineitem": (src.lineitem_letters, DNA), "benchmark": (src.benchmark_letters, PROTEIN)}

# --- DuckDB: alignments and the steps over them, as common table expressions -----------------------------------------

def _padded(letters: str, alphabet: str) -> str:
    return f"""seen AS ({letters}
), wide AS (SELECT taxon_id, max(col_idx) + 1 AS n FROM seen GROUP BY taxon_id
), letters AS (SELECT * FROM seen UNION ALL SELECT taxon_id, unnest(range(n, w)), '-' FROM wide, (SELECT max(n) AS w FROM wide)
), alpha AS (SELECT '{alphabet}' AS a)"""


_DOCS = f"""letters AS (
  SELECT doc_id AS taxon_id, i - 1 AS col_idx, upper(r) AS r
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS r, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> '')
), alpha AS (SELECT '{PROTEIN}' AS a)"""
_EVENTS = _padded("""
  SELECT user_id AS taxon_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS col_idx,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'G' WHEN 'view' THEN 'T' ELSE '-' END AS r FROM events""", DNA)
_LINEITEM = _padded("""
  SELECT l_suppkey AS taxon_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag, l_linestatus) - 1 AS col_idx,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'C' WHEN 'NF' THEN 'G' WHEN 'NO' THEN 'T' WHEN 'RO' THEN 'N' ELSE '-' END AS r FROM lineitem""", DNA)
_BENCH = _padded("""
  SELECT item_id AS taxon_id, i - 1 AS col_idx, upper(r) AS r
  FROM (SELECT item_id, unnest(string_split(text, '')) AS r, unnest(range(1, length(text) + 1)) AS i FROM benchmark WHERE text <> '')""", PROTEIN)
_CELLS = """, taxa AS (SELECT taxon_id, row_number() OVER (ORDER BY taxon_id) - 1 AS t FROM (SELECT DISTINCT taxon_id FROM letters))
, cells AS (SELECT t, col_idx AS j, CASE WHEN length(r) = 1 AND strpos(a, r) > 0 THEN strpos(a, r) - 1 ELSE -1 END AS c FROM letters JOIN taxa USING (taxon_id), alpha)
, states AS (SELECT unnest(range(0, length(a))) AS c FROM alpha)"""


def _count(cells: str, key: str = "0") -> str:
    """raw, o (fudged), e and chi2 of the cells of a table, for each value of key."""
    return f"""
, raw AS (SELECT g.p, g.t, s.c, coalesce(n, 0) AS n FROM (SELECT DISTINCT {key} AS p, t FROM {cells}) g CROSS JOIN states s LEFT JOIN (SELECT {key} AS p, t, c, count(*) AS n FROM {cells} WHERE c >= 0 GROUP BY ALL) x ON x.p = g.p AND x.t = g.t AND x.c = s.c)
, o AS (SELECT p, t, c, n + CASE WHEN min(n) OVER (PARTITION BY p) = 0 THEN 1 ELSE 0 END AS n FROM raw)
, e AS (SELECT p, t, c, n, CAST(sum(n) OVER (PARTITION BY p, c) AS DOUBLE) / sum(n) OVER (PARTITION BY p) * sum(n) OVER (PARTITION BY p, t) AS e FROM o)
, chi AS (SELECT p, t, sum((n - e) * (n - e) / e) AS chi2 FROM e GROUP BY p, t)"""


def _permuted(name: str = "perm", n: int = P, seed: int = null.SEED) -> str:
    """Every cell sent to another taxon by its permutation's key; what falls beyond the last taxon is sent on."""
    key = keyed.sql_nested(keyed.sql_key(f"p + {seed}", "j"), f"(SELECT j, unnest(range(0, {n})) AS p FROM (SELECT DISTINCT j FROM cells))")
    begin = keyed.sql_nested(keyed.sql_step("t", "n"), f"(SELECT p, j, c, k, n, t FROM cells JOIN {name}k USING (j), (SELECT count(*) AS n FROM taxa))")
    on = keyed.sql_nested(keyed.sql_step("x", "n"), f"(SELECT * FROM {name}w WHERE x >= n)")
    return f"""
, {name}k AS MATERIALIZED (SELECT p, j, k FROM {key})
, {name}w(p, j, c, k, n, x) AS (SELECT p, j, c, k, n, y FROM {begin} UNION ALL SELECT p, j, c, k, n, y FROM {on})
, {name} AS MATERIALIZED (SELECT p, j, x AS t, c FROM {name}w WHERE x < n)"""


def _counted(cells: str, x: str, scores: str) -> str:
    """The steps of _count for permuted cells, under names that begin with x; the scores (p, t, chi2) under their own."""
    renamed = {"raw": f"{x}raw", ", o AS": f", {x}o AS", "FROM o)": f"FROM {x}o)", ", e AS (SELECT": f", {x}e AS (SELECT", "FROM e GROUP": f"FROM {x}e GROUP", "chi AS": f"{scores} AS"}
    sub = _count(cells, "p")
    for old, new in renamed.items():
        sub = sub.replace(old, new)
    return sub


def _null() -> str:
    """The null's scores (p, t, chi2) beside the observed ones (t, chi2)."""
    return _permuted() + _counted("perm", "n", "nul")


_SCORE = """
, s AS (SELECT avg(chi2) AS m, median(chi2) AS med, count(*) AS n FROM nul), mad AS (SELECT median(abs(chi2 - med)) / 0.6745 AS scale FROM nul, s)
, obs AS (SELECT t, chi2 FROM chi), nt AS (SELECT count(*) AS t FROM chi)
, pv AS (SELECT o2.t, o2.chi2, least(1.0, CAST((SELECT count(*) FROM nul WHERE nul.chi2 >= o2.chi2) AS DOUBLE) / s.n * nt.t) AS p, (o2.chi2 - m) / scale AS z FROM obs o2, s, mad, nt)
, tau AS (SELECT chi2 AS tau FROM (SELECT chi2, row_number() OVER (ORDER BY chi2) AS rn FROM nul), s, nt WHERE rn = s.n - CAST(floor(0.05 * s.n / nt.t) AS BIGINT))"""


def _sql(base: str, *steps: str, end: str) -> str:
    return "WITH RECURSIVE " + base + _CELLS + "".join(steps) + "\n" + end


def _counts(spark: SparkSession, sf_dir: str, which: str) -> tuple[DataFrame, int]:
    """Raw counts of an alignment, and its number of states; a document's are counted without cutting it up."""
    if which == "docs":
        return src.documents_counts(spark, sf_dir), len(PROTEIN)
    cells, n = _cells(spark, sf_dir, which)
    return comp.counts(cells, n), n


def _chi2(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return comp.chi2_of(*_counts(spark, sf_dir, which))


def _cells(spark: SparkSession, sf_dir: str, which: str) -> tuple[DataFrame, int]:
    letters, alphabet = _LETTERS[which]
    return src.cells(letters(spark, sf_dir), alphabet), len(alphabet)


def _tiles(spark: SparkSession, sf_dir: str, which: str) -> tuple[DataFrame, int]:
    cells, n = _cells(spark, sf_dir, which)
    return tile.tiles(cells, n), n


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _r(c: str, name: str | None = None, digits: int = 6):
    return (F.round(c, digits) + 0.0).alias(name or c)  # no negative zero


@register("alphabet_detect", f"""WITH {_DOCS.replace('letters AS', 'l1 AS').replace('alpha AS', 'a1 AS')}, {_EVENTS.replace('letters AS', 'l2 AS').replace('alpha AS', 'a2 AS')},
u AS (SELECT 'docs' AS aln_id, r FROM l1 UNION ALL SELECT 'events', r FROM l2), d AS (SELECT aln_id, r FROM u WHERE length(r) = 1 AND r NOT IN ('N', '-', '?', 'X', '.', 'ẞ') GROUP BY ALL)
SELECT aln_id, bool_and(r IN ('A', 'C', 'G', 'T')) AS is_dna, CASE WHEN bool_and(r IN ('A', 'C', 'G', 'T')) THEN '{DNA}' ELSE '{PROTEIN}' END AS alphabet, count(*) AS n_states FROM d GROUP BY aln_id""")
def alphabet_detect(spark, sf_dir):
    both = [_LETTERS[x][0](spark, sf_dir).select("aln_id", "residue") for x in ("docs", "events")]
    return detect(both[0].union(both[1]))


for _which, _base in (("docs", _DOCS), ("events", _EVENTS), ("lineitem", _LINEITEM), ("benchmark", _BENCH)):
    _count_sql = _count("cells")

    if _which != "docs":  # every character of every document would be the result there

        @register(f"encode_cells_{_which}", _sql(_base, end="SELECT t AS taxon_idx, j AS col_idx, c AS code FROM cells"))
        def _encode(spark, sf_dir, which=_which):
            return _cells(spark, sf_dir, which)[0].select("taxon_idx", "col_idx", "code")

    @register(f"nongap_counts_{_which}", _sql(_base, end="SELECT t AS taxon_idx, count(*) AS n FROM cells WHERE c >= 0 GROUP BY t"))
    def _nongap(spark, sf_dir, which=_which):
        n = F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x)
        return _counts(spark, sf_dir, which)[0].select("taxon_idx", n.alias("n")).filter("n > 0")

    @register(f"row_counts_raw_{_which}", _sql(_base, _count_sql, end="SELECT t AS taxon_idx, c AS code, n FROM raw"))
    def _raw(spark, sf_dir, which=_which):
        return _counts(spark, sf_dir, which)[0].select("taxon_idx", F.posexplode("o").alias("code", "n"))

    @register(f"row_counts_fudged_{_which}", _sql(_base, _count_sql, end="SELECT t AS taxon_idx, c AS code, n FROM o"))
    def _fudged(spark, sf_dir, which=_which):
        return comp.fudged(*_counts(spark, sf_dir, which)).select("taxon_idx", F.posexplode("o").alias("code", "n"))

    @register(f"expected_counts_{_which}", _sql(_base, _count_sql, end="SELECT t AS taxon_idx, c AS code, round(e, 6) AS e FROM e"))
    def _expected(spark, sf_dir, which=_which):
        return comp.fudged(*_counts(spark, sf_dir, which)).select("taxon_idx", F.posexplode(comp.expected()).alias("code", "e")).select("taxon_idx", "code", _r("e"))

    @register(f"row_chi2_{_which}", _sql(_base, _count_sql, end="SELECT t AS taxon_idx, round(chi2, 6) AS chi2 FROM chi"))
    def _row(spark, sf_dir, which=_which):
        return _chi2(spark, sf_dir, which).select("taxon_idx", _r("chi2"))

    @register(f"global_chi2_{_which}", _sql(_base, _count_sql, end="SELECT round(sum(chi2), 6) AS global_chi2, round(sum(chi2 * chi2), 2) AS quartic_chi2, round(max(chi2), 6) AS max_chi2 FROM chi"))
    def _global(spark, sf_dir, which=_which):
        return comp.summary(_chi2(spark, sf_dir, which)).select(_r("global_chi2"), _r("quartic_chi2", digits=2), _r("max_chi2"))

    @register(f"chi2_spread_{_which}", _sql(_base, _count_sql, ", m AS (SELECT median(chi2) AS med, avg(chi2) AS mean FROM chi)", end="SELECT round(any_value(mean), 6) AS mean, round(any_value(med), 6) AS median, round(median(abs(chi2 - med)), 6) AS mad FROM chi, m"))
    def _spread(spark, sf_dir, which=_which):
        return comp.spread(_chi2(spark, sf_dir, which)).select(_r("mean"), _r("median"), _r("mad"))


_PS = ", ".join(repr(p) for p in comp.positions(K))


@register("chi2_quantiles", _sql(_DOCS, _count("cells"), end=f"SELECT i - 1 AS k, round(q[i], 6) AS q FROM (SELECT q, unnest(range(1, {K + 1})) AS i FROM (SELECT quantile_cont(chi2, [{_PS}]) AS q FROM chi))"))
def chi2_quantiles(spark, sf_dir):
    q = comp.quantiles(_chi2(spark, sf_dir, "docs"), K)
    return q.select(F.posexplode("q").alias("k", "q")).select("k", _r("q"))


@register("permuted_cells", _sql(_EVENTS, _permuted(n=2), end="SELECT p AS perm, t AS taxon_idx, j AS col_idx, c AS code FROM perm"))
def permuted_cells(spark, sf_dir):
    return null.permuted(_tiles(spark, sf_dir, "events")[0], 2).select("perm", "taxon_idx", "col_idx", "code")


def _both(spark, sf_dir, which):
    made, n = _tiles(spark, sf_dir, which)
    return comp.chi2_of(tile.margins(made, n), n), null.null_chi2(made, n, P)


for _which, _base in (("events", _EVENTS), ("lineitem", _LINEITEM), ("benchmark", _BENCH)):
    _steps = (_count("cells"), _null())

    @register(f"null_row_chi2_{_which}", _sql(_base, *_steps, end="SELECT p AS perm, t AS taxon_idx, round(chi2, 6) AS chi2 FROM nul"))
    def _nulls(spark, sf_dir, which=_which):
        return _both(spark, sf_dir, which)[1].select("perm", "taxon_idx", _r("chi2"))

    @register(f"null_summary_{_which}", _sql(_base, *_steps, end="SELECT p AS perm, round(sum(chi2), 6) AS total, round(max(chi2), 6) AS mx, round((SELECT quantile_cont(chi2, 0.75) FROM nul), 6) AS q75, round((SELECT quantile_cont(chi2, 0.95) FROM nul), 6) AS q95 FROM nul GROUP BY p"))
    def _summary(spark, sf_dir, which=_which):
        per, pooled = null.summary(_both(spark, sf_dir, which)[1])
        return per.join(pooled, "aln_id").select("perm", _r("total"), _r("mx"), _r("q75"), _r("q95"))

    @register(f"empirical_p_alignment_{_which}", _sql(_base, *_steps, ", g AS (SELECT sum(chi2) AS g FROM chi), ps AS (SELECT p, sum(chi2) AS total FROM nul GROUP BY p)", end="SELECT round(any_value(g), 6) AS global_chi2, round(avg(CASE WHEN total >= g THEN 1.0 ELSE 0.0 END), 6) AS p FROM ps, g"))
    def _palign(spark, sf_dir, which=_which):
        return null.empirical_p_alignment(*_both(spark, sf_dir, which)).select(_r("global_chi2"), _r("p"))

    @register(f"empirical_p_taxon_{_which}", _sql(_base, *_steps, _SCORE, end="SELECT t AS taxon_idx, round(p, 6) AS p FROM pv"))
    def _ptaxon(spark, sf_dir, which=_which):
        return null.empirical_p_taxon(*_both(spark, sf_dir, which)).select("taxon_idx", _r("p"))

    @register(f"robust_z_taxon_{_which}", _sql(_base, *_steps, _SCORE, end="SELECT t AS taxon_idx, round(z, 6) AS z FROM pv"))
    def _z(spark, sf_dir, which=_which):
        return null.robust_z(*_both(spark, sf_dir, which)).select("taxon_idx", _r("z"))

    @register(f"biased_threshold_{_which}", _sql(_base, *_steps, _SCORE, end="SELECT round(any_value(tau), 6) AS tau, count(*) FILTER (WHERE chi2 > tau) AS n_biased FROM chi, tau"))
    def _tau(spark, sf_dir, which=_which):
        chi2, nul = _both(spark, sf_dir, which)
        return chi2.join(null.threshold(chi2, nul), "aln_id").groupBy("aln_id").agg(F.round(F.first("tau"), 6).alias("tau"), F.count_if(F.col("chi2") > F.col("tau")).alias("n_biased")).select("tau", "n_biased")

    @register("taxon_score_report" if _which == "events" else f"taxon_score_report_{_which}", _sql(_base, *_steps, _SCORE, end="SELECT taxon_id, round(pv.p, 4) AS p, round(z, 2) AS z FROM pv JOIN taxa USING (t)"))
    def _report(spark, sf_dir, which=_which):
        got = null.taxon_scores(*_both(spark, sf_dir, which))
        ids = src.taxa(_LETTERS[which][0](spark, sf_dir))
        return got.join(ids, ["aln_id", "taxon_idx"]).select("taxon_id", _r("p", digits=4), _r("z", digits=2))


@register("biased_taxa", _sql(_BENCH, _count("cells"), _null(), _SCORE, end="SELECT t AS taxon_idx FROM pv WHERE p < 0.05"))
def biased_taxa(spark, sf_dir):
    return null.taxon_scores(*_both(spark, sf_dir, "benchmark")).filter("biased").select("taxon_idx")


_REF = f"""
, zs AS (SELECT (chi2 - m) / scale AS z FROM nul, s, mad), nq AS (SELECT quantile_cont(z, [{_PS}]) AS zq FROM zs), cq AS (SELECT quantile_cont(chi2, [{_PS}]) AS rq FROM nul)"""


@register("null_z_reference", _sql(_EVENTS, _count("cells"), _null(), _SCORE, _REF, end="SELECT round(m, 6) AS z_mean, round(scale, 6) AS z_scale, i - 1 AS k, round(zq[i], 6) AS q FROM (SELECT m, scale, zq, unnest(range(1, %d)) AS i FROM s, mad, nq)" % (K + 1)))
def null_z_reference(spark, sf_dir):
    r = null.reference(_both(spark, sf_dir, "events")[1], K)
    return r.select("z_mean", "z_scale", F.posexplode("q").alias("k", "q")).select(_r("z_mean"), _r("z_scale"), "k", _r("q"))


def _w(values: str, target: str) -> str:
    return f"list_avg(list_transform(range(1, {K + 1}), lambda i: abs(({values})[i] - ({target})[i])))"


@register("row_wasserstein", _sql(_EVENTS, _count("cells"), _null(), _SCORE, _REF, end=f"SELECT round({_w('oq', 'rq')}, 6) AS w, round({_w('ozq', 'zq')}, 6) AS w_z FROM (SELECT quantile_cont(chi2, [{_PS}]) AS oq, quantile_cont((chi2 - m) / scale, [{_PS}]) AS ozq FROM chi, s, mad), nq, cq"))
def row_wasserstein(spark, sf_dir):
    chi2, nul = _both(spark, sf_dir, "events")
    ref = null.reference(nul, K)
    z = chi2.join(ref.drop("q"), "aln_id").withColumn("z", (F.col("chi2") - F.col("z_mean")) / F.col("z_scale"))
    raw, on_z = comp.wasserstein(chi2, comp.quantiles(nul, K), K), comp.wasserstein(z, ref.select("aln_id", "q"), K, "z").withColumnRenamed("w", "w_z")
    return raw.join(on_z, "aln_id").select(_r("w"), _r("w_z"))


#: Naive recount: every site taken out of the fudged counts in turn.
_LOO = """
, lo AS (SELECT x.j, o.t, o.c, o.n - CASE WHEN k.c = o.c THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT j FROM cells) x CROSS JOIN o JOIN cells k ON k.j = x.j AND k.t = o.t)
, le AS (SELECT j, t, c, n, coalesce(CAST(sum(n) OVER (PARTITION BY j, c) AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY j), 0), 0) * sum(n) OVER (PARTITION BY j, t) AS e0 FROM lo)
, lf AS (SELECT j, t, c, n, e0 + CASE WHEN min(e0) OVER (PARTITION BY j) = 0 THEN 1 ELSE 0 END AS e FROM le)
, lchi AS (SELECT j, t, sum((n - e) * (n - e) / e) AS chi2 FROM lf GROUP BY j, t)"""


for _which, _base in (("events", _EVENTS), ("lineitem", _LINEITEM), ("benchmark", _BENCH)):
    for _scorer, _x in (("squared", "chi2"), ("quartic", "chi2 * chi2")):

        @register(f"delta_{_scorer}_{_which}", _sql(_base, _count("cells"), _LOO, end=f"SELECT j AS col_idx, round((SELECT sum({_x}) FROM chi) - sum({_x}), {6 if _scorer == 'squared' else 3}) + 0.0 AS delta FROM lchi GROUP BY j"))
        def _delta(spark, sf_dir, which=_which, scorer=_scorer):
            return delta.site_deltas(*_tiles(spark, sf_dir, which), scorer).select("col_idx", _r("delta", digits=6 if scorer == "squared" else 3))


for _scorer, _obs, _target in (("wasserstein", "(chi2 - m) / scale", "zq"), ("wasserstein_raw", "chi2", "rq")):

    @register(f"delta_{_scorer}", _sql(_EVENTS, _count("cells"), _null(), _SCORE, _REF, _LOO, f", lq AS (SELECT j, quantile_cont({_obs}, [{_PS}]) AS q FROM lchi, s, mad GROUP BY j), bq AS (SELECT quantile_cont({_obs}, [{_PS}]) AS q0 FROM chi, s, mad)", end=f"SELECT j AS col_idx, round({_w('q0', _target)} - {_w('q', _target)}, 6) + 0.0 AS delta FROM lq, bq, nq, cq"))
    def _wdelta(spark, sf_dir, scorer=_scorer):
        made, n = _tiles(spark, sf_dir, "events")
        nul = null.null_chi2(made, n, P)
        ref = null.reference(nul, K)
        if scorer == "wasserstein_raw":
            ref = ref.drop("q").join(comp.quantiles(nul, K), "aln_id")
        return delta.site_deltas(made, n, scorer, ref, K).select("col_idx", _r("delta"))


#: Every supplier's lines as A, C and G after a mark T, so that taking out the first site leaves the state T without any count.
_MARKED = _padded("""
  SELECT l_suppkey AS taxon_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag, l_linestatus) AS col_idx,
    CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' WHEN 'R' THEN 'G' ELSE '-' END AS r FROM lineitem
  UNION ALL SELECT DISTINCT l_suppkey, 0, 'T' FROM lineitem""", DNA)


@register("delta_degenerate", _sql(_MARKED, _count("cells"), _LOO, end="SELECT j AS col_idx, round((SELECT sum(chi2) FROM chi) - sum(chi2), 6) + 0.0 AS delta FROM lchi GROUP BY j"))
def delta_degenerate(spark, sf_dir):
    made = tile.tiles(src.cells(src.marked_letters(spark, sf_dir), DNA), len(DNA))
    return delta.site_deltas(made, len(DNA)).select("col_idx", _r("delta"))


#: The delta null has permutations of its own, whose seeds go on from the main null's last one.
_DNULL = _permuted("dperm", seed=null.SEED + P) + _counted("dperm", "dt", "dnul")
_PDELTA = _LOO.replace("SELECT DISTINCT j FROM cells", "SELECT DISTINCT p, j FROM dperm").replace("lo AS (SELECT x.j", "lo AS (SELECT x.p, x.j").replace("CROSS JOIN o JOIN cells k ON k.j = x.j AND k.t = o.t", "JOIN dto o ON o.p = x.p JOIN dperm k ON k.p = x.p AND k.j = x.j AND k.t = o.t").replace("SELECT j, t", "SELECT p, j, t").replace("PARTITION BY j", "PARTITION BY p, j").replace("GROUP BY j, t", "GROUP BY p, j, t")
_NULLMAX = _DNULL + _PDELTA + ", ld AS (SELECT p, j, sum(chi2) AS w FROM lchi GROUP BY p, j), nb AS (SELECT p, sum(chi2) AS base FROM dnul GROUP BY p), nm AS (SELECT p, max(base - w) AS mx FROM ld JOIN nb USING (p) GROUP BY p)"


def _null_deltas(made, n):
    return delta.delta_null(made, n, P, null.SEED + P)


for _which, _base in (("events", _EVENTS), ("benchmark", _BENCH)):

    @register(f"delta_null_max_{_which}", _sql(_base, _NULLMAX, end="SELECT p AS perm, round(mx, 6) AS max_delta FROM nm"))
    def _nullmax(spark, sf_dir, which=_which):
        return _null_deltas(*_tiles(spark, sf_dir, which)).select("perm", _r("max_delta"))


_TOPS = _LOO + f", d AS (SELECT j, (SELECT sum(chi2) FROM chi) - sum(chi2) AS delta FROM lchi GROUP BY j), top AS (SELECT j, delta, row_number() OVER (ORDER BY round(delta, 9) DESC, j) AS rk FROM d QUALIFY rk <= {TOP})"


for _which, _base in (("events", _EVENTS), ("benchmark", _BENCH)):

    @register(f"topk_sites_{_which}", _sql(_base, _count("cells"), _TOPS, end="SELECT j AS col_idx, round(delta, 6) AS delta FROM top"))
    def _top(spark, sf_dir, which=_which):
        return delta.top_sites(delta.site_deltas(*_tiles(spark, sf_dir, which)), TOP).select("col_idx", _r("delta"))


_TOPS2 = _TOPS.replace(" lo AS", " l2o AS").replace("FROM lo)", "FROM l2o)").replace(" le AS", " l2e AS").replace("FROM le)", "FROM l2e)").replace(" lf AS", " l2f AS").replace("FROM lf GROUP", "FROM l2f GROUP").replace("lchi", "l2chi")


_WALK = _NULLMAX + _TOPS2 + """
, w AS (SELECT rk, j, delta, (SELECT avg(CASE WHEN mx >= delta THEN 1.0 ELSE 0.0 END) FROM nm) AS p FROM top)
, walk AS (SELECT rk, j, delta, p FROM (SELECT *, max(p) OVER (ORDER BY rk) AS worst FROM w) WHERE worst <= 0.05)"""


@register("delta_null_walk", _sql(_BENCH, _count("cells"), _null(), _WALK, end="SELECT rk AS rank, j AS col_idx, round(delta, 6) + 0.0 AS delta, round(p, 6) AS p FROM walk"))
def delta_null_walk(spark, sf_dir):
    made, n = _tiles(spark, sf_dir, "benchmark")
    got = delta.justified(delta.top_sites(delta.site_deltas(made, n), TOP), _null_deltas(made, n))
    return got.select("rank", "col_idx", _r("delta"), _r("p"))


_AFTER = _count("kept").replace("raw", "araw").replace(", o AS", ", ao AS").replace("FROM o)", "FROM ao)").replace(", e AS (SELECT", ", ae AS (SELECT").replace("FROM e GROUP", "FROM ae GROUP").replace("chi AS", "after AS")
_BATCH = _WALK + ", kept AS (SELECT * FROM cells WHERE j NOT IN (SELECT j FROM walk))" + _AFTER + """
, ps AS (SELECT avg(CASE WHEN total >= g THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT sum(chi2) AS total FROM nul GROUP BY p), (SELECT sum(chi2) AS g FROM chi))
, fin AS (SELECT sum(chi2) AS total, count(*) FILTER (WHERE chi2 > tau) AS n FROM after, tau)"""


@register("prune_one_batch", _sql(_BENCH, _count("cells"), _null(), _SCORE, _BATCH, end="SELECT walk.j AS original_index, round(fin.total, 6) AS global_chi2, round((SELECT sum(chi2) FROM chi), 6) AS initial_score, round(delta, 6) + 0.0 AS delta, fin.n AS significant_taxa, round(walk.p, 6) AS null_p FROM walk, fin, ps WHERE ps.p <= 0.95"))
def prune_one_batch(spark, sf_dir):
    got = analyses.one_batch(*_tiles(spark, sf_dir, "benchmark"), TOP, P)
    return got.select(F.col("col_idx").alias("original_index"), _r("global_chi2"), _r("initial_score"), _r("delta"), "significant_taxa", _r("p", "null_p"))


@register("chi2_histogram", _sql(_DOCS, _count("cells"), f", h AS (SELECT min(chi2) AS lo, max(chi2) AS hi FROM chi), b AS (SELECT CASE WHEN hi > lo THEN least({K - 1}, CAST(floor((chi2 - lo) / (hi - lo) * {K}) AS BIGINT)) ELSE 0 END AS bin, lo, hi FROM chi, h)", end=f"SELECT bin, round(any_value(lo + (hi - lo) / {K} * bin), 6) AS low, count(*) AS n FROM b GROUP BY bin"))
def chi2_histogram(spark, sf_dir):
    return comp.histogram(_chi2(spark, sf_dir, "docs"), K).select("bin", _r("low"), "n")


_POINTS = 64
_DENSITY = f"""
, lg AS (SELECT ln(chi2) AS x FROM chi WHERE chi2 > 0), sz AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM lg)
, gr AS (SELECT n, h, lo - 3 * h AS start, (hi - lo + 6 * h) / {_POINTS - 1} AS step FROM sz), pl AS (SELECT (x - start) / step AS a, least(CAST(floor((x - start) / step) AS INT), {_POINTS - 2}) AS i FROM lg, gr)
, wt AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (a - i) AS w FROM pl UNION ALL SELECT i + 1, a - i FROM pl) GROUP BY i)"""


@register("chi2_density_docs", _sql(_DOCS, _count("cells"), _DENSITY, end=f"SELECT point, round(exp(any_value(start + step * point)), 6) AS x, round(sum(w * exp(-0.5 * pow((point - i) * step / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM (SELECT unnest(range(0, {_POINTS})) AS point), wt, gr GROUP BY point"))
def chi2_density_docs(spark, sf_dir):
    return comp.density(_chi2(spark, sf_dir, "docs"), _POINTS).select("point", _r("x"), _r("density"))


if "largest" not in delta.FOLDS:
    delta.register_fold("largest", lambda x: x, "max")


@register("delta_own_fold", _sql(_LINEITEM, _count("cells"), _LOO, end="SELECT j AS col_idx, round((SELECT max(chi2) FROM chi) - max(chi2), 6) + 0.0 AS delta FROM lchi GROUP BY j"))
def delta_own_fold(spark, sf_dir):
    """What each site's removal takes from the highest score of any taxon: a fold that a user registers."""
    return delta.site_deltas(*_tiles(spark, sf_dir, "lineitem"), "largest").select("col_idx", _r("delta"))


_REMOVED = [0, 7, 13]


@register("pruned_sequences", _sql(_EVENTS, end=f"SELECT taxon_id, string_agg(r, '' ORDER BY col_idx) AS seq FROM letters WHERE col_idx NOT IN ({', '.join(map(str, _REMOVED))}) GROUP BY taxon_id"))
def pruned_sequences(spark, sf_dir):
    return report.sequences(_LETTERS["events"][0](spark, sf_dir).filter(~F.col("col_idx").isin(_REMOVED))).select("taxon_id", "seq")


@register("fasta_lines", _sql(_DOCS, end=f"SELECT taxon_id, '>' || taxon_id || chr(10) || rtrim(regexp_replace(string_agg(CASE WHEN length(r) = 1 AND strpos('{PROTEIN}', r) > 0 THEN r ELSE '-' END, '' ORDER BY col_idx), '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS fasta FROM letters GROUP BY taxon_id"))
def fasta_lines(spark, sf_dir):
    return report.fasta(src.documents_sequences(spark, sf_dir)).select("taxon_id", "fasta")


def _at(sql: str, i: int) -> str:
    """Steps of a count and of leave-one-out scores, for the cells that are left after i batches."""
    return re.sub(r"\b(cells|raw|o|e|chi|lo|le|lf|lchi)\b", rf"\g<1>_{i}", sql)


def _loop(batches: int) -> str:
    """The squared pruning by one site a batch, with a delta null that is never renewed, turn after turn."""
    steps = ", tot AS (SELECT p, sum(chi2) AS total FROM nul GROUP BY p), cells_0 AS (SELECT * FROM cells)"
    for i in range(batches + 1):
        if i:
            steps += f"\n, cells_{i} AS MATERIALIZED (SELECT * FROM cells_{i - 1} WHERE j NOT IN (SELECT j FROM take_{i - 1}))"
        steps += _at(_count("cells"), i)
        if i < batches:
            before = f" AND EXISTS (SELECT 1 FROM take_{i - 1})" if i else ""
            steps += _at(_LOO, i) + f"""
, best_{i} AS (SELECT j, s, s - w AS delta FROM (SELECT j, sum(chi2) AS w FROM lchi_{i} GROUP BY j), (SELECT sum(chi2) AS s FROM chi_{i}) ORDER BY round(s - w, 9) DESC, j LIMIT 1)
, take_{i} AS MATERIALIZED (SELECT j, s, delta, p FROM (SELECT *, (SELECT avg(CASE WHEN mx >= delta THEN 1.0 ELSE 0.0 END) FROM nm) AS p, (SELECT avg(CASE WHEN total >= s THEN 1.0 ELSE 0.0 END) FROM tot) AS pa FROM best_{i}) WHERE pa <= 0.95 AND p <= 0.05{before})"""
    return steps


_CAP = 4
_ROUNDED = "round(global_chi2, 6) AS global_chi2, round(s, 6) AS initial_score, round(delta, 6) + 0.0 AS delta, significant_taxa, round(p, 6) AS null_p"
_TURNS = " UNION ALL ".join(f"SELECT {i + 1} AS iteration, j AS original_index, (SELECT sum(chi2) FROM chi_{i + 1}) AS global_chi2, s, delta, (SELECT count(*) FROM chi_{i + 1}, tau WHERE chi2 > tau) AS significant_taxa, p FROM take_{i}" for i in range(_CAP))


@register("prune_loop_benchmark", _sql(_BENCH, _count("cells"), _null(), _SCORE, _NULLMAX, _loop(_CAP), end=f"SELECT iteration, original_index, {_ROUNDED} FROM ({_TURNS})"))
def prune_loop_benchmark(spark, sf_dir):
    got = pruning.prune_tiles(*_tiles(spark, sf_dir, "benchmark"), pruning.Settings("squared", _CAP, P, 1, True, 0))
    return got.log.select(F.col("turn").alias("iteration"), F.col("col_idx").alias("original_index"), _r("global_chi2"), _r("score", "initial_score"), _r("delta"), F.col("biased").alias("significant_taxa"), _r("p", "null_p"))


#: Batches of sites that are taken out one after another; the last is undone.
_BATCHES = [[0, 7, 13], [1, 2, 3, 30], [5]]


@register("margins_by_batch", _sql(_EVENTS, ", gone(v, j) AS (VALUES " + ", ".join(f"({v}, {j})" for v, js in enumerate(_BATCHES, 1) for j in js) + f"), vs AS (SELECT unnest(range(0, {len(_BATCHES) + 2})) AS v)", end=f"SELECT v AS version, t AS taxon_idx, s.c AS code, count(x.j) AS n FROM vs CROSS JOIN taxa CROSS JOIN states s LEFT JOIN (SELECT v, t, c, j FROM cells, vs WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.j = cells.j AND gone.v <= CASE vs.v WHEN {len(_BATCHES) + 1} THEN vs.v - 2 ELSE vs.v END)) x USING (v, t, c) GROUP BY ALL"))
def margins_by_batch(spark, sf_dir):
    made, n = _tiles(spark, sf_dir, "events")
    versions = [tile.margins(made, n)]
    for batch in _BATCHES:
        gone = spark.createDataFrame([("events", j) for j in batch], "aln_id string, col_idx int")
        versions.append(pruning.less(versions[-1], tile.margins(tile.only(made, gone), n)))
    versions.append(versions[-2])
    out = [v.select(F.lit(i).alias("version"), "taxon_idx", F.posexplode("o").alias("code", "n")) for i, v in enumerate(versions)]
    return pruning.union(out)


def _pruned(spark, sf_dir, kind):
    """Rows of a kind of the benchmark alignment pruned by the default algorithm with the default permutations, in batches of
    ten, then one by one, until it stops by itself: no cap."""
    letters = _LETTERS["benchmark"][0](spark, sf_dir)
    taxa = report.sequences(letters).join(src.taxa(letters), ["aln_id", "taxon_id"]).withColumn("taxon_id", F.col("taxon_id").cast("string"))
    return analyses.prune(taxa, max_residue_pruned=None, top_n=10, kinds=(kind,))


@register("prune_log_full")
def prune_log_full(spark, sf_dir):
    return _pruned(spark, sf_dir, "log").select("seq", "iteration", "original_index", "global_chi2", "initial_score", "delta", "significant_taxa", "null_p", "algorithm")


@register("before_after_scores")
def before_after_scores(spark, sf_dir):
    return _pruned(spark, sf_dir, "score").select("taxon_id", "before_z", "before_p", "after_z", "after_p", "delta_z")
