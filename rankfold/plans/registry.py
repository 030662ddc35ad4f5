"""Registered queries over the driver's tables and their DuckDB twins.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a
DataFrame; ``ORACLE`` holds the same computation as DuckDB SQL over the
pre-registered views.  Column names and types agree between the two.
Randomness is the md5 rule of ``functions.hashing`` on both sides, so
samples, signs, coordinates and Gaussian entries are identical.  Where a
result is a sum of non-integers (order-dependent in the last bits) both
sides round to the same number of decimals.  Queries with no SQL twin
(iterative solvers, whole jobs) are in ``QUERIES`` only and are tested in
``tests/``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.functions import hashing as H
from rankfold.operators import factorize as FZ
from rankfold.operators import linop as L
from rankfold.operators import norms as N
from rankfold.operators import product as P
from rankfold.operators import sampling as S
from rankfold.operators import sketch as K
from rankfold.operators.prefix import cdf_lookup, column_cdf
from rankfold.sources import fixtures as X
from rankfold.sources import generate as G

# ---------------------------------------------------------------------------
# fixed parameters of the registered queries (the same on both sides)
# ---------------------------------------------------------------------------
SEED = 7
RANK = 2
SS = 2.0
SKETCH_K = 16
HOURS = 24          # a user's vector of event values by hour of day: padded to 32
POWER_ITERS = 5
ALS_ITERS = 5
DEC = 6             # decimals kept for order-dependent sums
DEC_FINE = 9        # decimals for values of order 1 or below

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def rnd(c, d=DEC):
    return F.round(c, d)


# ---------------------------------------------------------------------------
# SQL building blocks (lineitem: A = order x part, B = order x supplier)
# ---------------------------------------------------------------------------
SQL_CELLS = """
cells AS (
  SELECT mat, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(sum(val) AS DOUBLE) AS val
  FROM (
    SELECT 'A' AS mat, l_orderkey AS "row", l_partkey AS col, l_quantity AS val FROM lineitem
    UNION ALL
    SELECT 'B' AS mat, l_orderkey AS "row", l_suppkey AS col, l_quantity AS val FROM lineitem
  ) t
  WHERE "row" IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL
  GROUP BY mat, "row", col
)"""

SQL_NORMS = """
norms AS (
  SELECT mat, col, CAST(sum(val * val) AS DOUBLE) AS norm2, CAST(count(*) AS BIGINT) AS nnz
  FROM cells GROUP BY mat, col
)"""

def sql_sides(rank: int = RANK) -> str:
    return """
a_n AS (SELECT col AS i, norm2 AS a FROM norms WHERE mat = 'A'),
b_n AS (SELECT col AS j, norm2 AS b FROM norms WHERE mat = 'B'),
tot AS (
  SELECT CAST((SELECT count(*) FROM a_n) AS DOUBLE) AS n1, CAST((SELECT count(*) FROM b_n) AS DOUBLE) AS n2,
         CAST((SELECT sum(a) FROM a_n) AS DOUBLE) AS fa, CAST((SELECT sum(b) FROM b_n) AS DOUBLE) AS fb
),
bud AS (
  SELECT CAST(ceil((n1 + n2) / 2.0::DOUBLE) AS DOUBLE) AS nbar FROM tot
),
bud2 AS (
  SELECT nbar, {ss}::DOUBLE * ceil(nbar * {rank}::DOUBLE * ln(nbar)) AS m FROM bud
)""".format(ss=repr(SS), rank=rank)


SQL_SIDES = sql_sides()

SQL_ALLOC = """
alloc AS (
  SELECT i, a, CAST(floor(m * (1.0::DOUBLE / (2.0::DOUBLE * n1) + a / (2.0::DOUBLE * fa)) + 0.5::DOUBLE) AS BIGINT) AS m_i
  FROM a_n, tot, bud2
),
cdf AS (
  SELECT j, b, CAST(row_number() OVER (ORDER BY j) - 1 AS BIGINT) AS idx,
         coalesce(sum(b) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS lo
  FROM b_n
)"""


def sql_thinned(purpose: str, seed: int = SEED) -> str:
    """Twin of sampling.bernoulli_thinned: ``<purpose>_rows`` (i, x, w) and
    ``b_n`` to ``<purpose>`` (i, j).  Skips are drawn far beyond need and cut
    at the end of their record, which gives the candidates of all rounds."""
    skip = H.sql_uniform(seed, purpose + ".skip", "i", "c", "ch", "k")
    acc = H.sql_uniform(seed, purpose + ".acc", "h.i", "q.j")
    return f"""
{purpose}_cls AS (
  SELECT j, b, CASE WHEN b <= 0 THEN 63 ELSE CAST(len(list_filter(range(1, 63), lambda s: b <= bm * pow(0.5::DOUBLE, s))) AS INTEGER) END AS c
  FROM b_n, (SELECT max(b) AS bm FROM b_n)
),
{purpose}_rank AS (SELECT c, j, b, row_number() OVER (PARTITION BY c ORDER BY j) - 1 AS r FROM {purpose}_cls),
{purpose}_st AS (SELECT c, count(*) AS n_c, max(b) AS bmax FROM {purpose}_cls GROUP BY c),
{purpose}_rec AS (
  SELECT i, x, w, c, n_c, pbar, CAST(greatest(1, ceil(n_c * pbar / {S.THIN_CHUNK})) AS BIGINT) AS nch FROM (
    SELECT i, x, w, c, n_c, least(1.0::DOUBLE, x + w * bmax) AS pbar FROM {purpose}_rows, {purpose}_st) z WHERE pbar > 0
),
{purpose}_ch AS (SELECT i, x, w, c, n_c, pbar, nch, unnest(range(nch)) AS ch FROM {purpose}_rec),
{purpose}_lim AS (
  SELECT i, x, w, c, ch, pbar, CAST(floor(ch * n_c / nch) AS BIGINT) AS lo, CAST(floor((ch + 1) * n_c / nch) AS BIGINT) AS hi FROM {purpose}_ch
),
{purpose}_k AS (
  SELECT *, unnest(generate_series(1, CAST(ceil((hi - lo) * pbar + 12 * sqrt((hi - lo) * pbar) + 40) AS BIGINT))) AS k FROM {purpose}_lim
),
{purpose}_cum AS (
  SELECT i, x, w, c, ch, pbar, lo, hi, sum(CASE WHEN pbar >= 1 THEN 1 ELSE 1 + floor(ln({skip}) / (-2.0::DOUBLE * atanh(pbar / (2.0::DOUBLE - pbar)))) END)
         OVER (PARTITION BY i, c, ch ORDER BY k) AS cum FROM {purpose}_k
),
{purpose} AS (
  SELECT h.i, q.j FROM {purpose}_cum h JOIN {purpose}_rank q ON q.c = h.c AND q.r = h.lo + h.cum - 1
  WHERE h.cum <= h.hi - h.lo AND {acc} * h.pbar < least(1.0::DOUBLE, h.x + h.w * q.b)
)"""


def sql_samples(seed: int = SEED) -> str:
    ub = H.sql_uniform(seed, "branch", "d.i", "d.t")
    uc = H.sql_uniform(seed, "col", "d.i", "d.t")
    return f"""
heavy AS (SELECT alloc.* FROM alloc, tot WHERE m_i * ln(n2) / ln(2.0::DOUBLE) > n2),
light AS (SELECT alloc.* FROM alloc, tot WHERE NOT (m_i * ln(n2) / ln(2.0::DOUBLE) > n2)),
draws0 AS (SELECT i, a, unnest(generate_series(1, m_i)) AS t FROM light WHERE m_i >= 1),
draws AS (SELECT d.i, d.a, d.t, {ub} AS ub, {uc} AS uc FROM draws0 d),
uni AS (
  SELECT d.i, c.j FROM draws d CROSS JOIN tot JOIN cdf c ON c.idx = CAST(floor(d.uc * tot.n2) AS BIGINT)
  WHERE d.ub * (d.a * tot.n1 + tot.fa) < d.a * tot.n1
),
hit AS (
  SELECT d.i, c.j FROM draws d CROSS JOIN tot JOIN cdf c
    ON d.uc * tot.fb >= c.lo AND d.uc * tot.fb < c.lo + c.b
  WHERE NOT (d.ub * (d.a * tot.n1 + tot.fa) < d.a * tot.n1) AND c.b > 0
),
bern_rows AS (
  SELECT i, m_i * a / (n2 * fa) / (a / fa + 1.0::DOUBLE / n1) AS x, m_i / (n1 * fb) / (a / fa + 1.0::DOUBLE / n1) AS w
  FROM heavy, tot
),
{sql_thinned('bern', seed).strip()},
sij AS (SELECT DISTINCT i, j FROM (SELECT * FROM uni UNION ALL SELECT * FROM hit UNION ALL SELECT * FROM bern) u),
samples AS (
  SELECT s.i, s.j, bud2.m / 2.0::DOUBLE * (a_n.a / (tot.n2 * tot.fa) + b_n.b / (tot.n1 * tot.fb)) AS p
  FROM sij s JOIN a_n ON a_n.i = s.i JOIN b_n ON b_n.j = s.j CROSS JOIN tot CROSS JOIN bud2
)"""


SQL_OBSERVED = """
pairs AS (
  SELECT s.i, s.j, sum(a.val * b.val) AS v
  FROM samples s JOIN cells a ON a.mat = 'A' AND a.col = s.i
                 JOIN cells b ON b.mat = 'B' AND b.col = s.j AND b."row" = a."row"
  GROUP BY s.i, s.j
),
observed AS (
  SELECT s.i, s.j, s.p, CAST(coalesce(pairs.v, 0.0) AS DOUBLE) AS val, 1.0::DOUBLE AS w
  FROM samples s LEFT JOIN pairs ON pairs.i = s.i AND pairs.j = s.j
)"""


def base_ctes(*extra: str) -> str:
    return with_(SQL_CELLS, SQL_NORMS, *extra)


def sampling_ctes(*extra: str) -> str:
    return with_(SQL_CELLS, SQL_NORMS, SQL_SIDES, SQL_ALLOC, sql_samples(), *extra)


# ---------------------------------------------------------------------------
# Spark side helpers shared by the queries
# ---------------------------------------------------------------------------

class _Ctx:
    """Cells, norms, totals and budget of the lineitem pair."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        from pyspark import StorageLevel

        from rankfold.session import cut_lineage

        self.by_row = False
        if stored:
            # for long queries: files take less disk than persisted frames and the exchanges behind them
            self.cells, self.by_row = X.stored_lineitem_cells(spark, sf_dir)
            self.norms = cut_lineage(N.col_norms2(self.cells))
        else:
            # identical plans share one cache entry, so every query of a session
            # scans and aggregates lineitem once
            self.cells = X.lineitem_cells(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
            self.norms = N.col_norms2(self.cells).persist(StorageLevel.MEMORY_AND_DISK)
        self.tot = N.norm_totals(self.norms)
        self.bud = S.sample_budget(self.tot["n1"], self.tot["n2"], RANK, SS)
        self.a_n = S.a_side(self.norms)
        self.b_n = S.b_side(self.norms)
        self._drawn = None

    def args(self):
        t = self.tot
        return t["n1"], t["n2"], t["fro_a"], t["fro_b"]

    def alloc(self):
        return S.row_allocation(self.a_n, self.bud["m"], self.tot["n1"], self.tot["fro_a"])

    def samples(self):
        n1, n2, fa, fb = self.args()
        return S.sample_adaptive(self.a_n, self.b_n, self.bud["m"], n1, n2, fa, fb, SEED)

    def drawn(self):
        """The samples, drawn once: the choice of plan and the plan read them."""
        from rankfold.session import cut_lineage
        if self._drawn is None:
            self._drawn = cut_lineage(self.samples())
        return self._drawn

    def observed(self):
        """The sampled cells with their exact values, by the cheapest plan and stored: blocks and solvers read them often."""
        from rankfold.session import cut_lineage
        return cut_lineage(S.weights(self.valued(), "ones"))

    def valued(self):
        return P.value_exact(self.cells, self.drawn(), "auto", columns=self.norms, by_row=self.by_row)


# ---------------------------------------------------------------------------
# Cells, norms, exact product
# ---------------------------------------------------------------------------
@register("cells_lineitem", base_ctes() + 'SELECT mat, "row", col, val FROM cells')
def q_cells_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lineitem_cells(spark, sf_dir)


@register("col_norms", base_ctes() + "SELECT mat, col, norm2, nnz FROM norms")
def q_col_norms(spark, sf_dir):
    return N.col_norms2(X.lineitem_cells(spark, sf_dir))


@register("frobenius", base_ctes() + """
SELECT mat, CAST(sum(norm2) AS DOUBLE) AS fro2, CAST(count(*) AS BIGINT) AS n_cols FROM norms GROUP BY mat""")
def q_frobenius(spark, sf_dir):
    return N.frobenius2(N.col_norms2(X.lineitem_cells(spark, sf_dir)))


SQL_PRODUCT = """
product AS (
  SELECT a.col AS i, b.col AS j, CAST(sum(a.val * b.val) AS DOUBLE) AS val
  FROM cells a JOIN cells b ON a."row" = b."row" AND a.mat = 'A' AND b.mat = 'B'
  GROUP BY a.col, b.col
)"""


@register("product_exact", base_ctes(SQL_PRODUCT) + "SELECT i, j, val FROM product")
def q_product_exact(spark, sf_dir):
    return P.product_exact(X.lineitem_cells(spark, sf_dir))


@register("transpose", base_ctes(SQL_PRODUCT) + "SELECT j AS i, i AS j, val FROM product")
def q_transpose(spark, sf_dir):
    return P.transpose(P.product_exact(X.lineitem_cells(spark, sf_dir))).select("i", "j", "val")


@register("mask_filter", sampling_ctes(SQL_PRODUCT) +
          "SELECT p.i, p.j, p.val FROM product p WHERE EXISTS (SELECT 1 FROM samples s WHERE s.i = p.i AND s.j = p.j)")
def q_mask_filter(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return P.mask(P.product_exact(c.cells), c.drawn())


# ---------------------------------------------------------------------------
# Vectors, scaling, padding, Hadamard
# ---------------------------------------------------------------------------
SQL_EMB_CELLS = """
emb_cells AS (
  SELECT CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS mat, CAST(r AS BIGINT) AS "row",
         CAST(vec_id AS BIGINT) AS col, CAST(v AS DOUBLE) AS val
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS r FROM embeddings) e
)"""


@register("cells_embeddings", with_(SQL_EMB_CELLS) + 'SELECT mat, "row", col, val FROM emb_cells')
def q_cells_embeddings(spark, sf_dir):
    return X.embeddings_cells(spark, sf_dir)


@register("col_norms_vectors", with_(SQL_EMB_CELLS) + f"""
SELECT mat, col, ROUND(sum(val * val), {DEC_FINE}) AS norm2 FROM emb_cells GROUP BY mat, col""")
def q_col_norms_vectors(spark, sf_dir):
    v = N.col_norms2_vecs(X.embeddings_vecs(spark, sf_dir))
    return v.select("mat", "col", rnd(F.col("norm2"), DEC_FINE).alias("norm2"))


@register("scale_rows", base_ctes() + f"""
SELECT mat, "row", col, ROUND(val * pow("row" + 1.0::DOUBLE, -1.0::DOUBLE), {DEC_FINE}) AS val FROM cells""")
def q_scale_rows(spark, sf_dir):
    s = G.scale_rows(X.lineitem_cells(spark, sf_dir), 1.0)
    return s.select("mat", "row", "col", rnd(F.col("val"), DEC_FINE).alias("val"))


@register("pad_pow2", f"""
WITH h AS (SELECT CAST(user_id AS BIGINT) AS col, CAST(extract(hour FROM ts) AS INTEGER) AS pos, sum(CAST(value AS DOUBLE)) AS val
           FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT u.col, CAST(r.pos AS INTEGER) AS pos, ROUND(coalesce(h.val, 0.0), {DEC}) AS val
FROM (SELECT DISTINCT col FROM h) u CROSS JOIN (SELECT unnest(range(32)) AS pos) r
LEFT JOIN h ON h.col = u.col AND h.pos = r.pos""")
def q_pad_pow2(spark, sf_dir):
    """B3 on vectors whose length is no power of two: events of a user by hour of day."""
    from rankfold.functions.arrays import pad_to
    n = K.padded_length(HOURS)
    v = X.user_hour_vecs(spark, sf_dir)
    return v.select("col", F.posexplode(pad_to(F.col("vec"), HOURS, n)).alias("pos", "val")) \
        .select("col", F.col("pos").cast("int").alias("pos"), rnd(F.col("val")).alias("val"))


# the padded length of an embedding, from the data
SQL_EMB_N = """
npad AS (SELECT CAST(pow(2, ceil(log2(max(len(embedding))))) AS BIGINT) AS n FROM embeddings)"""


@register("hadamard_vectors", with_(SQL_EMB_N) + f"""
, e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS r FROM embeddings)
SELECT CAST(vec_id AS BIGINT) AS col, CAST(h AS INTEGER) AS pos,
       ROUND(sum(v * (1 - 2 * (bit_count(CAST(h AS BIGINT) & CAST(r AS BIGINT)) % 2))), {DEC_FINE}) AS val
FROM e, (SELECT unnest(range(n)) AS h FROM npad) hh GROUP BY vec_id, h""")
def q_hadamard_vectors(spark, sf_dir):
    from rankfold.functions.arrays import hadamard, pad_to
    v = X.embeddings_vecs(spark, sf_dir)
    d = X.vector_width(v)
    n = K.padded_length(d)
    return v.select("col", F.posexplode(hadamard(pad_to(F.col("vec"), d, n), n)).alias("pos", "val")) \
        .select("col", F.col("pos").cast("int").alias("pos"), rnd(F.col("val"), DEC_FINE).alias("val"))


# ---------------------------------------------------------------------------
# A1 / A2: generated decaying pair, shape taken from the tables
# (rows = suppliers, columns = nations: grows with the supplier table)
# ---------------------------------------------------------------------------
def _decay_shape(spark, sf_dir):
    rows = X.table(spark, sf_dir, "supplier").count()
    cols = X.table(spark, sf_dir, "nation").count()
    return rows, cols


SQL_DECAY = f"""
shape AS (SELECT (SELECT count(*) FROM supplier) AS d, (SELECT count(*) FROM nation) AS n),
ids AS (SELECT unnest(range(d * n)) AS id, n FROM shape),
rc AS (SELECT CAST(id // n AS BIGINT) AS "row", CAST(id % n AS BIGINT) AS col FROM ids),
decay AS (
  SELECT m.mat, rc."row", rc.col,
         {H.sql_gaussian(SEED, 'decay', 'm.mat', 'rc."row"', 'rc.col')} * pow(rc."row" + 1.0::DOUBLE, -1.0::DOUBLE) AS val
  FROM rc, (SELECT unnest(['A', 'B']) AS mat) m
)"""


@register("decay_matrix", with_(SQL_DECAY) + f'SELECT mat, "row", col, ROUND(val, {DEC_FINE}) AS val FROM decay')
def q_decay_matrix(spark, sf_dir):
    d, n = _decay_shape(spark, sf_dir)
    c = G.decay_matrix(spark, d, n, 1.0, SEED)
    return c.select("mat", "row", "col", rnd(F.col("val"), DEC_FINE).alias("val"))


@register("decay_vectors", with_(SQL_DECAY) + f"""
SELECT mat, col, CAST(count(*) AS INTEGER) AS n_rows, ROUND(sum(val * val), {DEC_FINE}) AS norm2
FROM decay GROUP BY mat, col""")
def q_decay_vectors(spark, sf_dir):
    from rankfold.functions.arrays import sum_squares
    d, n = _decay_shape(spark, sf_dir)
    v = G.decay_vecs(G.decay_matrix(spark, d, n, 1.0, SEED))
    return v.select("mat", "col", F.size("vec").cast("int").alias("n_rows"),
                    rnd(sum_squares(F.col("vec")), DEC_FINE).alias("norm2"))


# ---------------------------------------------------------------------------
# Shared signs and coordinates
# ---------------------------------------------------------------------------
SQL_NPAD = """
npad AS (SELECT CAST(pow(2, ceil(log2(max(l_orderkey) + 1))) AS BIGINT) AS n FROM lineitem)"""


def sql_coords(k: int = SKETCH_K, seed: int = SEED) -> str:
    cand = 64 * k  # far more draws than k distinct values need
    u = H.sql_uniform(seed, "coord", "draw")
    return f"""
cand AS (SELECT draw, CAST(floor({u} * npad.n) AS BIGINT) AS h
         FROM (SELECT unnest(range({cand})) AS draw) d, npad),
firsts AS (SELECT h, min(draw) AS draw FROM cand GROUP BY h),
coords AS (SELECT CAST(t AS INTEGER) AS t, h FROM (
  SELECT h, row_number() OVER (ORDER BY draw) - 1 AS t FROM firsts) x WHERE t < {k})"""


def _npad(spark, sf_dir) -> int:
    mx = X.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return K.padded_length(int(mx) + 1)


@register("pick_coords", with_(SQL_NPAD, sql_coords()) + "SELECT t, h FROM coords")
def q_pick_coords(spark, sf_dir):
    n = _npad(spark, sf_dir)
    return K.coords_frame(spark, SEED, n, SKETCH_K).select(F.col("t").cast("int").alias("t"), "h")


@register("sign_flip", base_ctes() + f"""
SELECT "row", {H.sql_sign(SEED, 'sign', 'r."row"')} AS sign FROM (SELECT DISTINCT "row" FROM cells) r""")
def q_sign_flip(spark, sf_dir):
    rows = X.lineitem_cells(spark, sf_dir).select("row").distinct()
    return rows.select("row", K.sign_column(SEED).alias("sign"))


# ---------------------------------------------------------------------------
# sketches
# ---------------------------------------------------------------------------
def sql_srht(k: int = SKETCH_K) -> str:
    sg = H.sql_sign(SEED, "sign", 'c."row"')
    return f"""
srht AS (
  SELECT c.mat, c.col, k.t,
         CAST(sum({sg} * (1 - 2 * (bit_count(k.h & c."row") % 2)) * c.val) AS DOUBLE) * {1.0 / math.sqrt(k)!r} AS s
  FROM cells c CROSS JOIN coords k GROUP BY c.mat, c.col, k.t
)"""


def _coords(spark, sf_dir):
    return K.pick_coords(SEED, _npad(spark, sf_dir), SKETCH_K)


@register("srht_sketch_cells", base_ctes(SQL_NPAD, sql_coords(), sql_srht()) + "SELECT mat, col, t, s FROM srht")
def q_srht_sketch_cells(spark, sf_dir):
    cells = X.lineitem_cells(spark, sf_dir)
    return K.srht_sketch_cells(cells, _coords(spark, sf_dir), SEED).select("mat", "col", F.col("t").cast("int").alias("t"), "s")


@register("sketch_norms", base_ctes(SQL_NPAD, sql_coords(), sql_srht()) + """
SELECT mat, col, CAST(sum(s * s) AS DOUBLE) AS norm2 FROM srht GROUP BY mat, col""")
def q_sketch_norms(spark, sf_dir):
    cells = X.lineitem_cells(spark, sf_dir)
    return N.sketch_norms2(K.srht_sketch_cells(cells, _coords(spark, sf_dir), SEED))


@register("sketch_with_norms", base_ctes(SQL_NPAD, sql_coords(), sql_srht()) + """
SELECT mat, col, t, s FROM srht
UNION ALL SELECT mat, col, CAST(-1 AS INTEGER) AS t, norm2 AS s FROM norms""")
def q_sketch_with_norms(spark, sf_dir):
    """B6 + E1 in ONE scan and one aggregation (t = -1 carries the norm)."""
    cells = X.lineitem_cells(spark, sf_dir)
    return K.srht_sketch_cells(cells, _coords(spark, sf_dir), SEED, with_norms=True) \
        .select("mat", "col", F.col("t").cast("int").alias("t"), "s")


SQL_GAUSS = f"""
ks AS (SELECT unnest(range({SKETCH_K})) AS t),
gsk AS (
  SELECT c.mat, c.col, CAST(ks.t AS INTEGER) AS t,
         sum({H.sql_gaussian(SEED, 'jl', 'ks.t', 'c."row"')} * c.val) / {math.sqrt(SKETCH_K)!r} AS s
  FROM cells c CROSS JOIN ks GROUP BY c.mat, c.col, ks.t
)"""


@register("gaussian_sketch", base_ctes(SQL_GAUSS) + f"SELECT mat, col, t, ROUND(s, {DEC}) AS s FROM gsk")
def q_gaussian_sketch(spark, sf_dir):
    g = K.gaussian_sketch_cells(X.lineitem_cells(spark, sf_dir), SKETCH_K, SEED)
    return g.select("mat", "col", F.col("t").cast("int").alias("t"), rnd(F.col("s")).alias("s"))


def sql_emb_srht() -> str:
    sg = H.sql_sign(SEED, "sign", "e.r")
    return f"""
{SQL_EMB_N.strip()},
{sql_coords().strip()},
e AS (SELECT vec_id, label, unnest(embedding) AS v, CAST(unnest(range(len(embedding))) AS BIGINT) AS r FROM embeddings),
esk AS (
  SELECT CASE WHEN e.label < 5 THEN 'A' ELSE 'B' END AS mat, CAST(e.vec_id AS BIGINT) AS col, k.t,
         sum({sg} * (1 - 2 * (bit_count(k.h & e.r) % 2)) * e.v) * {1.0 / math.sqrt(SKETCH_K)!r} AS s
  FROM e CROSS JOIN coords k GROUP BY 1, 2, 3
)"""


@register("srht_sketch_vectors", with_(sql_emb_srht()) + f"SELECT mat, col, t, ROUND(s, {DEC_FINE}) AS s FROM esk")
def q_srht_sketch_vectors(spark, sf_dir):
    """B2+B3+B4+B5 as one projection (N follows the data's width)."""
    v = X.embeddings_vecs(spark, sf_dir)
    d = X.vector_width(v)
    sk = K.srht_sketch_vecs(v, d, K.pick_coords(SEED, K.padded_length(d), SKETCH_K), SEED)
    return K.wide_to_long(sk).select("mat", "col", F.col("t").cast("int").alias("t"),
                                     rnd(F.col("s"), DEC_FINE).alias("s"))


# ---------------------------------------------------------------------------
# sampling
# ---------------------------------------------------------------------------
@register("sample_budget", with_(SQL_CELLS, SQL_NORMS, SQL_SIDES) + """
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(nbar AS BIGINT) AS nbar, m FROM tot, bud2""")
def q_sample_budget(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    b = c.bud
    return spark.createDataFrame([(b["n1"], b["n2"], b["nbar"], float(b["m"]))], "n1 bigint, n2 bigint, nbar bigint, m double")


@register("row_allocation", with_(SQL_CELLS, SQL_NORMS, SQL_SIDES, SQL_ALLOC) + "SELECT i, a, m_i FROM alloc")
def q_row_allocation(spark, sf_dir):
    return _Ctx(spark, sf_dir).alloc().select("i", "a", "m_i")


@register("column_cdf", with_(SQL_CELLS, SQL_NORMS, SQL_SIDES, SQL_ALLOC) +
          "SELECT j, b, idx, lo, lo + b AS hi FROM cdf")
def q_column_cdf(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return column_cdf(c.b_n)


@register("cdf_lookup", sampling_ctes() + """
SELECT d.i, d.t, c.j FROM draws d CROSS JOIN tot JOIN cdf c
  ON d.uc * tot.fb >= c.lo AND d.uc * tot.fb < c.lo + c.b WHERE c.b > 0""")
def q_cdf_lookup(spark, sf_dir):
    """D3 alone: every draw of the light rows looked up in the b-CDF."""
    c = _Ctx(spark, sf_dir)
    n1, n2, fa, fb = c.args()
    light = c.alloc().where(~S.heavy_condition(n2))
    d = S._draws(light, SEED).withColumn("_x", H.uniform(SEED, "col", F.col("i"), F.col("t")) * F.lit(float(fb)))
    return cdf_lookup(d.select("i", "t", "_x"), "_x", column_cdf(c.b_n), "j", float(fb)).select("i", "t", "j")


@register("sample_cdf", sampling_ctes() + "SELECT DISTINCT i, j FROM (SELECT * FROM uni UNION ALL SELECT * FROM hit) u")
def q_sample_cdf(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    n1, n2, fa, fb = c.args()
    light = c.alloc().where(~S.heavy_condition(n2))
    return S.sample_cdf(light, column_cdf(c.b_n), n1, n2, fa, fb, SEED)


@register("sample_bernoulli_row", sampling_ctes() + "SELECT i, j FROM bern")
def q_sample_bernoulli_row(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    n1, n2, fa, fb = c.args()
    heavy = c.alloc().where(S.heavy_condition(n2))
    return S.sample_bernoulli_row(heavy, c.b_n, n1, n2, fa, fb, SEED)


@register("sample_adaptive", sampling_ctes() + f"SELECT i, j, ROUND(p, {DEC_FINE}) AS p FROM samples")
def q_sample_adaptive(spark, sf_dir):
    return _Ctx(spark, sf_dir).samples().select("i", "j", rnd(F.col("p"), DEC_FINE).alias("p"))


@register("cell_probability", sampling_ctes() + f"""
SELECT i, CAST(count(*) AS BIGINT) AS n_samples, ROUND(sum(p), {DEC}) AS p_sum FROM samples GROUP BY i""")
def q_cell_probability(spark, sf_dir):
    s = _Ctx(spark, sf_dir).samples()
    return s.groupBy("i").agg(F.count(F.lit(1)).alias("n_samples"), rnd(F.sum("p")).alias("p_sum"))


SQL_BERNOULLI = f"""
mask_rows AS (
  SELECT i, a * (m / (2.0::DOUBLE * n2 * fa)) AS x, m / (2.0::DOUBLE * n1 * fb) AS w FROM a_n, tot, bud2
),
{sql_thinned('mask').strip()},
mask_p AS (
  SELECT s.i, s.j, bud2.m / 2.0::DOUBLE * (a_n.a / (tot.n2 * tot.fa) + b_n.b / (tot.n1 * tot.fb)) AS p
  FROM mask s JOIN a_n ON a_n.i = s.i JOIN b_n ON b_n.j = s.j CROSS JOIN tot CROSS JOIN bud2
)"""


@register("sample_bernoulli", with_(SQL_CELLS, SQL_NORMS, SQL_SIDES, SQL_BERNOULLI) +
          f"SELECT i, j, ROUND(p, {DEC_FINE}) AS p FROM mask_p")
def q_sample_bernoulli(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    n1, n2, fa, fb = c.args()
    m = S.sample_bernoulli(c.a_n, c.b_n, c.bud["m"], n1, n2, fa, fb, SEED)
    return m.select("i", "j", rnd(F.col("p"), DEC_FINE).alias("p"))


@register("value_exact", sampling_ctes(SQL_OBSERVED) + "SELECT i, j, val FROM observed")
def q_value_exact(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return P.value_exact(c.cells, c.drawn(), "auto").select("i", "j", "val")


@register("observed_matrix", sampling_ctes(SQL_OBSERVED) +
          f"SELECT i, j, val, w, ROUND(1.0 / least(p, 1.0), {DEC}) AS w_inv_p FROM observed")
def q_observed_matrix(spark, sf_dir):
    """G8 + H5: sampled cells with both weight choices."""
    c = _Ctx(spark, sf_dir, stored=True)
    o = S.weights(c.valued(), "ones")
    o = S.weights(o.withColumnRenamed("w", "w1"), "inverse_p").withColumnRenamed("w", "w_inv_p") \
        .withColumnRenamed("w1", "w")
    return o.select("i", "j", "val", "w", rnd(F.col("w_inv_p")).alias("w_inv_p"))


# ---------------------------------------------------------------------------
# Values from sketches on the sampled cells
# ---------------------------------------------------------------------------
SQL_SKETCH_VALUES = """
ska AS (SELECT col AS i, t, s FROM srht WHERE mat = 'A'),
skb AS (SELECT col AS j, t, s FROM srht WHERE mat = 'B'),
raw AS (
  SELECT s.i, s.j, coalesce(sum(x.s * y.s), 0.0) AS raw
  FROM samples s LEFT JOIN ska x ON x.i = s.i LEFT JOIN skb y ON y.j = s.j AND y.t = x.t
  GROUP BY s.i, s.j
),
sn AS (SELECT mat, col, sum(s * s) AS n2s FROM srht GROUP BY mat, col),
resc AS (
  SELECT r.i, r.j, r.raw,
         CASE WHEN coalesce(x.n2s, 0.0) = 0 OR coalesce(y.n2s, 0.0) = 0 THEN 0.0
              ELSE r.raw / sqrt(x.n2s) / sqrt(y.n2s) * sqrt(coalesce(na.a, 0.0)) * sqrt(coalesce(nb.b, 0.0)) END AS val
  FROM raw r LEFT JOIN sn x ON x.mat = 'A' AND x.col = r.i LEFT JOIN sn y ON y.mat = 'B' AND y.col = r.j
             LEFT JOIN a_n na ON na.i = r.i LEFT JOIN b_n nb ON nb.j = r.j
)"""


def _sketch_values(spark, sf_dir, estimator):
    """Sketches and samples are stored: the grid counts them before it deals them out."""
    from rankfold.session import cut_lineage
    c = _Ctx(spark, sf_dir)
    wide = cut_lineage(K.sketch_wide(K.srht_sketch_cells(c.cells, _coords(spark, sf_dir), SEED), SKETCH_K))
    return K.value_from_sketch(c.drawn().select("i", "j"), wide, c.norms, estimator)


@register("value_raw", sampling_ctes(SQL_NPAD, sql_coords(), sql_srht(), SQL_SKETCH_VALUES) +
          "SELECT i, j, CAST(raw AS DOUBLE) AS val FROM raw")
def q_value_raw(spark, sf_dir):
    return _sketch_values(spark, sf_dir, "raw").select("i", "j", "val")


@register("value_rescaled", sampling_ctes(SQL_NPAD, sql_coords(), sql_srht(), SQL_SKETCH_VALUES) +
          f"SELECT i, j, ROUND(val, {DEC}) AS val FROM resc")
def q_value_rescaled(spark, sf_dir):
    return _sketch_values(spark, sf_dir, "rescaled").select("i", "j", rnd(F.col("val")).alias("val"))


# ---------------------------------------------------------------------------
# H4 / H2 / H3 / H6 / H7: weighted ALS (rank 1 has a closed form in SQL)
# ---------------------------------------------------------------------------
def sql_v0(seed: int = SEED) -> str:
    g = H.sql_gaussian(seed, "init", "b_n.j", "0")
    return f"""
v0g AS (SELECT b_n.j AS id, {g} AS g FROM b_n),
v0 AS (SELECT id, 0.0::DOUBLE + g * (1.0::DOUBLE / sqrt((SELECT sum(g * g) FROM v0g))) AS f FROM v0g)"""


def sql_half(name: str, src: str, side_key: str, other_key: str, lam: float = 0.0) -> str:
    return f"""
{name} AS (
  SELECT o.{side_key} AS id,
         CASE WHEN sum(o.w * x.f * x.f) + {lam!r}::DOUBLE = 0 THEN 0.0
              ELSE sum(o.w * o.val * x.f) / (sum(o.w * x.f * x.f) + {lam!r}::DOUBLE) END AS f
  FROM observed o JOIN {src} x ON x.id = o.{other_key} GROUP BY o.{side_key}
)"""


def sql_wals(iters: int) -> list[str]:
    ctes, prev = [sql_v0()], "v0"
    for k in range(1, iters + 1):
        ctes.append(sql_half(f"u{k}", prev, "i", "j"))
        ctes.append(sql_half(f"v{k}", f"u{k}", "j", "i"))
        prev = f"v{k}"
    return ctes


def _ids(df, col):
    return df.select(F.col(col).alias("id"))


def _v0(c: _Ctx, rank: int = 1):
    return FZ.random_init(_ids(c.b_n, "j"), rank, SEED)


def _long_factor(df, side: str):
    return df.select(F.lit(side).alias("side"), "id", F.posexplode("f").alias("k", "val")) \
        .select("side", "id", F.col("k").cast("int").alias("k"), "val")


@register("random_init", base_ctes() + """
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS g
FROM (SELECT unnest(range(2)) AS a) x, (SELECT unnest(range(2)) AS b) y""")
def q_random_init(spark, sf_dir):
    """H4: the whitened random start is orthonormal (Gram = I), rank 2."""
    c = _Ctx(spark, sf_dir)
    v = _v0(c, 2)
    g = v.select(F.posexplode("f").alias("a", "x"), "id", "f") \
        .select("a", F.posexplode("f").alias("b", "y"), "x") \
        .groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    return g.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"),
                    (rnd(F.col("g")) + F.lit(0.0)).alias("g"))


@register("wals_half_step", sampling_ctes(SQL_OBSERVED, *sql_wals(0), sql_half("u1", "v0", "i", "j")) +
          f"SELECT id, ROUND(f, {DEC}) AS f FROM u1")
def q_wals_half_step(spark, sf_dir):
    c = _Ctx(spark, sf_dir, stored=True)
    u = FZ.wals_half_step(c.observed(), _v0(c), 1, 0.0)
    return u.select("id", rnd(F.get("f", 0)).alias("f"))


SQL_WALS = sampling_ctes(SQL_OBSERVED, *sql_wals(ALS_ITERS)) + f"""
SELECT 'u' AS side, id, CAST(0 AS INTEGER) AS k, ROUND(f, {DEC - 2}) AS val FROM u{ALS_ITERS}
UNION ALL SELECT 'v' AS side, id, CAST(0 AS INTEGER) AS k, ROUND(f, {DEC_FINE - 2}) AS val FROM v{ALS_ITERS}"""


def _rounded_factors(u, v):
    lu = _long_factor(u, "u").withColumn("val", rnd(F.col("val"), DEC - 2))
    lv = _long_factor(v, "v").withColumn("val", rnd(F.col("val"), DEC_FINE - 2))
    return lu.unionByName(lv)


# H3 whole: the rank for which the samples are drawn, and the reference's rounds (Matlab/MatrixProductPCA.m:36)
WALS_ROUNDS = 10


def sql_whitened(name: str, ids: str, key: str, seed: int = SEED) -> list[str]:
    """The orthonormal start of rank 2: G^(-1/2) of the 2 x 2 Gram matrix G is t (G + s)⁻¹ with s² = det G and t² = tr G + 2 s."""
    g0, g1 = (H.sql_gaussian(seed, "init", f"{ids}.{key}", str(k)) for k in (0, 1))
    return [f"""
{name}_g AS (SELECT {key} AS id, {g0} AS g0, {g1} AS g1 FROM {ids}),
{name}_s AS (SELECT sum(g0 * g0) AS p, sum(g0 * g1) AS q, sum(g1 * g1) AS r FROM {name}_g),
{name}_t AS (SELECT p, q, r, sqrt(p * r - q * q) AS s, sqrt(p + r + 2.0::DOUBLE * sqrt(p * r - q * q)) AS t FROM {name}_s),
{name}_w AS (SELECT t * (r + s) / ((p + s) * (r + s) - q * q) AS x, -t * q / ((p + s) * (r + s) - q * q) AS y,
                    t * (p + s) / ((p + s) * (r + s) - q * q) AS z FROM {name}_t),
{name} AS (SELECT id, g0 * x + g1 * y AS f0, g0 * y + g1 * z AS f1 FROM {name}_g, {name}_w)"""]


def sql_half2(name: str, src: str, side_key: str, other_key: str) -> str:
    """A half-step of rank 2: the 2 x 2 systems in closed form, and where one is singular its least-norm solution h / tr G."""
    return f"""
{name}_s AS (
  SELECT o.{side_key} AS id, sum(o.w * x.f0 * x.f0) AS p, sum(o.w * x.f0 * x.f1) AS q, sum(o.w * x.f1 * x.f1) AS r,
         sum(o.w * o.val * x.f0) AS h0, sum(o.w * o.val * x.f1) AS h1
  FROM observed o JOIN {src} x ON x.id = o.{other_key} GROUP BY o.{side_key}
),
{name} AS (
  SELECT id, CASE WHEN p + r = 0 THEN 0.0 WHEN p * r - q * q > 1e-12 * (p + r) * (p + r) THEN (r * h0 - q * h1) / (p * r - q * q) ELSE h0 / (p + r) END AS f0,
             CASE WHEN p + r = 0 THEN 0.0 WHEN p * r - q * q > 1e-12 * (p + r) * (p + r) THEN (p * h1 - q * h0) / (p * r - q * q) ELSE h1 / (p + r) END AS f1
  FROM {name}_s
)"""


def sql_wals2(rounds: int) -> list[str]:
    ctes, prev = sql_whitened("v0", "b_n", "j"), "v0"
    for k in range(1, rounds + 1):
        ctes.append(sql_half2(f"u{k}", prev, "i", "j"))
        ctes.append(sql_half2(f"v{k}", f"u{k}", "j", "i"))
        prev = f"v{k}"
    return ctes


SQL_WALS_WHOLE = sampling_ctes(SQL_OBSERVED, *sql_wals2(WALS_ROUNDS)) + " UNION ALL ".join(
    f"SELECT '{side}' AS side, id, CAST({k} AS INTEGER) AS k, ROUND(f{k}, {dec}) AS val FROM {side}{WALS_ROUNDS}"
    for side, dec in (("u", DEC - 2), ("v", DEC_FINE - 2)) for k in (0, 1))


@register("wals", SQL_WALS_WHOLE)
def q_wals(spark, sf_dir):
    """H3: weighted ALS of rank RANK, WALS_ROUNDS rounds, λ = 0, unit weights."""
    c = _Ctx(spark, sf_dir, stored=True)
    return _rounded_factors(*FZ.wals(c.observed(), _ids(c.b_n, "j"), RANK, WALS_ROUNDS, 0.0, SEED))


@register("published_factors", SQL_WALS)
def q_published_factors(spark, sf_dir):
    """A3: the rank-1 factors written as a version in the shared folder and read back."""
    from rankfold.session import ensure_checkpoint_dir
    from rankfold.sources.sink import read_result, write_result
    c = _Ctx(spark, sf_dir, stored=True)
    u, v = FZ.wals(c.observed(), _ids(c.b_n, "j"), 1, ALS_ITERS, 0.0, SEED)
    root = f"{ensure_checkpoint_dir(spark)}/{_fresh('published')}"
    number = write_result({"u": u, "v": v}, root, {"rank": 1, "iters": ALS_ITERS, "seed": SEED})
    got = read_result(spark, root, number)
    return _rounded_factors(got["u"], got["v"])


@register("factor_matrix", sampling_ctes(SQL_OBSERVED, *sql_wals(0), sql_half("u1", "v0", "i", "j")) + f"""
SELECT CAST(p.p_partkey AS BIGINT) AS id, CAST(0 AS INTEGER) AS k, ROUND(coalesce(u1.f, 0.0), {DEC}) AS val
FROM part p LEFT JOIN u1 ON u1.id = p.p_partkey""")
def q_factor_matrix(spark, sf_dir):
    """H6: the A-side factor over every part (parts never sampled get 0)."""
    c = _Ctx(spark, sf_dir, stored=True)
    u = FZ.wals_half_step(c.observed(), _v0(c), 1, 0.0)
    parts = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    fm = FZ.factor_matrix(parts, u, 1)
    return fm.select("id", F.posexplode("f").alias("k", "val")) \
        .select("id", F.col("k").cast("int").alias("k"), rnd(F.col("val")).alias("val"))


@register("reconstruct", sampling_ctes(SQL_OBSERVED, *sql_wals(0), sql_half("u1", "v0", "i", "j")) + f"""
SELECT s.i, s.j, ROUND(coalesce(u1.f * v0.f, 0.0), {DEC}) AS est
FROM samples s LEFT JOIN u1 ON u1.id = s.i LEFT JOIN v0 ON v0.id = s.j""")
def q_reconstruct(spark, sf_dir):
    """H7: û_i·v̂_j on every sampled cell."""
    c = _Ctx(spark, sf_dir, stored=True)
    v0 = _v0(c)
    u = FZ.wals_half_step(c.observed(), v0, 1, 0.0)
    return FZ.reconstruct(c.drawn().select("i", "j"), u, v0).select("i", "j", rnd(F.col("est")).alias("est"))


# ---------------------------------------------------------------------------
# Vectors and implicit products
# ---------------------------------------------------------------------------
def sql_start(name: str, ids_cte: str, id_col: str, purpose: str) -> str:
    return f"{name} AS (SELECT {id_col} AS id, {H.sql_gaussian(SEED, purpose, id_col)} AS val FROM {ids_cte})"


def _start(c: _Ctx, side: str, purpose: str):
    ids = _ids(c.b_n, "j") if side == "B" else _ids(c.a_n, "i")
    return L.random_start(ids, SEED, purpose)


@register("random_start", base_ctes(SQL_SIDES, sql_start("x", "b_n", "j", "start")) +
          f"SELECT id, ROUND(val, {DEC_FINE}) AS val FROM x")
def q_random_start(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return _start(c, "B", "start").select("id", rnd(F.col("val"), DEC_FINE).alias("val"))


@register("normalize", base_ctes(SQL_SIDES, sql_start("x", "b_n", "j", "start")) + f"""
SELECT id, ROUND(val / sqrt((SELECT sum(val * val) FROM x)), {DEC_FINE}) AS val FROM x""")
def q_normalize(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.normalize(_start(c, "B", "start")).select("id", rnd(F.col("val"), DEC_FINE).alias("val"))


@register("dot", base_ctes(SQL_SIDES, sql_start("x", "b_n", "j", "x"), sql_start("y", "b_n", "j", "y")) + f"""
SELECT ROUND(sum(x.val * y.val), {DEC}) AS dot FROM x JOIN y ON x.id = y.id""")
def q_dot(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.dot(_start(c, "B", "x"), _start(c, "B", "y")).select(rnd(F.col("dot")).alias("dot"))


@register("axpy", base_ctes(SQL_SIDES, sql_start("x", "b_n", "j", "x"), sql_start("y", "b_n", "j", "y")) + f"""
SELECT x.id, ROUND(x.val * 2.0 + y.val, {DEC_FINE}) AS val FROM x JOIN y ON x.id = y.id""")
def q_axpy(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    r = L.axpy(2.0, _start(c, "B", "x"), _start(c, "B", "y"))
    return r.select("id", rnd(F.col("val"), DEC_FINE).alias("val"))


def sql_apply(name: str, x: str, first: str = "B") -> str:
    """y = Aᵀ(B x) (first='B') or z = Bᵀ(A y) (first='A') over cte x(id, val)."""
    second = "A" if first == "B" else "B"
    return f"""
{name}_w AS (SELECT c."row", sum(c.val * x.val) AS w FROM cells c JOIN {x} x ON x.id = c.col
             WHERE c.mat = '{first}' GROUP BY c."row"),
{name} AS (SELECT c.col AS id, sum(c.val * w.w) AS val FROM cells c JOIN {name}_w w ON w."row" = c."row"
           WHERE c.mat = '{second}' GROUP BY c.col)"""


@register("apply_product", base_ctes(SQL_SIDES, sql_start("x", "b_n", "j", "start"), sql_apply("y", "x", "B")) +
          f"SELECT id, ROUND(val, {DEC}) AS val FROM y")
def q_apply_product(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    ops = L.Operands(c.cells, persist=False)
    return L.apply_product(ops, _start(c, "B", "start")).select("id", rnd(F.col("val")).alias("val"))


@register("apply_product_t", base_ctes(SQL_SIDES, sql_start("x", "a_n", "i", "starta"), sql_apply("z", "x", "A")) +
          f"SELECT id, ROUND(val, {DEC}) AS val FROM z")
def q_apply_product_t(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    ops = L.Operands(c.cells, persist=False)
    return L.apply_product_t(ops, _start(c, "A", "starta")).select("id", rnd(F.col("val")).alias("val"))


def sql_uv() -> list[str]:
    """rank-1 random orthonormal factors: U over A ids (seed+1), V over B ids."""
    gu = H.sql_gaussian(SEED + 1, "init", "a_n.i", "0")
    gv = H.sql_gaussian(SEED, "init", "b_n.j", "0")
    return [f"""
ug AS (SELECT a_n.i AS id, {gu} AS g FROM a_n),
uf AS (SELECT id, 0.0::DOUBLE + g * (1.0::DOUBLE / sqrt((SELECT sum(g * g) FROM ug))) AS f FROM ug),
vg AS (SELECT b_n.j AS id, {gv} AS g FROM b_n),
vf AS (SELECT id, 0.0::DOUBLE + g * (1.0::DOUBLE / sqrt((SELECT sum(g * g) FROM vg))) AS f FROM vg)"""]


def _uv(c: _Ctx):
    u = FZ.random_init(_ids(c.a_n, "i"), 1, SEED + 1)
    v = FZ.random_init(_ids(c.b_n, "j"), 1, SEED)
    return u, v


def sql_residual(name: str, x: str) -> str:
    """(U Vᵀ − M) x for rank-1 U = uf, V = vf."""
    return sql_apply(name + "_m", x, "B") + f""",
{name}_c AS (SELECT sum(vf.f * x.val) AS c FROM vf JOIN {x} x ON x.id = vf.id),
{name} AS (
  SELECT coalesce(a.id, m.id) AS id, coalesce(a.val, 0.0) + coalesce(-1.0 * m.val, 0.0) AS val
  FROM (SELECT uf.id, 0.0::DOUBLE + uf.f * (SELECT c FROM {name}_c) AS val FROM uf) a
  FULL OUTER JOIN {name}_m m ON a.id = m.id
)"""


def sql_residual_t(name: str, y: str) -> str:
    return sql_apply(name + "_m", y, "A") + f""",
{name}_c AS (SELECT sum(uf.f * y.val) AS c FROM uf JOIN {y} y ON y.id = uf.id),
{name} AS (
  SELECT coalesce(a.id, m.id) AS id, coalesce(a.val, 0.0) + coalesce(-1.0 * m.val, 0.0) AS val
  FROM (SELECT vf.id, 0.0::DOUBLE + vf.f * (SELECT c FROM {name}_c) AS val FROM vf) a
  FULL OUTER JOIN {name}_m m ON a.id = m.id
)"""


@register("apply_residual", base_ctes(SQL_SIDES, *sql_uv(), sql_start("x", "b_n", "j", "start"),
                                      sql_residual("rx", "x")) + f"SELECT id, ROUND(val, {DEC}) AS val FROM rx")
def q_apply_residual(spark, sf_dir):
    """(U Vᵀ − M) x with rank-1 random orthonormal U, V."""
    c = _Ctx(spark, sf_dir)
    u, v = _uv(c)
    ops = L.Operands(c.cells, persist=False)
    return L.apply_residual(ops, u, v, _start(c, "B", "start"), 1).select("id", rnd(F.col("val")).alias("val"))


# ---------------------------------------------------------------------------
# Power iteration, unrolled in SQL
# ---------------------------------------------------------------------------
DEC_NORM = 3


def sql_power(iters: int, residual: bool, purpose: str, pre: str = "p") -> tuple[list[str], str]:
    """Unrolled power iteration; CTE names start with ``pre`` so two runs can
    share one query.  Returns (ctes, select of (round, value))."""
    ctes = [sql_start(f"{pre}x0r", "b_n", "j", purpose),
            f"{pre}x0 AS (SELECT id, val / sqrt((SELECT sum(val * val) FROM {pre}x0r)) AS val FROM {pre}x0r)"]
    sel = []
    for k in range(1, iters + 1):
        x = f"{pre}x{k - 1}"
        if residual:
            ctes.append(sql_residual(f"{pre}q{k}y", x))
            ctes.append(sql_residual_t(f"{pre}q{k}", f"{pre}q{k}y"))
        else:
            ctes.append(sql_apply(f"{pre}q{k}y", x, "B"))
            ctes.append(sql_apply(f"{pre}q{k}", f"{pre}q{k}y", "A"))
        ctes.append(f"{pre}n{k} AS (SELECT sqrt(sum(val * val)) AS nz FROM {pre}q{k})")
        ctes.append(f"{pre}x{k} AS (SELECT id, val / (SELECT nz FROM {pre}n{k}) AS val FROM {pre}q{k})")
        sel.append(f"SELECT CAST({k} AS INTEGER) AS round, sqrt(nz) AS value FROM {pre}n{k}")
    return ctes, " UNION ALL ".join(sel)


_PW_CTES, _PW_SEL = sql_power(POWER_ITERS, False, "start", "pw")
_RS_CTES, _RS_SEL = sql_power(POWER_ITERS, True, "resid", "rs")


@register("spectral_norm", base_ctes(SQL_SIDES, *_PW_CTES) +
          f"SELECT round, ROUND(value, {DEC_NORM}) AS value FROM ({_PW_SEL}) t")
def q_spectral_norm(spark, sf_dir):
    """‖AᵀB‖₂ estimate per power round (5 rounds)."""
    c = _Ctx(spark, sf_dir)
    ops = L.Operands(c.cells)
    try:
        _, trace = L.spectral_norm(ops, POWER_ITERS, SEED)
    finally:
        ops.release()
    return spark.createDataFrame([(k, round(v, DEC_NORM)) for k, v in trace], "round int, value double")


@register("residual_norm", base_ctes(SQL_SIDES, *sql_uv(), *_RS_CTES) +
          f"SELECT round, ROUND(value, {DEC_NORM}) AS value FROM ({_RS_SEL}) t")
def q_residual_norm(spark, sf_dir):
    """‖U Vᵀ − AᵀB‖₂ estimate per round, rank-1 random U, V."""
    c = _Ctx(spark, sf_dir)
    u, v = _uv(c)
    ops = L.Operands(c.cells)
    try:
        _, trace = L.residual_norm(ops, u, v, 1, POWER_ITERS, SEED)
    finally:
        ops.release()
    return spark.createDataFrame([(k, round(v, DEC_NORM)) for k, v in trace], "round int, value double")


@register("relative_error", base_ctes(SQL_SIDES, *sql_uv(), *_PW_CTES, *_RS_CTES) + f"""
SELECT ROUND(sqrt(a.nz), {DEC_NORM}) AS norm, ROUND(sqrt(b.nz), {DEC_NORM}) AS residual,
       ROUND(sqrt(b.nz) / sqrt(a.nz), {DEC_FINE}) AS rel_error
FROM pwn{POWER_ITERS} a, rsn{POWER_ITERS} b""")
def q_relative_error(spark, sf_dir):
    """I8: ‖U Vᵀ − AᵀB‖₂ / ‖AᵀB‖₂, same number of power rounds for both."""
    c = _Ctx(spark, sf_dir, stored=True)
    u, v = _uv(c)
    ops = L.Operands(c.cells)
    try:
        e = L.relative_error(ops, u, v, 1, POWER_ITERS, SEED)
    finally:
        ops.release()
    return spark.createDataFrame([(round(e["norm"], DEC_NORM), round(e["residual"], DEC_NORM),
                                   round(e["rel_error"], DEC_FINE))], "norm double, residual double, rel_error double")


# ---------------------------------------------------------------------------
# Streams over the events table (row = hour, A col = user,
# B col = event type); the oracle is the batch answer on the same table
# ---------------------------------------------------------------------------
DEC_STREAM = 4

SQL_EVENTS = f"""
ev AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS "row", CAST(value AS DOUBLE) AS val, user_id, event_type
       FROM events WHERE value IS NOT NULL),
contrib AS (
  SELECT 'A' AS mat, "row", CAST(user_id AS BIGINT) AS col, val FROM ev
  UNION ALL
  SELECT 'B' AS mat, "row", {H.sql_hash52(0, 'etype', 'event_type')} AS col, val FROM ev
),
ecells AS (SELECT mat, "row", col, sum(val) AS val FROM contrib GROUP BY mat, "row", col)"""


# the padded row space follows the data: hours up to the last event's
SQL_STREAM_N = """
npad AS (SELECT CAST(pow(2, ceil(log2(max("row") + 1))) AS BIGINT) AS n FROM ev)"""


def _fresh(name: str) -> str:
    """A query starts its stream anew; a job that resumes gives a stable name."""
    import uuid
    return f"{name}-{uuid.uuid4().hex[:8]}"


def _event_contrib(spark, sf_dir):
    from rankfold.streaming.sketch_stream import read_table_stream
    ev = read_table_stream(spark, sf_dir, "events").where(F.col("value").isNotNull())
    return X.events_cells_rows(ev)


@register("stream_sketch", with_(SQL_EVENTS, SQL_STREAM_N, sql_coords()) + f"""
SELECT c.mat, c.col, k.t,
       ROUND(sum({H.sql_sign(SEED, 'sign', 'c."row"')} * (1 - 2 * (bit_count(k.h & c."row") % 2)) * c.val)
             * {1.0 / math.sqrt(SKETCH_K)!r}, {DEC_STREAM}) AS s
FROM contrib c CROSS JOIN coords k GROUP BY c.mat, c.col, k.t""")
def q_stream_sketch(spark, sf_dir):
    """Structured Streaming SRHT sketch of the event stream (final state)."""
    from rankfold.streaming.sketch_stream import SKETCH, run_updates, sketch_of, stream_sketch
    hours = X.events_cells_rows(X.table(spark, sf_dir, "events")).agg(F.max("row")).first()[0]
    n = K.padded_length(int(hours or 0) + 1)
    coords = K.pick_coords(SEED, n, SKETCH_K)
    path = run_updates(stream_sketch(_event_contrib(spark, sf_dir), coords, SEED, n), _fresh("stream_sketch"), keys=SKETCH)
    return sketch_of(spark, path, SKETCH_K).select("mat", "col", F.col("t").cast("int").alias("t"),
                                                   rnd(F.col("s"), DEC_STREAM).alias("s"))


@register("stream_norms", with_(SQL_EVENTS) + f"""
SELECT mat, col, ROUND(sum(val * val), {DEC_STREAM}) AS norm2 FROM ecells GROUP BY mat, col""")
def q_stream_norms(spark, sf_dir):
    """Exact squared column norms from a stream in which one cell
    (user, hour) arrives in several events."""
    from rankfold.streaming.sketch_stream import norms_of, run_updates, stream_cells
    path = run_updates(stream_cells(_event_contrib(spark, sf_dir)), _fresh("stream_norms"))
    return norms_of(spark, path).select("mat", "col", rnd(F.col("norm2"), DEC_STREAM).alias("norm2"))


# ---------------------------------------------------------------------------
# Whole jobs (rows-only checks; see tests/)
# ---------------------------------------------------------------------------
@register("factorize_als")
def q_factorize_als(spark, sf_dir):
    """H1: MLlib ALS (rank 2, small regParam) on the exactly valued samples."""
    c = _Ctx(spark, sf_dir, stored=True)
    u, v = FZ.factorize_als(c.observed(), RANK, ALS_ITERS, 1e-6, SEED)
    return _long_factor(u, "u").unionByName(_long_factor(v, "v"))


def _emb_ops(spark, sf_dir):
    return L.Operands(X.embeddings_cells(spark, sf_dir))


@register("svd_exact")
def q_svd_exact(spark, sf_dir):
    """H8: top-3 singular values of the label<5 x label>=5 cross-product of
    the embeddings (64 shared coordinates)."""
    ops = _emb_ops(spark, sf_dir)
    try:
        sig, _, _ = L.svd_exact(ops, 3, 80, SEED, tol=1e-4)
    finally:
        ops.release()
    return spark.createDataFrame([(k + 1, s) for k, s in enumerate(sig)], "k int, sigma double")


@register("optimal_error")
def q_optimal_error(spark, sf_dir):
    """σ_{r+1}/σ₁ for r = 2 on the embeddings cross-product."""
    ops = _emb_ops(spark, sf_dir)
    try:
        e = L.optimal_error(ops, RANK, 80, SEED, tol=1e-4)
    finally:
        ops.release()
    return spark.createDataFrame([(RANK, e["opt_error"])], "rank int, opt_error double")


@register("two_pass_lineitem")
def q_two_pass_lineitem(spark, sf_dir):
    """P1 on lineitem (order x part vs order x supplier quantities)."""
    from rankfold.plans.jobs import two_pass_factorize
    cells, by_row = X.stored_lineitem_cells(spark, sf_dir)
    r = two_pass_factorize(spark, cells, rank=RANK, iters=ALS_ITERS, ss=SS,
                           seed=SEED, power_iters=POWER_ITERS, stored=True, by_row=by_row)
    return r["report"]


# Rank 1, where a whole job has an SQL twin: budget, samples, values, ALS rounds and power rounds unrolled.
DEC_JOB = 6
SQL_JOB_FACTORS = f"""
uf AS (SELECT id, f FROM u{ALS_ITERS}),
vf AS (SELECT id, f FROM v{ALS_ITERS})"""
SQL_JOB_REPORT = f"""
SELECT metric, round, ROUND(value, CASE WHEN metric = 'rel_error' THEN {DEC_JOB} ELSE {DEC_NORM} END) AS value FROM (
SELECT 'n1' AS metric, 0 AS round, n1 AS value FROM tot
UNION ALL SELECT 'n2', 0, n2 FROM tot
UNION ALL SELECT 'budget', 0, m FROM bud2
UNION ALL SELECT 'samples', 0, CAST(count(*) AS DOUBLE) FROM observed
UNION ALL SELECT 'norm', round, value FROM ({_PW_SEL}) pw
UNION ALL SELECT 'residual', round, value FROM ({_RS_SEL}) rs
UNION ALL SELECT 'rel_error', 0, sqrt(b.nz) / sqrt(a.nz) FROM pwn{POWER_ITERS} a, rsn{POWER_ITERS} b"""


def sql_job(*values: str) -> str:
    """The factors and errors of a rank-1 job whose values are the cte observed of ``values``."""
    return with_(SQL_CELLS, SQL_NORMS, sql_sides(1), SQL_ALLOC, sql_samples(), *values, *sql_wals(ALS_ITERS),
                 SQL_JOB_FACTORS, *_PW_CTES, *_RS_CTES)


def _rounded_report(report):
    decimals = F.when(F.col("metric") == "rel_error", F.round("value", DEC_JOB)).otherwise(F.round("value", DEC_NORM))
    return report.select("metric", "round", decimals.alias("value"))


@register("two_pass_rank1", sql_job(SQL_OBSERVED) + SQL_JOB_REPORT + ") r")
def q_two_pass_rank1(spark, sf_dir):
    """P1 at rank 1, whole job: its report against the same job in SQL."""
    from rankfold.plans.jobs import two_pass_factorize
    cells, by_row = X.stored_lineitem_cells(spark, sf_dir)
    r = two_pass_factorize(spark, cells, rank=1, iters=ALS_ITERS, ss=SS, seed=SEED,
                           power_iters=POWER_ITERS, stored=True, by_row=by_row)
    return _rounded_report(r["report"])


SQL_ONE_PASS_OBSERVED = """
observed AS (SELECT s.i, s.j, s.p, resc.val, 1.0::DOUBLE AS w FROM samples s JOIN resc ON resc.i = s.i AND resc.j = s.j)"""


@register("one_pass_rank1", sql_job(SQL_NPAD, sql_coords(), sql_srht(), SQL_SKETCH_VALUES, SQL_ONE_PASS_OBSERVED) + SQL_JOB_REPORT + f"""
UNION ALL SELECT 'k', 0, {SKETCH_K}
UNION ALL SELECT 'value_rms', 0, sqrt(avg(val * val)) FROM observed
UNION ALL SELECT 'estimator_spread', 0, sqrt(avg(a_n.a * b_n.b) / {SKETCH_K}) FROM observed o JOIN a_n ON a_n.i = o.i JOIN b_n ON b_n.j = o.j) r""")
def q_one_pass_rank1(spark, sf_dir):
    """P2 at rank 1, cells form, whole job: its report against the same job in SQL."""
    from rankfold.plans.jobs import one_pass_factorize
    n_rows = int(X.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]) + 1
    cells, _ = X.stored_lineitem_cells(spark, sf_dir)
    r = one_pass_factorize(spark, cells, rank=1, k=SKETCH_K, iters=ALS_ITERS, ss=SS, seed=SEED,
                           power_iters=POWER_ITERS, n_rows=n_rows, stored=True)
    return _rounded_report(r["report"])


@register("one_pass_lineitem")
def q_one_pass_lineitem(spark, sf_dir):
    """P2 on lineitem, cells form: one scan builds the SRHT sketch and norms."""
    from rankfold.plans.jobs import one_pass_factorize
    li = X.table(spark, sf_dir, "lineitem")
    n_rows = int(li.agg(F.max("l_orderkey")).first()[0]) + 1
    cells, _ = X.stored_lineitem_cells(spark, sf_dir)
    r = one_pass_factorize(spark, cells, rank=RANK, k=64, iters=ALS_ITERS, ss=SS,
                           seed=SEED, power_iters=POWER_ITERS, n_rows=n_rows, stored=True)
    return r["report"]


@register("one_pass_embeddings")
def q_one_pass_embeddings(spark, sf_dir):
    """P2 on column-grouped vectors: fast Hadamard transform per record."""
    from rankfold.plans.jobs import one_pass_factorize_vecs
    v = X.embeddings_vecs(spark, sf_dir)
    r = one_pass_factorize_vecs(spark, v, X.vector_width(v), rank=RANK, k=32, iters=ALS_ITERS, ss=SS, seed=SEED)
    return _long_factor(r["u"], "u").unionByName(_long_factor(r["v"], "v"))


@register("compare_methods")
def q_compare_methods(spark, sf_dir):
    """P3 on the embeddings cross-product: optimal, one-pass, two-pass."""
    from rankfold.plans.jobs import compare_methods
    return compare_methods(spark, X.embeddings_cells(spark, sf_dir), rank=RANK, k=32, iters=ALS_ITERS,
                           ss=SS, seed=SEED, power_iters=POWER_ITERS, svd_iters=80)
